"""Party regions: a party's labelled block with the blocks that go on with it.

``blocks`` have doc_id, block (their order), text, method and locations, an array
of ``LOCATION``.  A region begins at every party label, and a later block belongs
to it if it and all blocks between do: so the region's first block and the cells
so far are running window values, and membership is a running minimum.  One sort
by document and block is all that the regions need; no group is held in memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.values import canonical_text, strip
from .segment import column_number

LOCATION = "struct<kind: string, page: int, x0: double, top: double, x1: double, bottom: double, sheet: string, cell: string>"
BLOCK = f"doc_id long, block int, text string, method string, locations array<{LOCATION}>"

# Street words, how far a line may be from the one before, in line heights, and from the left edge, in points.
_MALAY_STREETS = ("jalan", "lorong", "persiaran", "lebuh")
_STREETS = ("street", "road", "avenue", "lane", "drive", "boulevard", "st", "rd")
_HAN_STREETS, _HAN_NUMBER = "路街道巷", "号號"
_GAP, _SPACED_GAP, _EDGE = 2, 3, 2


def _begins(labels: list[str]) -> str:
    """One of the labels at the start, ended by a blank, a mark or the end."""
    return rf"(?iU)^\s*(?:{L.alternatives(labels)})(?=\s|[:=|]|\z)"


_PARTY = _begins([x for k in L.PARTIES for x in L.LABELS[k]])
_FIELD = _begins([x for own in L.LABELS.values() for x in own] + list(L.BOUNDARY_LABELS))
_OTHER_LABEL = r"^\s*[^\n:=]{1,80}[:=]"


def street_address(text: Column) -> Column:
    """Whether a stripped text is a street address, on one line from the street word on: a house number and a street's name, or a Chinese street with its number."""
    words = F.split(text, r"(?U)\s+")
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    starts = lambda x, names: x.rlike(rf"(?iU)^(?:{'|'.join(names)})\b")
    in_last_line = F.size(F.split(strip(F.substring_index(text, "\n", -1)), r"(?U)\s+"))
    to_end = lambda k: F.size(words) - k <= in_last_line
    malay = to_end(1) & starts(word(1), _MALAY_STREETS) & ((F.size(words) > 2) | ~word(1).rlike(rf"(?i)^(?:{'|'.join(_MALAY_STREETS)})\z"))
    named = [reduce(lambda a, k: a & word(k).rlike(r"(?U)^[\w.'-]+\z"), range(1, k), to_end(k)) & starts(word(k), _STREETS) for k in range(2, 7)]
    western = word(0).rlike(r"(?U)^\d+[A-Za-z/-]*\z") & (malay | reduce(lambda a, b: a | b, named))
    chinese = text.rlike(rf"(?U)^[\x{{3400}}-\x{{9fff}}]{{2,}}[{_HAN_STREETS}]\s*\d+\s*[{_HAN_NUMBER}][^\n]*\z")
    return western | chinese


def _features(blocks: DataFrame) -> DataFrame:
    """What the geometry of a block says, as plain columns."""
    text = F.coalesce("canonical", F.lit(""))
    held = F.coalesce("locations", F.array().cast(f"array<{LOCATION}>"))
    first, last = F.get(held, F.lit(0)), F.get(held, F.size(held) - 1)
    cells = F.transform(held, lambda x: F.struct(F.regexp_extract(x["cell"], "^([A-Z]+)([1-9][0-9]*)$", 1).alias("c"), F.regexp_extract(x["cell"], "^([A-Z]+)([1-9][0-9]*)$", 2).alias("r"), x["sheet"].alias("s")))
    whole = (F.size(held) > 0) & F.forall(cells, lambda x: F.coalesce((x["c"] != "") & x["s"].isNotNull() & (x["s"] == F.get(cells, F.lit(0))["s"]), F.lit(False)))
    row = lambda x: x["r"].try_cast("long")
    column = lambda x: column_number(x["c"])
    boxed = lambda x: x["x0"].isNotNull() & x["top"].isNotNull() & x["x1"].isNotNull() & x["bottom"].isNotNull()
    return canonical_text(blocks.select("doc_id", "block", "text", "method", "locations")).select(
        "doc_id", "block", "method",
        text.rlike(_PARTY).alias("opens"),
        (text.rlike(_FIELD) | text.rlike(_OTHER_LABEL)).alias("labelled"),
        street_address(strip(text)).alias("street"),
        first.alias("first"), last.alias("last"), boxed(first).alias("first_boxed"), boxed(last).alias("last_boxed"),
        F.when(whole, F.get(cells, F.lit(0))["s"]).alias("sheet"),
        F.when(whole, F.array_min(F.transform(cells, row))).alias("row_low"), F.when(whole, F.array_max(F.transform(cells, row))).alias("row_high"),
        F.when(whole, F.array_min(F.transform(cells, column))).alias("col_low"), F.when(whole, F.array_max(F.transform(cells, column))).alias("col_high"),
    )


def party_regions(blocks: DataFrame) -> DataFrame:
    """doc_id, block, region (the first block of its region), n (blocks in it); a block that goes on with none is its own region."""
    order = Window.partitionBy("doc_id").orderBy("block")
    rows = _features(blocks).withColumn("anchor", F.max(F.when(F.col("opens"), F.col("block"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "anchor").orderBy("block")
    so_far, whole = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*",
        F.lag("last").over(inside).alias("before"), F.lag("last_boxed").over(inside).alias("before_boxed"), F.lag("method").over(inside).alias("method_before"),
        F.first("first").over(whole).alias("anchored"), F.first("first_boxed").over(whole).alias("anchor_boxed"), F.first("sheet").over(whole).alias("anchor_sheet"),
        F.max("row_high").over(so_far).alias("rows_end"), F.min("col_low").over(so_far).alias("cols_from"), F.max("col_high").over(so_far).alias("cols_to"),
    )
    top, bottom = F.col("before.top"), F.col("before.bottom")
    height = F.greatest(bottom - top, F.col("first.bottom") - F.col("first.top"))
    gap, shift = F.col("first.top") - bottom, F.abs(F.col("first.x0") - F.col("anchored.x0"))
    near = (gap <= _GAP * height) | ((gap <= _SPACED_GAP * height) & (shift <= F.greatest(F.lit(2.0), height / 2)) & F.col("street"))
    aligned = F.col("first.x0").between(F.col("anchored.x0") - _EDGE, F.col("anchored.x1") + _EDGE)
    placed = F.col("first.kind").isin("pdf", "image") & F.col("before.page").eqNullSafe(F.col("first.page")) & F.col("before_boxed") & F.col("first_boxed") & F.col("anchor_boxed") & (height > 0) & (gap >= 0) & near & aligned
    cells = (F.col("first.kind") == "xlsx") & (F.col("sheet") == F.col("anchor_sheet")) & (F.col("row_low") == F.col("rows_end") + 1) & F.col("col_low").between(F.col("cols_from"), F.col("cols_to"))
    goes_on = ~F.col("labelled") & F.col("before").isNotNull() & F.col("first").isNotNull() & (F.col("before.kind") == F.col("first.kind")) & F.col("method_before").eqNullSafe(F.col("method")) & F.when(F.col("first.kind") == "xlsx", cells).otherwise(placed)
    member = F.when(F.col("block") == F.col("anchor"), F.lit(True)).otherwise(F.coalesce(goes_on, F.lit(False)) & F.col("anchor").isNotNull())
    rows = rows.select("doc_id", "block", "anchor", member.alias("member")).withColumn("held", F.min("member").over(whole))
    region = F.when(F.col("held"), F.col("anchor")).otherwise(F.col("block"))
    rows = rows.select("doc_id", "block", region.alias("region"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "region")))


def omitted_continuations(regions: DataFrame, selections: DataFrame) -> DataFrame:
    """doc_id, field, omitted of ``selections`` (doc_id, field, blocks): whether a region is touched but not covered."""
    chosen = selections.select("doc_id", "field", F.explode(F.array_distinct("blocks")).alias("block"))
    touched = chosen.join(regions, ["doc_id", "block"]).groupBy("doc_id", "field", "region").agg((F.count("*") < F.max("n")).alias("omitted"))
    found = touched.groupBy("doc_id", "field").agg(F.bool_or("omitted").alias("omitted"))
    return selections.select("doc_id", "field").join(found, ["doc_id", "field"], "left").withColumn("omitted", F.coalesce("omitted", F.lit(False)))


def complete_selections(regions: DataFrame, choices: DataFrame) -> DataFrame:
    """doc_id, field, blocks of ``choices`` (doc_id, field, block): a party's block brings its whole region, a null block nothing."""
    whole = regions.groupBy("doc_id", "region").agg(F.array_sort(F.collect_list("block")).alias("members"))
    member = regions.join(whole, ["doc_id", "region"]).select("doc_id", "block", "members")
    own = choices.select("doc_id", "field", "block").join(member, ["doc_id", "block"], "left")
    alone = F.array("block")
    blocks = F.when(F.col("block").isNull(), F.array().cast("array<int>")).when(F.col("field").isin(*L.PARTIES), F.coalesce("members", alone)).otherwise(alone)
    return own.select("doc_id", "field", blocks.alias("blocks"))


def destination_reviews(blocks: DataFrame, selections: DataFrame) -> DataFrame:
    """doc_id of ``selections`` whose port of discharge rests on a "Destination port" while another block has a discharge label of its own."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\r\n]"), strip)
    destination = lambda x: F.lower(x).startswith("destination port")
    explicit = F.exists(lines, lambda x: x.rlike(L.leading("port_of_discharge")) & ~destination(x))
    facts = blocks.select("doc_id", "block", destination(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+", "")).alias("destination"), explicit.alias("explicit")).where("destination or explicit")
    chosen = selections.where("field = 'port_of_discharge'").select("doc_id", F.explode("blocks").alias("block")).distinct().withColumn("chosen", F.lit(True))
    side = facts.join(chosen, ["doc_id", "block"], "left").groupBy("doc_id")
    out = side.agg(F.bool_or(F.col("chosen").isNotNull() & F.col("destination")).alias("rests"), F.bool_or(F.col("chosen").isNull() & F.col("explicit")).alias("other"))
    return out.where("rests and other").select("doc_id")


def selection_issues(blocks: DataFrame, selections: DataFrame) -> DataFrame:
    """doc_id, field, issue of ``selections``: a destination in place of a discharge port, or part of a party's region."""
    omitted = omitted_continuations(party_regions(blocks), selections)
    review = destination_reviews(blocks, selections).withColumn("review", F.lit(True))
    out = omitted.join(review, "doc_id", "left")
    issue = F.when((F.col("field") == "port_of_discharge") & F.col("review"), "destination_port_requires_review").when(F.col("field").isin(*L.PARTIES) & F.col("omitted"), "incomplete_party_evidence")
    return out.select("doc_id", "field", issue.alias("issue"))
