"""From placed words and paragraphs to lines and blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .segment import _OTHER, _STARTS, least_confidence, runs_of, starts_field

LINE_STEP, BLOCK_GAP = 3.0, 12.0  # fixed values, in points

_PARTY = rf"(?iU)^\s*(?:{L.alternatives(x for k in L.PARTIES for x in L.LABELS[k])})(?=\s|[:=|]|\z)"
_ALONE = rf"(?iU)^\s*(?:{L.alternatives(x for own in L.LABELS.values() for x in own)})\s*:?[ \t]*\z"
_CONTAINER_ID = r"(?iU)^\s*container\s+(?:number|no\.?|id)\s*[:=|]?\s*\z"

_WORD = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double, font string"


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A new line begins where ``top`` leaves that of the line's first word by more than 3; rows come page by page, in order of ``top``."""
    page, line, anchor = None, 0, 0.0
    for rows in batches:
        numbers = []
        for doc, number, top in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "page", "top")), strict=True):
            top = math.nan if top is None else top
            if page != (doc, number):
                page, line, anchor = (doc, number), 1, top
            elif abs(top - anchor) > LINE_STEP:
                line, anchor = line + 1, top
            numbers.append(line)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(numbers, pa.int32())], names=[*rows.schema.names, "line"])


_HELD = ("x0", "top", "x1", "font", "text", "bottom")


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a line with its words, which are neighbours; those of the line that may go on are kept for the next batch."""
    kept: list[pa.RecordBatch] = []
    last: list[tuple] = []

    def lines(keys: list[tuple], starts: list[int]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept).combine_chunks()
        words = pa.StructArray.from_arrays([rows.column(k).combine_chunks() for k in _HELD], names=list(_HELD))
        ids = [pa.array([x[k] for x in keys], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(pa.array([*starts, rows.num_rows], pa.int32()), words)], names=["doc_id", "page", "line", "held"])

    for rows in _number_lines(batches):
        keys = list(zip(*(rows.column(k).to_pylist() for k in ("doc_id", "page", "line")), strict=True))
        starts = [k for k, (before, own) in enumerate(zip([*last, *keys] if last else [None, *keys], keys, strict=False)) if before != own]
        if starts:
            held = sum(x.num_rows for x in kept)
            kept.append(rows.slice(0, starts[-1]))
            if whole := [*last, *(keys[k] for k in starts[:-1])]:
                yield lines(whole, [*([0] if last else []), *(held + k for k in starts[:-1])])
            kept, last = [rows.slice(starts[-1])], [keys[-1]]
        elif keys:
            kept.append(rows)
    if last:
        yield lines(last, [0])


def pdf_lines(words: DataFrame, *, together: bool = False) -> DataFrame:
    """doc_id, page, line (from 1), text, x0, top, x1, bottom of words (doc_id, page, text, x0, x1, top, bottom, font).

    The fold over a page needs its order and nothing else, so it runs over
    sorted rows with one line's words in memory, whatever the size of a page,
    and gives lines.  Words that touch and
    differ in font only are joined without a blank.  ``together`` says that
    those of a doc_id are in one partition already, so they are only sorted.
    """
    typed = words.select(*(F.col(k).cast(t) for k, t in (x.split() for x in _WORD.split(", ")))).withColumn("text", F.coalesce("text", F.lit("")))
    dealt = typed if together else typed.repartition("doc_id", "page")
    ordered = dealt.sortWithinPartitions("doc_id", "page", F.asc_nulls_last("top"))
    kinds = dict(x.split() for x in _WORD.split(", "))
    lines = ordered.mapInArrow(_whole_lines, f"doc_id long, page int, line int, held array<struct<{', '.join(f'{k}: {kinds[k]}' for k in _HELD)}>>")
    rows = lines.select("doc_id", "page", "line", F.sort_array("held").alias("held"), *(F.array_min(f"held.{k}").alias(k) for k in ("x0", "top")), *(F.array_max(f"held.{k}").alias(k) for k in ("x1", "bottom")))
    before = lambda k: F.get("held", k - 1)

    def touching(x: Column, k: Column) -> Column:
        gap = x["x0"] - before(k)["x1"]
        return ~x["font"].eqNullSafe(before(k)["font"]) & gap.between(-0.25, 0.5) & before(k)["text"].rlike(r"[\p{L}\p{N}]\z") & x["text"].rlike(r"^[\p{L}\p{N}]")

    parts = F.transform("held", lambda x, k: F.concat(F.when((k == 0) | touching(x, k), "").otherwise(" "), x["text"]))
    text = F.regexp_replace(F.array_join(parts, ""), r"(?U)^\s+|\s+$", "")
    return rows.select("doc_id", "page", "line", text.alias("text"), "x0", "top", "x1", "bottom").where("text <> ''")


def pdf_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, page, block (from 1), text and box: a block ends before a labelled line or a gap of more than 12."""
    own = Window.partitionBy("doc_id", "page").orderBy("line")
    gap = F.coalesce(F.col("top") - F.lag("bottom").over(own) > BLOCK_GAP, F.lit(True))
    begins = lines.withColumn("begins", starts_field(F.col("text")) | gap)
    numbered = begins.withColumn("block", F.sum(F.col("begins").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.sort_array(F.collect_list(F.struct("line", "text")))
    out = numbered.groupBy("doc_id", "page", "block").agg(held.alias("held"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return out.select("doc_id", "page", "block", F.array_join(F.transform("held", lambda x: x["text"]), "\n").alias("text"), "x0", "top", "x1", "bottom")


def ocr_blocks(lines: DataFrame, *, scale: float = 1.0) -> DataFrame:
    """doc_id, paragraph, block (from 1), text, boxes, confidence and x0, top, x1, bottom (around all boxes).

    ``lines``: doc_id, paragraph, at (the reader's order), text, x0, top, x1,
    bottom, confidence in percent.  Boxes are divided by ``scale``; lines stand
    in order of (at, top, x0), and one that begins with a label opens a block of
    its paragraph.  The confidence is the least of the lines', null if one is.
    """
    box = F.struct(*((F.col(k) / scale).alias(k) for k in ("x0", "top", "x1", "bottom")))
    text = F.coalesce("text", F.lit(""))
    line = F.struct("at", (F.col("top") / scale).alias("top"), (F.col("x0") / scale).alias("x0"), text.alias("text"), box.alias("box"), "confidence", starts_field(text).alias("opens"))
    # one sort of a paragraph's lines, in its row, and none of all lines of a task
    paragraphs = lines.groupBy("doc_id", "paragraph").agg(F.sort_array(F.collect_list(line)).alias("held"))
    blocks = paragraphs.select("doc_id", "paragraph", F.posexplode(runs_of(F.col("held"), lambda _, x: ~x["opens"])).alias("at", "held"))
    values = lambda k: F.transform("held", lambda x: x["box"][k])
    around = [F.array_min(values(k)).alias(k) for k in ("x0", "top")] + [F.array_max(values(k)).alias(k) for k in ("x1", "bottom")]
    confidence = least_confidence(F.transform("held", lambda x: x["confidence"]))
    return blocks.select("doc_id", "paragraph", (F.col("at") + 1).cast("long").alias("block"), F.array_join(F.transform("held", lambda x: x["text"]), "\n").alias("text"), F.transform("held", lambda x: x["box"]).alias("boxes"), confidence.alias("confidence"), *around)


def table_text(cells: DataFrame) -> DataFrame:
    """doc_id, item, text of a table row's paragraphs (doc_id, item, cell, paragraph, text); blank ones and cells without others are left out."""
    some = cells.where(F.col("text").rlike(r"(?U)\S"))
    own = F.array_sort(F.collect_list(F.struct("paragraph", "text")))
    cell = some.groupBy("doc_id", "item", "cell").agg(own.alias("held")).withColumn("text", F.array_join(F.transform("held", lambda x: x["text"]), "\n"))
    row = cell.groupBy("doc_id", "item").agg(F.array_sort(F.collect_list(F.struct("cell", "text"))).alias("held"))
    return row.select("doc_id", "item", F.array_join(F.transform("held", lambda x: x["text"]), " | ").alias("text"))


def word_blocks(items: DataFrame) -> DataFrame:
    """doc_id, first_item, last_item, text of items (doc_id, item, kind, text); ``kind`` is boundary, table or paragraph.

    A party's label (or a container number's alone) takes in the paragraphs
    after it, up to a new label, a table or a boundary; every other paragraph
    and every table row is a block of its own.  Blank items make none.
    """
    text = F.coalesce("text", F.lit(""))
    cut = F.col("kind") != "paragraph"
    rows = items.withColumn("text", text).where(F.col("text").rlike(r"(?U)\S") | (F.col("kind") == "boundary"))
    starts = F.col("text").rlike(_STARTS) | F.col("text").rlike(_OTHER) | F.col("text").rlike(_ALONE)
    rows = rows.withColumn("opens", ~cut & (F.col("text").rlike(_PARTY) | F.col("text").rlike(_CONTAINER_ID)))
    rows = rows.withColumn("cut", cut).withColumn("starts", cut | starts)
    order = Window.partitionBy("doc_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    # a table or boundary closes its own segment too
    rows = rows.withColumn("segment", F.sum(F.col("starts").cast("int") + F.col("cut").cast("int")).over(order) - F.col("cut").cast("int"))
    within = Window.partitionBy("doc_id", "segment").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.max("opens").over(within)).where("kind <> 'boundary'")
    key = F.when(F.col("open"), F.struct(F.col("segment").alias("s"), F.lit(None).cast("long").alias("i"))).otherwise(F.struct(F.col("segment").alias("s"), F.col("item").cast("long").alias("i")))
    held = F.array_sort(F.collect_list(F.struct("item", "text")))
    out = rows.groupBy("doc_id", key.alias("key")).agg(F.min("item").alias("first_item"), F.max("item").alias("last_item"), held.alias("held"))
    return out.select("doc_id", "first_item", "last_item", F.array_join(F.transform("held", lambda x: x["text"]), "\n").alias("text"))
