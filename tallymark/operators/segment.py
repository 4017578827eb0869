"""From text, cells and OCR words to located blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.values import told

#: Line ends as Python's str.splitlines knows them.
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_EVERY = [x for own in L.LABELS.values() for x in own] + list(L.BOUNDARY_LABELS)
_STARTS = rf"(?iU)^\s*(?:{L.alternatives(_EVERY)})(?:\s*\([^()\r\n]*\))*\s*[:=|\t]"
_VALUED = rf"(?iU)^\s*(?:{L.alternatives(_EVERY)})(?:\s*\([^()\r\n]*\))*\.?(?:\s*[:=|]\s*|\s+)\S"
_BOUNDARY = rf"(?iU)^\s*(?:{L.alternatives(L.BOUNDARY_LABELS)})(?=\s|[:=|]|\z)"
MARGIN_LABEL = 81  # fixed value: characters before the colon of a label that is not known
_OTHER = r"(?U)^[A-Z][\w /.&'()-]{1,60}:\s*\S"
_MALAY = ("dan", "yang", "untuk", "kepada", "dengan", "pelabuhan", "berat", "tarikh", "nombor", "pengirim", "penerima", "kontena")


def starts_field(line: Column) -> Column:
    """Whether a line begins with a known label, with or without a sign before its value, or one that bounds the fields."""
    return line.rlike(_VALUED) | line.rlike(_BOUNDARY)


def starts_text(line: Column) -> Column:
    """Also whether it begins, at the margin, with any label, a colon and a value; indented lines go on.  Known labels are looked for last."""
    return (F.instr(line, ":").between(2, MARGIN_LABEL + 1) & line.rlike(r"(?U)^\S") & told(line)) | starts_field(line)


def split_lines(text: Column) -> Column:
    """Lines at all of these ends; of texts with others than LF the ends are made LF first, as splitting at a pattern compiles it for each row."""
    odd = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), _BREAKS, "\n" * len(_BREAKS))
    return F.split(F.when(text.rlike(f"[{_BREAKS[1:]}]"), odd).otherwise(text), "\n", -1)


def text_blocks(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, block (from 1), line_start, line_end, text: a block ends before a blank line or a labelled line."""
    lines = texts.select(F.col(id_col), F.posexplode(split_lines(F.regexp_replace(F.coalesce(text_col, F.lit("")), "^\\uFEFF", ""))).alias("at", "line"))
    blank = ~F.col("line").rlike(r"(?U)\S")
    labelled = starts_text(F.col("line"))
    own = Window.partitionBy(id_col).orderBy("at")
    lines = lines.withColumn("blank", blank)
    begins = ~F.col("blank") & (labelled | F.coalesce(F.lag("blank").over(own), F.lit(True)))
    lines = lines.withColumn("begins", begins).withColumn("block", F.sum(F.col("begins").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.sort_array(F.collect_list(F.struct("at", "line")))
    out = lines.where(~F.col("blank")).groupBy(id_col, "block").agg((F.min("at") + 1).alias("line_start"), (F.max("at") + 1).alias("line_end"), held.alias("held"))
    return out.select(id_col, F.col("block").cast("long").alias("block"), "line_start", "line_end", F.array_join(F.transform("held", lambda x: x["line"]), "\n").alias("text"))


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)


def sheet_rows(cells: DataFrame) -> DataFrame:
    """sheet, row_no, text, uncertain: two values read ``a: b``, others are joined by tabs; an uncertain cell withholds its row."""
    held = F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct(column_number(F.col("col")).alias("c"), F.col("value").alias("v")))))
    rows = cells.groupBy("sheet", "row_no").agg(held.alias("held"), F.bool_or("uncertain").alias("uncertain"))
    values = F.transform("held", lambda x: x["v"])
    text = F.when(F.size("held") == 2, F.array_join(values, ": ")).otherwise(F.array_join(values, "\t"))
    return rows.select("sheet", "row_no", F.when(~F.col("uncertain"), text).alias("text"), "uncertain")


def within_budget(sizes: DataFrame, *, most_cells: int = 200_000) -> DataFrame:
    """Sheets (workbook, sheet_no, n_rows, n_columns) with the rows that the running cell budget still allows."""
    run = Window.partitionBy("workbook").orderBy("sheet_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n_rows") * F.col("n_columns")).over(run), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(most_cells) - before)
    return sizes.withColumn("rows_read", F.least("n_rows", F.floor(left / F.greatest("n_columns", F.lit(1)))))


def least_confidence(conf: Column) -> Column:
    """The least of an array, null as soon as one is unknown or out of 0..100."""
    bad = F.exists(conf, lambda x: x.isNull() | F.isnan(x.cast("double")) | ~x.between(0, 100))
    return F.when(~bad, F.array_min(conf) / 100)


def runs_of(held: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Array of the runs of neighbours in array ``held``; ``same`` tells whether an element goes on the run of the one before it."""
    starts = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | ~same(F.get(held, i - 1), F.get(held, i)))
    cut = lambda at: F.transform(at, lambda low, k: F.slice(held, low + 1, F.coalesce(F.get(at, k + 1), F.size(held)) - low))
    runs = F.element_at(F.transform(F.array(starts), cut), 1)  # the starts are found once
    return F.when(F.size(held) > 0, runs).otherwise(F.slice(F.array(held), 1, 0))


def ocr_lines(pages: DataFrame) -> DataFrame:
    """doc_id, line, text in left order, confidence, n of pages (doc_id, words: array of line, x0, word, conf in this order).

    A reader gives the words of a page together, and they stay so: lines are
    runs of the page's sorted words, so no word is shuffled or sorted by itself.
    Ids tell pages apart; rows of one id are put together by the caller.
    """
    kept = pages.select("doc_id", F.sort_array("words").alias("words"))
    lines = kept.select("doc_id", F.explode(runs_of(F.col("words"), lambda a, b: a["line"].eqNullSafe(b["line"]))).alias("held"))
    confidence = least_confidence(F.transform("held", lambda w: w["conf"]))
    return lines.select("doc_id", F.get("held", F.lit(0))["line"].alias("line"), F.array_join(F.transform("held", lambda w: w["word"]), " ").alias("text"), confidence.alias("confidence"), F.size("held").cast("long").alias("n"))


def script_route(text: Column) -> Column:
    """Reader language: chinese from four Han characters on, malay from two of its common words, else english."""
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    malay = F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b({'|'.join(_MALAY)})\b"), F.lit(1))))
    return F.when(han >= 4, "chinese").when(malay >= 2, "malay").otherwise("english")
