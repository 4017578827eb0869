"""Numbers in text with their places and the unit of their line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import labels as L

_NUMBER = rf"(?U)(?=[0-9])(?<![\w.,/-]){L.GROUPED}{L.FRACTION}(?![\w.,/-])"  # alone in what stands together
_TONNES = L.TONNES + L.TONNE_SIGNS
_UNITS = L.KILOGRAMS + L.KILOGRAM_SIGNS + _TONNES
_UNIT = rf"(?i)(?=[{''.join(sorted({x[0] for x in _UNITS}))}])(?<![A-Za-z])(?:{L.alternatives(_UNITS)})(?![A-Za-z])"
_BREAK = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
_AFTER_BREAK = r"(?<=\r\n)|(?<=[\n\x0B\x0C\x1C\x1D\x1E\x85  ])|(?<=\r)(?!\n)"
MOST_CANDIDATES = 120


def _spans(found: Column, pieces: Column) -> Column:
    """Array of (value, start) of the matches ``found`` between ``pieces``."""
    before = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k + 1), F.lit(0), lambda n, x: n + F.char_length(x)) + F.aggregate(F.slice(found, F.lit(1), k), F.lit(0), lambda n, x: n + F.char_length(x))
    start = lambda k: F.when(k == 0, F.char_length(F.get(pieces, F.lit(0)))).otherwise(before(k))
    return F.transform(found, lambda x, k: F.struct(x.alias("value"), start(k).alias("start")))


def numeric_candidates(blocks: DataFrame, *, keys: list[str]) -> DataFrame:
    """keys, number (from 1 in reading order), block, value, start, end, unit, unit_start, line.

    ``blocks``: keys, block (its order), method, text; only native text counts.
    A line's unit is its first one, unless its units differ in scale.  A
    document with more than 120 numbers has no candidates at all.
    """
    native = blocks.where("method = 'native'").where(F.col("text").rlike("[0-9]"))
    whole = F.when(F.col("text").rlike(_BREAK), F.split("text", _AFTER_BREAK, -1)).otherwise(F.array("text"))
    parts = native.select(*keys, "block", whole.alias("parts"))
    lines = parts.select(*keys, "block", "parts", F.posexplode("parts").alias("at", "line"))
    offset = F.aggregate(F.slice("parts", F.lit(1), F.col("at")), F.lit(0), lambda n, x: n + F.char_length(x))
    found = lines.select(*keys, "block", "at", offset.alias("offset"), "line", F.regexp_extract_all("line", F.lit(_NUMBER), F.lit(0)).alias("found")).where(F.size("found") > 0)
    units = found.withColumn("pieces", F.split("line", _NUMBER, F.when(F.size("found") == 1, 2).otherwise(-1))).withColumn("units", F.regexp_extract_all("line", F.lit(_UNIT), F.lit(0)))
    scales = F.array_distinct(F.transform("units", lambda x: F.lower(x).isin(*_TONNES)))
    first = F.struct(F.get("units", F.lit(0)).alias("value"), F.char_length(F.get(F.split("line", _UNIT, 2), F.lit(0))).alias("start"))
    unit = F.when(F.when(F.size("units") > 0, F.size(scales)) == 1, first)
    rows = units.withColumn("u", unit).select(*keys, "block", "at", "offset", "line", "u", F.explode(_spans(F.col("found"), F.col("pieces"))).alias("n"))
    reading = Window.partitionBy(*keys)
    numbered = rows.withColumn("number", F.row_number().over(reading.orderBy("block", "at", "n.start"))).withColumn("total", F.count("*").over(reading))
    start = F.col("offset") + F.col("n.start")
    trimmed = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return numbered.where(F.col("total") <= MOST_CANDIDATES).select(
        *keys, "number", "block", F.col("n.value").alias("value"), start.alias("start"), (start + F.char_length("n.value")).alias("end"),
        F.col("u.value").alias("unit"), (F.col("offset") + F.col("u.start")).alias("unit_start"), trimmed.alias("line"),
    )
