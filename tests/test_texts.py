"""Trimming, folding and the search for labels give what their patterns say, on odd texts too."""

import itertools

from pyspark.sql import functions as F

from tallymark.functions import labels as L
from tallymark.functions import values

ODD = ["", " ", "\t a  b ", "　x  y \n", "a\x1cb\x1f", "​z᠎", "a \u0085 b\r\n", "  ", "a\tb", "n/a.\n", "İpod", "ſhipper", "K notify", "CONSIGNEE", "no.of containers", "ppol", "po l", "装货港", "port  of loading", None]


def test_trimming_and_folding(spark):
    rows = spark.createDataFrame([(x,) for x in ODD + [a + b for a, b in itertools.product(ODD[:-1], ODD[:8])]], "text string")
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    t = F.col("text")
    out = rows.select(strip(t).alias("a"), values.strip(t).alias("b"), F.regexp_replace(strip(F.lower(t)), r"(?U)\s+", " ").alias("c"), values.fold(t).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in out)


def test_labels_are_found_as_the_pattern_finds_them(spark):
    texts = ODD + [f"x{label.upper()}y" for own in L.LABELS.values() for label in own]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", F.col("text").rlike(values._ANY_LABEL).alias("a"), values._has_label(F.col("text")).alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_numbers_are_read_as_the_pattern_reads_them(spark):
    ends = ["", " ", "kg", " KGS", "  mt ", "lb.", "x", "x 40'HC", "公斤", " 个", "kgs2", " ton", "containers", "\n"]
    texts = [a + b for a, b in itertools.product(["", "1", "12,345", "1,23", "1.50", "1.", "01,000.5", "-1", ".5"], ends)]
    rows = spark.createDataFrame([(x,) for x in texts], "value string").withColumn("field", F.lit("gross_weight_kg"))
    old = [F.regexp_extract("value", values._NUMBER, k) for k in (1, 2)]
    number = F.when(old[0] != "", F.replace(old[0], F.lit(","), F.lit("")).cast("decimal(20,6)"))
    out = values.with_numbers(rows).select("value", "number", F.coalesce("unit", F.lit("")).alias("unit"), number.alias("a"), F.lower(old[1]).alias("b"))
    assert [r.value for r in out.collect() if (r.number, r.unit) != (r.a, r.b)] == []
