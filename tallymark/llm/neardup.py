"""Near-duplicate documents: ProbMinHash sketches, banding, verification.

A text is the set of its runs of ``shingle`` words (all its words, if fewer).
All weigh the same, however often they occur, for only so is the similarity
that the sketch sees the one that is verified.  A shingle of weight w sends
arrivals of a Poisson process of rate w, each to a random slot of the sketch;
a slot keeps its earliest.  Once a shingle's next arrival is later than every
slot's, it stops, so most stop at their first.  Two slots agree with the
probability Jaccard similarity of the weighted sets, with equal weights the
plain one: 24 bands of 5 miss a pair at 0.8 once in 14000.  Bands of slots are
buckets; candidates are verified by the Jaccard similarity of the plain sets,
and chains of verified pairs make a class.  Members of a bucket that its center
does not connect are candidates only if they share one of their rarest shingles
early enough for the overlap that ``similarity`` asks (an exact condition, so a
passage that many documents hold makes no pairs).

Equal texts are one node from the start and never become pairs.  Defined
results: a text without words (null, empty) is a class of its own text;
``class_id`` is the least id of the class (nulls last); repeated rows share
their class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import link, shared_buckets
from .scratch import materialize
from .wordhash import Words, mix, slices, words_of

_U = np.uint64


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle, by row."""
    whole = np.flatnonzero(words.fits(k))
    row, value = words.row[whole], words.runs(k)[whole]
    lengths = np.diff(words.first)
    for n in range(1, k):
        few = np.flatnonzero(lengths == n)
        if len(few):
            row = np.r_[row, few]
            value = np.r_[value, words.runs(n)[words.first[few]] + _U(n)]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.empty(0, np.int64)
    return row[new], value[new], np.diff(np.r_[new, len(row)])


def sketch(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """For each row and slot the shingle that arrives first (0 in rows without shingles)."""
    first, owner = np.full(rows * slots, np.inf), np.zeros(rows * slots, _U)
    clock, arrival = np.zeros(len(row)), 0
    while len(row):
        arrival += 1
        draw = mix(value + _U(arrival * 0x9E3779B97F4A7C15 % (1 << 64)))
        clock = clock - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = row * slots + (mix(draw ^ _U(0x5851F42D4C957F2D)) % _U(slots)).astype(np.int64)
        np.minimum.at(first, place, clock)
        won = first[place] == clock
        owner[place[won]] = value[won]
        alive = clock < first.reshape(rows, slots).max(axis=1)[row]
        row, value, weight, clock = row[alive], value[alive], weight[alive], clock[alive]
    return owner.reshape(rows, slots)


def _bands(shingle: int, bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts):
                row, value, _ = _shingles(words_of(texts[low:high]), shingle)
                held = sketch(row, value, np.ones(len(row)), high - low, bands * width)
                filled = np.unique(row)
                if not len(filled):
                    continue
                keys = []
                for b in range(bands):
                    key = np.full(len(filled), b + 1, _U)
                    for s in range(b * width, (b + 1) * width):
                        key = mix(key * _U(0xD1342543DE82EF95) + held[filled, s])
                    keys.append(key)
                taken = nodes[low:high].take(pa.array(np.repeat(filled, bands)))
                yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, 1).ravel().view(np.int64)), taken], ["key", "node"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts):
                row, value, _ = _shingles(words_of(texts[low:high]), shingle)
                offsets = np.searchsorted(row, np.arange(high - low + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([nodes[low:high], lists], ["node", "held"])

    return run


def _classed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 24, width: int = 5) -> DataFrame:
    """doc_id, node (digest of the text), comp (least node of the class), class_id of every row."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("node"), F.col(text_col).alias("text"))
    texts = materialize(named.groupBy("node").agg(F.first("text").alias("text"), F.min("doc_id").alias("first_id")), "texts")
    buckets = materialize(texts.select("node", "text").mapInArrow(_bands(shingle, bands, width), "key long, node binary"), "buckets")  # read twice, sketched once
    members = shared_buckets(buckets)
    candidates = members.select("node").distinct()
    wanted = texts.select("node", "text").join(candidates, "node", "left_semi")
    sets = materialize(wanted.mapInArrow(_sets(shingle), "node binary, held array<long>"), "shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        size = sets.select("node", F.size("held").alias("n"))
        near = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        near = near.where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb"))
        full = near.join(sets.select(F.col("node").alias("a"), F.col("held").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return full.withColumn("common", common).where(F.col("common") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("common")))

    def across(rest: DataFrame) -> DataFrame:
        """Sets that overlap by ``similarity`` share one of their 1 - ``similarity`` rarest shingles; a common passage is not among them."""
        held = rest.join(sets, "node").select("node", "comp", F.size("held").alias("n"), F.explode("held").alias("s"))
        often = held.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
        alone = F.col("n") - F.count("*")
        shared = held.join(often, "s").groupBy("node", "comp", "n").agg(alone.alias("alone"), F.sort_array(F.collect_list(F.struct("often", "s"))).alias("shared"))
        length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - F.col("alone")
        rare = shared.where(length > 0).select("node", "comp", "n", "alone", F.posexplode(F.slice("shared", 1, length.cast("int"))["s"]).alias("i", "s"))
        rare = materialize(rare.select("node", "comp", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), "s"), "rare-shingles")
        mixed = rare.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("s")
        rare = materialize(rare.join(mixed, "s"), "mixed-shingles")
        left, right = (rare.select("s", *(F.col(c).alias(c + side) for c in ("node", "comp", "n", "rest"))) for side in "ab")
        enough = F.least("resta", "restb") >= F.lit(similarity) * (F.col("na") + F.col("nb")) / (1 + similarity) - 1e-9  # the first shingle in common leaves room for the overlap
        apart = (F.col("compa") != F.col("compb")) & (F.col("nodea") < F.col("nodeb"))
        return left.join(right, "s").where(apart & enough).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()

    groups = link(members, verify, across)
    nodes = texts.select("node", "first_id").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = materialize(nodes.select("node", "comp", "first_id"), "nodes")
    least = nodes.groupBy("comp").agg(F.min("first_id").alias("class_id"))
    placed = nodes.join(least, "comp").select("node", "comp", "class_id")
    return named.select("doc_id", "node").join(placed, "node").select("doc_id", "node", "comp", "class_id")


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, node (digest of the text), class_id of every row."""
    return _classed(docs, **options).drop("comp")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the least id (null ids last); of rows alike in id and text any one."""
    found = _classed(docs, id_col=id_col, text_col=text_col, **options)
    named = F.struct(F.col("doc_id").isNull().alias("_z"), F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("node").alias("_n"))
    stay = found.groupBy("comp").agg(F.min(named).alias("stay")).select("stay.*")
    own = docs.withColumn("_i", F.coalesce(F.col(id_col).cast("long"), F.lit(0))).withColumn("_z", F.col(id_col).cast("long").isNull()).withColumn("_n", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    alone = own.dropDuplicates(["_i", "_z", "_n"])  # combines before the shuffle that the join then uses too
    return alone.join(stay, ["_i", "_z", "_n"], "left_semi").drop("_i", "_z", "_n")
