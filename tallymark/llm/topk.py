"""Exact top-k inner products with a bit-sliced index.

Components become integers, ``floor(scale * x)``.  A block of vectors is kept as
bitmaps, one per attribute and bit, without the ``dropped`` lowest bits.  A
query's score is the sum of the slices weighted by its own bits, added with
carry-save bitmap adders for all rows of the block at once.  From the most
significant slice of the sum downward the k-th best is found, rows that the
dropped bits cannot lift to it are left out, and the rest, the boundary rows,
get their exact integer scores.  So the result is exact at any ``dropped``.

A task gets the vectors of a block of about ``block`` rows first, builds its
index once, and then the queries, a batch at a time; every query meets every
block.  The best k of each block are merged by a window that keeps k rows of a
query per task before the shuffle.  Components wider than ``_NARROW`` bits are
scored apart from the bitmaps, with integers of any width.

Defined results: vectors that are null, or hold null or non-finite components,
and rows without an id, take no part; an empty vector scores 0 with every other;
shorter vectors count as ended by zeros; rows of the query's own id are not its
candidates; repeated rows are candidates of their own; ties go to the smaller
id; with fewer candidates than k there are fewer rows; a score beyond 64 bits
takes its exact rank and is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

_NARROW = 20  # bits of a component in a bitmap
_HIT = "query_id long, vec_id long, score long, place binary"
_HIT_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("place", pa.binary())])


def _matrix(lists: pa.Array) -> np.ndarray:
    """Whole numbers as doubles, a row each, ended by zeros."""
    lengths = np.asarray(pc.list_value_length(lists), np.int64)
    out = np.zeros((len(lists), int(lengths.max(initial=0))))
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(lists.flatten())
    return out


def _wide(vectors: np.ndarray) -> np.ndarray:
    """True for rows with a component that bitmaps don't hold."""
    return (np.abs(vectors) >= float(1 << _NARROW)).any(axis=1) if vectors.size else np.zeros(len(vectors), bool)


def _places(scores: list[int]) -> list[bytes]:
    """Bytes that sort as the integers do, whatever their width."""
    out = []
    for s in scores:
        held = abs(s).to_bytes((abs(s).bit_length() + 7) // 8, "big")
        own = len(held).to_bytes(2, "big") + held
        out.append(b"\x01" + own if s >= 0 else b"\x00" + bytes(255 - x for x in own))
    return out


class BitSliced:
    """Bitmaps of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray, dropped: int = 2):
        self.vectors, self.dropped = vectors, dropped
        self.n, dim = vectors.shape
        least = vectors.min(axis=0)
        self.bits = int((vectors - least).max()).bit_length()
        coarse = (vectors - least) >> dropped
        self.slices: list[list[np.ndarray]] = []
        kept = max(0, self.bits - dropped)
        for j in range(dim):
            self.slices.append([self._pack((coarse[:, j] >> b) & 1) for b in range(kept)])
        self.full = self._pack(np.ones(self.n, np.uint8))
        self.inverse = [[x ^ self.full for x in own] for own in self.slices]

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags.astype(np.uint8), bitorder="little")
        return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=self.n, bitorder="little"))

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bit slices of the sum of |q| times the attribute, or times its complement where q is negative."""
        columns: list[list[np.ndarray]] = []
        for j, q in enumerate(query.tolist()):
            weight, shift = abs(q), 0
            source = self.slices[j] if q > 0 else self.inverse[j]
            while weight:
                if weight & 1:
                    while len(columns) < shift + len(source):
                        columns.append([])
                    for b, bitmap in enumerate(source):
                        columns[shift + b].append(bitmap)
                weight >>= 1
                shift += 1
        sums, p = [], 0
        while p < len(columns):
            own = columns[p]
            if len(own) > 1 and p + 1 == len(columns):
                columns.append([])
            while len(own) > 2:
                a, b, c = own.pop(), own.pop(), own.pop()
                half = a ^ b
                columns[p + 1].append((a & b) | (half & c))
                own.insert(0, half ^ c)
            if len(own) == 2:
                a, b = own
                columns[p + 1].append(a & b)
                own = [a ^ b]
            sums.append(own[0] if own else np.zeros_like(self.full))
            p += 1
        return sums

    def top(self, query: np.ndarray, k: int, excluded: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best: at least all rows that are, ties included."""
        alive = self.full & ~self._pack(excluded)
        if np.bitwise_count(alive).sum() <= k:
            return self._rows(alive)
        sums, need, best, left = self.score_slices(query), k, 0, alive
        for b in range(len(sums) - 1, -1, -1):
            high = left & sums[b]
            count = int(np.bitwise_count(high).sum())
            if count >= need:
                left, best = high, best | (1 << b)
            else:
                need -= count
                left = left & ~sums[b]
        slack = int(np.abs(query).sum()) * ((1 << self.dropped) - 1) >> self.dropped
        least = max(0, best - slack)
        above, equal = np.zeros_like(self.full), alive
        for b in range(len(sums) - 1, -1, -1):
            if least >> b & 1:
                equal = equal & sums[b]
            else:
                above |= equal & sums[b]
                equal = equal & ~sums[b]
        return self._rows(above | equal)


class Block:
    """The index of a block: bitmaps of its narrow vectors, the others beside them."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, dropped: int):
        wide = _wide(vectors)
        self.names, self.wide_names = names[~wide], names[wide]
        self.wide = vectors[wide]
        self.index = BitSliced(vectors[~wide].astype(np.int64), dropped) if (~wide).any() else None
        self.dim = vectors.shape[1]

    def best(self, name: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """Ids and exact scores of the k best, and of those that are wide."""
        query = np.pad(query[: self.dim], (0, max(0, self.dim - len(query))))
        ids, scores = [], []
        if self.index is not None:
            if _wide(query[None])[0]:
                rows = np.flatnonzero(self.names != name)
                exact = self.index.vectors[rows].astype(object) @ np.array([int(x) for x in query], object) if self.dim else [0] * len(rows)
            else:
                rows = self.index.top(query.astype(np.int64), k, self.names == name)
                exact = (self.index.vectors[rows] @ query.astype(np.int64)).tolist()
            ids, scores = self.names[rows].tolist(), [int(s) for s in exact]
        for other, vector in zip(self.wide_names.tolist(), self.wide, strict=True):
            if other != name:
                ids.append(other)
                scores.append(sum(int(a) * int(b) for a, b in zip(vector, query, strict=True)))
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return [ids[i] for i in order], [scores[i] for i in order]


def _search(k: int, dropped: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches (b, asked, vec_id, v) in order of b, a block's vectors before its queries."""
        at, held, block = None, [], None
        for batch in batches:
            b, asked = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.diff(b) | np.diff(asked)) + 1
            for low, high in zip(np.r_[0, edges], np.r_[edges, len(b)], strict=True):
                if low == high:
                    continue
                if b[low] != at:
                    at, held, block = b[low], [], None
                part = batch.slice(low, high - low)
                if not asked[low]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    vectors = pa.chunked_array([x.column(3) for x in held]).combine_chunks()
                    block = Block(np.concatenate([np.asarray(x.column(2)) for x in held]), _matrix(vectors), dropped)
                hits = []
                for name, query in zip(np.asarray(part.column(2)).tolist(), _matrix(part.column(3)), strict=True):
                    ids, scores = block.best(name, query, k)
                    small = [s if -(2**63) <= s < 2**63 else None for s in scores]
                    hits.extend(zip([name] * len(ids), ids, small, _places(scores), strict=True))
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*hits, strict=True), _HIT_ARROW, strict=True)], schema=_HIT_ARROW)

    return run


def _integers(embedding: Column, scale: int) -> tuple[Column, Column]:
    """The vector in whole numbers, and whether it takes part."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # beyond that a double has no fraction
    return F.transform(embedding, lambda x: whole(x.cast("double") * scale)), F.coalesce(finite, F.lit(False))


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16384, dropped: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates among all rows but its own."""
    spark = vectors.sparkSession
    values, fits = _integers(F.col(vector_col), scale)
    asked = F.coalesce(is_query, F.lit(False))
    part = vectors.where(fits & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v"), asked.alias("asked"))
    part = materialize(part.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_blocks = max(1, -(-part.count() // block))
    left = part.select(F.pmod(F.hash("row"), F.lit(n_blocks)).alias("b"), F.lit(False).alias("asked"), "vec_id", "v")
    right = part.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), "asked", "vec_id", "v")
    tasks = min(n_blocks, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = left.unionByName(right).repartitionByRange(tasks, "b").sortWithinPartitions("b", "asked")  # by range, blocks are dealt evenly
    hits = met.mapInArrow(_search(k, dropped), _HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
