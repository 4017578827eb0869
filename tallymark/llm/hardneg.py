"""Hard negatives of anchors (bounds along a spanning tree of the anchors).

Components become integers, ``floor(scale * x)``.  Anchors come in rounds of at
most about ``anchors`` vectors, which the driver collects, links by a minimum
spanning tree of Euclidean distances and broadcasts; every task then walks the
tree over its own candidates, so candidates are never shuffled.  A score differs
from the one at the parent anchor by the edge's length times the candidate's
norm at most.  Only candidates whose bounds overlap what is sought at an anchor
are rescored exactly, and their bounds there become points; where more than half
of them are, all are, which begins the bounds anew.

Two walks a round: the first seeks the best ``positives`` of the anchor's label
(bounds against the least of the best so far), the second, for each positive,
the best ``negatives`` of other labels with ``low * positive <= 100 * negative
<= high * positive`` (bounds against the windows).  Tasks keep the best of their
rows; window functions merge them.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; shorter vectors count as ended by zeros; rows of the
anchor's own id are neither positives nor negatives of it; repeated rows are
candidates of their own, and each repeated anchor gets its rows; ties go to the
smaller id; with fewer rows than asked for there are fewer; components of any
size take part, with integers of any width beside the walks; a score beyond 64
bits takes its exact rank and is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, new_path
from .topk import _integers, _matrix, _places

_NARROW = 20  # bits of a component of which products are summed exactly in doubles
_MOST_WIDTH = 1 << 12
_ROWS = 4096
_FAR = float(1 << 53)
_HIT = "a int, j int, vec_id long, score long, place binary"
_HIT_ARROW = pa.schema([("a", pa.int32()), ("j", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("place", pa.binary())])


def _value(place: bytes) -> int:
    """The integer of which ``_places`` made these bytes."""
    return int.from_bytes(place[3:], "big") if place[0] else -int.from_bytes(bytes(255 - x for x in place[3:]), "big")


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the walk, each point's parent (-1 for the root) and its distance from it: a minimum spanning tree."""
    n = len(points)
    order, parent, length = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    if not n:
        return order, parent, length
    best, near = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    for k in range(n):
        order[k], left[at] = at, False
        if k:
            parent[at], length[at] = near[at], np.sqrt(best[at])
        far = ((points - points[at]) ** 2).sum(axis=1)
        closer = left & (far < best)
        best[closer], near[closer] = far[closer], at
        at = int(np.where(left, best, np.inf).argmin())
    return order, parent, length


class Best:
    """The k best (score, then smaller id) of what was added."""

    def __init__(self, k: int, least: float = -np.inf):
        self.k, self.floor = k, least
        self.scores, self.ids = np.empty(0), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        keep = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.floor = max(self.floor, self.scores[-1])


class Anchors:
    """Anchors of a round: ids, labels, vectors, the tree of the narrow ones, and what is sought at each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.wide = _is_wide(vectors)
        self.narrow = np.flatnonzero(~self.wide)
        order, parent, length = spanning_tree(vectors[self.narrow])
        self.order, self.length = self.narrow[order], np.zeros(len(ids))
        self.parent = np.full(len(ids), -1)
        self.length[self.narrow] = length
        self.parent[self.narrow[parent >= 0]] = self.narrow[parent[parent >= 0]]
        self.windows: list[list[tuple[int, int]]] | None = None  # by anchor and positive; None while positives are sought


def _is_wide(vectors: np.ndarray) -> np.ndarray:
    if vectors.shape[1] > _MOST_WIDTH:
        return np.ones(len(vectors), bool)
    return (np.abs(vectors) >= float(1 << _NARROW)).any(axis=1) if vectors.size else np.zeros(len(vectors), bool)


def _fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or ended by zeros to ``width``; what an anchor lacks adds nothing to a score."""
    return np.pad(vectors[:, :width], ((0, 0), (0, max(0, width - vectors.shape[1]))))


def _walk(shipped, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shipped.value
        seek = anchors.windows
        clip = lambda x: float(min(max(x, -(1 << 53)), 1 << 53))
        if seek is None:
            tops = [[(Best(k), _FAR)] for _ in anchors.ids]
        else:
            tops = [[(Best(k, clip(low)), clip(high)) for low, high in own] for own in seek]
        beside: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids, labels = np.asarray(part.column(0)), np.asarray(part.column(1))
                whole = _matrix(part.column(2))
                wide = _is_wide(whole)
                vectors = _fitted(whole, anchors.vectors.shape[1])
                _tree(anchors, tops, ids[~wide], labels[~wide], vectors[~wide], seek is None)
                beside.extend(_exact(anchors, range(len(anchors.ids)), ids[wide], labels[wide], vectors[wide], seek))
                beside.extend(_exact(anchors, np.flatnonzero(anchors.wide), ids[~wide], labels[~wide], vectors[~wide], seek))
        rows = [(a, j, i, int(s)) for a, own in enumerate(tops) for j, (best, _) in enumerate(own) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]
        rows += _best_beside(beside, k)
        if rows:
            a, j, name, score = zip(*rows, strict=True)
            small = [s if -(2**63) <= s < 2**63 else None for s in score]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((a, j, name, small, _places(list(score))), _HIT_ARROW, strict=True)], schema=_HIT_ARROW)

    return run


def _tree(anchors: Anchors, tops: list, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool) -> None:
    """Walk from parents to children, with each candidate's bounds; rescore where they overlap what is sought."""
    if not len(ids):
        return
    norm = np.sqrt((vectors * vectors).sum(axis=1)) * (1 + 1e-9)
    low, high = np.full((len(anchors.ids), len(ids)), -_FAR), np.full((len(anchors.ids), len(ids)), _FAR)
    for a in anchors.order.tolist():
        up, vector = anchors.parent[a], anchors.vectors[a]
        if up >= 0:
            low[a], high[a] = low[up] - anchors.length[a] * norm, high[up] + anchors.length[a] * norm
        fits = ((labels == anchors.labels[a]) == same) & (ids != anchors.ids[a])
        overlaps = np.zeros(len(ids), bool)
        for best, most in tops[a]:
            if best.floor <= most:
                overlaps |= (high[a] >= best.floor) & (low[a] <= most)
        wanted = np.flatnonzero(fits & overlaps)
        if up < 0 or 2 * len(wanted) > len(ids):
            low[a] = high[a] = vectors @ vector
        elif len(wanted):
            low[a, wanted] = high[a, wanted] = vectors[wanted] @ vector
        scores = low[a, wanted]
        for best, most in tops[a]:
            inside = (scores >= best.floor) & (scores <= most)
            best.add(scores[inside], ids[wanted[inside]])


def _exact(anchors: Anchors, which, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seek) -> list[tuple[int, int, int, int]]:
    """Scores of components of any size, as integers."""
    out = []
    if not len(ids) or not len(which):
        return out
    held = [[int(x) for x in v] for v in vectors]
    for a in which:
        own = [int(x) for x in anchors.vectors[a]]
        for i, label, other in zip(ids.tolist(), labels.tolist(), held, strict=True):
            if i == anchors.ids[a] or (label == anchors.labels[a]) != (seek is None):
                continue
            score = sum(x * y for x, y in zip(own, other, strict=True))
            out += [(int(a), j, i, score) for j, (low, high) in enumerate([(score, score)] if seek is None else seek[a]) if low <= score <= high]
    return out


def _best_beside(rows: list[tuple[int, int, int, int]], k: int) -> list[tuple[int, int, int, int]]:
    out, at, n = [], None, 0
    for a, j, i, score in sorted(rows, key=lambda r: (r[0], r[1], -r[3], r[2])):
        at, n = ((a, j), 1) if (a, j) != at else (at, n + 1)
        if n <= k:
            out.append((a, j, i, score))
    return out


def _merged(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "j").orderBy(F.desc("place"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _round(part: DataFrame, own: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Result rows of a round's anchors."""
    spark, own = part.sparkSession, own.combine_chunks()
    lists = own.column(2).combine_chunks()
    anchors = Anchors(np.asarray(own.column(0)), np.asarray(own.column(1)), _matrix(lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists))
    rows = part.select("vec_id", "label", "v")
    found = _merged(rows.mapInArrow(_walk(spark.sparkContext.broadcast(anchors), positives), _HIT), positives).toArrow().to_pylist()  # positives * anchors of a round at most
    found.sort(key=lambda r: (r["a"], r["rank"]))
    anchors.windows = [[] for _ in anchors.ids]
    pairs = []
    for r in found:
        score = _value(r["place"])
        pairs.append((r["a"], len(anchors.windows[r["a"]]), int(anchors.ids[r["a"]]), r["vec_id"], r["score"]))
        anchors.windows[r["a"]].append((-(-low * score // 100), high * score // 100))
    hits = _merged(rows.mapInArrow(_walk(spark.sparkContext.broadcast(anchors), negatives), _HIT), negatives)
    sought = spark.createDataFrame(pairs, "a int, j int, anchor_id long, positive_id long, positive_score long")
    return hits.join(sought, ["a", "j"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchors: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    values, fits = _integers(F.col(vector_col), scale)
    asked = F.coalesce(is_anchor, F.lit(False))
    part = vectors.where(fits & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    part = materialize(part.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), values.alias("v"), asked.alias("asked")), "vectors")
    sought = part.where("asked").withColumn("row", F.monotonically_increasing_id())
    sought = materialize(sought, "anchors")
    rounds = max(1, -(-sought.count() // anchors))
    results, schema = [], None
    for k in range(rounds):
        own = sought if rounds == 1 else sought.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)
        own = own.orderBy("vec_id").select("vec_id", "label", "v").toArrow()
        if rounds > 1 and not own.num_rows:
            continue
        out = _round(part, own, positives, negatives, low, high)
        if rounds == 1:
            return out
        schema, path = out.schema, new_path(spark, "hard-negatives")
        materialize(out, "hard-negatives", path=path)
        results.append(path)
    return spark.read.schema(schema).parquet(*results)
