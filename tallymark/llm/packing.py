"""Packing documents into fixed windows (bounded-space online best fit).

Every input partition keeps at most ``open_windows`` windows.  A document's
pieces of a full window leave at once; what is left of it goes to the open
window where it fits best.  When none has room, the fullest is topped up with
the head of the piece and emitted.  At its end a partition merges its open
windows, and its last unfilled stretch is laid end to end with those of the
other partitions: a prefix sum over one row per partition says where.  So only
the very last window of the whole corpus can be short; it is cut at powers of
two, lengths that need no padding.

Defined results: a null or empty text is the end id alone; every row is packed
on its own, repeated rows and repeated or null ids too; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, settings
from .tokens import SLICE, encoder, id_dtype
from .wordhash import slices

_PIECE = "part int, seq long, offset long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PIECE_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_FLUSH_WINDOWS = 500
_TEXTS = "1000"  # a batch is held by the executor and by its Python worker


class _Window:
    __slots__ = ("pieces", "used")

    def __init__(self):
        self.used, self.pieces = 0, []

    def add(self, doc_id, start, ids, total):
        self.pieces.append((self.used, doc_id, start, ids, total))
        self.used += len(ids) // 4


class BestFit:
    """Places pieces of one partition; ``full`` gets each window that is complete."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.limit = size, open_windows
        self.open: list[_Window] = []
        self.full: list[_Window] = []

    def _emit(self, window: _Window) -> None:
        self.full.append(window)

    def place(self, doc_id, ids: bytes) -> None:
        total, at, room = len(ids) // 4, 0, self.size
        while total - at >= room:
            window = _Window()
            window.add(doc_id, at, ids[4 * at : 4 * (at + room)], total)
            self._emit(window)
            at += room
        if at == total:
            return
        need = total - at
        best = None
        for window in self.open:
            if window.used + need <= room and (best is None or window.used > best.used):
                best = window
        if best is None and len(self.open) < self.limit:
            best = _Window()
            self.open.append(best)
        if best is None:
            fullest = max(self.open, key=lambda w: w.used)
            head = room - fullest.used
            fullest.add(doc_id, at, ids[4 * at : 4 * (at + head)], total)
            self.open.remove(fullest)
            self._emit(fullest)
            at += head
            best = _Window()
            self.open.append(best)
        best.add(doc_id, at, ids[4 * at :], total)
        if best.used == room:
            self.open.remove(best)
            self._emit(best)

    def merge(self) -> _Window:
        """Merge what is open; the return value is the stretch that fills no window."""
        last = _Window()
        for window in sorted(self.open, key=lambda w: -w.used):
            for _, doc_id, start, ids, total in window.pieces:
                while len(ids) // 4 >= self.size - last.used:
                    head = self.size - last.used
                    last.add(doc_id, start, ids[: 4 * head], total)
                    self._emit(last)
                    last, start, ids = _Window(), start + head, ids[4 * head :]
                if ids:
                    last.add(doc_id, start, ids, total)
        self.open = []
        return last


def _rows(part: int, pieces: list[tuple]) -> pa.RecordBatch:
    """pieces: (seq, offset, doc_id, start, ids as 32-bit bytes, total, dtype)."""
    columns = [
        [part] * len(pieces),
        [p[0] for p in pieces],
        [p[1] for p in pieces],
        [p[2] for p in pieces],
        [p[3] for p in pieces],
        [len(p[4]) // 4 for p in pieces],
        [zlib.crc32(p[4]) for p in pieces],
        [p[5] for p in pieces],
        [np.frombuffer(p[4], "<u4").astype(p[6]).tobytes() for p in pieces],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PIECE_ARROW, strict=True)], schema=_PIECE_ARROW)


def pack_partition(path: str, size: int, open_windows: int, end_id: int):
    """The function that packs the batches of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        dtype, fit, seq = id_dtype(encode.vocabulary), BestFit(size, open_windows), 0
        ready: list[tuple] = []

        def drain():
            nonlocal seq
            for window in fit.full:
                ready.extend((seq, o, d, s, i, t, dtype) for o, d, s, i, t in window.pieces)
                seq += 1
            fit.full = []

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in slices(texts, SLICE):
                ids, offsets = encode(texts[low:high], end_id)
                held, edges = ids.tobytes(), (4 * offsets).tolist()
                for doc_id, begin, end in zip(names[low:high], edges[:-1], edges[1:], strict=True):
                    fit.place(doc_id, held[begin:end])
                    if len(fit.full) >= _FLUSH_WINDOWS:
                        drain()
                        yield _rows(part, ready)
                        ready = []
        rest = fit.merge()
        drain()
        ready.extend((None, o, d, s, i, t, dtype) for o, d, s, i, t in rest.pieces)
        if ready:
            yield _rows(part, ready)

    return run


def _cuts(total: int, size: int) -> list[int]:
    """Ends of the sequences that ``total`` tokens fill: whole windows, then powers of two."""
    ends = list(range(size, total + 1, size))
    at = ends[-1] if ends else 0
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return ends


def _cut_rest(size: int, total: int, itemsize: int):
    """Cuts pieces of the joint stretch where one sequence ends and the next begins."""
    whole = total - total % size
    tail = _cuts(total - whole, size)

    def limits(at: int) -> tuple[int, int, int]:
        """Number, begin and end of the sequence at a position."""
        if at < whole:
            return at // size, at - at % size, at - at % size + size
        begin = whole
        for k, end in enumerate(tail):
            if at < whole + end:
                return whole // size + k, begin, whole + end
            begin = whole + end
        raise ValueError(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = "<u2" if itemsize == 2 else "<u4"
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, at, start = np.frombuffer(r["ids"], dtype).astype("<u4").tobytes(), r["at"], r["start"]
                while ids:
                    seq, begin, end = limits(at)
                    head = ids[: 4 * (end - at)]
                    out.append((seq, at - begin, r["doc_id"], start, head, r["doc_tokens"], dtype))
                    ids, at, start = ids[4 * (end - at) :], end, start + len(head) // 4
            if out:
                yield _rows(-1, out)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, open_windows: int = 64, end_id: int = 2) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's flat unsigned ids (16 bits if the vocabulary fits).
    """
    run = pack_partition(tokenizer_path, size, open_windows, end_id)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=_TEXTS):
        pieces = materialize(chosen.mapInArrow(run, _PIECE), "pieces")
    parts = pieces.groupBy("part").agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("n_full"), F.sum(F.when(F.col("seq").isNull(), F.col("length")).otherwise(0)).alias("n_rest"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per document
    bases = materialize(parts.select("part", "n_full", "n_rest", F.coalesce(F.sum("n_full").over(before), F.lit(0)).alias("seq_base"), F.coalesce(F.sum("n_rest").over(before), F.lit(0)).alias("rest_base")), "bases")
    n_full, n_rest = bases.agg(F.coalesce(F.sum("n_full"), F.lit(0)), F.coalesce(F.sum("n_rest"), F.lit(0))).first()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    joined = pieces.join(bases.select("part", "seq_base", "rest_base"), "part")
    full = joined.where(F.col("seq").isNotNull()).withColumn("sequence_id", F.col("seq") + F.col("seq_base")).select(names)
    if not n_rest:
        return full
    itemsize = 2 if id_dtype(encoder(tokenizer_path).vocabulary) == "<u2" else 4
    rest = joined.where(F.col("seq").isNull()).withColumn("at", F.col("rest_base") + F.col("offset")).select("doc_id", "start", "doc_tokens", "ids", "at")
    cut = rest.mapInArrow(_cut_rest(size, int(n_rest), itemsize), _PIECE).withColumn("sequence_id", F.col("seq") + int(n_full)).select(names)
    return full.unionByName(cut)


def sequences(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """sequence_id, n_tokens, n_padding, ids: the packed windows themselves, at most ``size`` ids each."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("held"))
    padded = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(size - F.col("n_tokens"))
    return out.select("sequence_id", "n_tokens", padded.alias("n_padding"), F.expr("aggregate(held, X'', (a, x) -> a || x.ids)").alias("ids"))
