"""Removing byte strings that occur more than once (suffix arrays by two-stage sorting).

Equal strings of ``window`` bytes meet through their *anchor*, the least-hashed
string of ``gram`` bytes inside them; windows in a row with the same anchor are
a segment.  Segments whose anchor stands in the corpus once end there.  Of the
others, each distinct one goes to the task of its anchor, with the mark whether
the corpus holds it more than once, and tasks build suffix arrays over about
``_BATCH`` bytes of whole anchors:

1. suffixes smaller than their successors are sorted directly, by eight bytes a
   round, equal windows once (no order among them is needed);
2. all others are induced by one scan over the buckets of first bytes;
3. common prefixes of neighbours tell which windows stand elsewhere, too.

Windows repeated so, and those of marked segments, go back to every document
that holds the segment.  An anchor with more than ``most_kinds`` distinct
segments (a common line in ever new surroundings) is split: each of its windows
becomes a segment of its own, with the window's hash as anchor, so no group
grows with the corpus.

What is shuffled is a row per segment (about one in 80 bytes), the distinct
segments of repeated anchors, and, twice, the texts that hold some of them.  Segments count as equal when
two 64-bit hashes are (chance 2^-128 a pair); windows are compared by bytes.

Defined results: a null text is empty; equal rows are repeats of each other;
rows of one id are documents of their own; a text of less than ``window`` bytes
stays whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, new_path
from .substrings import _keyed
from .wordhash import _BYTES, mix, slices

_U = np.uint64
_BYTE_ENDS = _U(1) << np.arange(0, 64, 8, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_PLACE = 28  # low bits of a sort key that hold the position
_BATCH = 1 << 20
_STRIDE = 32
_MOST_BITS = 28
_SEGMENT = "k1 long, k2 long, anchor long, content long, span long"  # span: start * 2^_COUNT + number of windows
_COUNT = 16
_BODY = "anchor long, content long, often boolean, body binary"
_FOUND = "anchor long, content long, runs array<long>"
_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


# ---- suffix arrays -------------------------------------------------------------------------


def _ascending(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successors; the end is smaller than any byte."""
    ends = np.r_[np.flatnonzero(text[1:] != text[:-1]), len(text) - 1]
    rises = np.r_[text[ends[:-1]] < text[ends[:-1] + 1], False]
    return np.repeat(rises, np.diff(np.r_[-1, ends]))


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts as they do; zeros follow the end."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    return np.ndarray(len(text), ">u8", padded.data, strides=(1,)).astype(_U)


def _parted(keys: np.ndarray, new: np.ndarray) -> np.ndarray:
    """True for members of groups (each begins where ``new``) that differ in their keys."""
    group = np.cumsum(new) - 1
    differs = (keys[1:] != keys[:-1]) & ~new[1:]
    parted = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    parted[group[1:][differs]] = True
    return parted[group]


def _sorted_directly(text: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """``places`` ordered by their first ``window`` bytes."""
    values = _BYTES[np.r_[text, np.zeros(_STRIDE, np.uint8)]]
    whole, strides, eights = _runs(values, window)[places], _runs(values, _STRIDE), _eights(text)
    by_hash = np.argsort(whole, kind="stable")
    hashes = whole[by_hash]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    count = np.diff(np.r_[first, len(hashes)])
    one = places[by_hash[first]]
    key = eights[one]
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]][: len(order)]
    open_ = np.arange(len(order))
    asleep: list[np.ndarray] = []
    for depth in range(8, window, 8):
        long_step = (depth - 8) % _STRIDE == 0
        if long_step:
            open_, asleep = np.sort(np.concatenate([open_, *asleep])), []
        alone = new & np.r_[new[1:], True]
        open_ = open_[~alone[open_]]  # slots of groups not told apart yet
        if not len(open_):
            if not asleep:
                break
            continue
        if long_step:  # most groups agree on a whole stride and stay as they are
            parted = _parted(strides[one[order[open_]] + depth], new[open_])
            asleep.append(open_[~parted])
            open_ = open_[parted]
        key = eights[np.minimum(one[order[open_]] + depth, len(eights) - 1)]
        those = np.flatnonzero(_parted(key, new[open_]))
        if not len(those):
            continue
        slots, key = open_[those], key[those]
        group = np.cumsum(new[slots])
        again = np.lexsort((key, group))
        order[slots], key = order[slots[again]], key[again]
        new[slots[1:]] |= key[1:] != key[:-1]
    count, start = count[order], first[order]
    before = np.cumsum(count) - count
    return places[by_hash[np.repeat(start - before, count) + np.arange(len(places))]]


def suffix_order(text: np.ndarray, window: int) -> np.ndarray:
    """All positions of ``text`` (bytes), ordered by at least their first ``window`` bytes."""
    text = np.r_[text, np.zeros(window, np.uint8)]  # so that every suffix has its window
    n, rising = len(text), _ascending(text)
    direct = np.flatnonzero(rising)
    direct = _sorted_directly(text, direct, window)
    size, risen = np.bincount(text, minlength=256), np.bincount(text[direct], minlength=256)
    start = np.cumsum(size) - size
    tail = start + size - risen  # in a bucket the induced come before the directly sorted
    out, head = np.empty(n, np.int64), start.copy()
    at = np.cumsum(risen) - risen
    for c in np.flatnonzero(risen):
        out[tail[c] : tail[c] + risen[c]] = direct[at[c] : at[c] + risen[c]]

    def induce(those: np.ndarray) -> None:
        before = those[those > 0] - 1
        before = before[~rising[before]]
        if len(before):
            bucket = text[before]
            if len(before) > 1:
                order = np.argsort(bucket, kind="stable")
                before, bucket = before[order], bucket[order]
            own = np.bincount(bucket, minlength=256)
            out[(head - (np.cumsum(own) - own))[bucket] + np.arange(len(before))] = before
            head[:] += own

    out[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    for c in np.flatnonzero(size):
        done = start[c]
        while done < head[c]:  # a run of one byte is induced a byte at a time
            done, low = head[c], done
            induce(out[low:done])
        induce(out[tail[c] : tail[c] + risen[c]])
    return out[out < n - window]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each position of ``order`` shares with the one before it (0 for the first)."""
    n, eights = len(text), _eights(text)
    before = np.full(n + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    paired = before[:n] >= 0
    last = paired & (before[1:] != before[:-1] + 1)  # the next position's neighbour is another one
    ends = np.flatnonzero(last)
    shared, open_ = np.zeros(n, np.int64), ends
    for depth in range(0, most, 8):
        a, b = open_ + depth, before[open_] + depth
        fit = (a < n) & (b < n)
        open_, a, b = open_[fit], a[fit], b[fit]
        x = eights[a] ^ eights[b]
        same = 8 - np.searchsorted(_BYTE_ENDS, x, "right")
        shared[open_] += np.minimum(same, n - np.maximum(a, b))
        open_ = open_[same == 8]
    places = np.arange(n)
    equal = np.zeros(n, bool)
    equal[paired] = text[places[paired]] == text[before[:n][paired]]
    event = np.where(last | ~equal, places, n)
    following = np.minimum.accumulate(event[::-1])[::-1]  # up to there the neighbours run in parallel
    shared = np.where(paired, following - places + np.where(following < n, np.r_[np.where(equal, shared, 0), 0][following], 0), 0)
    return np.minimum(shared, most)[order]


def repeated(text: np.ndarray, fits: np.ndarray, window: int) -> np.ndarray:
    """True for positions that ``fits`` and whose next ``window`` bytes stand at another such position, too."""
    order = suffix_order(text, window)
    order = order[fits[order]]
    twice = common_prefixes(text, order, window) >= window
    out = np.zeros(len(text), bool)
    out[order[twice]] = True
    out[order[:-1][twice[1:]]] = True
    return out


# ---- segments ------------------------------------------------------------------------------


def _runs(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of k values from each position on."""
    out, done, power, step, base = None, 0, values, 1, _BASE
    while step <= k:
        if k & step:
            tail = power[done:]
            out = tail if out is None else out[: len(tail)] * _U(base) + tail
            done += step
        if step * 2 <= k:
            power = power[:-step] * _U(base) + power[step:] if len(power) > step else power[:0]
        step, base = step * 2, base * base % (1 << 64)
    return mix(out)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least of ``span`` values from each position on."""
    reach = 1
    while reach * 2 <= span:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (span - reach)], values[span - reach :]) if reach < span else values


def _flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and where each begins (one more than rows)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _pieces(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Rows, base of the first, bytes and edges of slices; a long text comes in pieces that overlap by a window."""
    for low, high in slices(column.cast(pa.large_string()), _PIECE):
        data, edges = _flat_bytes(column[low:high])
        for base in range(0, max(1, len(data) - window + 1), _PIECE) if high == low + 1 else (0,):
            part = data[base : base + _PIECE + window - 1] if high == low + 1 else data
            yield np.arange(low, high), base, part, np.array([0, len(part)]) if high == low + 1 else edges


def _segments(data: np.ndarray, edges: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, anchor, content hash, start in the row, number of windows."""
    none = (np.empty(0, np.int64),) * 5
    if len(data) < window:
        return none
    grams = _runs(_BYTES[data], gram)
    place = _least(((grams >> _U(_PLACE)) << _U(_PLACE)) | np.arange(len(grams), dtype=_U), window - gram + 1)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(place)]
    inside = np.flatnonzero(np.arange(len(place)) + window <= edges[row + 1])
    if not len(inside):
        return none
    row, place = row[inside], (place[inside] & _U((1 << _PLACE) - 1)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    length = np.diff(np.r_[at, len(inside)])
    begin, row, place = inside[at], row[at], place[at]
    sums = np.r_[_U(0), np.cumsum(grams)]
    last = begin + length + window - gram
    content = mix(sums[last] - sums[begin] + mix(grams[begin] ^ mix(grams[last - 1] + length.astype(_U) + ((place - begin).astype(_U) << _U(32)))))
    return row, grams[place], content, begin - edges[row], length


def _index(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for rows, base, data, edges in _pieces(batch.column(2), window):
                row, anchor, content, start, n = _segments(data, edges, window, gram)
                if len(row):
                    yield pa.RecordBatch.from_pydict({"k1": k1[rows[row]], "k2": k2[rows[row]], "anchor": anchor.view(np.int64), "content": content.view(np.int64), "span": ((start + base) << _COUNT) + n})

    return run


def _wanted(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of every struct in a column of lists, and the structs' fields."""
    lengths = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), lengths), {f.name: np.asarray(flat.field(f.name)) for f in flat.type}


def _single_windows(window: int):
    """Each window of the listed segments as a segment of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, edges = _flat_bytes(batch.column(2))
            row, of = _wanted(batch.column(3))
            for k in range(len(row)):
                start, count = of["span"][k] >> _COUNT, of["span"][k] & ((1 << _COUNT) - 1)
                low = edges[row[k]] + start
                own = _runs(_BYTES[data[low : low + count + window - 1]], window)
                n = len(own)
                yield pa.RecordBatch.from_pydict({"k1": np.repeat(k1[row[k]], n), "k2": np.repeat(k2[row[k]], n), "anchor": own.view(np.int64), "content": mix(own ^ _U(_BASE)).view(np.int64), "span": ((start + np.arange(n)) << _COUNT) + 1})

    return run


def _bodies(window: int):
    """The bytes of the listed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = _flat_bytes(batch.column(0))
            row, of = _wanted(batch.column(1))
            if not len(row):
                continue
            key = np.stack([of["anchor"], of["content"]])
            _, once = np.unique(key, axis=1, return_index=True)  # rows alike in id and text name the same segments
            low = edges[row[once]] + (of["span"][once] >> _COUNT)
            high = low + (of["span"][once] & ((1 << _COUNT) - 1)) + window - 1
            held = [data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"anchor": of["anchor"][once], "content": of["content"][once], "often": of["often"][once], "body": pa.array(held, pa.binary())})

    return run


def _sorted_segments(window: int):
    """Repeated windows of each segment, as offset * 2^32 + count."""

    def solve(part: pa.Table) -> pa.RecordBatch | None:
        part = part.combine_chunks()
        anchor, content = (np.asarray(part.column(k)) for k in range(2))
        part = part.filter(pa.array(np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
        data, edges = _flat_bytes(pa.concat_arrays(part.column(3).chunks))
        first = np.zeros(len(data) + 1, np.int8)
        first[edges[:-1]] += 1
        first[edges[1:] - window + 1] -= 1
        fits = np.cumsum(first[:-1], dtype=np.int8) > 0
        often = np.repeat(np.asarray(part.column(2).combine_chunks().cast(pa.uint8())) > 0, np.diff(edges))
        twice = np.r_[False, repeated(data, fits, window) | (often & fits)]
        low = np.flatnonzero(twice[1:] & ~twice[:-1])  # a segment's end, which fits no window, parts it from the next
        high = np.flatnonzero(twice[1:] & ~np.r_[twice[2:], False]) + 1
        row = np.searchsorted(edges, low, "right") - 1
        if not len(row):
            return None
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        runs = pa.ListArray.from_arrays(np.r_[begin, len(row)].astype(np.int32), pa.array(((low - edges[row]) << 32) + high - low))
        return pa.RecordBatch.from_arrays([np.asarray(part.column(0))[row[begin]], np.asarray(part.column(1))[row[begin]], runs], ["anchor", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(3).nbytes
            if size < _BATCH:
                continue
            table = pa.Table.from_batches(held)
            anchor = np.asarray(table.column(0))
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                if (found := solve(table.slice(0, cut))) is not None:
                    yield found
                held, size = table.slice(cut).to_batches(), sum(x.column(3).nbytes for x in table.slice(cut).to_batches())
        if held and (found := solve(pa.Table.from_batches(held))) is not None:
            yield found

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = _flat_bytes(batch.column(1))
            lists = batch.column(2).fill_null([])
            at, values = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten())
            removed, spans, kept = [], [], []
            for k in range(len(lists)):
                text, own = data[edges[k] : edges[k + 1]], np.sort(values[at[k] : at[k + 1]])
                low, high = own >> 32, (own >> 32) + (own & 0xFFFFFFFF) + window - 1
                reach = np.maximum.accumulate(high)
                new = np.r_[True, low[1:] > reach[:-1]][: len(low)]
                begin, end = low[new], reach[np.r_[new[1:], True][: len(low)]]
                removed.append(int((end - begin).sum()))
                spans.append(len(begin))
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(edges)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``marked``, true for all whose k2 is among the keys' and for few others: a bitmap of at most 2^``_MOST_BITS`` bits.

    Texts that have nothing to meet so stay where they are; with more keys than
    bits more of them travel, and results are the same.
    """
    bits = 1 << min(_MOST_BITS, max(15, (8 * keys.count()).bit_length()))
    place = F.pmod("k2", F.lit(bits))
    bucket, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = keys.select(bucket.alias("bucket"), position.alias("position")).groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("map"))
    met = rows.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket", "left").withColumn("position", position)
    byte = "cast(conv(hex(substring(map, cast(position div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = F.coalesce(F.expr(f"shiftright({byte}, cast(position % 8 as int)) & 1 = 1"), F.lit(False))
    return met.withColumn("marked", marked).drop("bucket", "position", "map")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 40, most_kinds: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row."""
    if not 1 <= gram <= window < 1 << _COUNT:
        raise ValueError("1 <= gram <= window < 2^16")
    spark, keyed = docs.sparkSession, _keyed(docs, id_col, text_col)
    texts, place = keyed.select("k1", "k2", "text"), F.struct("k1", "k2", "span")
    index_path = new_path(spark, "segments")
    index = materialize(texts.mapInArrow(_index(window, gram), _SEGMENT), "segments", path=index_path)
    again = index.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1").select("anchor")
    spans = materialize(index.join(again, "anchor"), "repeated-anchors")
    discard(spark, index_path)

    def kinds(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor", "content").agg((F.count("*") > 1).alias("often"), F.min(place).alias("at")).select("anchor", "content", "often", "at.*")

    distinct = materialize(kinds(spans), "kinds")
    hot = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most_kinds).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    if not hot.isEmpty():
        split = materialize(spans.join(hot, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("span")).alias("wanted")), "hot-spans")
        windows = _marked(texts, split).where("marked").join(split.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_single_windows(window), _SEGMENT)
        windows = materialize(windows, "windows")
        same = windows.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1").select("anchor")
        windows = windows.join(same, "anchor").select(spans.columns)
        spans = materialize(spans.join(hot, "anchor", "left_anti").unionByName(windows), "segments-split")
        distinct = materialize(kinds(spans), "kinds-split")

    lists = distinct.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "content", "often", "span")).alias("wanted"))
    bodies = _marked(texts, distinct).where("marked").join(lists.hint("shuffle_hash"), ["k1", "k2"]).select("text", "wanted").mapInArrow(_bodies(window), _BODY)
    found = bodies.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(_sorted_segments(window), _FOUND)
    found = materialize(found, "repeated-windows")
    runs = F.transform("runs", lambda x: x + F.shiftleft(F.shiftright("span", _COUNT), 32)).alias("runs")
    removed = spans.join(found, ["anchor", "content"]).select("k1", "k2", runs).groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    removed = materialize(removed, "removed")
    marked = _marked(keyed, removed)
    touched = marked.where("marked").join(removed.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "runs")
    whole = marked.where("not marked").select("doc_id", "text", F.lit(None).cast("array<long>").alias("runs"))
    return touched.unionByName(whole).mapInArrow(_remove(window), _KEPT)
