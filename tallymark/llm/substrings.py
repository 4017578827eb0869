"""Removing word sequences that occur more than once (blocks cut by content).

This stands in for relative Lempel-Ziv parsing: every document is compared with
blocks of all documents, but no factor keeps a position in a reference document
and none is extended word by word.  Blocks are chosen by content: of the windows
of ``window`` words, those with the same least-hashed word group (the *anchor*)
in a row make one block, so both copies of a passage are cut into the same
blocks wherever they stand.  The index counts blocks by anchor.  Runs of blocks
whose anchors lead to equal blocks only are duplicate spans as they stand; where
an anchor leads to different blocks, the *boundary* of such a run, windows are
compared one by one.  Repeats inside one document are found where its text is
read again.

What is shuffled is a row per block (about one in twelve words), a row per
window of boundary blocks and the texts twice; hot blocks are counted before
they are shuffled.  Blocks and windows count as equal when two independent
64-bit hashes are.

Defined results: a null text has no words; equal rows are duplicates of each
other; rows of one id are documents of their own; a text of less than
``window`` words stays whole; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, new_path
from .wordhash import Words, mix, slices, words_of

_U = np.uint64
_PLACE = 28  # low bits of a sort key that hold the position
_BLOCK = "k1 long, k2 long, anchor long, block long, start int, n int"
_WINDOW = "k1 long, k2 long, anchor long, content long, start int"
_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2: the identity of a row by id and text, never null."""
    name, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(name.alias("doc_id"), F.coalesce(name, F.lit(0)).alias("k1"), F.xxhash64(text, name.isNull()).alias("k2"), text.alias("text"))


def _anchored(words: Words, window: int, group: int) -> tuple[np.ndarray, ...]:
    """For each window inside a row: its first word, its anchor's position and the anchor's hash, and the window's hash."""
    whole = np.flatnonzero(words.fits(window))
    if not len(whole):
        return whole, whole, np.empty(0, _U), np.empty(0, _U)
    hashes, span = words.runs(group), window - group + 1
    least = ((hashes >> _U(_PLACE)) << _U(_PLACE)) | np.arange(len(hashes), dtype=_U)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    place = (least[whole] & _U((1 << _PLACE) - 1)).astype(np.int64)
    return whole, place, hashes[place], words.runs(window)[whole]


def _blocks(words: Words, window: int, group: int) -> tuple[np.ndarray, ...]:
    """row, anchor hash, block hash, first window (counted in its row), number of windows; once per row and content."""
    whole, place, anchor, content = _anchored(words, window, group)
    if not len(whole):
        return (np.empty(0, np.int64),) * 5
    row = words.row[whole]
    new = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(whole)])
    sums = np.r_[_U(0), np.cumsum(mix(content), dtype=_U)]
    block = mix(sums[at + n] - sums[at] + n.astype(_U) * _U(0xA0761D6478BD642F) + (place[at] - whole[at]).astype(_U) * _U(0xE7037ED1A0B428DB))
    _, once = np.unique(mix(block ^ mix(row[at].astype(_U) + _U(1))), return_index=True)
    once.sort()
    at = at[once]
    return row[at], anchor[at], block[once], whole[at] - words.first[row[at]], n[once]


def _index(window: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            for low, high in slices(texts):
                row, anchor, block, start, n = _blocks(words_of(texts[low:high]), window, group)
                if len(row):
                    yield pa.RecordBatch.from_pydict({"k1": k1[low:high][row], "k2": k2[low:high][row], "anchor": anchor.view(np.int64), "block": block.view(np.int64), "start": start.astype(np.int32), "n": n.astype(np.int32)})

    return run


def _flat(lists: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Row (from 0) and value of every element of a list column's rows."""
    part = lists[low:high].fill_null([]) if lists.null_count else lists[low:high]
    values, lengths = np.asarray(part.flatten()), np.diff(np.asarray(part.offsets))
    return np.repeat(np.arange(high - low), lengths), values.astype(np.int64)


def _boundary(window: int, group: int):
    """Windows of the boundary blocks, once per row and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, texts, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2), batch.column(3)
            for low, high in slices(texts):
                words = words_of(texts[low:high])
                row, value = _flat(lists, low, high)
                whole, _, anchor, content = _anchored(words, window, group)
                wanted = np.zeros(len(words.row) + 1, np.int32)
                begin = words.first[row] + (value >> 8)
                np.add.at(wanted, begin, 1)
                np.add.at(wanted, begin + (value & 255), -1)
                pick = np.flatnonzero(np.cumsum(wanted)[whole] > 0)
                of = words.row[whole[pick]]
                _, once = np.unique(mix(content[pick] ^ mix(of.astype(_U) + _U(1))), return_index=True)
                pick, of = pick[once], of[once]
                if len(pick):
                    yield pa.RecordBatch.from_pydict({"k1": k1[low:high][of], "k2": k2[low:high][of], "anchor": anchor[pick].view(np.int64), "content": content[pick].view(np.int64), "start": (whole[pick] - words.first[of]).astype(np.int32)})

    return run


def _removed(words: Words, row: np.ndarray, value: np.ndarray, window: int) -> np.ndarray:
    """True for each word to remove: spans found in the corpus, and repeats of all their windows inside the row."""
    whole = np.flatnonzero(words.fits(window))
    content = words.runs(window)[whole]
    own = mix(content ^ mix(words.row[whole].astype(_U) + _U(1)))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    group = np.empty(len(order), np.int64)
    if len(order):
        group[order] = np.cumsum(np.r_[0, ~same])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    found = np.zeros(len(words.row) + 1, np.int32)
    begin = words.first[row] + (value >> 8)
    np.add.at(found, begin, 1)
    np.add.at(found, begin + (value & 255), -1)
    hit = np.cumsum(found)[whole] > 0
    marked = np.zeros(len(order) + 1, bool)
    marked[group[hit]] = True  # an equal window elsewhere in the row shares the fate
    cover = np.zeros(len(words.row) + 1, np.int32)
    removed = whole[twice | marked[group]]
    cover[removed] += 1
    np.add.at(cover, removed + window, -1)
    return np.cumsum(cover)[:-1] > 0


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, lists = batch.column(0), batch.column(1), batch.column(2)
            for low, high in slices(texts):
                words = words_of(texts[low:high])
                gone = _removed(words, *_flat(lists, low, high), window)
                count, kept = [], []
                for k, text in enumerate(texts[low:high].to_pylist()):
                    own = gone[words.first[k] : words.first[k + 1]]
                    held = (text or "").encode().split()
                    count.append(int(own.sum()))
                    kept.append(b" ".join(compress(held, ~own) if count[-1] else held))
                yield pa.RecordBatch.from_arrays([names[low:high].cast(pa.int64()), pa.array(np.diff(words.first)), pa.array(count, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, group: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank) of every row."""
    if not group <= window <= 255:
        raise ValueError("group <= window <= 255")
    spark, keyed = docs.sparkSession, _keyed(docs, id_col, text_col)
    index_path = new_path(spark, "blocks")
    index = materialize(keyed.select("k1", "k2", "text").mapInArrow(_index(window, group), _BLOCK), "blocks", path=index_path)
    families = index.groupBy("anchor").agg(F.count("*").alias("rows"), F.min("block").alias("least"), F.max("block").alias("most")).where("rows > 1")
    families = materialize(families.select("anchor", (F.col("least") != F.col("most")).alias("boundary")), "families")
    span = (F.shiftleft(F.col("start").cast("long"), 8) + F.col("n")).alias("span")
    spans = materialize(index.join(families, "anchor").select("k1", "k2", span, "boundary"), "spans")
    discard(spark, index_path)

    per_text = spans.where("boundary").groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    inside = keyed.select("k1", "k2", "text").join(per_text.hint("shuffle_hash"), ["k1", "k2"])
    windows = materialize(inside.select("k1", "k2", "text", "spans").mapInArrow(_boundary(window, group), _WINDOW), "windows")
    shared = windows.groupBy("anchor", "content").agg(F.count("*").alias("rows")).where("rows > 1").select("anchor", "content")
    shared = materialize(shared, "shared-windows")
    single = (F.shiftleft(F.col("start").cast("long"), 8) + 1).alias("span")
    found = spans.where("not boundary").select("k1", "k2", "span").unionByName(windows.join(shared, ["anchor", "content"]).select("k1", "k2", single))
    found = materialize(found.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")), "found")
    joined = keyed.join(found.hint("shuffle_hash"), ["k1", "k2"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_remove(window), _KEPT)
