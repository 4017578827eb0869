"""Phrases whose words stand together more often than apart (broadcast double-array tries).

Texts are cut into words once; what later passes read is the words' 64-bit
hashes with zeros where a piece ends.  Phrases of k words are counted in one
pass: the frequent phrases of k-1 words, the only ones that a frequent phrase
can begin and end with, are broadcast as a double-array trie, ``t = base[s] + c``
with ``check[t] = s``.  numpy moves the states of all text positions by one word
at a time; where a position *and* the one after it end in accepting states, a
candidate of k words stands.  A task counts the pairs of accepting state and
next word with ``bincount``, and Spark sums the tasks' counts.  Most phrases of
frequent parts are rare, so a pass before counts them in hashed buckets, about
one for every ``_PER_BUCKET`` words; a phrase in a bucket of fewer than
``least`` is no candidate.  Full buckets are a bitmap of 2^``_MOST_BUCKETS``
bits at most; larger corpora take several passes, each for a class by hash.

A broadcast trie holds ``trie_phrases`` phrases at most.  More are dealt to
several tries by hash, each with a pass of its own over the words; the check of
the later phrase, which may be in another trie, is then left to the sums.

Words count as equal when their hashes are (chance about v^2 / 2^65 for v
distinct words).  Products of counts are decimals of 38 digits.

Defined results: a null text is empty, a null language ``und``; equal rows count
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, settings
from .suffixes import _flat_bytes
from .wordhash import _word_hashes, mix, slices

_U = np.uint64
_SLICE = 1 << 19
_SALTS = 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BLANK = _ENDS.copy()
_BLANK[[9, 32]] = True
_WORDS = "lang string, words binary, row long, names array<struct<h: long, word: string, n: long>>"
_NAME_BITS, _ROW_BITS = 22, 20  # of a name's place: its number in a row, and a row's in a task
_PER_BUCKET, _CHUNK, _MOST_BUCKETS = 4, 16, 28
_FLUSH, _HELD = 1 << 18, 1 << 20  # counts, and buckets, that a task holds at a time
_TEXTS, _LONG_ROWS = "1000", "8"  # rows that go to a Python worker at a time
_TASK_BYTES = "128m"  # words that a task sums before it gives its counts
_ROWS = 1 << 15


# ---- words ---------------------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per language and slice of texts: hashes of the words in order, and each word with its count."""
    count, task = 0, TaskContext.get().partitionId() if TaskContext.get() else 0
    for batch in batches:
        langs = batch.column(0).fill_null("und").dictionary_encode()
        for low, high in slices(batch.column(1).cast(pa.large_string()), _SLICE):
            own = langs[low:high]
            for k in np.unique(np.asarray(own.indices)).tolist():
                row = _words(*_flat_bytes(batch.column(1)[low:high].filter(pa.array(np.asarray(own.indices) == k))))
                if row is None:
                    continue
                words, names = row
                for at in range(0, len(names), 1 << _NAME_BITS):  # a long text may have more names than a row holds
                    part = names[at : at + (1 << _NAME_BITS)]
                    lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                    place = pa.array([(task << _ROW_BITS) + count], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([own.dictionary[k].as_py()]), pa.array([b"" if at else words], pa.binary()), place, lists], ["lang", "words", "row", "names"])
                    count += 1


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[bytes, pa.StructArray] | None:
    data = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    inside = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1
    if not len(starts):
        return None
    hashes = _word_hashes(data, starts, ends)
    hashes[hashes == 0] = _U(1)
    piece = np.cumsum(_ENDS[data])[starts] + np.searchsorted(edges, starts, "right")
    new = np.flatnonzero(np.diff(piece)) + 1
    known, at, count = np.unique(hashes, return_index=True, return_counts=True)
    held = data.tobytes()
    spelled = pa.array([held[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
    names = pa.StructArray.from_arrays([pa.array(known.view(np.int64)), spelled, pa.array(count, pa.int64())], ["h", "word", "n"])
    return np.insert(hashes, new, _U(0)).tobytes(), names


# ---- tries ---------------------------------------------------------------------------------


class DoubleArray:
    """A trie of rows of codes, each row a phrase; ``roots`` are its first codes' states."""

    def __init__(self, roots: np.ndarray, codes: np.ndarray, n_codes: int):
        """``roots``: number of each phrase's root; ``codes``: its words, all rows of one length."""
        self.n_codes, n_roots = n_codes, int(roots.max(initial=-1)) + 1
        size = n_roots * (n_codes + 1) + 2 * codes.size + n_codes + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self._used, self._free, self._end = np.zeros(size, bool), 0, n_roots
        self._used[:n_roots] = True
        self._scatter = np.random.default_rng(0).integers(0, 1 << 40, 2048)
        state = roots.astype(np.int64)
        for k in range(codes.shape[1]):
            state = self._level(state, codes[:, k])
        top = self._end + n_codes + 1
        self.base, self.check = self._sized(self.base, top, 0), self._sized(self.check, top, -1)
        self.phrase = np.full(top, -1, np.int32)
        self.phrase[state] = np.arange(len(state))
        del self._used, self._scatter

    @staticmethod
    def _sized(values: np.ndarray, n: int, fill: int) -> np.ndarray:
        return values[:n] if n <= len(values) else np.r_[values, np.full(n - len(values), fill, values.dtype)]

    def _level(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Add the children ``code`` of ``state`` and return each row's child."""
        edge, back = np.unique(state * self.n_codes + code, return_inverse=True)
        parent, child = edge // self.n_codes, edge % self.n_codes
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]][: len(parent)])
        count = np.diff(np.r_[first, len(parent)])
        base = np.empty(len(first), np.int64)
        for g in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
            own = child[first[g] : first[g] + count[g]]
            base[g] = self._fit(own)
            self._take(base[g] + own)
        single = np.flatnonzero(count == 1)
        own = child[first[single]]
        self._reserve(self._end + self.n_codes + len(own) + 1)
        slots = np.flatnonzero(~self._used[self.n_codes :][: self._end + len(own)])[: len(own)] + self.n_codes  # a base is never negative
        base[single] = slots - own
        self._take(slots)
        self.base[parent[first]] = base
        slot = np.repeat(base, count) + child
        self.check[slot] = parent
        return slot[back]

    def _reserve(self, n: int) -> None:
        if n > len(self._used):
            n = max(n, len(self._used) * 3 // 2)
            self.base, self.check, self._used = self._sized(self.base, n, 0), self._sized(self.check, n, -1), np.r_[self._used, np.zeros(n - len(self._used), bool)]

    def _take(self, slots: np.ndarray) -> None:
        self._used[slots] = True
        self._end = max(self._end, int(slots.max(initial=-1)) + 1)

    def _fit(self, own: np.ndarray) -> int:
        """A base with all children's slots free, of the first and of scattered ones; past the end where none is found."""
        self._reserve(self._end + 2 * self.n_codes + 2)
        while self._used[self._free]:
            self._free += 1
        tried = np.flatnonzero(~self._used[self._free : self._free + 4096])[:256] + self._free - own[0]
        tried = np.r_[tried, self._scatter[: max(64, 2048 // len(own))] % (self._end + 1)]
        tried = tried[(tried >= 0) & (tried < self._end)]
        free = ~self._used[tried[:, None] + own].any(axis=1)
        return int(tried[free.argmax()]) if free.any() else self._end

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Each state's child, or -1."""
        to = self.base[state] + code
        return np.where(self.check[to] == state, to, -1)


def _buckets(lang: str, words: np.ndarray, at: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bucket of the ``length`` words from each place on, and the hash that says their class."""
    phrase = mix(words[at] ^ _U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")))
    for k in range(1, length):
        phrase = mix(phrase + words[at + k])
    return (phrase >> _U(64 - bits)).astype(np.int64), phrase


def _phrase_buckets(length: int, bits: int, classes: int, own: int):
    """Buckets of all phrases of ``length`` words inside pieces, by chunk: offsets of two bytes each."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(held))
        chunk = (every >> _CHUNK)
        at = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]][: len(chunk)])
        offsets = (every & ((1 << _CHUNK) - 1)).astype("<u2")
        parts = [offsets[a:b].tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(every)], strict=True)] if len(at) else []
        return pa.RecordBatch.from_arrays([pa.array(chunk[at].astype(np.int64)), pa.array(parts, pa.binary())], ["chunk", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.empty(0, np.uint32)], 0
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = np.frombuffer(raw.as_buffer(), _U)
                filled = words != 0
                inside = filled[: max(0, len(words) - length + 1)].copy()
                for k in range(1, length):
                    inside &= filled[k : k + len(inside)]
                bucket, phrase = _buckets(lang, words, np.flatnonzero(inside), length, bits)
                held.append(bucket[phrase % _U(classes) == own].astype(np.uint32))
                size += len(held[-1])
                if size > _HELD:
                    yield rows(held)
                    held, size = held[:1], 0
        yield rows(held)

    return run


def _full_buckets(least: int):
    """A bitmap per chunk of the buckets with at least ``least`` phrases; rows come sorted by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(1 << _CHUNK, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["chunk", "full"])

        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != at:
                    if at is not None:
                        yield row()
                    at = chunk
                    sums[:] = 0
                sums += np.bincount(np.frombuffer(raw.as_buffer(), "<u2"), minlength=1 << _CHUNK)
        if at is not None:
            yield row()

    return run


def _count(shipped, length: int, alone: bool, sieve):
    """Counts of ``length`` words that begin, and if the trie is alone also end, with a phrase of it, and pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, phrases, langs, roots, trie = shipped.value
        bits, classes, own, full = sieve.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            phrase, last, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((last, phrase))
            phrase, last, n = phrase[order], last[order], n[order]
            new = np.r_[True, (phrase[1:] != phrase[:-1]) | (last[1:] != last[:-1])][: len(order)]
            return phrase[new], last[new], np.bincount(np.cumsum(new) - 1, n, int(new.sum())).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            every = merged()
            for at in range(0, len(every[0]), _ROWS):
                phrase, last, n = (x[at : at + _ROWS] for x in every)
                words = np.zeros((5, len(n)), _U)
                words[: length - 1], words[length - 1] = phrases[phrase].T, last
                yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(roots[phrase])), *(pa.array(x.view(np.int64)) for x in words), pa.array(n)], ["lang", "h1", "h2", "h3", "h4", "h5", "n"])

        number = {lang: k for k, lang in enumerate(langs)}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in number:
                    continue
                words = np.frombuffer(raw.as_buffer(), _U)
                n = len(words) - length + 1
                if n <= 0:
                    continue
                code = np.minimum(np.searchsorted(known, words), len(known) - 1)
                code[known[code] != words] = -1
                at = np.flatnonzero(code[: n + 1] >= 0)
                state = trie.step(np.full(len(at), number[lang]), code[at])
                for k in range(1, length - 1):
                    going = (state >= 0) & (code[np.minimum(at + k, len(code) - 1)] >= 0) & (at + k < len(code))
                    at, state = at[going], state[going]
                    state = trie.step(state, code[at + k])
                at, state = at[state >= 0], state[state >= 0]
                accepts = np.zeros(n + 1, bool)
                accepts[at] = True
                here = (at < n) & (accepts[np.minimum(at + 1, n)] if alone else words[np.minimum(at, n - 1) + length - 1] != 0)
                at, state = at[here], state[here]
                bucket, phrase = _buckets(lang, words, at, length, bits)
                here = (phrase % _U(classes) == own) & ((full[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 > 0)
                at, state = at[here], state[here]
                held.append((trie.phrase[state], words[at + length - 1], np.ones(len(at), np.int64)))
                size += len(at)
                if size > _FLUSH:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > _FLUSH // 2:
                        yield from rows()
                        held, size = [], 0
        if held:
            yield from rows()

    return run


_COUNTED = "lang string, h1 long, h2 long, h3 long, h4 long, h5 long, n long"


def _sieves(words: DataFrame, length: int, n: int, least: int):
    """For each class of phrases a broadcast (bits, classes, class, bitmap of full buckets)."""
    spark = words.sparkSession
    wanted = max(_CHUNK, int(np.ceil(np.log2(max(1, int(n / _PER_BUCKET)) + 1))))
    bits, classes = min(wanted, _MOST_BUCKETS), 1 << max(0, wanted - _MOST_BUCKETS)
    for own in range(classes):
        found = words.select("lang", "words").mapInArrow(_phrase_buckets(length, bits, classes, own), "chunk long, offsets binary")
        dealt = found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_full_buckets(least), "chunk long, full binary")
        full = np.zeros(1 << (bits - 3), np.uint8)
        for batch in dealt.toArrow().to_batches():  # 2^bits bits in all
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                full[chunk << (_CHUNK - 3) : (chunk + 1) << (_CHUNK - 3)] = np.frombuffer(raw.as_buffer(), np.uint8)
        yield spark.sparkContext.broadcast((bits, classes, _U(own), full))


def _shipped_trie(own: DataFrame, length: int):
    """The phrases (lang, p) of ``length`` words as a broadcast trie, with the hashes that its codes stand for."""
    part = own.select("lang", "p").toArrow().combine_chunks()  # bounded by trie_phrases
    if not part.num_rows:
        return None
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    langs, lists = one(one(part.column(0)).dictionary_encode()), one(part.column(1))
    phrases = np.asarray(one(lists).flatten()).view(_U).reshape(part.num_rows, length)
    known, code = np.unique(phrases, return_inverse=True)
    roots = np.asarray(langs.indices).astype(np.int64)
    trie = DoubleArray(roots, code.reshape(phrases.shape).astype(np.int64), len(known))
    return own.sparkSession.sparkContext.broadcast((known, phrases, langs.dictionary.to_pylist(), roots, trie))


def _next_level(words: DataFrame, shorter: DataFrame, length: int, n_words: int, least: int, trie_phrases: int) -> DataFrame:
    """Phrases of ``length`` words found ``least`` times: lang, p (hashes), a."""
    counted, tries = None, -(-shorter.count() // trie_phrases)
    sieves = list(_sieves(words, length, n_words, least))
    for k in range(tries):
        shipped = _shipped_trie(shorter if tries == 1 else shorter.where(F.pmod(F.xxhash64("lang", "p"), F.lit(tries)) == k), length - 1)
        for sieve in sieves if shipped is not None else []:
            found = words.select("lang", "words").mapInArrow(_count(shipped, length, tries == 1, sieve), _COUNTED)
            counted = found if counted is None else counted.unionByName(found)
    keys = [f"h{k}" for k in range(1, length + 1)]
    dealt = counted.select("lang", *keys, "n").repartition("lang", *keys)  # tasks have summed their own rows already
    sums = dealt.groupBy("lang", *keys).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return materialize(sums.select("lang", F.array(*keys).alias("p"), "a"), f"phrases-{length}")


# ---- the operator --------------------------------------------------------------------------


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) in whole numbers."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast((cast(1000 as decimal(4, 0)) * {wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)}) as long)")


def mine(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, first: int = 2000, trie_phrases: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases of 2 to ``longest`` words by score."""
    if not 2 <= longest <= 5:
        raise ValueError("2 <= longest <= 5")
    spark = docs.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=_TEXTS):
        words = materialize(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(_encode, _WORDS), "words")
    named = words.select("lang", "row", F.posexplode("names").alias("k", "name")).select("lang", "name.*", (F.shiftleft("row", _NAME_BITS) + F.col("k")).alias("place"))
    with settings(spark, spark__sql__parquet__columnarReaderBatchSize=_LONG_ROWS):
        total = materialize(words.select("lang", F.aggregate("names", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent = named.groupBy("lang", "h").agg(F.sum("n").alias("a"), F.min("place").alias("place")).where(F.col("a") >= least)
        frequent = materialize(frequent, "frequent-words")
    n_words = total.agg(F.sum("n")).first()[0] or 0
    levels = [frequent.select("lang", F.array("h").alias("p"), "a")]
    for length in range(2, longest + 1):
        if levels[-1].isEmpty():
            break
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=_LONG_ROWS, spark__sql__files__maxPartitionBytes=_TASK_BYTES, spark__sql__parquet__columnarReaderBatchSize=_LONG_ROWS):
            levels.append(_next_level(words, levels[-1], length, n_words, least, trie_phrases))
    known, found = levels[0], levels[0].limit(0)
    for k, level in enumerate(levels[1:], 1):
        found = level if k == 1 else found.unionByName(level)
        known = known.unionByName(level) if k + 1 < len(levels) else known

    size = F.size("p")
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")
    halves = found.select("lang", "p", "a", cut).select("*", F.slice("p", F.lit(1), F.col("cut")).alias("before"), F.slice("p", F.col("cut") + 1, size - F.col("cut")).alias("after"))
    halves = halves.join(known.select("lang", F.col("p").alias("before"), F.col("a").alias("l")), ["lang", "before"])
    halves = halves.join(known.select("lang", F.col("p").alias("after"), F.col("a").alias("r")), ["lang", "after"])
    halves = halves.join(total, "lang").select("lang", "p", "a", "n", F.struct(_score("a", "n", "l", "r").alias("score"), "cut", "l", "r").alias("at"))
    scored = halves.groupBy("lang", "p").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("at").alias("at"))

    longer = found.where(size > 2)
    part = longer.select("lang", "p", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("k")).select("lang", "p", "a", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("at"))
    held = part.groupBy("lang", F.slice("p", F.col("at"), F.col("k")).alias("p")).agg(F.max("a").alias("longer"))
    scored = scored.join(held, ["lang", "p"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) < F.col("a"))
    scored = scored.select("lang", "p", "a", "at.l", "at.r", "n", "at.score")

    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(_SALTS))).orderBy(F.desc("score"), F.desc("a"))
    best = materialize(scored.withColumn("ahead", F.rank().over(salted)).where(F.col("ahead") <= first).drop("ahead"), "best-phrases")  # ties stay for the order by phrase
    used = best.select("lang", F.explode("p").alias("h")).distinct().join(frequent.select("lang", "h", "place"), ["lang", "h"])
    names = named.select("place", "word").join(used, "place").select("lang", "h", "word")  # one place a word
    spelled = best.select("lang", "p", F.posexplode("p").alias("k", "h")).join(names, ["lang", "h"])
    texts = spelled.groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(texts, ["lang", "p"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
