"""Suffix arrays, collocations and hard negatives against brute force, with awkward rows."""

import collections
import functools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import collocations, fuzzylines, hardneg, links, suffixes

DOCS = "doc_id long, text string, lang string, k1 int, anchor string, rank int, a int, p int, h int"


def _frame(spark, rows):
    """Rows of doc_id, text, lang with further columns named like inner ones."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], DOCS)


# ---- suffix arrays


@pytest.mark.parametrize("letters", [b"ab", b"abcd ", bytes(range(256)), b"\0a"])
@pytest.mark.parametrize("window", [1, 3, 8, 9, 20])
def test_suffix_order_and_common_prefixes(letters, window):
    rng = random.Random(f"{letters}{window}")
    for _ in range(15):
        parts = [bytes(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5)]
        parts += [rng.choice(parts)[rng.randrange(5) :] + b"x" for _ in range(3)] + [b"a" * rng.randrange(50)]
        text = np.frombuffer(b"".join(parts), np.uint8)
        order = suffixes.suffix_order(text, window)
        held = text.tobytes() + b"\0" * window
        assert sorted(order) == list(range(len(text)))
        first = [held[i : i + window] for i in order]
        assert first == sorted(first)
        for k, found in enumerate(suffixes.common_prefixes(text, order, window).tolist()):
            a, b = (text[order[k - 1] :][:window], text[order[k] :][:window]) if k else (b"", b"")
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert found == n


def _expected(texts, window):
    """n_bytes, n_removed, n_spans, kept of each text."""
    held = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + window] for t in held for i in range(len(t) - window + 1))
    for t in held:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        yield len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(t, gone, strict=True) if not g)


def _repeats(spark, rows, **how):
    out = suffixes.remove_repeats(_frame(spark, rows), **how).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out)
    want = collections.Counter((r[0], *x) for r, x in zip(rows, _expected([r[1] for r in rows], how.get("window", 200)), strict=True))
    assert got == want


def _letters(rng, n, of="abcdefgh é中"):
    return "".join(rng.choice(of) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    passage, base = _letters(rng, 150), [_letters(rng, rng.randrange(50, 400)) for _ in range(8)]
    out = [*base, base[0], base[1][:100] + "!" + base[1][101:], *(_letters(rng, 40) + passage[k:] + _letters(rng, 40) for k in range(5))]
    out += ["a" * 500, "ab" * 300, "a" * 30 + "b" + "a" * 40, None, "", "short", _letters(rng, 5000) + passage, base[2], base[2]]
    return [(k, t, None) for k, t in enumerate(out)] + [(None, base[3], "x"), (3, base[3], "x"), (3, base[3], "x"), (9, None, None)]


@pytest.mark.parametrize("most_kinds", [0, 2, 64])
def test_repeated_bytes(spark, texts, most_kinds):
    """Also with every anchor split into its windows (0)."""
    _repeats(spark, texts, window=24, gram=6, most_kinds=most_kinds)


def test_repeated_bytes_at_their_limits(spark):
    rng = random.Random(2)
    shared = _letters(rng, 30, "abcdefgh")
    for n in (19, 20, 21):
        _repeats(spark, [(1, "x" + shared[:n] + "y", None), (2, "z" + shared[:n], None)], window=20, gram=5)


def test_segments_of_long_texts(monkeypatch):
    """Texts that come in pieces: every window is in one segment, and equal windows have one anchor."""
    monkeypatch.setattr(suffixes, "_PIECE", 300)
    rng = random.Random(4)
    text = _letters(rng, 2000, "abc")
    anchors, found = collections.defaultdict(set), collections.Counter()
    for _, base, data, edges in suffixes._pieces(pa.array(["short", None, text, "abc" * 150]), 20):
        for row, anchor, _, start, n in zip(*suffixes._segments(data, edges, 20, 5), strict=True):
            for i in range(start, start + n):
                anchors[data[edges[row] + i :][:20].tobytes()].add(int(anchor))
                found[base + i, len(data)] += 1
    assert sum(found.values()) == 1981 + 431 and max(map(len, anchors.values())) == 1


def test_repeated_bytes_of_an_empty_table(spark):
    assert suffixes.remove_repeats(_frame(spark, [])).collect() == []


# ---- collocations


def _phrases(rows, least, first):
    split = str.maketrans(dict.fromkeys(".,;:!?\n\v\f\r", "\n"))
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(split).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    frequent = {k: n for k, n in counts.items() if n >= least}
    longer = collections.Counter()
    for (lang, p), n in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], n)
    found = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) > 1 and longer[lang, p] < a:
            score, _, left, right = min((1000 * a * total[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k, frequent[lang, p[:k]], frequent[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for lang, own in found.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:first]))


def _mined(spark, rows, **how):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in names) for r in collocations.mine(_frame(spark, rows), **how).collect())


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    words = ["New", "york", "city", "the", "of", "été", "中", "a", "A", "hall"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r", " "]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None])) for k in range(120)]
    return [*rows, rows[0], (None, "a a a a a a a a", "en"), (7, "", "fr"), (8, None, "fr"), (9, "...", "de"), (10, "new york city hall " * 400, "en")]


@pytest.mark.parametrize(("trie_phrases", "most"), [(1 << 20, 28), (7, 28), (1 << 20, 16)])
def test_collocations(spark, talk, trie_phrases, most, monkeypatch):
    """Also with many tries a level (7 phrases each), and with several classes of pairs."""
    monkeypatch.setattr(collocations, "_MOST_BUCKETS", most)
    monkeypatch.setattr(collocations, "_PER_BUCKET", 4 if most > 16 else 0.01)
    expected = _phrases(talk, 5, 40)
    assert len(expected) > 60
    assert _mined(spark, talk, least=5, first=40, trie_phrases=trie_phrases) == expected


def test_collocations_without_any(spark):
    assert _mined(spark, []) == [] == _mined(spark, [(1, None, None), (2, "two words", "en")])


def test_collocation_scores_beyond_64_bits(spark):
    big = spark.sql(f"select {3 * 10**12}L a, {10**13}L n, {3 * 10**12}L l, {7 * 10**9}L r").select(collocations._score("a", "n", "l", "r").alias("s"))
    assert big.first().s == 1000 * 3 * 10**12 * 10**13 // (21 * 10**21)


def test_double_array():
    rng = np.random.default_rng(1)
    for n_codes, m, depth in ((50, 200, 3), (3000, 20000, 2), (5, 3, 1)):
        rows = np.unique(np.c_[rng.integers(0, 3, m), rng.zipf(1.3, (m, depth)) % n_codes], axis=0)
        trie = collocations.DoubleArray(rows[:, 0], rows[:, 1:], n_codes)
        held = set(map(tuple, rows.tolist()))
        for asked in (rows, np.c_[rng.integers(0, 3, m), rng.zipf(1.3, (m, depth)) % n_codes]):
            state = asked[:, 0].copy()
            for k in range(depth):
                state = np.where(state >= 0, trie.step(np.maximum(state, 0), asked[:, k + 1]), -1)
            assert ((state >= 0) == np.array([tuple(x) in held for x in asked.tolist()])).all()
            assert (rows[trie.phrase[state[state >= 0]]] == asked[state >= 0]).all()


# ---- hard negatives


def _negatives(rows, anchor, positives=5, negatives=10):
    fit = [(i, y, [int(np.floor(256.0 * x)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, v in fit:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in fit if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            own = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            short = lambda n: n if -(2**63) <= n < 2**63 else None
            out += [(i, j, k + 1, n, short(-s), short(-t)) for k, (t, n, _) in enumerate(own)]
    return collections.Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, a int, j int, rank int, v string, score string"


def _hard(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in rows], VECTORS)
    out = hardneg.mine(frame, F.col("vec_id") % 4 == 0, **how).collect()
    return collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out)


@pytest.mark.parametrize("anchors", [1024, 5])
def test_hard_negatives(spark, anchors):
    """Also in several rounds (5 anchors each)."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = [(k, (centre[k % 3] + rng.normal(size=6) * 0.4).astype("f4").tolist(), int(k * 7 % 3)) for k in range(150)]
    rows += [(200, [0.5] * 6, 1), (201, [0.5] * 6, 1), (202, [0.5] * 6, 2), (203, [0.5] * 6, 2), (204, [], 1), (205, [0.25, 0.5], 2)]
    rows += [(206, None, 1), (208, [0.1] * 6, None), (None, [0.1] * 6, 1), (209, [None] * 6, 1), (210, [float("nan")] * 6, 1), (211, [float("inf")] * 6, 1)]
    rows += [(212, [70000.0, -1e6, 0, 0, 0, 0], 1), (213, [1e30] * 6, 2), (216, [5000.0] * 6, 2), rows[5], rows[5]]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got, expected = _hard(spark, rows, anchors=anchors), _negatives(rows, lambda i: i % 4 == 0)
    assert len(expected) > 300
    assert got == expected


def test_hard_negatives_without_any(spark):
    assert not _hard(spark, []) and not _hard(spark, [(1, [1.0], 1)]) and not _hard(spark, [(4, [1.0], 1)])


def test_spanning_tree_is_a_least_one():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (40, 3)).astype(float)
    order, parent, length = hardneg.spanning_tree(points)
    assert sorted(order) == list(range(40)) and (parent >= 0).sum() == 39
    place = {int(a): k for k, a in enumerate(order)}
    assert all(parent[a] < 0 or place[int(parent[a])] < place[int(a)] for a in order)
    edges = sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(40) for b in range(a))
    group, total = list(range(40)), 0.0
    for d, a, b in edges:
        if group[a] != group[b]:
            total, old = total + d, group[b]
            group = [group[a] if g == old else g for g in group]
    assert abs(total - length.sum()) < 1e-6


def test_wide_buckets_lose_no_link(spark):
    members = spark.range(100).selectExpr("7L AS key", "id AS node").unionByName(spark.range(90, 100).selectExpr("8L AS key", "id AS node"))
    seen = links.link(members, lambda pairs: pairs.where("a = 50 and b = 51"))
    assert {(r.node, r.comp) for r in seen.collect()} == {(50, 50), (51, 50)}


def test_lines_of_wide_buckets_meet_as_all_pairs_do(spark, monkeypatch):
    draw = random.Random(3)
    common = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(60):
        words = ["amber", "cedar", "delta"] + draw.sample(common, draw.choice((2, 5, 9)))
        draw.shuffle(words)
        text = " ".join(words)
        rows += [(2 * k, text), (2 * k + 1, text[: draw.randrange(len(text))] + draw.choice("xyz") + text[draw.randrange(len(text)) :] if k % 3 else text.replace("w", "v", 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for narrow in (1, 10**9):
        monkeypatch.setattr(fuzzylines, "link", functools.partial(links.link, narrow=narrow))
        found.append({r.doc_id: r.n_removed for r in fuzzylines.remove_lines(docs).collect()})
    assert found[0] == found[1]
    assert sum(found[0].values()) > 20
