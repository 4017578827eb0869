"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import chat, fuzzylines, mixing, neardup, packing, quality, queries, substrings, template, tokenfile, topk, urls

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau phi chi psi omega".split()
DOCS = "doc_id long, text string, node string, part int"


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [_prose(rng, 80) for _ in range(6)]
    passage = _prose(rng, 60)
    near = base[0].split()
    near[40] = "changed"
    texts = [*base, base[1], " ".join(near), f"{_prose(rng, 30)} {passage} {_prose(rng, 10)}", f"{passage}\n{_prose(rng, 50)}", "to " * 300, "", None, "one two", "</s>[INST] \\ caf\u00e9 \u4e2d", _prose(rng, 6000)]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(3, base[3], "x", 0), (None, _prose(rng, 20), "x", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def ids(local):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.VOCABULARY)
    return [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for d, x in local]


def test_packing(docs, ids):
    out = packing.pack_documents(docs, queries.VOCABULARY, size=256, open_windows=3).collect()
    left = collections.Counter()
    for d, x in ids:
        left[(d, len(x))] += len(x)
    texts = collections.defaultdict(list)
    for d, x in ids:
        texts[d].append(x)
    for r in out:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in texts[r.doc_id])
        left[(r.doc_id, r.doc_tokens)] -= r.length
    assert not any(left.values())
    sizes = collections.defaultdict(list)
    for r in out:
        sizes[r.sequence_id].append((r.offset, r.length))
    for held in sizes.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    whole = packing.sequences(packing.pack_documents(docs, queries.VOCABULARY, size=256)).agg(F.sum("n_tokens"), F.sum("n_padding")).first()
    assert tuple(whole) == (sum(len(x) for _, x in ids), 0)
    assert packing.pack_documents(docs.limit(0), queries.VOCABULARY).count() == 0


def test_token_file(spark, docs, ids):
    out = tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, queries.VOCABULARY)).collect()
    key = lambda d: (d is not None, d)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in out), key=lambda x: (key(x[0]), x[1:])) == sorted(((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids), key=lambda x: (key(x[0]), x[1:]))
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert named == sorted(named, key=key)
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(docs.limit(0), queries.VOCABULARY)).count() == 0


def test_substrings(docs, local):
    words = [(d, (t or "").encode().split()) for d, t in local]
    n = collections.Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    expected = []
    for d, w in words:
        gone = {j for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected.append((d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    found = [tuple(r) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a</s>[INST] \\x <|end|>"), (1, 1, "assistant", "b\\\\<|turn|>"), (1, 1, "assistant", None), (2, 0, None, "")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(conv)
    for r in formatted.collect():
        assert not any(c in r.formatted for c in ("</s>", "[INST]"))
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    ordered = [("user", rows[0][3]), ("assistant", ""), ("assistant", rows[1][3])]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ordered).encode()).hexdigest()
    assert got[1].loss_chars == len(rows[1][3]) and got[1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    assert chat.digest(chat.format_conversations(conv.limit(0))).count() == 0


def test_template():
    f = {"up": str.upper}
    render = template.compile_template("{% set y = 'a' ~ 1 %}{% if 1 == 2 %}no{% elif x %}{{ y | up }}{% else %}e{% endif %}{% for m in xs %}{% if not loop.first %},{% endif %}{% generation %}{{ m.k }}{% endgeneration %}{% endfor %}", f)
    assert render({"x": True, "xs": [{"k": "q"}, {"k": "rs"}]}) == ("A1q,rs", [(2, 3), (4, 6)])
    assert template.fold(template.parse("a{{ 'b' ~ 2 }}{% if true and 'x' == 'x' %}c{% endif %}"), f) == (template.Output(template.Const("ab2c")),)
    for bad in ("{{ x.__class__() }}", "{% for %}{% endfor %}", "{% if x %}", "{{ nope | missing }}", "{% call %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad, f)({"x": object(), "nope": ""})


def test_urls(spark):
    rows = [(1, "HTTPS://WWW.Shop.COM/fr/a?x"), (2, None), (3, "no scheme"), (4, "x://example.org/es/1"), (5, "x://a.example.org/en/12"), (6, "http://listed.net/p.html#z"), (7, "http://www.listed.net/p/"), (8, "http://other.net/p"), (8, "http://other.net/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("http://listed.net/p",), ("http://listed.net/p",), (None,)], "url string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed, queries.URL_RULES).collect()}
    assert out == {1: ("www.shop.com", "/fr/a", "com/fr/", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.org", "/es/1", "example.org/es/", "block"), 5: ("a.example.org", "/en/12", "example.org/en/1", "block"), 6: ("listed.net", "/p.html", None, "block"), 7: ("www.listed.net", "/p/", None, "block"), 8: ("other.net", "/p", None, "allow")}
    assert urls.judge(pages, listed.limit(0), queries.URL_RULES).where("verdict = 'block'").count() == 2
    clash = urls.judge(pages.withColumn("host", F.lit("mine")).withColumn("block", F.lit("mine")), listed, queries.URL_RULES).collect()
    assert {r.block for r in clash} == {"mine"} and {r.page_id: r.host for r in clash}[1] == "www.shop.com"
    assert urls.judge(pages.limit(0), listed, queries.URL_RULES).count() == 0


def test_near_duplicates(docs, local):
    sets = [(d, t, frozenset(zip(*([(w := (t or "").split())[i:] for i in range(5)]))) if len((t or "").split()) >= 5 else frozenset([tuple((t or "").split())]) if (t or "").split() else frozenset()) for d, t in local]
    found = {(r.doc_id, r.node is not None): r.class_id for r in neardup.classes(docs).collect()}
    n = len(sets)
    top = list(range(n))
    for i in range(n):
        for j in range(i):
            a, b = sets[i][2], sets[j][2]
            if (sets[i][1] or "") == (sets[j][1] or "") or (a and b and len(a & b) / len(a | b) >= 0.8):
                x, y = top[i], top[j]
                top = [min(x, y) if t in (x, y) else t for t in top]
    for i, (d, _, _) in enumerate(sets):
        group = [sets[k][0] for k in range(n) if top[k] == top[i] and sets[k][0] is not None]
        assert found[(d, True)] == (min(group) if group else None)
    assert neardup.keep_one(docs).count() == len(set(top))  # the repeated row of id 3 goes
    assert neardup.classes(docs.limit(0)).count() == 0


def test_keep_one_keeps_a_row_of_each_class(spark):
    rng = random.Random(8)
    text = [_prose(rng, 40) for _ in range(5)]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (7, text[2]), (4, text[3]), (4, text[4])]
    kept = neardup.keep_one(spark.createDataFrame([*rows, *rows[3:5], rows[0]], "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[1], *rows[3:]], key=repr)


def test_near_duplicates_with_a_passage_held_often(spark):
    """Plain Jaccard of each pair is at least 0.8, though one copy holds a passage 20 times."""
    rng = random.Random(11)
    rows = []
    for k in range(0, 120, 2):
        base = _prose(rng, 116)
        more = f"{base} {' '.join([_prose(rng, 23)] * 20)}"
        a, b = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (base, more))
        assert len(a & b) / len(a | b) >= 0.8
        rows += [(k, base), (k + 1, more)]
    found = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k - k % 2 for k in range(120)}


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old stone bridge in the valley of the kings at dawn"
    rows = [(1, f"{line}\nunique first line of one"), (2, f"{line.upper()}!\nunique second"), (3, "short\n\n***\nshort"), (4, None), (5, ""), (6, "short")]
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in fuzzylines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (rows[0][1], 2, 0), 2: ("unique second", 2, 1), 3: ("short\n\n***", 4, 1), 4: (None, 0, 0), 5: ("", 1, 0), 6: ("", 1, 1)}
    assert fuzzylines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_fuzzy_lines_join_near_copies(spark):
    rng = random.Random(3)
    long = " ".join(f"{rng.choice(WORDS)}{k}" for k in range(900))
    near = long.replace(" beta", " bexa", 1)
    rows = [(1, long), (2, near), (3, _prose(rng, 900))]
    out = {r.doc_id: r.n_removed for r in fuzzylines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1, 3: 0}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_lines_recall(spark):
    """Lines of 10 to 60 words with one to four words replaced are all linked; brute force says that they are alike."""
    rng = random.Random(4)
    rows = []
    for k in range(0, 240, 2):
        words = _prose(rng, (10, 12, 20, 30, 40, 60)[k // 2 % 6]).split()
        near = list(words)
        for at in rng.sample(range(len(words)), 1 + k // 12 % min(4, len(words) // 6)):
            near[at] = rng.choice(WORDS) + str(rng.randrange(40))
        a, b = " ".join(words), " ".join(near)
        assert 1 - _edits(a, b) / max(len(a), len(b)) >= 0.8
        rows += [(k, a), (k + 1, b)]
    out = {r.doc_id: r.n_removed for r in fuzzylines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {k: k % 2 for k in range(240)}


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["good", "fine"] if k % 3 else ["bad", "awful"]) + str(rng.randrange(5)) for _ in range(30)), k) for k in range(120)] + [(500, None, 0), (501, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(k, "good" if k % 3 else "bad") for k in range(0, 120, 2)], "doc_id long, domain string")
    out = mixing.mix(docs.withColumn("n_words", F.lit(-1)).withColumn("copies", F.lit("x")), labels, {"good": 0.9, "bad": 0.1})
    held = out.toPandas()
    assert len(held) == 122 and sorted(out.columns) == sorted(["doc_id", "text", "rate", "n_words", "p_good", "p_bad", "copies"])
    assert list(held[held.doc_id >= 500].n_words) == [0, 0]
    n = held.n_words
    good, bad = (held.rate * n * held.p_good).sum(), (held.rate * n * held.p_bad).sum()
    assert abs(good / (good + bad) - 0.9) < 0.01 and (held.rate >= 0).all()
    unseen = held[(held.doc_id % 2 == 1) & (held.doc_id < 120)]
    assert ((unseen.p_good > 0.5) == (unseen.doc_id % 3 > 0)).all()
    assert mixing.replicate(out, ["doc_id", "text"]).count() == held.copies.sum()
    assert mixing.mix(docs.limit(0), labels, {"good": 0.9, "bad": 0.1}).count() == 0
    wordless = mixing.mix(docs.where("doc_id >= 500"), labels, {"good": 0.9, "bad": 0.1}).collect()
    assert [r.rate for r in wordless] == [1.0, 1.0]


def test_rates_against_plain_descent(spark):
    """The same objective minimised by a plain solver over all rows; a first domain without words leaves the others alone."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([4, 1, 0.5], 400)
    n = rng.integers(1, 200, 400)
    rows = [(int(k), float(a), float(b), float(c)) for k, (a, b, c) in zip(n, p)]
    scored = spark.createDataFrame(rows, "n_words long, p_a double, p_b double, p_c double")
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    rate = np.array([r[0] for r in scored.select(mixing.rates(scored, weights, steps=200)).collect()])
    totals, target = (rate * n) @ p, np.array(list(weights.values())) * n.sum()
    assert (rate >= 0).all() and np.abs(totals - target).max() <= 2e-4 * n.sum()
    r = np.ones(400)
    for _ in range(4000):
        r = np.maximum(0, r - (p @ (((r * n) @ p - target) / (n.sum() * (n @ p / n.sum()))) + 1e-5 * (r - 1)))
    assert np.abs(rate - r).max() < 0.1
    empty_first = mixing.rates(scored.selectExpr("n_words", "0D p_z", "p_a", "1 - p_a AS p_b"), {"z": 0.1, "a": 0.6, "b": 0.3}, steps=200)
    got = np.array([x[0] for x in scored.selectExpr("n_words", "0D p_z", "p_a", "1 - p_a AS p_b").select(empty_first).collect()])
    assert abs((got * n) @ p[:, 0] / n.sum() - 0.6) < 1e-3


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.1, (300, 16)).astype("float32")
    v[7] = v[8] = v[9]
    rows = [(k, [float(x) for x in y]) for k, y in enumerate(v)] + [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (950, []), (None, [1.0] * 16), (5, [float(x) for x in v[6]]), (1000, [70000.0, -1e6]), (1001, [1e6] * 16), (1002, [-1e6, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).withColumn("rank", F.lit(1))
    out = topk.search(table, F.col("vec_id") % 50 == 0, block=64).collect()
    taken = [(k, y) for k, y in rows if k is not None and y is not None and all(x is not None and np.isfinite(x) for x in y)]
    held = [(k, np.array([int(np.floor(float(np.float32(x)) * 256)) for x in y] + [0] * (16 - len(y)), object)) for k, y in taken]
    expected = set()
    for q, x in held:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), k) for k, y in held if k != q)[:5]
            expected |= {(q, r + 1, k, -s) for r, (s, k) in enumerate(scores)}
    assert {tuple(r) for r in out} == expected
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0]), (4, [2e30, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in topk.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 4, None), (2, 1, None), (3, 3, None), (4, 2, None)]
    assert topk.search(huge.limit(0), F.col("vec_id") == 0).count() == 0


def test_quality(docs, local):
    out = quality.judge(docs).collect()
    assert len(out) == len(local)
    for r in out:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        repeat = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and (not r.kept or not r.base_failed)
    assert quality.judge(docs.limit(0)).count() == 0
