"""Mail sections, numbers and layout against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import mail
from tallymark.functions.numbers import numeric_candidates
from tallymark.operators import layout, proposals

QUOTED = "-----Original Message-----\nFrom: a\nSent: b\nSubject: c\n\nold"
SIGNED = "Kind regards\nA. Person\nTel: 1\n"
NOTICE = "WARNING: this Email originated outside\n\n"
BODIES = [
    (NOTICE + "Hi\n" + SIGNED + QUOTED, (NOTICE, "Hi\n", SIGNED, QUOTED)),
    ("Hi\n_____\nFrom: x\n\nSent: y\nSubject: z\n", ("", "Hi\n_____\nFrom: x\n\nSent: y\nSubject: z\n", "", "")),
    ("Hi\n_____\nFrom: x\nnone\n\n" + QUOTED, ("", "Hi\n_____\nFrom: x\nnone\n\n", "", QUOTED)),
    ("Hi\n" + SIGNED + "PS: one thing", ("", "Hi\n" + SIGNED + "PS: one thing", "", "")),
    (SIGNED, ("", SIGNED, "", "")),
    ("Hi\n" + SIGNED + SIGNED, ("", "Hi\n" + SIGNED + SIGNED, "", "")),
    ("Hi\n" + SIGNED + "x\n" * 18, ("", "Hi\n", SIGNED + "x\n" * 18, "")),
    ("Hi\n" + SIGNED + "x\n" * 19, ("", "Hi\n" + SIGNED + "x\n" * 19, "", "")),
    ("", ("", "", "", "")),
    (None, ("", "", "", "")),
]


def test_mail_sections(spark):
    rows = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(BODIES)], "k int, b string").select("k", mail.sections(F.col("b")).alias("s")).orderBy("k").collect()
    for row, (_, wanted) in zip(rows, BODIES, strict=True):
        assert tuple(row.s) == wanted


def _is_number(token):
    whole, _, fraction = token.partition(".")
    groups = whole.split(",")
    digits = all(g.isascii() and g.isdigit() for g in groups) and all(len(g) == 3 for g in groups[1:])
    return digits and ("." not in token or (fraction.isascii() and fraction.isdigit()))


def _numbers(text):
    """Value, start and end of each number that stands alone, by one walk over the characters."""
    start = None
    for k, c in enumerate(text + " "):
        if c.isalnum() or c in "_.,/-":
            start = k if start is None else start
        elif start is not None:
            if _is_number(text[start:k]):
                yield text[start:k], start, k
            start = None


def test_numbers(spark):
    texts = ["Gross 1,200.5 kg\nNo. 7 of 8\r\nab12 3/4 MT 5", "5 kg 6 MT 7", "", None, "x 1 公斤", "é1 2"]
    blocks = spark.createDataFrame([(1, k, "native", t) for k, t in enumerate(texts)] + [(1, 99, "ocr", "44"), (2, 0, "native", "1 " * 121), (3, 0, "native", "1 " * 120)], "doc long, block int, method string, text string")
    got = numeric_candidates(blocks, keys=["doc"])
    mine = [(r.number, r.block, r.value, r.start, r.end, r.unit, r.unit_start) for r in got.where("doc = 1").orderBy("number").collect()]
    wanted = [(k, *found) for k, t in enumerate(texts) if t for found in _numbers(t)]
    assert [(b, v, s, e) for _, b, v, s, e, _, _ in mine] == wanted
    assert [n for n, *_ in mine] == list(range(1, len(mine) + 1))
    units = {(b, v): (u, at) for _, b, v, _, _, u, at in mine}
    assert units[0, "1,200.5"] == ("kg", 14) and units[0, "7"] == (None, None) and units[0, "5"] == ("MT", texts[0].index("MT")) and units[1, "5"] == (None, None) and units[4, "1"] == ("公斤", 4)
    assert got.where("doc = 2").count() == 0 and got.where("doc = 3").count() == 120


def _plain_lines(words):
    rows = []
    for w in sorted(words, key=lambda w: (w[4], w[2])):
        if not rows or abs(w[4] - rows[-1][0][4]) > 3:
            rows.append([])
        rows[-1].append(w)
    out = []
    for row in rows:
        row.sort(key=lambda w: w[2])
        text, last = "", None
        for w in row:
            joined = last and last[6] != w[6] and -0.25 <= w[2] - last[3] <= 0.5 and last[1][-1:].isalnum() and w[1][:1].isalnum()
            text += ("" if joined or last is None else " ") + w[1]
            last = w
        out.append((text.strip(), min(w[2] for w in row), min(w[4] for w in row), max(w[3] for w in row), max(w[5] for w in row)))
    return out


def test_pdf_lines_and_blocks(spark):
    r = random.Random(5)
    words, pages = [], {}
    for page in range(6):
        for k in range(60):
            x0 = k * 10 + r.random()
            words.append((page, r.choice(["a", "b-", "c1", "Shipper: x"]), x0, x0 + r.choice([6.0, 9.5, 10.1]), r.randrange(0, 200) / 2, 0.0, r.choice("fg")))
            words[-1] = words[-1][:5] + (words[-1][4] + 8, words[-1][6])
        pages[page] = _plain_lines([w for w in words if w[0] == page])
    df = spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double, bottom double, font string").withColumn("doc_id", F.lit(1).cast("long"))
    lines = layout.pdf_lines(df).cache()
    for page, wanted in pages.items():
        assert [(x.text, x.x0, x.top, x.x1, x.bottom) for x in lines.where(f"page = {page}").orderBy("line").collect()] == wanted
    blocks = [(x.page, x.text) for x in layout.pdf_blocks(lines).orderBy("page", "block").collect()]
    plain = []
    for page, own in pages.items():
        last = None
        for text, _, top, _, bottom in own:
            if last is None or text.startswith("Shipper:") or top - last > 12:
                plain.append((page, text))
            else:
                plain[-1] = (page, plain[-1][1] + "\n" + text)
            last = bottom
    assert blocks == plain


def test_word_blocks(spark):
    items = ["Hello", "Shipper", "A Ltd", " ", "Road 1", "|t", "after", "Container No:", "X1", "POL: here", "free", "Consignee: B", "#", "loose", None]
    rows = [(1, k, "table" if t and t[0] == "|" else "boundary" if t == "#" else "paragraph", t) for k, t in enumerate(items)]
    got = layout.word_blocks(spark.createDataFrame(rows, "doc_id long, item int, kind string, text string")).orderBy("first_item").collect()
    assert [x.text for x in got] == ["Hello", "Shipper\nA Ltd\nRoad 1", "|t", "after", "Container No:\nX1", "POL: here", "free", "Consignee: B", "loose"]
    cells = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 0, 1, "b"), (1, 0, 1, 0, " "), (1, 0, 2, 0, "c")], "doc_id long, item int, cell int, paragraph int, text string")
    assert layout.table_text(cells).first().text == "a\nb | c"


@pytest.mark.parametrize(("first", "second", "wanted"), [(("1", None), ("1", None), ("1", None, "first")), (("1", None), ("2", None), ("1", "provider_disagreement", "first")), ((None, "missing_value"), ("2", None), ("2", None, "second")), (("1", "low"), (None, "x"), ("1", "low", "first")), ((None, None), (None, None), (None, None, "first"))])
def test_combine(spark, first, second, wanted):
    row = spark.createDataFrame([first + second], "a string, b string, c string, d string").select(proposals.combine_readers(*(F.col(x) for x in "abcd")).alias("r")).first().r
    assert tuple(row) == wanted


def test_empty_proposals(spark):
    rows = spark.createDataFrame([], "document long, field string, selected int, confidence double")
    assert proposals.extraction_errors(rows, known=F.col("selected") != 0).count() == 0
    odd = spark.createDataFrame([(1, None, None, None)], rows.schema)
    assert proposals.extraction_errors(odd, known=F.col("selected") != 0).first().error == "fields"
