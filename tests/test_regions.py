"""Party regions against a fold over the blocks of each document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.operators import regions

CELL = re.compile("([A-Z]+)([1-9][0-9]*)")
PARTY = ("shipper", "consignee", "notify party")
STREET = ("12 Jalan Api", "7B Old Mill Road", "深水路 12 号")


def _stops(text):
    low = text.lower().strip()
    known = (*PARTY, "port of loading", "booking", "vessel")
    return any(low.startswith(x) and (low == x or low[len(x)] in " :=|") for x in known) or bool(re.match(r"\s*[^\n:=]{1,80}[:=]", text))


def _cell(x):
    m = CELL.fullmatch(x["cell"] or "")
    if not m:
        return None
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]), column


def _goes_on(region, block):
    if _stops(block["text"]) or not region[-1]["locations"] or not block["locations"]:
        return False
    before, after, anchor = region[-1]["locations"][-1], block["locations"][0], region[0]["locations"][0]
    if before["kind"] != after["kind"] or region[-1]["method"] != block["method"]:
        return False
    if before["kind"] == "xlsx":
        old, new = [x for b in region for x in b["locations"]], block["locations"]
        if len({x["sheet"] for x in old + new}) != 1 or None in {x["sheet"] for x in old + new}:
            return False
        a, b = [_cell(x) for x in old], [_cell(x) for x in new]
        if None in a or None in b:
            return False
        return min(b)[0] == max(a)[0] + 1 and min(c for _, c in a) <= min(c for _, c in b) <= max(c for _, c in a)
    if before["kind"] not in ("pdf", "image") or before["page"] != after["page"] or None in (before["x0"], after["x0"], anchor["x0"]):
        return False
    height = max(before["bottom"] - before["top"], after["bottom"] - after["top"])
    gap = after["top"] - before["bottom"]
    spaced = gap <= 3 * height and abs(after["x0"] - anchor["x0"]) <= max(2, height / 2) and block["text"].strip() in STREET
    return height > 0 and gap >= 0 and (gap <= 2 * height or spaced) and anchor["x0"] - 2 <= after["x0"] <= anchor["x1"] + 2


def _regions(blocks):
    out, k = {}, 0
    while k < len(blocks):
        region = [blocks[k]]
        k += 1
        if any(region[0]["text"].lower().strip().startswith(x) for x in PARTY):
            while k < len(blocks) and _goes_on(region, blocks[k]):
                region.append(blocks[k])
                k += 1
        for b in region:
            out[b["doc_id"], b["block"]] = (region[0]["block"], len(region))
    return out


def _place(kind, page=1, x0=None, top=None, x1=None, bottom=None, sheet=None, cell=None):
    return {"kind": kind, "page": page, "x0": x0, "top": top, "x1": x1, "bottom": bottom, "sheet": sheet, "cell": cell}


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(6)
    out = []
    for doc in range(1500):
        blocks, top, row = [], 10.0, 1
        kind = rng.choice(["pdf", "pdf", "image", "xlsx", "docx"])
        for k in range(rng.randrange(1, 12)):
            text = rng.choice(["Shipper: A", "CONSIGNEE", "Notify Party | B", "Port of Loading: X", "Ref = 9", "plain words", "plain words", "more", *STREET])
            height = rng.choice([8.0, 10.0, 10.0, 0.0])
            top += rng.choice([0.0, 2.0, 12.0, 20.0, 25.0, 30.0, 31.0, -5.0])
            row += rng.choice([1, 1, 1, 2, 0])
            left = rng.choice([50.0, 50.0, 51.0, 47.5, 56.0, 150.0, 153.0])
            own = kind if rng.random() < 0.95 else "pdf"
            places = []
            for _ in range(rng.choice([1, 1, 1, 2, 0])):
                if own == "xlsx":
                    places.append(_place("xlsx", None, sheet=rng.choice(["S", "S", "S", "T", None]), cell=rng.choice("ABAB") + str(row) if rng.random() < 0.95 else "?"))
                elif rng.random() < 0.95:
                    places.append(_place(own, rng.choice([1, 1, 1, 1, 2]), left, top, left + 100, top + height))
                else:
                    places.append(_place(own))
                top += height
            blocks.append({"doc_id": doc, "block": k, "text": text, "method": rng.choice(["native"] * 9 + ["ocr"]), "locations": places})
        out.append(blocks)
    return out


@pytest.fixture(scope="module")
def found(spark, documents):
    rows = spark.createDataFrame([b for own in documents for b in own], regions.BLOCK)
    return rows, regions.party_regions(rows).cache()


def test_party_regions(documents, found):
    expected = {k: v for own in documents for k, v in _regions(own).items()}
    got = {(r.doc_id, r.block): (r.region, r.n) for r in found[1].collect()}
    assert sum(n > 1 for _, n in expected.values()) > 100
    assert got == expected


def test_selections(spark, documents, found):
    """An anchor brings its region; part of a region is flagged."""
    rng = random.Random(1)
    picks = [(own[0]["doc_id"], rng.choice(["shipper", "container_count"]), rng.choice([None, *(b["block"] for b in own)])) for own in documents]
    whole = {}
    for own in documents:
        for (doc, block), (region, _) in _regions(own).items():
            whole.setdefault((doc, region), []).append(block)
    of = {(doc, b): members for (doc, _), members in whole.items() for b in members}
    choices = spark.createDataFrame(picks, "doc_id long, field string, block int")
    got = {(r.doc_id, r.field): r.blocks for r in regions.complete_selections(found[1], choices).collect()}
    assert got == {(d, f): [] if b is None else of[d, b] if f == "shipper" else [b] for d, f, b in picks}
    chosen = [(own[0]["doc_id"], "shipper", sorted({rng.choice(own)["block"] for _ in range(rng.randrange(0, 6))})) for own in documents]
    omitted = regions.omitted_continuations(found[1], spark.createDataFrame(chosen, "doc_id long, field string, blocks array<int>"))
    expected = {d: any(not set(of[d, b]) <= set(own) for b in own) for d, _, own in chosen}
    assert 20 < sum(expected.values()) < 1480
    assert {r.doc_id: r.omitted for r in omitted.collect()} == expected


@pytest.mark.parametrize(
    ("text", "is_one"),
    [
        ("12 Jalan Api", True), ("12A/3 LORONG 5", False), ("12A/ LORONG 5", True), ("12 jalan", False), ("12 Jalan-", True), ("Jalan Api 12", False), ("7 Old Mill Road", True), ("7 Road", False),
        ("7B St. Anne St.", True), ("7 a b c d e road x", True), ("7 a b c d e f road", False), ("7 a, b road", False), ("7 Mill Roads", False), ("深水路12号", True), ("深水路 12 號 3 楼", True), ("水路12号", False), ("7 Old\nMill Road", True), ("7 Old Mill Road\nx", False), ("12\nJalan x", True), ("12 Jalan\nx", False), ("深水路12号\nx", False), ("", False),
    ],
)
def test_street_addresses(spark, text, is_one):
    assert spark.createDataFrame([(text,)], "t string").select(regions.street_address(F.col("t")).alias("x")).first().x == is_one


def test_destination_ports(spark):
    docs = {1: ["Destination port: X", "Port of Discharge: Y"], 2: ["Destination port: X", "Port of Loading: Y"], 3: ["Port of Discharge: Y", "Destination port: X"], 4: ["  destination PORT X", "a\n  POD: Z"], 5: ["Destination port: X", "Destination port: Y"]}
    rows = [{"doc_id": d, "block": k, "text": t, "method": "native", "locations": []} for d, own in docs.items() for k, t in enumerate(own)]
    picks = spark.createDataFrame([(d, "port_of_discharge", [0]) for d in docs], "doc_id long, field string, blocks array<int>")
    issues = regions.selection_issues(spark.createDataFrame(rows, regions.BLOCK), picks).collect()
    assert {r.doc_id for r in issues if r.issue == "destination_port_requires_review"} == {1, 4}
