"""Checklists against a line-by-line reading of small pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from civicloom.operators import layout as L
from civicloom.operators import requirements as RQ

SCHEMA = "doc string, page int, page_width double, block long, x0 double, y0 double, x1 double, y1 double, text string"
ITEMS = ["1. Valid ID", "2.", "•", "• Clearance", "with copies", "x", "(two)", "Form A", "--", "a) Letter"]
PLACES = ["Registrar", "Treasurer", "None", "3 Minutes", "PHP 50.00", "1. Window", "near the hall"]


def page_of(rng, doc, page):
    out, y = [], 10.0
    wide = rng.random() < 0.8
    for i in range(rng.randrange(0, 9)):
        y += rng.choice([2.0, 12.0, 13.0, 30.0])
        x = rng.choice([40.0, 60.0])
        out.append((doc, page, 600.0, i, x, y, x + 60, y + 10, rng.choice(ITEMS)))
        if wide and rng.random() < 0.6:
            at = y + rng.choice([0.0, 4.0, -3.0])
            out.append((doc, page, 600.0, rng.randrange(3), 400.0, at, 500.0, at + rng.choice([8.0, 10.0, 25.0]), rng.choice(PLACES)))
    return out


def listed(lines):
    items, pending = [], None
    for r in sorted(lines, key=lambda r: (r[5], r[4], r[8])):
        if re.match(r"^\s*(?:[•·▪◦*\-–—]|\(?\d{1,2}(?:\.\d+)*\)?\.?|[a-z]\))\s*$", r[8], re.I):
            pending = r[8].strip()
            continue
        own = re.match(r"^\s*(?:[•·▪◦*]|\d{1,2}(?:\.\d+)*\s*[.)]|[a-z]\))\s*\S", r[8], re.I)
        if pending is not None or own or not items:
            items.append([r[8] if pending is None or own else f"{pending} {r[8]}", r[5], r[7]])
        else:
            items[-1] = [f"{items[-1][0]} {r[8]}", items[-1][1], max(items[-1][2], r[7])]
        pending = None
    return items


def grouped(lines):
    out, reach, block = [], None, None
    for r in sorted(lines, key=lambda r: (r[5], r[4], r[8])):
        goes_on = bool(out) and block == r[3] and r[5] - reach < max(r[7] - r[5], 8) * 1.35
        if goes_on:
            out[-1] = [f"{out[-1][0]} {r[8]}", out[-1][1], max(out[-1][2], r[7])]
        else:
            out.append([r[8], r[5], r[7]])
        # the reach is that of the whole run of lines of a block
        reach = max(reach, r[7]) if out and block == r[3] else r[7]
        block = r[3]
    return out


def read(lines):
    """(item, place) and places without an item, of one page."""
    right = [r for r in lines if r[4] >= 300]
    left = [r for r in lines if r[4] < 300]
    if not left or not right:
        left, right = lines, []
    items = listed(left)
    places = listed(right) if any(re.match(r"^\s*\d{1,2}\s*[.)]\s*\S", r[8]) for r in right) else grouped(right)
    beside = [[i for i, it in enumerate(items) if min(it[2], p[2]) - max(it[1], p[1]) > 0] for p in places]
    clear = len(places) <= len(items) and all(len(b) == 1 for b in beside) and len({b[0] for b in beside}) == len(beside)
    of = {b[0]: p[0] for b, p in zip(beside, places)} if clear else {}
    is_place = lambda t: t is not None and t not in ("None", "3 Minutes", "PHP 50.00")
    found = [(it[0], of[i] if is_place(of.get(i)) else None) for i, it in enumerate(items) if re.search(r"\w", it[0])]
    return found, [] if clear else [p[0] for p in places if is_place(p[0])], sum(not is_place(p[0]) for p in places) if not clear else 0


@pytest.mark.parametrize("seed", range(3))
def test_checklists_equal_a_line_by_line_reading(spark, seed):
    rng = random.Random(seed)
    pages = {(f"d{d}", p): page_of(rng, f"d{d}", p) for d in range(12) for p in range(6)}
    lines = [r for page in pages.values() for r in page]
    got = RQ.read(spark.createDataFrame(lines, SCHEMA))
    texts = {(r.doc, r.page, r["item"]): r.text for r in got.texts.collect()}
    items, unpaired, dropped = [], [], 0
    for (doc, page), own in pages.items():
        if own:
            found, alone, lost = read(own)
            items += [(doc, page, *f) for f in found]
            unpaired += [(doc, page, a) for a in alone]
            dropped += lost
    key = lambda r: str(tuple(r))
    rows = got.items.collect()
    assert sorted(((r.doc, r.page, texts[r.doc, r.page, r["item"]], r.place) for r in rows), key=key) == sorted(items, key=key)
    assert sorted(((r.doc, r.page, r.place) for r in got.unpaired.collect()), key=key) == sorted(unpaired, key=key)
    assert got.dropped.count() == dropped
    want = {}
    for doc, _, text, place in items:
        want.setdefault(doc, []).append((text.strip(), place))
    for doc, own in want.items():
        paired = sum(p is not None for _, p in own)
        want[doc] = not any(len(t) < 5 or re.match("[a-z(]", t) for t, _ in own) and not (paired and len(own) > 3 and paired * 2 < len(own))
    assert {r.doc: r.coherent for r in RQ.coherent(got.items, ["doc"]).collect()} == want


def test_no_text_is_gathered_whole(spark):
    """An item of very many lines comes in pieces, in order; an empty table has no checklist."""
    lines = [("d", 1, 600.0, 0, 40.0, float(i), 100.0, i + 9.0, "1. Begin" if i == 0 else f"w{i}") for i in range(1000)]
    df = spark.createDataFrame(lines, SCHEMA)
    got = RQ.read(df)
    pieces = [r.text for r in got.texts.orderBy("piece").collect()]
    assert len(pieces) == 4 and all(len(p.split()) <= RQ.PIECE + 1 for p in pieces)
    assert " ".join(pieces) == " ".join(r[8] for r in lines)
    assert RQ.read(df.limit(0)).items.count() == 0


def test_the_whole_text_of_a_place_counts(spark):
    """A place of more lines than a piece has is read to its end, with an item and without one."""
    n = 2 * RQ.PIECE + 100
    long = lambda page, block, at, end: [("d", page, 600.0, block, 400.0, at + i, 500.0, at + i + 1.0, end if i == n - 1 else f"hall {i}") for i in range(n)]
    item = lambda page, y1: ("d", page, 600.0, 0, 40.0, 10.0, 100.0, y1, "1. Valid ID")
    blank = [("d", 3, 600.0, 1, 400.0, 10.0 + i, 500.0, 11.0 + i, "None" if i == 0 else " ") for i in range(n)]
    # page 2 has two places beside one item; they differ in their last lines only
    lines = [item(1, 2000.0), *long(1, 1, 20.0, "annex"), item(2, 4000.0), *long(2, 1, 20.0, "north"), *long(2, 2, 1500.0, "south"), item(3, 900.0), *blank]
    got = RQ.read(spark.createDataFrame(lines, SCHEMA))
    text = lambda end: " ".join([*(f"hall {i}" for i in range(n - 1)), end])
    assert [r.place for r in got.items.orderBy("page").collect()] == [text("annex"), None, None]
    assert sorted(r.place for r in got.unpaired.collect()) == [text("north"), text("south")]


def test_fragment_keys(spark):
    df = spark.createDataFrame([("CLIENT STEPS",), ("AGENCY",), ("time",), ("TIME",), ("Fee",), (None,)], "t string")
    assert [r[0] for r in df.select(L.fragment_key(F.col("t"))).collect()] == ["clientStep", "agencyAction", None, "processingTime", None, None]
