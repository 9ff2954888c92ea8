"""Vocabulary matches, what a translation keeps, and figures by section, against plain readings."""

import random
import re

import pytest

import __spark_entry__ as entry
from civicloom.operators import pages as P
from civicloom.operators import phrases as PH

VOCABULARY = ["red gear", "gear", "a b a", "a a", "Office of the Mayor", "nowhere at all", "...", "b"]


def places(text, term):
    own, asked = re.findall(r"[^\W_]+", text or ""), re.findall(r"[^\W_]+", term)
    return [i for i in range(len(own) - len(asked) + 1) if asked and own[i : i + len(asked)] == asked]


@pytest.mark.parametrize("seed", range(2))
def test_phrases_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "red", "gear", "red gear", "Office of the", "Mayor", "x", "ñ"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(parts, k=rng.randrange(0, 30)))) for i in range(60)] + [(90, None), (91, ""), (92, "a " * 3000)]
    df = spark.createDataFrame(docs, "d int, body string")
    vocabulary = spark.createDataFrame([(v, "x") for v in VOCABULARY * 2] + [(None, "x")], "term string, body string")
    got = sorted(tuple(r) for r in PH.phrase_matches(df, "d", "body", vocabulary, "term").collect())
    assert got == sorted((d, v, at) for d, t in docs for v in VOCABULARY for at in places(t, v))
    twins = [(d, " ".join(rng.choices(parts, k=12))) for d, _ in docs[:50]]
    drift = PH.translated_terms(df, spark.createDataFrame(twins, "d int, body string"), "d", "body", vocabulary, "term")
    want = set()
    for (d, other) in twins:
        for v in VOCABULARY:
            here, there = bool(places(dict(docs)[d], v)), bool(places(other, v))
            if here != there:
                want.add((d, "lost" if here else "added", v))
    assert {tuple(r) for r in drift.collect()} == want and {w[1] for w in want} == {"lost", "added"}
    assert PH.phrase_matches(df.limit(0), "d", "body", vocabulary, "term").count() == 0
    assert PH.phrase_matches(df, "d", "body", vocabulary.limit(0), "term").count() == 0


def test_required_terms(spark):
    rows = [(1, "Window 3, Mayor's\nOffice", "Window  3", "Mayor's Office of everything"), (2, None, "x", None), (3, "x", None, ""), (4, "Mayor's Office of every day", "Z", " Mayor's   Office of every day")]
    df = spark.createDataFrame(rows, "d int, body string, office string, title string")
    got = PH.required_terms(df, "d", "body", {"office": df.office, "opening": df.title})
    assert sorted(map(tuple, got.collect())) == [(1, "office", "Window  3"), (1, "opening", "Mayor's Office of everyt"), (2, "office", "x"), (4, "office", "Z")]


def sections(text, pattern):
    out, section, fenced = [], None, False
    for pos, line in enumerate(text.split("\n")):
        if re.match(r"^\s*(```|~~~)", line):
            fenced = not fenced
        elif not fenced and re.match(r"^##\s+\S", line):
            section = re.sub(r"[*_`]", "", line[2:]).strip() or section
        out += [(pos, k, section, m) for k, m in enumerate(re.findall(pattern, line))]
    return out


def test_figures_by_section(spark):
    rng = random.Random(3)
    lines = ["## Fees", "## **Other** ", "```", "~~~ x", "pay ₱50 or PHP 70", "## Copies ₱5", "text", "##no", "1,250.00", "## ***"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randrange(0, 40)))) for i in range(40)] + [(90, ""), (91, "₱1")]
    df = spark.createDataFrame(docs + [(92, None)], "d int, body string")
    pattern = r"₱\s?[\d,]+|\bPHP\s?[\d,]+|\b\d{1,3}(?:,\d{3})*\.\d{2}\b"
    got = P.figures_by_section(df, "d", "body", pattern).select("d", "pos", "k", "section", "figure").collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(((d, *f) for d, t in docs for f in sections(t, pattern)), key=key)
    found = P.fee_scope(df, "d", "body", df.where("d < 60").select("d"), spark.createDataFrame([(" FEES ",)], "section string"), pattern)
    want = {(d, s, m, "outside" if d < 60 else "untranscribed") for d, t in docs for _, _, s, m in sections(t, pattern) if d >= 60 or (s or "").lower() != "fees"}
    assert {(r.d, r.section, r.figure, r.problem) for r in found.collect()} == want


def test_long_documents_are_walked_in_pieces(spark):
    """A million headings take about ten times what a hundred thousand take, not a hundred times."""
    import time

    def took(n):
        df = spark.range(1).selectExpr("id AS d", f"array_join(transform(sequence(1, {n}), i -> concat('## h', i)), '\\n') AS body")
        start = time.time()
        assert P.outline(df, "d", "body").count() == n
        return time.time() - start

    took(1000)
    small = took(100_000)
    assert took(1_000_000) < 30 * max(small, 1)


def test_every_rule_fires(spark):
    folder = "/root/testdata/sf0.001"
    terms = entry.queries()["txt_untranslated_terms"](spark, folder).groupBy("rule").count().collect()
    assert {r["rule"] for r in terms} == {"lost", "added", "office", "opening"}
    fees = entry.queries()["txt_fee_scope"](spark, folder).groupBy("problem").count().collect()
    assert {r["problem"] for r in fees} == {"untranscribed", "outside"}
