"""Column expressions: input / expected pairs."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from civicloom.functions import dates, urls
from civicloom.functions import text as T
from civicloom.operators import layout as L
from civicloom.operators import pages as P
from civicloom.operators import records as RC
from civicloom.operators import search as S
from civicloom.sources import readers as SRC


def value(spark, text, build, kind="string"):
    df = spark.createDataFrame([(text,)], f"x {kind}")
    return df.select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text", ["Ñandú", "Été", "a^b", "straße", "ﬁn", "İstanbul", "ΑΘΉΝΑ", "👍 é", "plain", ""]
)
def test_fold_equals_the_definition(spark, text):
    want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    assert value(spark, text, T.fold) == want == T.fold_literal(text)


@pytest.mark.parametrize("text", ["Ñandú", "Éx", "👍 é", "abc"])
def test_fold_chars_keeps_length(spark, text):
    assert len(value(spark, text, T.fold_chars)) == len(text)


@pytest.mark.parametrize(
    "text,kind,marker,rest",
    [
        ("2.1 Check", "sub", "2.1", "Check"),
        ("7) Go", "number", "7", "Go"),
        ("1.Original", "number", "1", "Original"),
        ("• Card", "bullet", "•", "Card"),
        ("* Card", "bullet", "*", "Card"),
        ("**You:** go", "none", None, "**You:** go"),
        ("- Dash", "dash", "-", "Dash"),
        ("Plain", "none", None, "Plain"),
    ],
)
def test_list_marker(spark, text, kind, marker, rest):
    assert tuple(value(spark, text, T.list_marker)) == (kind, marker, rest)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Who may avail?  All", "All"),
        ("WHO MAY AVAIL   Everyone ", "Everyone"),
        ("Who may avail:", None),
        ("x\n Who may avail: A\ny", "A"),
        ("Who may avail?", None),
    ],
)
def test_inline_field(spark, text, want):
    assert value(spark, text, lambda c: T.inline_field(c, "Who may avail")) == want


def test_money_and_time(spark):
    assert value(spark, "P 1,000.00 or Php200.00, 12.50", T.fees) == ["P 1,000.00", "Php200.00", "12.50"]
    assert value(spark, "3 working days, 2 Hrs", T.durations) == ["3 working days", "2 Hrs"]
    assert value(spark, "9 August 2026, 22 documents", T.figures) == []


def test_entities(spark):
    got = value(spark, "a&#8217;b &amp;lt; &AMP; &bogus; &#38;lt;", T.decode_entities)
    assert got == "a’b &lt; & &bogus; <"


def test_tel_and_cells(spark):
    assert value(spark, " +63 (86) 1-2", T.tel) == "tel:+638612"
    assert value(spark, "a|b\n\nc ", T.escape_cell) == "a\\|b c"


def test_slugs(spark):
    assert value(spark, "Ñu & Co.", T.slugify) == "nu-co"
    assert value(spark, "Office-of-X.PDF", T.stem) == "office-of-x"
    assert value(spark, "Don’t go", T.title_slug) == "dont-go"


@pytest.mark.parametrize("text", ["2026-02-31", "2026-2-3", "2026-13-01", "soon", "2026-01-01T00:00"])
def test_strict_date_rejects(spark, text):
    assert value(spark, text, dates.strict_date) is None


@pytest.mark.parametrize(
    "age,forced,want",
    [(0, False, "fresh"), (90, False, "fresh"), (91, False, "due"), (100, False, "due"), (101, False, "stale"),
     (-1, False, "undated"), (-1, True, "undated"), (0, True, "stale")],
)
def test_freshness_borders(spark, age, forced, want):
    df = spark.range(1).select(
        dates.freshness(F.date_sub(F.lit("2026-01-01").cast("date"), age), F.lit("2026-01-01").cast("date"), F.lit(100), F.lit(forced)).alias("s")
    )
    assert df.first()["s"] == want


def test_unknown_class_has_no_state(spark):
    df = spark.range(1).select(
        dates.freshness(F.lit("2026-01-01").cast("date"), F.lit("2026-01-01").cast("date"), F.lit(None).cast("int")).alias("s")
    )
    assert df.first()["s"] is None


def test_round_and_instant(spark):
    assert [value(spark, v, dates.round_half_up, "double") for v in (-2.5, 2.5, -2.6)] == [-2, 3, -3]
    assert value(spark, "2026-08-21T00:30", lambda c: dates.qualify_instant(c, F.lit(-12600))) == "2026-08-21T00:30-03:30"


@pytest.mark.parametrize(
    "text,want,bad",
    [("a%20b", "a b", False), ("a%2520b", "a b", False), ("100%", "100%", True), ("a+b", "a+b", False), ("%E0%A4%A", "%E0%A4%A", True)],
)
def test_decode_param(spark, text, want, bad):
    assert value(spark, text, urls.decode_param) == want
    assert value(spark, text, urls.is_malformed) is bad


@pytest.mark.parametrize(
    "text,query,want",
    [
        ("Abcabc", "bc ca", [("A", False), ("bcabc", True)]),
        ("aaaa b", "aa", [("aaaa", True), (" b", False)]),
        ("Bérth certificate", "berth cert", [("Bérth", True), (" ", False), ("cert", True), ("ificate", False)]),
        ("a.*b", ".*", [("a", False), (".*", True), ("b", False)]),
        ("none here", "zz", [("none here", False)]),
        ("", "zz", [("", False)]),
        ("x", "  ", [("x", False)]),
        ("👍é👍", "e", [("👍", False), ("é", True), ("👍", False)]),
    ],
)
def test_highlight_segments(spark, text, query, want):
    got = [tuple(s) for s in value(spark, text, lambda c: S.segments(c, query))]
    assert got == want
    assert "".join(t for t, _ in got) == text


def test_folding_pattern_tries_one_range_for_plain_text(spark):
    from civicloom.functions import text as T

    alike = {"e", *T._folding_to()["e"]}
    pattern = T.folding_to("e")
    # what is beyond ASCII stands behind one range
    assert pattern.count("&&") == 1 and sorted(c for c in alike if c.isascii()) == ["E", "e"]
    some = sorted(alike | set("adf EFé ñ日") | {"\U0001f600"})
    found = spark.createDataFrame([(c,) for c in some], "c string").where(F.col("c").rlike(f"^{pattern}$")).collect()
    assert {r.c for r in found} == alike


def test_highlight_keeps_null_and_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(None,), ("aXbaab",), ("abab",)], "t string").select(S.segments(F.col("t"), "ab b").alias("s"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in df.collect()]
    assert got == [None, [("aX", False), ("b", True), ("a", False), ("ab", True)], [("abab", True)]]


@pytest.mark.parametrize(
    "text,query",
    [("한국 서울", "한국"), (unicodedata.normalize("NFD", "한국"), "국"), ("한국", unicodedata.normalize("NFD", "한")), ("कोन", "को"), ("कोन", "कोन"),
     ("résumé", "resume"), ("re\u0301sume\u0301", "RÉSUMÉ"), ("কো", unicodedata.normalize("NFD", "কো")), ("\U0002f800", "\u4e3d")],
)
def test_text_and_query_fold_alike(spark, text, query):
    df = spark.createDataFrame([(text, "x")], "name string, category string")
    assert S.search(df, query, ["name"], "name", "category").count() == 1
    assert value(spark, text, T.fold) == T.fold_literal(text)


@pytest.mark.parametrize("text,want", [
    ("&#99999999999;&#65;", "&#99999999999;A"), ("&#1114112;", "&#1114112;"), ("&#55296;x", "&#55296;x"), ("&#128512; &#1114111;", "\U0001f600 \U0010ffff"), (None, None),
])
def test_codes_that_are_no_character_stay(spark, text, want):
    assert value(spark, text, T.decode_entities) == want


def test_search_semantics(spark):
    df = spark.createDataFrame(
        [(1, "Birth certificate", "x", "health"), (2, "Other", "birth certificate copy", "civil"), (3, "Birth", "y", "z")],
        "pos int, name string, description string, category string",
    )
    run = lambda q: [r["pos"] for r in S.ranked(S.search(df, q, ["name", "description"], "name", "category"), "category", "pos").collect()]
    assert run("certificate BIRTH") == [1, 2]
    assert run("birth health") == [1]
    assert run(" % ") == [] and run("") == []
    assert run("birth nowhere") == []


def test_article_and_change(spark):
    page = "<p>x</p><SCRIPT a=1>var t='</p><article>no'</script><article class=a><h1>A&amp;B</h1> c<br>d</article><article>2</article>"
    assert value(spark, page, P.article_text) == "A&B c d"
    assert value(spark, "<p>nothing</p>", P.article_text) == ""
    cols = "k int, html string"
    prev = spark.createDataFrame([(1, "<article>a</article>"), (2, "<article>b</article>"), (4, "<p>")], cols)
    curr = spark.createDataFrame([(1, "<script>9</script><article> a </article>"), (2, "<article>c</article>"), (3, "x"), (4, "<i>")], cols)
    got = {r["k"]: r["state"] for r in P.changes(prev, curr, "k", "html").collect()}
    assert got == {1: "same", 2: "changed", 3: "new", 4: "same"}


def test_pdf_links(spark):
    html = '<a href="/a.pdf"><b> </b></a><a class=q href="/a.pdf">First <i>text</i></a><a href="/a.pdf">Second</a> https://h/x.pdf <a href="/b.html">no</a>'
    df = spark.createDataFrame([(1, html)], "page int, html string")
    got = {r["url"]: r["title"] for r in P.links(df, "page", "html").collect()}
    assert got == {"/a.pdf": "First text", "https://h/x.pdf": None}


def test_header_and_places(spark):
    assert value(spark, "PROCESSIN G TIME", L.is_header) is True
    assert value(spark, "time", L.is_header) is False
    assert value(spark, "3|Page", L.is_furniture) is True
    for text, kept in [("None", None), ("3 Minutes", None), ("P 50.00", None), ("Registrar", "Registrar")]:
        assert value(spark, text, RC.place_or_null) == kept


@pytest.mark.parametrize("text,want", [("12", 12), (" 7 ", 7), ("-1", None), ("1.5", None), ("", None), (None, None), ("9" * 30, None)])
def test_counter(spark, text, want):
    assert value(spark, text, SRC.counter) == want


def test_framing_rules_fire_and_spare(spark):
    docs = spark.createDataFrame(
        [(1, "Twice the clerk refused to stamp it. One note conceals it; it concealed much."), (2, "Refuse bins; withholding tax desk."), (3, "One total stays withheld.")],
        "path int, body string",
    )
    got = {(r["path"], r["match"]) for r in P.pattern_scan(docs, "path", F.col("body"), P.FRAMINGS).collect()}
    assert got == {(1, "refused to"), (1, "conceals"), (1, "concealed"), (3, "withheld")}
