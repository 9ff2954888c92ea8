"""Operators against brute force on small random data, hot keys included."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civicloom.operators import intervals as I
from civicloom.operators import layout as L
from civicloom.operators import pages as P
from civicloom.operators import records as RC
from civicloom.operators import reconcile as R
from civicloom.operators import segments as SG
from civicloom.operators import skew as K
from civicloom.operators import validate as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under one key."""
    rng = random.Random(1)
    data = [(0 if i % 3 == 0 else rng.randrange(40), i, rng.randrange(100), rng.choice([None, 1, 2])) for i in range(3000)]
    return spark.createDataFrame(data, "k int, pos int, v int, m int").cache()


def test_prefix_scan_equals_plain_windows(hot):
    got = K.prefix_scan(
        hot, ["k"], ["pos"], F.floor(F.col("pos") / 50),
        [K.Measure("n", "count", F.lit(1)), K.Measure("s", "sum", F.col("v")), K.Measure("mx", "max", F.col("v"), inclusive=False),
         K.Measure("l", "last", F.col("m")), K.Measure("mn", "min", F.col("v"))],
    )
    w = W.partitionBy("k").orderBy("pos")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = hot.select(
        "*", F.count(F.lit(1)).over(upto), F.sum("v").over(upto), F.max("v").over(before), F.last("m", True).over(upto), F.min("v").over(upto)
    )
    key = lambda r: r[1]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_neighbours_equal_lag_and_lead(hot):
    got = K.neighbours(hot, ["k"], ["pos"], F.floor(F.col("pos") / 50), {"a": "v"}, {"b": "v"}, number="n")
    w = W.partitionBy("k").orderBy("pos")
    want = hot.select("*", F.lag("v").over(w), F.lead("v").over(w), F.row_number().over(w))
    key = lambda r: r[1]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_lookup_join_with_a_hot_key(spark, hot):
    dim = spark.createDataFrame([(k, k * 10) for k in range(0, 30)], "k int, d int")
    before = spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin")
    for how in ("left", "inner", "left_semi"):
        assert len(K.lookup_join(hot, dim, ["k"], how).collect()) == hot.join(dim, "k", how).count()
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == before


def test_first_n_limits_before_the_shuffle(hot):
    plan = K.first_n(hot, ["k"], ["pos"], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_range_join_equals_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, rng.randrange(3), rng.uniform(-50, 400)) for i in range(300)]
    rngs = [(g, j, None if j == 0 else j * 37.5, None if j == 7 else (j + 1) * 37.5) for g in range(2) for j in range(8)]
    got = I.range_join(
        spark.createDataFrame(pts, "i int, g int, x double"), spark.createDataFrame(rngs, "g int, j int, lo double, hi double"),
        ["g"], "x", "lo", "hi", 25.0, (0.0, 300.0),
    ).select("i", "j")
    want = sorted((i, j) for i, g, x in pts for g2, j, lo, hi in rngs if g == g2 and (lo is None or x >= lo) and (hi is None or x < hi))
    assert rows(got) == want


def pair_brute(items, sources):
    out, pages = {}, {s[0] for s in sources}
    for p in pages:
        it, so = [x for x in items if x[0] == p], [x for x in sources if x[0] == p]
        hits = {s[1]: [i[1] for i in it if min(i[3], s[3]) - max(i[2], s[2]) > 0] for s in so}
        firsts = [h[0] for h in hits.values() if len(h) == 1]
        clear = len(so) <= len(it) and all(len(h) == 1 for h in hits.values()) and len(set(firsts)) == len(firsts)
        out.update({(p, s): (h[0] if clear else None) for s, h in hits.items()})
    return sorted((p, s, i) for (p, s), i in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_overlap_pair_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    span = lambda: (lambda a: (a, a + rng.choice([0, 2, 5, 9])))(rng.randrange(0, 60) * 1.0)
    items = [(p, 100 * p + i, *map(float, span())) for p in range(60) for i in range(rng.randrange(0, 4))]
    sources = [(p, 100 * p + i, *map(float, span())) for p in range(60) for i in range(rng.randrange(0, 3))]
    cols = "page int, {} long, y0 double, y1 double"
    got = I.overlap_pair(
        spark.createDataFrame(items, cols.format("item")), spark.createDataFrame(sources, cols.format("source")),
        ["page"], "item", "source", "y0", "y1", chunk=7.0,
    )
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(pair_brute(items, sources), key=key)


def test_heading_asof_equals_brute_force(spark):
    rng = random.Random(5)
    lines = [(d, p, rng.choice("ahb--------")) for d in range(4) for p in range(200)]
    df = spark.createDataFrame(lines, "doc int, pos int, kind string")
    got = I.heading_asof(
        df, ["doc"], "pos", F.col("kind") == "a", F.col("kind") == "h", F.col("kind") == "b", F.col("pos"), bound=6, chunk=16
    ).select("doc", "pos", "heading")
    want = []
    for d, p, k in lines:
        if k != "a":
            continue
        found = None
        for q in range(p - 1, max(-1, p - 7), -1):
            kind = lines[d * 200 + q][2]
            if kind == "b":
                break
            if kind == "h":
                found = q
                break
        want.append((d, p, found))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_contained_sets_equal_brute_force(spark):
    rng = random.Random(3)
    words = list("abcdefgh")
    docs = [(i, rng.sample(words, rng.randrange(1, 6))) for i in range(80)]
    sets = [(rng.sample(words, rng.randrange(0, 4)),) for _ in range(6)]
    got = I.contained_sets(
        spark.createDataFrame(docs, "d int, w array<string>"), "d", F.col("w"), spark.createDataFrame(sets, "s array<string>"), "s"
    )
    want = sorted((i,) for i, w in docs if any(s and set(s) <= set(w) for (s,) in sets))
    assert rows(got) == want


def test_reconcile_and_two_sided(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (3,), (4,)], "k int")
    assert rows(R.reconcile(a, b, ["k"])) == [(1, "missing"), (3, "duplicate"), (4, "extra")]
    en = spark.createDataFrame([("x", "one"), ("y", "two"), ("z", "km"), ("q", "a")], "key string, text string")
    fil = spark.createDataFrame([("x", "isa"), ("y", "two"), ("z", "km"), ("r", "b")], "key string, text string")
    ex = spark.createDataFrame([("z",), ("x",)], "key string")
    assert rows(R.two_sided(en, fil, ["key"], "text", ex)) == [
        ("q", "left", "only-left"), ("r", "right", "only-right"), ("x", "exempt", "not-needed"), ("y", "both", "identical")]


def test_drift_is_null_safe(spark):
    rec = spark.createDataFrame([(1, "a", None), (2, None, "g")], "id int, name string, grp string")
    auth = spark.createDataFrame([(1, "a", None), (2, "b", "g"), (9, "z", "z")], "id int, name string, grp string")
    assert [tuple(r) for r in R.drift(rec, auth, ["id"], ["name", "grp"]).collect()] == [(2, "name", None, "b")]


def test_rules_fire_once_each(spark):
    good = ("a-b", "n", "d", "2026-01-02", "V3", None, "https://x.org/y")
    bad = [("A b",) + good[1:], good[:1] + (" ",) + good[2:], good[:3] + ("2026-02-31",) + good[4:], good[:4] + ("V9",) + good[5:],
           good[:5] + ("mayor",) + good[6:], good[:6] + ("x.org",)]
    cols = "slug string, name string, description string, last_checked_at string, verification string, review_role string, url string"
    rules = V.page_entry_rules(F.lit(True))
    assert V.violations(spark.createDataFrame([good], cols), ["slug"], rules).count() == 0
    found = V.violations(spark.createDataFrame(bad, cols), ["slug"], rules)
    assert sorted(r["rule"] for r in found.collect()) == sorted(
        ["slug-shape", "name-missing", "checked-not-a-date", "level-unknown", "review-role-unknown", "url-shape"])
    with pytest.raises(ValueError):
        V.strict(found)


# ---------------------------------------------------------------- layout


def gutters_brute(lines, width, least=5):
    span = -(-int(width * 1000) // 1000) + 2
    used = [False] * span
    for x0, x1 in lines:
        if x1 - x0 > width * 0.55:
            continue
        for x in range(max(0, int(x0 // 1)), min(span - 1, -int(-x1 // 1)) + 1):
            used[x] = True
    out, start = [], None
    for x in range(span + 1):
        free = x < span and not used[x]
        if free and start is None:
            start = x
        if not free and start is not None:
            out.append((start, x - 1))
            start = None
    return [(a, b) for a, b in out if b - a >= least and a > 0 and b < span - 1]


def test_gutters_equal_the_bitmap(spark):
    rng = random.Random(8)
    pages = {p: [(lambda a: (a, a + rng.uniform(5, 400)))(rng.uniform(0, 500)) for _ in range(rng.randrange(1, 9))] for p in range(60)}
    data = [(0, p, 600.0, a, b) for p, ls in pages.items() for a, b in ls]
    got = L.gutters(spark.createDataFrame(data, "doc int, page int, page_width double, x0 double, x1 double"))
    want = sorted((0, p, a, b) for p, ls in pages.items() for a, b in gutters_brute(ls, 600.0))
    assert rows(got) == want


def line(page, block, x0, y0, x1, text, doc="d"):
    return (doc, page, 600.0, block, float(x0), float(y0), float(x1), float(y0) + 10, text)


COLS = "doc string, page int, page_width double, block int, x0 double, y0 double, x1 double, y1 double, text string"


def test_merged_column_is_reported_not_spread(spark):
    lines = []
    for i in range(3):
        lines += [line(1, i, 40, 100 + 40 * i, 150, 'Go to ' + 'abc'[i]), line(1, 10 + i, 200, 100 + 40 * i, 300, 'Check ' + 'abc'[i]),
                  line(1, 20 + i, 500, 100 + 40 * i, 560, "Clerk")]
    lines.append(line(1, 30, 350, 140, 400, "None"))
    lines.append(line(1, 40, 10, 300, 590, "a full width paragraph does not bridge the gutters"))
    names, cells = L.table(spark.createDataFrame(lines, COLS))
    named = {r["col"]: (r["key"], r["via"]) for r in names.collect()}
    assert named[2] == ("fee", "content") and named[0] == ("clientStep", "position")
    bands, merged = L.row_bands(cells.where(F.col("y0") < 300))
    assert [r["key"] for r in merged.collect()] == ["fee"]
    fee = [r for r in L.rows(cells.where(F.col("y0") < 300), bands).collect() if r["key"] == "fee"]
    assert [(r["band"], r["text"]) for r in fee] == [(2, "None")]


def test_table_writes_no_line_on_its_way_to_cells(spark, monkeypatch):
    """Columns are named from outlines; on a tall page a cell may reach into the next piece."""
    lines, written = [], []
    for page, top in ((1, 100), (2, L.TALL - 60)):
        for i in range(4):
            y = top + 40 * i
            lines += [line(page, i, 40, y, 150, f"Go {i}"), line(page, i, 40, y + 12, 150, "and back"), line(page, 20 + i, 500, y, 560, f"PHP {i}.00")]
    settle = L.settle
    monkeypatch.setattr(L, "settle", lambda df: written.append(df.columns) or settle(df))
    names, cells = L.table(spark.createDataFrame(lines, COLS))
    assert written and not any("text" in cols for cols in written)
    assert {(r["page"], r["col"]): (r["key"], r["via"]) for r in names.collect()} == {
        (p, c): v for p in (1, 2) for c, v in enumerate([("clientStep", "position"), ("fee", "content")])
    }
    got = sorted((r["page"], r["key"], r["y0"], r["y1"], r["text"]) for r in cells.collect())
    want = [(p, "clientStep", t + 40.0 * i, t + 40 * i + 22, f"Go {i} and back") for p, t in ((1, 100), (2, 1940)) for i in range(4)]
    want += [(p, "fee", t + 40.0 * i, t + 40 * i + 10, f"PHP {i}.00") for p, t in ((1, 100), (2, 1940)) for i in range(4)]
    assert got == sorted(want)


def test_list_items_and_groups(spark):
    text = ["•", "PSA certificate (pres", "photocopies)", "1. Stub", "1.", "1. RSBSA", "-", "loose", "tail"]
    data = [("d", i, t, i * 12.0, i * 12.0 + 9, 0.0, 1 if i < 5 else 2) for i, t in enumerate(text)]
    df = spark.createDataFrame(data, "doc string, pos int, text string, y0 double, y1 double, x0 double, block int")
    out = L.list_items(df, ["doc"], ["pos"], F.floor(F.col("pos") / 2))
    items = {}
    for r in sorted(out.collect(), key=lambda r: r["pos"]):
        items.setdefault(r["item"], []).append(r["piece"])
    assert [" ".join(v) for v in items.values()] == ["• PSA certificate (pres photocopies)", "1. Stub", "1. RSBSA", "- loose tail"]
    groups = L.adjacent_groups(df, ["doc"], F.floor(F.col("y0") / 24))
    assert groups.select("grp").distinct().count() == 2


def test_section_banner_may_wrap(spark):
    text = ["Office External", "Services", "x", "Internal Services y", "z"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, pos int, text string")
    out = SG.section_fill(df, ["doc"], ["pos"], "text", SG.declared_section, F.floor(F.col("pos") / 2))
    assert [r["section"] for r in sorted(out.collect(), key=lambda r: r["pos"])] == ["external"] * 2 + ["internal"] * 3


def test_total_is_the_last_one_and_leading_rows_are_requirements(spark):
    step = lambda **kw: [kw.get(f) for f in RC.STEP_FIELDS]
    data = [
        step(clientStep="Valid ID"), step(clientStep="Go", fee="P 5.00"), step(fee="P 1.00"), step(clientStep="Wait", processingTime="1 day"),
        step(clientStep="TOTAL:", fee="P 6.00"),
    ]
    df = spark.createDataFrame([("r", i, *d) for i, d in enumerate(data)], "k string, pos int, " + ", ".join(f"{f} string" for f in RC.STEP_FIELDS))
    got = {r["pos"]: r["part"] for r in RC.sectioned(df, ["k"]).collect()}
    assert got == {0: "requirement", 1: "step", 2: "step", 3: "step", 4: "total"}


def test_leaked_equals_contains(spark):
    rng = random.Random(4)
    words = [("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(30)]
    titles = [(i, docs[i % 30][1][40 : 40 + rng.randrange(20, 90)].upper()) for i in range(20)]
    titles += [(99, "x" * 40)]
    squash = lambda s: "".join(c for c in s.lower() if c.isalnum())
    got = P.leaked(
        spark.createDataFrame(titles, "t int, title string"), "t", "title", spark.createDataFrame(docs, "d int, body string"), "d", "body"
    )
    want = sorted((t, d) for t, s in titles for d, b in docs if len(squash(s)) > 24 and squash(s) in squash(b))
    assert rows(got) == want and len(want) > 5


def test_outline_skips_fences_and_numbers_repeats(spark):
    body = "## One\n```\n## hidden\n```\n## **One** [x](/y)\n## ???\n## Ñu\n## One"
    df = spark.createDataFrame([(1, body)], "d int, body string")
    out = P.heading_ids(P.outline(df, "d", "body"), "d")
    assert [r["id"] for r in sorted(out.collect(), key=lambda r: r["pos"])] == ["one", "one-x", "nu", "one-2"]


def test_robots_uses_the_star_group_only(spark):
    text = ["User-agent: other", "Disallow: /", "User-agent: *", "Disallow: /private # no", "Disallow:"]
    lines = spark.createDataFrame([("h", i, t) for i, t in enumerate(text)], "host string, pos int, line string")
    pages = spark.createDataFrame([("http://h/private/x",), ("http://h/ok",), ("http://g/private",)], "url string")
    got = {r["url"]: r["rule"] for r in P.robots_verdict(pages, "url", P.robots_rules(lines)).collect()}
    assert got == {"http://h/private/x": "/private", "http://h/ok": None, "http://g/private": None}




def test_pages_without_a_source_lose_no_figure(spark):
    from civicloom.operators import corpus as C

    pages = spark.createDataFrame([(1, "PHP 50 and PHP 70"), (2, "PHP 60"), (3, "none")], "k int, body string")
    source = spark.createDataFrame([(1, "fee PHP  50"), (3, "x")], "k int, text string")
    got = C.untraceable_figures(pages, source, ["k"], "body", "text").collect()
    assert sorted((r["k"], r["figure"]) for r in got) == [(1, "PHP 70"), (2, "PHP 60")]


def test_absence_without_any_attempt_is_found(spark):
    absent = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    attempts = spark.createDataFrame([(1, "cited"), (1, "other"), (2, "other")], "k int, place string")
    got = V.uncited_absences(absent, attempts, ["k"], F.col("place") == "cited").collect()
    assert sorted(r["k"] for r in got) == [2, 3]


def test_labels_that_wrap_are_read(spark):
    from civicloom.plans import jobs as J

    lines = ["Office or Division", "Office or", "Division: Registry", "Who may", "avail: All", "Classification", "  Simple"]
    text = spark.createDataFrame([("a.pdf", i, x) for i, x in enumerate(lines)], "doc string, pos int, text string")
    got = J.job_enumerate(text, "doc").first()
    assert (got["office"], got["owning_office"], got["eligibility"], got["classification"]) == ("Registry", "present", "present", "Simple")


def test_a_lost_step_is_held(spark, monkeypatch):
    """The ledger reads the published body: a renderer that drops a plain step, a total or a cell is caught."""
    from civicloom.plans import jobs as J

    cols = "k string, pos int, " + ", ".join(f"{f} string" for f in RC.STEP_FIELDS)
    data = [
        ("r", 1, "1. Bring alpha", None, None, None, "Registrar"), ("r", 2, "Submit beta", "Check gamma", "PHP 5.00", "3 Minutes", "Clerk"),
        ("r", 3, "Sign delta", None, None, "4 Minutes", "Clerk"), ("r", 4, "TOTAL", None, "PHP 9.00", "7 Minutes", None),
        ("s", 1, "Go epsilon", None, "None", None, None), ("s", 2, None, None, None, None, None),
    ]
    lines = spark.createDataFrame(data, cols)
    entries = spark.createDataFrame([("r", "Hall"), ("s", None)], "k string, office string")
    known = entries.select("k", *[F.lit("present").alias(f"k_{c}") for c in ("other", "fees", "time")], F.lit(None).cast("string").alias("eligibility"))

    def held():
        return sorted(map(tuple, J.job_publish(lines, entries, known, "k", {"Office": F.col("office")}, ["en", "fil"])[2].collect()))

    assert held() == []
    real = RC.render
    for lost, want in [((F.col("block") == 3) & (F.col("line_no") == 3), [("r", 3)]), (F.col("block") == 4, [("r", 4)]), (F.col("line").contains("alpha"), [("r", 1)])]:
        monkeypatch.setattr(RC, "render", lambda *a, lost=lost, **k: real(*a, **k).where(~lost))
        assert held() == want
    monkeypatch.setattr(RC, "render", lambda *a, **k: real(*a, **k).withColumn("line", F.replace("line", F.lit("gamma"), F.lit(""))))
    assert held() == [("r", 2)]
