"""What a job reads or joins more than once."""

import os
import random

from pyspark.sql import functions as F

from civicloom.operators import layout as L
from civicloom.operators import records as RC
from civicloom.operators import segments as SG
from civicloom.operators import skew
from civicloom.plans import jobs as J


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_a_page_are_counted_once(spark):
    """Columns with fewer cells than the spine come from one count of the cells; a page without a name has none."""
    rows = [("a", 1, "fee", 1.0), ("a", 1, "agencyAction", 1.0), ("a", 1, "agencyAction", 2.0), ("a", 2, "fee", 1.0), ("a", 2, "clientStep", 1.0), ("b", 1, None, 1.0)]
    rows += [("b", 1, None, 2.0), ("b", 1, "fee", 1.0), ("b", 1, "clientStep", 1.0), (None, 1, "fee", 1.0), (None, 1, "agencyAction", 1.0), (None, 1, "agencyAction", 2.0)]
    cells = spark.createDataFrame(rows, "doc string, page int, key string, y0 double").withColumn("y1", F.col("y0") + 1)
    merged = L.row_bands(cells)[1]
    assert "Join" not in plan(merged) and plan(merged).count("count(1)") == 1
    assert sorted(map(tuple, merged.collect())) == [("a", 1, "fee"), ("b", 1, "fee")]


def test_published_records_are_filed_once(spark, monkeypatch):
    """Filing is told in the pass that parts the lines; neither the body nor the ledger joins the entries' keys again."""
    none = F.lit(None).cast("string")
    raw = spark.createDataFrame([(1, 1, "PHP 5.00"), (1, 2, None), (2, 1, "PHP 6.00"), (None, 1, "PHP 7.00")], "k long, pos long, fee string")
    lines = raw.withColumns({c: F.lit("a step") if c == "clientStep" else none for c in RC.STEP_FIELDS if c != "fee"})
    entries = spark.createDataFrame([(1, "North"), (1, "North"), (None, "Null")], "k long, office string")
    known = spark.createDataFrame([], "k long, eligibility string, k_other string, k_fees string, k_time string")
    plans = []
    real = skew.settle
    monkeypatch.setattr(skew, "settle", lambda df: plans.append(plan(df)) or real(df))
    content, body, ledger = J.job_publish(lines, entries, known, "k", {"Office": F.col("office")}, ["en"])
    assert not any("LeftSemi" in p for p in plans)
    assert sorted(r.k for r in content.collect()) == [1, 2]
    steps = body.where("block = 3 AND line_no >= 0").select("k", "line_no").collect()
    assert sorted(map(tuple, steps)) == [(1, 1), (1, 2)]
    assert ledger.count() == 0


def test_telling_lines_name_the_services(spark):
    """Anchors are the same whether every line is scanned or only those that tell something."""
    texts = ["plain", "External", "Services", "7. Renew licence", "more", "Office or Division: A", "TOTAL: 5", "x",
             "8. Behind a barrier", "TOTAL: 6", "Office or Division: B", "INTERNAL SERVICES", "9. Far", *["y"] * 20, "Office or Division: C"]
    lines = spark.createDataFrame([("d", i * 3000, t) for i, t in enumerate(texts, 1)] + [("e", 1, "Office or Division")], "doc string, pos long, text string")
    barrier = F.col("text").rlike(SG.TOTAL)
    whole = SG.services(SG.annotate(lines, "doc", "pos", "text", 15000, barrier), "doc", "pos")
    told = SG.telling(SG.flagged(lines, "doc", "pos", "text", barrier))
    few = SG.services(SG.scanned(told, "doc", "pos", 15000), "doc", "pos")
    assert told.count() < lines.count()
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.collect()))
    assert {(r.doc, r.seg, r.number, r.section) for r in few.collect()} == {
        ("d", 1, 7, "external"), ("d", 2, None, "internal"), ("d", 3, None, "internal"), ("e", 1, None, "unknown")}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_of_a_low_page_meet_once(spark):
    """Bands and rows of pages of one piece need one shuffle each, and are those of pages that are cut into pieces."""
    rng = random.Random(5)
    rows = []
    for doc in ("a", "b", None):
        for page, steps in ((1, 30), (2, 1), (3, 400)):
            for i in range(steps):
                keys = [k for k in ("clientStep", "fee", "column0", None) if rng.random() < 0.7]
                rows += [(doc, page, k, i * 12.0 + rng.choice([0.0, 1.0]), i * 12.0 + 9, f"{k} {rng.randrange(9)}", page == 3) for k in keys]
    marked = spark.createDataFrame(rows, "doc string, page int, key string, y0 double, y1 double, text string, is_tall boolean")
    plain = marked.drop("is_tall")
    found = {}
    for df in (marked, plain, plain.withColumn("is_tall", F.lit(False))):
        bands, merged = L.row_bands(df)
        known = spark.createDataFrame(bands.collect(), bands.schema)
        placed = L.rows(df, known)
        needed = shuffles(L.row_bands(df)[0]), shuffles(placed)
        found.setdefault("bands", []).append(sorted(map(str, bands.collect())))
        found.setdefault("merged", []).append(sorted(map(str, merged.collect())))
        found.setdefault("rows", []).append(sorted(map(str, placed.collect())))
    assert all(each[0] == each[1] == each[2] and each[0] for each in found.values())
    assert needed == (1, 1)


def test_a_cell_of_several_lines(spark):
    """The first line of a cell says where it begins, the lowest where it ends; texts join in reading order."""
    rows = [("d", 1, "fee", 0, 40.0, 12.0, 30.0, "b"), ("d", 1, "fee", 0, 40.0, 10.0, 20.0, "a"), ("d", 1, "fee", 0, 50.0, 12.0, 22.0, "c"), ("d", 1, "fee", 0, 40.0, 90.0, 99.0, "z")]
    for tall in (False, True):
        df = spark.createDataFrame([(*r, tall) for r in rows], "doc string, page int, key string, block long, x0 double, y0 double, y1 double, text string, is_tall boolean")
        got = sorted(tuple(r) for r in L.cells(df).select("cell", "y0", "y1", "text", "is_tall").collect())
        assert got == [(1, 10.0, 30.0, "a b c", tall), (2, 90.0, 99.0, "z", tall)]


def test_services_reach_over_pieces(spark):
    """Lines get their service, and what is known of it, in one shuffle of the lines, however many pieces lie between its start and them."""
    lines = spark.createDataFrame([(d, p, f"t{p}") for d in ("a", "b", None) for p in range(1, 40)], "doc string, pos long, text string")
    found = spark.createDataFrame([("a", 3, "x"), ("a", 3, "x"), ("a", 20, "y"), ("a", 21, None), ("b", 39, "z"), (None, 1, "n")], "doc string, start long, name string")
    got = SG.assign(lines, found, "doc", "pos", chunk=4, own=["name"])
    assert got.columns == ["doc", "pos", "text", "service", "name"]
    want = [("a", p, f"t{p}", *((1, "x") if p < 20 else (2, "y") if p == 20 else (3, None))) for p in range(3, 40)] + [("b", 39, "t39", 1, "z")]
    assert sorted(map(tuple, got.collect())) == want


def test_scans_over_the_same_pieces_share_a_shuffle(spark):
    lines = spark.createDataFrame([("d", i, f"{i % 3}. w" if i % 4 else "-") for i in range(30)], "doc string, pos long, text string").withColumn("_p", F.floor(F.col("pos") / 8))
    scan = lambda piece: skew.prefix_scan(skew.following(lines, ["doc"], ["pos"], piece, {"after": "text"}), ["doc"], ["pos"], piece, [skew.Measure("n", "count", F.col("after"))])
    once, twice = scan("_p"), scan(F.col("_p") + 0)
    assert once.columns == twice.columns and sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert shuffles(once) < shuffles(twice)


def test_an_audit_keeps_findings_alone(spark, monkeypatch):
    """Tables that a check settles on its way are gone when the audit has its findings."""
    import __spark_entry__  # noqa: F401 - registers the queries in their order
    from civicloom.bindings import b_zjobs as B

    def check(spark, folder):
        return skew.settle(skew.settle(spark.range(5).withColumnRenamed("id", "k")).where("k > 2"))

    monkeypatch.setitem(B.QUERIES, "one_check", check)
    monkeypatch.setattr(B, "AUDIT", {"one_check": ["k"]})
    folder = skew.checkpoint_folder(spark)
    before = set(os.listdir(folder))
    found = B.QUERIES["job_audit"](spark, "no folder")
    assert sorted(map(tuple, found.collect())) == [("one_check", "3", ""), ("one_check", "4", "")]
    assert len(set(os.listdir(folder)) - before) == 1
