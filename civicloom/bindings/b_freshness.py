from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civicloom.bindings.registry import Tables, query
from civicloom.operators import freshness as FR
from civicloom.operators import validate as V
from civicloom.operators.skew import checkpoint_folder
from civicloom.plans import jobs as J

AS_OF = "2001-06-01"
CADENCES = [
    ("1-URGENT", 90),
    ("2-HIGH", 180),
    ("3-MEDIUM", 365),
    ("4-NOT SPECIFIED", 730),
    ("9-UNUSED", 30),
]
FORCED = ["2-HIGH"]


def as_of():
    return F.lit(AS_OF).cast("date")


def classes(t: Tables):
    return t.spark.createDataFrame(CADENCES, "name string, cadence_days int")


def pages(t: Tables):
    """orders as published entries; low priority is an undeclared class."""
    return t.orders.select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("data_class"),
        F.to_date("o_orderdate").alias("last_checked_at"),
        F.when(F.col("o_totalprice") > 400000, "verifier").alias("review_role"),
        F.when(F.col("o_orderstatus") == "F", "V3")
        .when(F.col("o_orderstatus") == "O", "V2")
        .otherwise("V0")
        .alias("verification"),
    )


def stated(t: Tables):
    return FR.states(pages(t), classes(t), as_of(), FORCED)


SQL = f"""classes(name, cadence) AS (VALUES {', '.join(f"('{n}', {c})" for n, c in CADENCES)}),
pages AS (
  SELECT o_orderkey AS key, o_orderpriority AS data_class, CAST(o_orderdate AS DATE) AS last_checked_at,
         CASE WHEN o_totalprice > 400000 THEN 'verifier' END AS review_role,
         CASE o_orderstatus WHEN 'F' THEN 'V3' WHEN 'O' THEN 'V2' ELSE 'V0' END AS verification FROM orders),
aged AS (
  SELECT p.*, c.cadence, date_diff('day', last_checked_at, DATE '{AS_OF}') AS age
  FROM pages p LEFT JOIN classes c ON c.name = p.data_class),
stated AS (
  SELECT *, CASE WHEN cadence IS NULL THEN NULL WHEN age < 0 THEN 'undated'
    WHEN data_class = '2-HIGH' OR age > cadence THEN 'stale'
    WHEN age > 0.9 * cadence THEN 'due' ELSE 'fresh' END AS state FROM aged)
"""


@query("job_freshness", f"""WITH {SQL},
h AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE state IN ('stale', 'due')) AS overdue, count(*) FILTER (WHERE state = 'undated') AS undated,
  count(review_role) AS reviewed, count(*) FILTER (WHERE cadence IS NULL) AS undeclared, count(DISTINCT data_class) AS manifests FROM stated)
SELECT key, data_class, age, state, h.* FROM stated, h""")
def _(t):
    head, rows, _, _ = freshness_job(t, report=False)
    counts = {c: head.select(c).scalar() for c in head.columns}
    return rows.select("key", "data_class", "age", "state").withColumns(counts)


def freshness_job(t: Tables, **options):
    path = f"{checkpoint_folder(t.spark)}/freshness-{uuid.uuid4().hex}"
    listed = pages(t).withColumn("manifest", F.col("data_class"))
    return J.job_freshness(listed, classes(t), as_of(), "key", "manifest", path, "only", FORCED, baseline(t), **options)


@query("job_freshness_report", f"""WITH {SQL}, byc AS (SELECT c.name, c.cadence, count(s.key) AS pages,
    count(*) FILTER (WHERE s.state IN ('stale', 'due')) AS overdue
  FROM classes c LEFT JOIN stated s ON s.data_class = c.name GROUP BY 1, 2)
SELECT 0 AS section, 0 AS rank, '' AS key, 'Generated **{AS_OF}**, against ' || count(*) || ' published pages in ' || count(DISTINCT data_class) || ' manifests.' AS line FROM stated
UNION ALL SELECT 1, 0, name, '| `' || name || '` | ' || cadence || ' days | ' || pages || ' | ' || overdue || ' |' FROM byc
UNION ALL SELECT 2, -age, CAST(key AS VARCHAR), '| `' || key || '` | `' || data_class || '` | ' ||
  strftime(last_checked_at, '%Y-%m-%d') || ' | ' || age || ' days | **' || state || '** |' FROM stated WHERE state IN ('stale', 'due')
UNION ALL SELECT 3, 0, CAST(key AS VARCHAR), '- `' || key || '` — ' || strftime(last_checked_at, '%Y-%m-%d') FROM stated WHERE state = 'undated'
UNION ALL SELECT 4, 0, '', count(review_role) || ' of ' || count(*) || ' pages carry a review.' FROM stated""")
def _(t):
    return freshness_job(t, record_baseline=True)[2]


@query("job_freshness_findings", f"""WITH {SQL}, baseline AS (
  SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS recorded
  FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice > 250000))
SELECT CAST(key AS VARCHAR) AS key, 'undeclared-class' AS kind, data_class AS detail FROM stated WHERE cadence IS NULL
UNION ALL SELECT CAST(key AS VARCHAR), 'future-date', strftime(last_checked_at, '%Y-%m-%d') FROM stated WHERE age < 0
UNION ALL SELECT CAST(p.key AS VARCHAR), CASE WHEN b.key IS NULL THEN 'not-in-baseline' ELSE 'advanced-unreviewed' END, strftime(p.last_checked_at, '%Y-%m-%d')
FROM stated p LEFT JOIN baseline b ON b.key = p.key WHERE b.key IS NULL OR (p.last_checked_at > b.recorded AND p.review_role IS NULL)""")
def _(t):
    return freshness_job(t, report=False)[3]


@query(
    "agg_freshness_by_class",
    f"""WITH {SQL} SELECT c.name AS data_class, c.cadence, count(s.key) AS pages,
  count(*) FILTER (WHERE s.state IN ('stale', 'due')) AS overdue
FROM classes c LEFT JOIN stated s ON s.data_class = c.name GROUP BY 1, 2""",
)
def _(t):
    return FR.by_class(stated(t), classes(t))


@query(
    "srt_overdue",
    f"WITH {SQL} SELECT key, age, state FROM stated WHERE state IN ('stale', 'due') ORDER BY age DESC, key",
)
def _(t):
    return FR.overdue(stated(t), "key").select("key", "age", "state")


@query("val_undeclared_class", f"WITH {SQL} SELECT key, data_class FROM stated WHERE cadence IS NULL")
def _(t):
    return FR.undeclared(stated(t)).select("key", "data_class")


@query("agg_checked_at", f"""WITH {SQL} SELECT 'all' AS tree, strftime(max(last_checked_at), '%Y-%m-%d') AS checked_at
FROM pages UNION ALL SELECT 'empty', NULL""")
def _(t):
    full = FR.checked_at(pages(t)).select(F.lit("all").alias("tree"), F.col("checked_at").cast("string"))
    empty = FR.checked_at(pages(t).where(F.col("data_class") == "no such class"))
    return full.unionByName(empty.select(F.lit("empty").alias("tree"), F.col("checked_at").cast("string")))


@query(
    "val_no_future_dates",
    f"""WITH {SQL} SELECT key, 'last_checked_at' AS field, strftime(last_checked_at, '%Y-%m-%d') AS value
FROM pages WHERE last_checked_at > DATE '{AS_OF}'""",
)
def _(t):
    return FR.future_dates(pages(t), "key", ["last_checked_at"], as_of()).withColumn(
        "value", F.col("value").cast("string")
    )


BASE = """baseline AS (
  SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS recorded
  FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice > 250000))"""


def baseline(t: Tables):
    return t.orders.where(~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000))).select(
        F.col("o_orderkey").alias("key"),
        F.date_sub(F.to_date("o_orderdate"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias(
            "last_checked_at"
        ),
    )


@query(
    "jn_baseline_advance",
    f"""WITH {SQL}, {BASE} SELECT p.key, CASE WHEN b.key IS NULL THEN 'not-in-baseline' ELSE 'advanced-unreviewed' END AS kind
FROM pages p LEFT JOIN baseline b ON b.key = p.key
WHERE b.key IS NULL OR (p.last_checked_at > b.recorded AND p.review_role IS NULL)""",
)
def _(t):
    return FR.baseline_advance(pages(t), baseline(t), "key").select("key", "kind")


@query(
    "snk_baseline",
    f"WITH {SQL} SELECT key, strftime(last_checked_at, '%Y-%m-%d') AS last_checked_at FROM pages ORDER BY key",
)
def _(t):
    from civicloom.sources.writers import baseline_frame

    return baseline_frame(pages(t), "key").withColumn("last_checked_at", F.col("last_checked_at").cast("string"))


@query(
    "snk_report",
    f"""WITH {SQL}, byc AS (SELECT c.name, c.cadence, count(s.key) AS pages,
    count(*) FILTER (WHERE s.state IN ('stale', 'due')) AS overdue
  FROM classes c LEFT JOIN stated s ON s.data_class = c.name GROUP BY 1, 2)
SELECT 1 AS section, 0 AS rank, name AS key,
  '| `' || name || '` | ' || cadence || ' days | ' || pages || ' | ' || overdue || ' |' AS line FROM byc
UNION ALL SELECT 2, -age, CAST(key AS VARCHAR), '| `' || key || '` | `' || data_class || '` | ' ||
  strftime(last_checked_at, '%Y-%m-%d') || ' | ' || age || ' days | **' || state || '** |'
  FROM stated WHERE state IN ('stale', 'due')
UNION ALL SELECT 3, 0, CAST(key AS VARCHAR), '- `' || key || '` — ' || strftime(last_checked_at, '%Y-%m-%d')
  FROM stated WHERE state = 'undated'""",
)
def _(t):
    return FR.report(stated(t), classes(t), "key").orderBy("section", "rank", "key")


@query("val_cadence_config", """
WITH c AS (SELECT p_brand AS name, min(p_size) - 2 AS cadence, max(CASE WHEN p_type = 'PROMO' THEN p_name END) AS why,
    count(*) FILTER (WHERE p_size > 49) AS triggers FROM part GROUP BY 1),
v AS (SELECT name, cadence <= 0 AS a, why IS NULL AS b, triggers = 0 AS d FROM c)
SELECT name, 'cadence-not-positive' AS rule FROM v WHERE a
UNION ALL SELECT name, 'no-reason' FROM v WHERE b
UNION ALL SELECT name, 'no-trigger' FROM v WHERE d
UNION ALL SELECT name, 'urgent-class-not-shortest' FROM c
  WHERE name = 'Brand#1' AND cadence > (SELECT min(cadence) FROM c)""")
def _(t):
    dim = t.part.groupBy(F.col("p_brand").alias("name")).agg(
        (F.min("p_size") - 2).alias("cadence_days"),
        F.max(F.when(F.col("p_type") == "PROMO", F.col("p_name"))).alias("why"),
        F.count_if(F.col("p_size") > 49).alias("triggers"),
    )
    shortest = dim.agg(F.min("cadence_days")).scalar()
    dim = dim.withColumn("is_longer", F.col("cadence_days") > shortest)
    rules = [
        V.Rule("cadence-not-positive", "cadenceDays", F.col("cadence_days") <= 0, "must be positive"),
        V.Rule("no-reason", "why", V.blank("why"), "say why"),
        V.Rule("no-trigger", "immediateTriggers", F.col("triggers") == 0, "name at least one"),
        V.Rule(
            "urgent-class-not-shortest",
            "cadenceDays",
            (F.col("name") == "Brand#1") & F.col("is_longer"),
            "must be the shortest",
        ),
    ]
    return V.violations(dim, ["name"], rules).select("name", "rule")
