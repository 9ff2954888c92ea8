from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civicloom.bindings.registry import Tables, query
from civicloom.functions import text as T
from civicloom.operators import aggregate as A
from civicloom.operators import corpus as C
from civicloom.operators import records as RC
from civicloom.operators import validate as V
from civicloom.operators.skew import checkpoint_folder, first_n, lookup_join, ordinal
from civicloom.sources import commits
from civicloom.sources import writers as SNK

# ---------------------------------------------------------------- services from lineitem

# Line order of a document: the printed number is not unique, so the rest of
# the row breaks ties.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ORDER_SQL = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def section():
    return F.when(F.col("l_linestatus") == "F", "external").when(F.col("l_returnflag") == "R", "internal")


def services(t: Tables):
    return t.lineitem.withColumn("section", section())


SERVICES = """services AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'external' WHEN l_returnflag = 'R' THEN 'internal' END AS section
  FROM lineitem)"""


@query("win_service_id", f"""WITH {SERVICES}
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, 'order-' || l_orderkey || '#' || coalesce(section, 'unknown') || '-' ||
  row_number() OVER (PARTITION BY l_orderkey, coalesce(section, 'unknown') ORDER BY {ORDER_SQL}) AS id FROM services""")
def _(t):
    s = services(t).withColumn("section", F.coalesce("section", F.lit("unknown")))
    numbered = ordinal(
        s.select("l_orderkey", "section", *ORDER), ["l_orderkey", "section"], ORDER, F.floor(F.col("l_linenumber") / 4096), "n"
    )
    stem = T.stem(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(".PDF")))
    return numbered.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
        F.concat(stem, F.lit("#"), F.col("section"), F.lit("-"), F.col("n").cast("string")).alias("id"),
    )


@query("agg_service_counts", f"""WITH {SERVICES}
SELECT l_orderkey, count(*) FILTER (WHERE section = 'external') AS external, count(*) FILTER (WHERE section = 'internal') AS internal,
  count(*) FILTER (WHERE section IS NULL) AS "unknown", count(*) AS total FROM services GROUP BY 1""")
def _(t):
    return A.service_counts(services(t), "l_orderkey", "section", ["external", "internal"])


@query("agg_source_notes", f"""WITH {SERVICES}
SELECT l_orderkey, '- **Derived:** ' || count(*) || ' services — ' || count(*) FILTER (WHERE section = 'external') || ' external, ' ||
  (count(*) - count(*) FILTER (WHERE section = 'external')) || ' internal' AS note FROM services GROUP BY 1""")
def _(t):
    n = A.service_counts(services(t), "l_orderkey", "section", ["external", "internal"])
    return n.select(
        "l_orderkey",
        F.format_string(
            "- **Derived:** %d services — %d external, %d internal", "total", "external", F.col("total") - F.col("external")
        ).alias("note"),
    )


@query("agg_extraction_report", """
SELECT l_returnflag AS document, CAST(grouping(l_returnflag) AS INTEGER) AS is_total, count(*) AS services, count(*) FILTER (WHERE l_tax > 0) AS with_fee,
  count(*) FILTER (WHERE l_discount = 0) AS no_time, max(l_linenumber) AS longest FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def _(t):
    return A.rollup_report(
        t.lineitem.withColumnRenamed("l_returnflag", "document"),
        "document",
        {
            "services": F.count(F.lit(1)),
            "with_fee": F.count_if(F.col("l_tax") > 0),
            "no_time": F.count_if(F.col("l_discount") == 0),
            "longest": F.max("l_linenumber"),
        },
    )


@query("snk_per_document", f"""WITH {SERVICES}
SELECT l_orderkey AS document, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS seq, l_partkey,
  coalesce(section, 'unknown') AS section FROM services""")
def _(t):
    # Rows read back from the documents' folders; the counts are agg_service_counts. The folder is that
    # of a document's last two digits: the tables have many small documents.
    s = services(t).select("l_orderkey", "section", *ORDER)
    rows = ordinal(s, ["l_orderkey"], ORDER, F.floor(F.col("l_linenumber") / 4096), "seq").select(
        F.col("l_orderkey").alias("document"), "seq", "l_partkey", F.coalesce("section", F.lit("unknown")).alias("section"),
        (F.col("l_orderkey") % 20).cast("int").alias("folder"),
    )
    path = f"{checkpoint_folder(t.spark)}/documents-{uuid.uuid4().hex}"
    for _ in range(2):
        SNK.write_per_document(rows, path, "folder", "only")
    return commits.load(t.spark, path, rows.schema).drop("folder")


# ---------------------------------------------------------------- records with steps


def step_columns():
    """Charter columns of a line: some rows have no fee or time, some only a fee."""
    idle = F.col("l_discount") >= 0.09
    return [
        F.when(idle, None).when(F.col("l_linenumber") % 2 == 1, F.concat(F.col("l_linenumber").cast("string"), F.lit(". Submit form "), F.col("l_partkey").cast("string"))).alias("clientStep"),
        F.when(~idle, F.concat(F.lit("Check part "), F.col("l_partkey").cast("string"), F.when(F.col("l_tax") == 0.05, " for").otherwise(""))).alias("agencyAction"),
        F.when((F.col("l_returnflag") == "R") | idle, F.concat(F.lit("PHP "), F.col("l_quantity").cast("int").cast("string"), F.lit(".00"))).alias("fee"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.col("l_linenumber").cast("string"), F.lit(" Minutes"))).alias("processingTime"),
        F.when(~idle, F.concat(F.lit("Officer "), F.col("l_suppkey").cast("string"))).alias("personResponsible"),
    ]


STEPS = f"""steps AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS i, fee IS NOT NULL OR processingTime IS NOT NULL AS timed,
    clientStep IS NULL AND agencyAction IS NULL AND personResponsible IS NULL AND (fee IS NOT NULL OR processingTime IS NOT NULL) AS is_total FROM (
  SELECT l_orderkey, {ORDER_SQL},
  CASE WHEN l_discount >= 0.09 THEN NULL WHEN l_linenumber % 2 = 1 THEN l_linenumber || '. Submit form ' || l_partkey END AS clientStep,
  CASE WHEN l_discount < 0.09 THEN 'Check part ' || l_partkey || CASE WHEN l_tax = 0.05 THEN ' for' ELSE '' END END AS agencyAction,
  CASE WHEN l_returnflag = 'R' OR l_discount >= 0.09 THEN 'PHP ' || CAST(l_quantity AS INTEGER) || '.00' END AS fee,
  CASE WHEN l_linestatus = 'F' THEN l_linenumber || ' Minutes' END AS processingTime,
  CASE WHEN l_discount < 0.09 THEN 'Officer ' || l_suppkey END AS personResponsible FROM lineitem))"""


def lines(t: Tables):
    """Lines of every record, numbered in document order."""
    raw = t.lineitem.select("l_orderkey", *ORDER, *step_columns())
    return ordinal(raw, ["l_orderkey"], ORDER, F.floor(F.col("l_linenumber") / 4096), "pos")


def parted(t: Tables):
    return RC.sectioned(lines(t), ["l_orderkey"])


PARTS = f"""{STEPS}, marks AS (SELECT l_orderkey, max(i) FILTER (WHERE is_total) AS tpos, min(i) FILTER (WHERE timed) AS fpos FROM steps GROUP BY 1),
pt AS (SELECT s.*, CASE WHEN i < fpos THEN 'requirement' WHEN i = tpos THEN 'total' ELSE 'step' END AS part
  FROM steps s JOIN marks m ON m.l_orderkey = s.l_orderkey)"""


@query("win_total_row", f"""WITH {PARTS}
SELECT l_orderkey, count(*) FILTER (WHERE part = 'step') AS steps, max(fee) FILTER (WHERE part = 'total') AS total_fee,
  max(processingTime) FILTER (WHERE part = 'total') AS total_time FROM pt GROUP BY 1""")
def _(t):
    return RC.measures(parted(t), ["l_orderkey"]).select(
        "l_orderkey", F.col("rows").alias("steps"), F.col("totalFee").alias("total_fee"), F.col("totalProcessingTime").alias("total_time")
    )


@query("win_first_real", f"""WITH {PARTS} SELECT l_orderkey, i AS pos, part FROM pt""")
def _(t):
    return parted(t).select("l_orderkey", "pos", "part")


@query("agg_distinct_values", f"""WITH {PARTS}
SELECT l_orderkey, fee AS value, bool_and(part = 'total') AS from_total, coalesce(min(i) FILTER (WHERE part <> 'total'), min(i)) AS first_pos
FROM pt WHERE fee IS NOT NULL GROUP BY 1, 2""")
def _(t):
    out = RC.distinct_values(parted(t), ["l_orderkey"], "fee")
    return out.select("l_orderkey", "value", F.col("at.is_total").alias("from_total"), F.col("at.pos").alias("first_pos"))


@query("fn_fees_fallback", f"""WITH {STEPS},
k AS (SELECT l_orderkey, CASE WHEN l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey < 50) THEN fee END AS kept, fee FROM steps)
SELECT DISTINCT l_orderkey, kept AS value FROM k WHERE kept IS NOT NULL
UNION SELECT l_orderkey, fee FROM k WHERE fee IS NOT NULL AND l_orderkey NOT IN (SELECT l_orderkey FROM k WHERE kept IS NOT NULL)""")
def _(t):
    # Records without a low-numbered supplier lose their fee column; the figure
    # is then only in the prose of the line.
    keep = t.lineitem.where(F.col("l_suppkey") < 50).select("l_orderkey").distinct().withColumn("keeps", F.lit(True))
    prose = lookup_join(lines(t), keep, ["l_orderkey"]).withColumn("prose", F.concat(F.lit("Pay "), F.coalesce("fee", F.lit("nothing")))).withColumn(
        "fee", F.when(F.col("keeps"), F.col("fee"))
    )
    return RC.fees_or_prose(RC.sectioned(prose, ["l_orderkey"]), ["l_orderkey"], "prose").select("l_orderkey", "value")


@query("prj_content_struct", f"""WITH {STEPS}
SELECT l_orderkey, i AS pos, clientStep, agencyAction, fee, processingTime, personResponsible FROM steps
WHERE coalesce(clientStep, agencyAction, fee, processingTime, personResponsible) IS NOT NULL""")
def _(t):
    return RC.content_steps(lines(t)).select("l_orderkey", "pos", *RC.STEP_FIELDS)


def enumerated(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(F.col("o_totalprice") > 450000, "Everyone").alias("eligibility"),
        F.when(F.col("o_orderstatus") == "F", "present").otherwise("absent").alias("k_fees"),
        F.when(F.col("o_orderstatus") == "O", "present").otherwise("absent").alias("k_time"),
        F.when(F.col("o_orderpriority") == "5-LOW", "present").otherwise("absent").alias("k_other"),
    )


NOT_STATED = f"""{PARTS},
x AS (SELECT l_orderkey, count(fee) FILTER (WHERE part = 'step') AS nf, count(processingTime) FILTER (WHERE part = 'step') AS np,
  max(fee) FILTER (WHERE part = 'total') AS tf, max(processingTime) FILTER (WHERE part = 'total') AS tp,
  count(clientStep) FILTER (WHERE part = 'requirement') AS nr, count(*) AS n_lines, count(*) FILTER (WHERE part = 'step') AS n_steps
  FROM pt GROUP BY 1),
ns AS (SELECT o_orderkey AS l_orderkey, concat_ws(',', 'whereToGo', 'officeHours', CASE WHEN o_orderpriority <> '5-LOW' THEN 'output' END,
  CASE WHEN o_totalprice <= 450000 AND o_orderpriority <> '5-LOW' THEN 'eligibility' END,
  CASE WHEN coalesce(nr, 0) = 0 AND o_orderpriority <> '5-LOW' THEN 'requirements' END,
  CASE WHEN coalesce(nf, 0) = 0 AND tf IS NULL AND o_orderstatus <> 'F' THEN 'fees' END,
  CASE WHEN coalesce(np, 0) = 0 AND tp IS NULL AND o_orderstatus <> 'O' THEN 'processingTime' END) AS not_stated, x.n_lines, x.n_steps
FROM orders LEFT JOIN x ON x.l_orderkey = o_orderkey)"""


@query("prj_not_stated", f"WITH {NOT_STATED} SELECT l_orderkey, not_stated FROM ns")
def _(t):
    known = {k: F.col("k_other") for k in ("output", "eligibility", "requirements")}
    known |= {"fees": F.col("k_fees"), "processingTime": F.col("k_time")}
    j = enumerated(t).join(RC.measures(parted(t), ["l_orderkey"]), "l_orderkey", "left")
    return j.select("l_orderkey", F.array_join(RC.not_stated(known), ",").alias("not_stated"))


@query("win_confidence", f"""WITH {PARTS},
x AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE timed) AS timed,
   count(agencyAction) + count(clientStep) AS prose, count(*) FILTER (WHERE agencyAction LIKE '% for') AS dangling
   FROM pt WHERE part = 'step' GROUP BY 1),
rq AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS paired, count(*) FILTER (WHERE l_partkey < 5) AS bad FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR x.n IS NULL THEN 'needs-human'
  WHEN x.n <= 20 AND timed = 0 THEN 'needs-human'
  WHEN x.n <= 20 AND timed * 2 < x.n AND o_orderstatus <> 'F' THEN 'needs-human'
  WHEN bad > 0 OR (paired > 0 AND rq.n > 3 AND paired * 2 < rq.n) THEN 'needs-human'
  WHEN x.n <= 20 AND dangling * 10 > prose * 3 THEN 'needs-human' ELSE 'high' END AS confidence
FROM orders LEFT JOIN x ON x.l_orderkey = o_orderkey LEFT JOIN rq ON rq.l_orderkey = o_orderkey""")
def _(t):
    m = RC.measures(parted(t), ["l_orderkey"])
    reqs = t.lineitem.select(
        "l_orderkey",
        F.when(F.col("l_partkey") < 5, "at").otherwise("Birth certificate").alias("item"),
        F.when(F.col("l_quantity") > 25, "Registrar").alias("whereToSecure"),
    )
    ok = RC.requirements_coherent(reqs, ["l_orderkey"])
    j = t.orders.withColumnRenamed("o_orderkey", "l_orderkey").join(m, "l_orderkey", "left").join(ok, "l_orderkey", "left")
    level = RC.confidence(
        office=F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        merged=F.col("o_orderstatus") == "F",
        no_columns=F.lit(False),
        unresolved=F.lit(0),
        reqs_ok=F.coalesce("coherent", F.lit(True)),
    )
    return j.select("l_orderkey", level.alias("confidence"))


@query("jn_confidence_present", """
WITH e AS (SELECT l_orderkey AS id, CASE WHEN max(l_discount) >= 0.1 THEN 'unsure' WHEN min(l_tax) > 0 THEN 'high' ELSE 'needs-human' END AS c
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN c IS NULL THEN 'no-extraction' ELSE 'unknown-confidence' END AS kind FROM orders LEFT JOIN e ON id = o_orderkey
WHERE c IS NULL OR c NOT IN ('high', 'needs-human')""")
def _(t):
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.when(F.max("l_discount") >= 0.1, "unsure").when(F.min("l_tax") > 0, "high").otherwise("needs-human").alias("c")
    )
    return C.confidence_present(t.orders.select(F.col("o_orderkey").alias("id")), e, "id", "c")


def requirements(t: Tables):
    """Where a requirement is secured: sometimes a fee or a duration, not a place."""
    where = (
        F.when(F.col("l_linenumber") == 1, F.lit("None"))
        .when(F.col("l_linenumber") == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" working days")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("PHP "), F.col("l_quantity").cast("int").cast("string"), F.lit(".00")))
        .otherwise(F.concat(F.lit("Office "), F.col("l_suppkey").cast("string")))
    )
    return t.lineitem.select("l_orderkey", *ORDER, where.alias("whereToSecure"))


@query("flt_not_a_place", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN 'Office ' || l_suppkey END AS place FROM lineitem""")
def _(t):
    return requirements(t).select("l_orderkey", "l_linenumber", RC.place_or_null(F.col("whereToSecure")).alias("place"))


def facts():
    return {
        "Office or Division": F.col("o_orderpriority"),
        "Classification": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
    }


def published(t: Tables):
    from civicloom.plans.jobs import job_publish

    entries = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return job_publish(lines(t), entries, enumerated(t), "l_orderkey", facts(), ["en", "fil"])


RENDERED = f"""{PARTS},
b AS (SELECT * FROM pt WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
st AS (SELECT l_orderkey, 3 AS block, i AS line_no, '| ' || coalesce(clientStep, '') || ' | ' || coalesce(agencyAction, '') || ' | ' || coalesce(fee, '')
    || ' | ' || coalesce(processingTime, '') || ' | ' || coalesce(personResponsible, '') || ' |' AS line FROM b WHERE part = 'step'
    AND coalesce(clientStep, agencyAction, fee, processingTime, personResponsible) IS NOT NULL),
rq AS (SELECT l_orderkey, 2 AS block, i AS line_no, '| ' || clientStep || ' | ' || coalesce(personResponsible, '—') || ' |' AS line
  FROM b WHERE part = 'requirement' AND clientStep IS NOT NULL),
tl AS (SELECT l_orderkey, 4 AS block, 0 AS line_no, '| **TOTAL** | | **' || coalesce(fee, '') || '** | **' || coalesce(processingTime, '') || '** | |' AS line
  FROM b WHERE part = 'total' AND l_orderkey IN (SELECT l_orderkey FROM st)),
f AS (SELECT o_orderkey AS l_orderkey, 1 AS block, n - 1 AS line_no, line FROM (
   SELECT o_orderkey, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT o_orderkey, list_concat(['| | |', '| --- | --- |',
     '| Office or Division | ' || o_orderpriority || ' |'], CASE WHEN o_orderstatus <> 'P' THEN ['| Classification | ' || o_orderstatus || ' |'] ELSE [] END) AS ls FROM orders))),
plain AS (SELECT * FROM f UNION ALL SELECT * FROM rq UNION ALL SELECT * FROM st UNION ALL SELECT * FROM tl),
l(locale, c, h) AS (VALUES ('en', '**Checklist of requirements**', '**Client steps**'), ('fil', '**Listahan ng requirement**', '**Mga hakbang**')),
hd AS (
  SELECT k.l_orderkey, locale, 2 AS block, unnest([-3, -2, -1]) AS line_no, unnest([c, '| Checklist of requirements | Where to secure |', '| --- | --- |']) AS line
    FROM (SELECT DISTINCT l_orderkey FROM rq) k, l
  UNION ALL SELECT k.l_orderkey, locale, 3, unnest([-3, -2, -1]), unnest([h,
    '| Client steps | Agency action | Fees to be paid | Processing time | Person responsible |', '| --- | --- | --- | --- | --- |'])
    FROM (SELECT DISTINCT l_orderkey FROM st) k, l),
body AS (SELECT p.l_orderkey, locale, block, line_no, line FROM plain p, l UNION ALL SELECT l_orderkey, locale, block, line_no, line FROM hd)"""


@query("snk_render_records", f"WITH {RENDERED} SELECT * FROM body")
def _(t):
    return published(t)[1]


HELD = f"""{RENDERED},
have AS (SELECT DISTINCT l_orderkey, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+')) AS tok FROM body WHERE locale = 'en'),
want AS (SELECT l_orderkey, i AS pos, unnest(regexp_extract_all(lower(concat_ws(' ', clientStep, agencyAction, fee, processingTime, personResponsible)),
  '[\\p{{L}}\\p{{N}}]+')) AS tok FROM b),
lost AS (SELECT DISTINCT l_orderkey, pos FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.l_orderkey = w.l_orderkey AND h.tok = w.tok))"""


@query("txt_completeness", f"""WITH {HELD} SELECT l_orderkey, pos FROM lost""")
def _(t):
    return published(t)[2]


@query("agg_ledger_totals", f"""WITH {HELD} SELECT count(DISTINCT l_orderkey) AS services, count(*) - (SELECT count(*) FROM lost) AS carried,
  (SELECT count(*) FROM lost) AS held FROM b""")
def _(t):
    content, _, held = published(t)
    kept = content.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    n = held.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.agg(F.count(F.lit(1)).alias("services"), F.sum("lines").alias("all")).withColumn("held", n).select(
        "services", (F.col("all") - F.col("held")).alias("carried"), "held"
    )


@query("job_publish", f"""WITH {NOT_STATED}
SELECT l_orderkey, n_lines, n_steps, not_stated FROM ns WHERE n_lines IS NOT NULL""")
def _(t):
    content = published(t)[0]
    return content.select(
        "l_orderkey", F.col("lines").alias("n_lines"), F.col("rows").alias("n_steps"), F.array_join("notStated", ",").alias("not_stated")
    )


# ---------------------------------------------------------------- validation


@query("val_page_entry", """
WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'Order ' || o_orderkey ELSE 'order-' || o_orderkey END AS slug,
  CASE WHEN o_totalprice > 1000 THEN o_orderpriority ELSE '' END AS name, CASE WHEN o_orderkey < 9000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'V4' ELSE 'V3' END AS lvl, CASE WHEN o_totalprice > 400000 THEN 'mayor' END AS role,
  CASE WHEN o_orderstatus = 'O' THEN 'www.example' WHEN o_orderstatus = 'F' THEN 'https://example.org/' || o_orderkey END AS url FROM orders)
SELECT k, 'slug-shape' AS rule FROM e WHERE slug LIKE 'Order%' UNION ALL SELECT k, 'name-missing' FROM e WHERE name = ''
UNION ALL SELECT k, 'checked-not-a-date' FROM e WHERE d LIKE '%/%' UNION ALL SELECT k, 'level-unknown' FROM e WHERE lvl = 'V4'
UNION ALL SELECT k, 'review-role-unknown' FROM e WHERE role IS NOT NULL UNION ALL SELECT k, 'url-shape' FROM e WHERE url = 'www.example'
UNION ALL SELECT o_orderkey, 'class-unknown' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def _(t):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    entries = t.orders.select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Order "), k)).otherwise(F.concat(F.lit("order-"), k)).alias("slug"),
        F.when(F.col("o_totalprice") > 1000, p).otherwise("").alias("name"),
        p.alias("description"),
        p.alias("data_class"),
        F.when(F.col("o_orderkey") < 9000, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("last_checked_at"),
        F.when(p == "1-URGENT", "V4").otherwise("V3").alias("verification"),
        F.when(F.col("o_totalprice") > 400000, "mayor").alias("review_role"),
        F.when(F.col("o_orderstatus") == "O", "www.example").when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://example.org/"), k)).alias("url"),
    )
    known = F.col("data_class").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
    return V.violations(entries, ["k"], V.page_entry_rules(known)).select("k", "rule")


@query("val_checksum_and_id", """
SELECT page_id, 'sha-shape' AS rule FROM pages WHERE html NOT LIKE '%</html>%'
UNION ALL SELECT page_id, 'file-shape' FROM pages WHERE NOT regexp_matches(url, '[.]pdf$')
UNION ALL SELECT page_id, 'id-shape' FROM pages WHERE url LIKE '%?%'""")
def _(t):
    sha = F.sha2("html", 256)
    rows = t.pages.select(
        "page_id",
        F.when(F.col("html").contains("</html>"), sha).otherwise(F.upper(F.concat(F.lit("x"), sha))).alias("sha256"),
        F.col("url").alias("file"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.when(F.col("url").contains("?"), "#other-1").otherwise("#external-1")).alias("service_id"),
    )
    rules = [
        V.Rule("sha-shape", "sha256", ~F.col("sha256").rlike(V.SHA256), "a lowercase hex sha256"),
        V.Rule("file-shape", "file", ~F.col("file").rlike(r"\.pdf$"), "the published filename"),
        V.Rule("id-shape", "id", ~F.col("service_id").rlike(V.SERVICE_ID), "document#section-ordinal"),
    ]
    return V.violations(rows, ["page_id"], rules).select("page_id", "rule")


@query("val_enum_array", """
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE '' END AS bad
FROM lineitem WHERE l_returnflag = 'R'""")
def _(t):
    rows = t.lineitem.withColumn("not_stated", F.array("l_returnflag", "l_linestatus"))
    bad = F.array_except("not_stated", F.array(*[F.lit(x) for x in ("A", "N", "F", "O")]))
    rule = V.Rule("unknown-field", "notStated", F.size(bad) > 0, "not in the allowed set")
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
    return V.violations(rows.withColumn("bad", F.array_join(bad, ",")), [*keys, "bad"], [rule]).select(*keys, "bad")


@query("val_bilingual_pair", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE (quality IS NULL) <> (d.lang <> 'en')""")
def _(t):
    j = t.documents.select("doc_id", F.when(F.col("lang") == "en", F.col("lang")).alias("en")).join(
        t.labels.select("doc_id", "quality"), "doc_id", "left"
    )
    rule = V.Rule("one-locale", "ambiguityFil", F.col("en").isNull() != F.col("quality").isNull(), "both or neither")
    return V.violations(j, ["doc_id"], [rule]).select("doc_id")


def order_records(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") == "P", "internal").otherwise("external").alias("section"),
        F.format_string("order-%s#%s-1", F.col("o_custkey").cast("string"), F.when(F.col("o_orderpriority") == "5-LOW", "internal").otherwise("external")).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "V3").when(F.col("o_orderstatus") == "O", "V2").otherwise("V1").alias("verification"),
        F.when(F.col("o_totalprice") > 100000, F.lit("https://example.org")).alias("url"),
    )


@query("val_section_agrees_id", """
SELECT o_orderkey AS k, 'not-external' AS rule FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'section-id-disagree' FROM orders WHERE (o_orderstatus = 'P') <> (o_orderpriority = '5-LOW')""")
def _(t):
    rules = [
        V.Rule("not-external", "charterSection", F.col("section") != "external", "internal services are never published"),
        V.Rule(
            "section-id-disagree", "charterServiceId",
            ~F.col("id").contains(F.concat(F.lit("#"), F.col("section"), F.lit("-"))), "section and id must agree",
        ),
    ]
    return V.violations(order_records(t), ["k"], rules).select("k", "rule")


@query("val_level_needs_url", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 100000")
def _(t):
    rule = V.Rule("v3-needs-url", "source.url", (F.col("verification") == "V3") & F.col("url").isNull(), "a primary source has an address")
    return V.violations(order_records(t), ["k"], [rule]).select("k")


def transcribed(t: Tables):
    d = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))
    return d.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.col("n")).alias("content"),
        F.when(F.col("lang") == "en", "V2").otherwise("V1").alias("verification"),
        F.when(F.col("toxic") == 1, F.substring("sha", 1, 63)).otherwise(F.col("sha")).alias("sha256"),
    )


@query("val_content_needs_level", """
SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 AND lang <> 'en'""")
def _(t):
    rule = V.Rule("content-needs-level", "verification", F.col("content").isNotNull() & ~F.col("verification").isin("V3", "V2"), "V2 or better")
    return V.violations(transcribed(t), ["doc_id"], [rule]).select("doc_id")


@query("val_content_needs_checksum", "SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 AND toxic = 1")
def _(t):
    rule = V.Rule("content-needs-checksum", "sha256", F.col("content").isNotNull() & (F.length("sha256") != 64), "name the exact copy")
    return V.violations(transcribed(t), ["doc_id"], [rule]).select("doc_id")


@query("val_two_person", """
WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, 'person-' || l_linenumber AS c,
  CASE WHEN l_returnflag = 'R' THEN 'person-' || l_linenumber WHEN l_returnflag = 'N' THEN 'Ana ' || l_linenumber ELSE 'person-x' END AS v,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_shipdate END AS d FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, 'same-person' AS rule FROM r WHERE c = v
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, 'handle-shape' FROM r WHERE v LIKE 'Ana%'
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, 'part-record' FROM r WHERE d IS NULL""")
def _(t):
    c = F.concat(F.lit("person-"), F.col("l_linenumber").cast("string"))
    r = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
        c.alias("collected_by"),
        F.when(F.col("l_returnflag") == "R", c).when(F.col("l_returnflag") == "N", F.concat(F.lit("Ana "), F.col("l_linenumber").cast("string"))).otherwise("person-x").alias("verified_by"),
        F.when(F.col("l_discount") != 0, F.col("l_shipdate")).alias("verified_at"),
    )
    parts = [F.col(x).isNull() for x in ("collected_by", "verified_by", "verified_at")]
    rules = [
        V.Rule("same-person", "verifiedBy", F.col("collected_by") == F.col("verified_by"), "the collector never verifies"),
        V.Rule("handle-shape", "verifiedBy", ~F.col("collected_by").rlike(V.SLUG) | ~F.col("verified_by").rlike(V.SLUG), "never a name"),
        V.Rule("part-record", "verificationRecord", (parts[0] | parts[1] | parts[2]) & ~(parts[0] & parts[1] & parts[2]), "whole or null"),
    ]
    return V.violations(r, ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"], rules).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "rule"
    )


ATTEMPTS = """att AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag = 'R') AS attempts FROM lineitem GROUP BY 1)"""


@query("val_register_status", f"""WITH {ATTEMPTS},
r AS (SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'linked' WHEN '2-HIGH' THEN 'not-located' WHEN '3-MEDIUM' THEN 'requested' ELSE 'published' END AS status,
  o_totalprice > 100000 AS has_url, o_orderstatus = 'F' AS has_of, o_orderstatus <> 'P' AS has_at, coalesce(attempts, 0) AS attempts, o_totalprice > 490000 AS bad_year
  FROM orders LEFT JOIN att ON att.k = o_orderkey)
SELECT k, 'linked-needs-url' AS rule FROM r WHERE status = 'linked' AND NOT has_url
UNION ALL SELECT k, 'absence-needs-attempt' FROM r WHERE status = 'not-located' AND attempts = 0
UNION ALL SELECT k, 'request-needs-details' FROM r WHERE status = 'requested' AND NOT (has_of AND has_at)
UNION ALL SELECT k, 'details-need-request' FROM r WHERE status <> 'requested' AND (has_of OR has_at)
UNION ALL SELECT k, 'person-as-office' FROM r WHERE has_of AND status = 'requested'
UNION ALL SELECT k, 'fiscal-year-shape' FROM r WHERE bad_year""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "linked").when(p == "2-HIGH", "not-located").when(p == "3-MEDIUM", "requested").otherwise("published")
    r = t.orders.join(n, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("k"),
        status.alias("status"),
        F.when(F.col("o_totalprice") > 100000, "https://example.org").alias("url"),
        F.coalesce("n", F.lit(0)).alias("attempts"),
        F.when(F.col("o_orderstatus") == "F", F.when(status == "requested", "Atty. Cruz").otherwise("Records Office")).alias("requested_of"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("requested_at"),
        F.when(F.col("o_totalprice") > 490000, "FY22").otherwise("2022").alias("fiscal_year"),
    )
    return V.violations(r, ["k"], V.register_rules()).select("k", "rule")


@query("val_no_person_in_office", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000")
def _(t):
    rows = t.supplier.select(
        "s_suppkey", F.concat(F.when(F.col("s_acctbal") < 2000, "Hon. ").otherwise("Honest "), F.col("s_name")).alias("office")
    )
    rule = V.Rule("person-as-office", "requestedOf", F.col("office").rlike(V.PERSONAL_TITLE), "an office, never a person")
    return V.violations(rows, ["s_suppkey"], [rule]).select("s_suppkey")


@query("val_held_document", """
SELECT doc_id FROM documents WHERE lang = 'es' OR regexp_matches(text, '(?i)\\bSALN\\b|statements?\\s+of\\s+assets')""")
def _(t):
    rows = t.documents.select(
        "doc_id", "text", F.when(F.col("lang") == "es", "Statement  of assets, 2020").otherwise("Budget").alias("name"), F.col("source").alias("slug")
    )
    held = F.col("text").rlike(V.HELD_DOCUMENT) | F.col("name").rlike(V.HELD_DOCUMENT) | F.col("slug").rlike(V.HELD_DOCUMENT)
    return V.violations(rows, ["doc_id"], [V.Rule("held", "documentName", held, "on a permanent hold")]).select("doc_id")


@query("val_attempt_cited", """
SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 1000 < 500)""")
def _(t):
    absent = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("k"))
    return V.uncited_absences(absent, t.lineitem.withColumn("k", F.col("l_orderkey")), ["k"], (F.col("l_partkey") % 1000) < 500)


@query("val_level_not_overclaimed", """
SELECT o_orderkey AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1 HAVING bool_and(coalesce(l_returnflag, 'R') = 'R')""")
def _(t):
    v3 = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("k"))
    return V.overclaimed_levels(v3, t.lineitem.withColumn("k", F.col("l_orderkey")), ["k"], F.col("l_returnflag") != "R")


@query("val_gap_note", """
SELECT doc_id, 'note-too-short' AS rule FROM documents WHERE length(split_part(text, chr(10), 1)) < 40
UNION ALL SELECT doc_id, 'channel-unknown' FROM documents WHERE lang = 'es'
UNION ALL SELECT doc_id, 'state-unknown' FROM documents WHERE source = 'src3'
UNION ALL SELECT doc_id, 'not-a-date' FROM documents WHERE n_chars % 100 >= 28 OR n_chars % 100 = 0""")
def _(t):
    from civicloom.functions.dates import strict_date

    rows = t.documents.select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("note"),
        F.when(F.col("lang") == "es", "rumour").otherwise("office").alias("channel"),
        F.when(F.col("source") == "src3", "lost").otherwise("open").alias("state"),
        F.format_string("2023-02-%02d", (F.col("n_chars") % 100 + F.when(F.col("n_chars") % 100 >= 28, 1).otherwise(0)).cast("int")).alias("checked"),
    )
    rules = [
        V.Rule("note-too-short", "note", F.length("note") < 40, "at least 40 characters"),
        V.Rule("channel-unknown", "channel", ~F.col("channel").isin("office", "request"), "known channel"),
        V.Rule("state-unknown", "state", ~F.col("state").isin("open", "held"), "open or held"),
        V.Rule("not-a-date", "lastCheckedAt", strict_date(F.col("checked")).isNull(), "an ISO day"),
    ]
    return V.violations(rows, ["doc_id"], rules).select("doc_id", "rule")


@query("val_bilingual_complete", """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS en, string_split(CASE WHEN lang = 'en' THEN text ELSE upper(text) END, chr(10)) AS fil FROM documents)
SELECT doc_id FROM p WHERE len([x FOR x IN range(1, len(en) + 1) IF en[x] = '' OR fil[x] = '' OR en[x] = fil[x]]) > 0""")
def _(t):
    pairs = F.zip_with(
        F.split("text", "\n"), F.split(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.upper("text")), "\n"),
        lambda a, b: F.struct(a.alias("en"), b.alias("fil")),
    )
    complete = F.forall(pairs, lambda x: (F.length(x["en"]) > 0) & (F.length(x["fil"]) > 0) & (x["en"] != x["fil"]))
    rule = V.Rule("both-locales", "entries", ~complete, "both locales, not the same text")
    return V.violations(t.documents, ["doc_id"], [rule]).select("doc_id")


@query("val_min_or_exact_count", """
SELECT l_orderkey, 'too-few' AS rule FROM lineitem GROUP BY 1 HAVING count(*) < 4
UNION ALL SELECT l_orderkey, 'not-exactly-one' FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_tax = 0) <> 1""")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("l_tax") == 0).alias("inverse"))
    rules = [
        V.Rule("too-few", "entries", F.col("entries") < 4, "at least four"),
        V.Rule("not-exactly-one", "cards", F.col("inverse") != 1, "exactly one"),
    ]
    return V.violations(n, ["l_orderkey"], rules).select("l_orderkey", "rule")


@query("val_partial_record_complete", f"""WITH {STEPS}
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM steps WHERE (agencyAction IS NULL) <> (fee IS NULL)""")
def _(t):
    lines = t.lineitem.select("l_orderkey", *ORDER, *step_columns()).withColumn(
        "content", F.struct(F.col("agencyAction").alias("a"), F.col("fee").alias("f"))
    )
    filled = F.array(*[F.col(c).isNotNull() for c in ("content.a", "content.f")])
    rule = V.Rule("part-filled", "content", F.exists(filled, lambda x: x) & F.exists(filled, lambda x: ~x), "complete or null")
    return V.violations(lines, ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"], [rule]).drop("rule", "path", "message")


# ---------------------------------------------------------------- aggregates on driver tables


@query("agg_category_summary", """
WITH r AS (SELECT source, doc_id, md5(split_part(text, chr(10), 1)) AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents)
SELECT source, count(*) AS entries, string_agg(name, '|' ORDER BY i) FILTER (WHERE i <= 3) AS examples FROM r GROUP BY 1""")
def _(t):
    d = t.documents.select("source", "doc_id", F.md5(F.split_part("text", F.lit("\n"), F.lit(1))).alias("name"))
    return A.category_summary(d, "source", "doc_id", "name").withColumn("examples", F.array_join("examples", "|"))


@query("agg_coverage", """
SELECT source, count(l.doc_id) AS transcribed, count(*) AS total, CAST(floor(100.0 * count(l.doc_id) / count(*) + 0.5) AS BIGINT) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    seen = t.labels.select("doc_id", F.lit(True).alias("seen")).distinct()
    return A.coverage(t.documents.select("doc_id", "source").join(seen, "doc_id", "left"), ["source"], F.col("seen").isNotNull())


@query("agg_office_counts", """
SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY 1, 2""")
def _(t):
    directory = t.nation.where(F.col("n_regionkey") != 2).select(F.col("n_nationkey").alias("c_nationkey"))
    return A.office_counts(t.customer, directory, "c_mktsegment", "c_nationkey").select("c_mktsegment", "c_nationkey", "n")


@query("agg_office_spans", """
WITH p AS (SELECT DISTINCT floor(c_acctbal / 10) AS office, c_mktsegment AS category FROM customer)
SELECT CAST(office AS BIGINT) AS office, category, count(*) OVER (PARTITION BY office) AS categories FROM p QUALIFY categories > 1""")
def _(t):
    d = t.customer.select(F.floor(F.col("c_acctbal") / 10).alias("office"), F.col("c_mktsegment").alias("category"))
    return A.spanning(d, "office", "category").select("office", "category", "categories")


@query("agg_duplicates", "SELECT md5(text) AS text, count(*) AS claims FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return A.duplicates(t.documents.select(F.md5("text").alias("text")), ["text"])


@query("agg_field_gaps", """
SELECT unnest(['eligibility', 'fees', 'office']) AS field, unnest([count(*) FILTER (WHERE o_totalprice < 50000),
  count(*) FILTER (WHERE o_orderpriority = '5-LOW'), 0]) AS absent FROM orders WHERE o_orderstatus = 'F'""")
def _(t):
    external = t.orders.where(F.col("o_orderstatus") == "F")
    return A.field_gaps(external, {
        "eligibility": RC.presence(F.when(F.col("o_totalprice") >= 50000, F.col("o_orderpriority"))) == "absent",
        "fees": RC.presence(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))) == "absent",
        "office": RC.presence(F.col("o_orderstatus")) == "absent",
    })


@query("agg_distinct_offices", "SELECT p_type AS branch, count(DISTINCT p_brand) AS offices FROM part GROUP BY 1")
def _(t):
    files = t.part.select(
        F.col("p_type").alias("branch"),
        F.concat("p_brand", F.when(F.col("p_size") < 20, "-External-Services.pdf").when(F.col("p_size") < 40, "-INTERNAL-services.pdf").otherwise(".pdf")).alias("file"),
    )
    return A.distinct_offices(files, "branch", F.col("file"))


@query("agg_stated_vs_counted", """
SELECT * FROM (
SELECT 'external' AS measure, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS counted, (SELECT count(DISTINCT o_custkey) FROM orders) AS stated
UNION ALL SELECT 'offices', (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(*) FROM customer)) WHERE counted IS DISTINCT FROM stated""")
def _(t):
    counted = t.orders.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("external"), F.countDistinct("o_custkey").alias("offices")
    )
    customers = t.customer.agg(F.count(F.lit(1)).alias("n")).scalar()
    stated = t.orders.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("o_custkey").alias("external")).withColumn("offices", customers)
    return A.stated_vs_counted(counted, stated)


@query("agg_handover_counts", """
SELECT lang, count(*) AS pages, count(DISTINCT source) AS manifests, count(*) FILTER (WHERE n_chars > 0) AS entries,
  count(l.doc_id) AS with_source_and_date FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    return A.handover_counts(t.documents, t.labels, "doc_id", ["lang"], "source", F.col("n_chars") > 0)


@query("agg_gap_states", "SELECT o_orderstatus AS state, o_orderpriority AS channel, count(*) AS gaps, strftime(max(o_orderdate), '%Y-%m-%d') AS last_checked FROM orders GROUP BY 1, 2")
def _(t):
    return A.gap_states(t.orders, "o_orderstatus", "o_orderpriority", "o_orderdate")


TERMS = ["the", "of", "le", "que", "der", "ring"]


@query("agg_term_occurrences", """
WITH k AS (SELECT unnest(['the', 'of', 'le', 'que', 'der', 'ring']) AS term),
n AS (SELECT term, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', '  ', 'g') || ' ', ' ' || term || ' ')) AS c FROM documents, k)
SELECT term, CAST(sum(c) AS BIGINT) AS occurrences, count(*) FILTER (WHERE c > 0) AS documents FROM n GROUP BY 1""")
def _(t):
    return A.term_occurrences(t.documents, F.col("text"), TERMS)


@query("agg_share", """
SELECT o_orderpriority, printf('%.1f', sum(o_totalprice) * 100 / (SELECT sum(o_totalprice) FROM orders)) AS share FROM orders GROUP BY 1""")
def _(t):
    return A.share(t.orders, ["o_orderpriority"], "o_totalprice")


@query("prj_present_missing", """
SELECT c_custkey, 'balance' AS fact, c_acctbal >= 0 AS present FROM customer
UNION ALL SELECT c_custkey, 'segment', c_mktsegment <> 'MACHINERY' FROM customer
UNION ALL SELECT c_custkey, 'name', true FROM customer""")
def _(t):
    return RC.present_missing(t.customer, ["c_custkey"], {
        "balance": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")),
        "segment": F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")),
        "name": F.col("c_name"),
    }).select("c_custkey", "fact", "present")


@query("prj_hotline_ready", """
SELECT c_custkey, 'tel:' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS number, NULL AS gap
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey, NULL, 'not-obtained' FROM customer WHERE c_acctbal < 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(t):
    return C.hotlines(
        t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, "obtained").otherwise("pending").alias("status")),
        t.orders.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit(" "), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("number")),
        "c_custkey",
    )


# ---------------------------------------------------------------- sorts and limits


@query("srt_locale_label", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def _(t):
    return t.nation.select("n_nationkey", "n_name").orderBy(F.collate("n_name", "UNICODE"))


@query("lim_first_advisory", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 1")
def _(t):
    return t.events.orderBy("ts", "event_id").limit(1).select("event_id", "event_type")


@query("lim_first_n", """
SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5""")
def _(t):
    return first_n(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 5)
