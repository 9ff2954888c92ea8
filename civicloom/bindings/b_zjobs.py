from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civicloom.bindings import b_layout as BL
from civicloom.bindings import b_text as BT
from civicloom.bindings.registry import ORACLE, QUERIES, Tables, query
from civicloom.operators.skew import alone, checkpoint_folder
from civicloom.plans import jobs as J


def charter_lines(t: Tables):
    """A customer's orders as the services of one text document."""
    s, k = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    lines = [
        F.when(s == "F", "Records  External").when(s == "O", "INTERNAL  SERVICES").otherwise("General notes"),
        F.when(s == "F", "  Services of the office").otherwise("Notes"),
        F.when(F.col("o_totalprice") > 50000, F.concat(F.lit("  7. Renew   licence "), k)).otherwise("TOTAL: none"),
        F.concat(F.lit("Office  or Division:  Office  "), "o_orderpriority"),
        F.concat(F.lit("CLASSIFICATION    "), s),
        F.when(s == "O", "Who may").when(s == "F", "Who may avail:").otherwise("Everyone welcome"),
        F.when(s == "O", "avail?  All"),
        F.when(s != "P", "CHECKLIST OF  REQUIREMENTS   WHERE TO SECURE").otherwise("Bring an ID"),
        F.lit("1. Valid ID"),
        F.lit("CLIENT STEPS   AGENCY ACTION   FEES TO BE"),
        F.when(s != "F", "   PAID   PROCESSIN G").otherwise("   PAID"),
        F.lit("3|Page"),
        F.when(s == "P", "Output:  A licence").otherwise("   TIME"),
        F.lit("TOTAL: PHP 5.00"),
    ]
    return t.orders.select(
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("document"),
        F.col("o_orderkey"),
        F.posexplode(F.array(*lines)).alias("k", "text"),
    ).select("document", (F.col("o_orderkey") * 16 + F.col("k")).alias("pos"), "text")


SECTION_SQL = "coalesce(last_value(CASE o_orderstatus WHEN 'F' THEN 'external' WHEN 'O' THEN 'internal' END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'unknown')"


@query("job_enumerate", f"""
WITH s AS (SELECT *, {SECTION_SQL} AS section FROM orders)
SELECT 'Customer ' || o_custkey || '.pdf' AS document, 'customer-' || o_custkey || '#' || section || '-' || row_number() OVER (PARTITION BY o_custkey, section ORDER BY o_orderkey) AS id,
  section, CASE WHEN o_totalprice > 50000 THEN 7 END AS number, CASE WHEN o_totalprice > 50000 THEN 'Renew licence ' || o_orderkey END AS title,
  CASE WHEN o_totalprice > 50000 THEN 'extracted' ELSE 'not-in-layout' END AS title_status, 'Office ' || o_orderpriority AS office, o_orderstatus AS classification,
  CASE WHEN o_orderstatus <> 'P' THEN 'present' ELSE 'absent' END AS eligibility, CASE WHEN o_orderstatus <> 'P' THEN 'present' ELSE 'absent' END AS requirements,
  'present' AS fees, CASE WHEN o_orderstatus <> 'F' THEN 'present' ELSE 'absent' END AS processing_time, 'present' AS owning_office,
  CASE WHEN o_orderstatus = 'P' THEN 'present' ELSE 'absent' END AS output FROM s""")
def _(t):
    return J.job_enumerate(charter_lines(t), "document")


EXPECTED = f"""o AS (SELECT *, {SECTION_SQL} AS section, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS service,
    lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_status FROM orders),
li AS (SELECT *, {BL.NUM} AS i, CASE WHEN l_tax = 0 THEN 'None' ELSE 'PHP ' || CAST(l_quantity AS INTEGER) || '.00' END AS price FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS officers, string_agg('Submit form ' || l_partkey || ' Check part ' || l_partkey || ' ' || price
    || ' ' || i || ' Minutes' || CASE WHEN l_discount > 0.05 THEN ' again' ELSE '' END, ' ' ORDER BY i) AS spoken FROM li GROUP BY 1),
base AS (SELECT o.*, o_custkey || '#' || service AS doc, coalesce(n.n, 0) AS n, officers, spoken, next_status IS NOT NULL AS has_next,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 END AS v FROM o LEFT JOIN n ON n.l_orderkey = o_orderkey),
req AS (
  SELECT doc, CASE WHEN v = 1 THEN '1. Valid ID with two copies' ELSE '1. Valid ID' END AS item, CASE WHEN v = 4 THEN NULL ELSE 'Registrar' END AS place FROM base
  UNION ALL SELECT doc, '2. Barangay clearance', 'Treasurer' FROM base WHERE v = 2
  UNION ALL SELECT doc, '2. x', NULL FROM base WHERE v = 3
  UNION ALL SELECT doc, '3. Police clearance', 'Station' FROM base WHERE v = 0 AND n > 0
  UNION ALL SELECT doc, '1. Valid ID ' || spoken, NULL FROM base WHERE v IS NULL AND n > 0
  UNION ALL SELECT doc, CASE next_status WHEN 'F' THEN 'External Services' WHEN 'O' THEN 'INTERNAL  SERVICES' ELSE 'General notes' END, NULL FROM base WHERE v IS NULL AND has_next),
asked AS (SELECT doc, count(*) AS requirements FROM req GROUP BY 1)"""


@query("job_extract", f"""WITH {EXPECTED}
SELECT doc, section, 7 AS number, 'Renew licence ' || o_orderkey AS title, 'Office ' || o_orderpriority AS office, o_orderstatus AS classification,
  n AS timed, requirements, coalesce(v <> 3, true) AS requirements_coherent,
  CASE WHEN v = 4 THEN 1 + o_orderkey % 2 WHEN v IS NULL AND n > 0 THEN 1 + officers ELSE 0 END AS unpaired, coalesce(v = 4 AND o_orderkey % 2 = 0, false) AS steps_text_in_requirements,
  n + CASE WHEN has_next THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'P' AND n = 0 THEN 1 ELSE 0 END AS rows,
  CASE WHEN n = 0 AND NOT has_next THEN 'needs-human' WHEN v = 3 THEN 'needs-human' ELSE 'high' END AS confidence FROM base JOIN asked USING (doc)""")
def _(t):
    services, _ = J.job_extract(BL.full_layout(t))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return services.select(
        "doc", "section", "number", "title", "office", "classification", zero("timed"), zero("requirements"), "requirements_coherent", zero("unpaired"),
        F.coalesce("steps_text_in_requirements", F.lit(False)).alias("steps_text_in_requirements"), zero("rows"), "confidence",
    )


@query("job_extract_steps", f"""WITH {EXPECTED}
SELECT doc, 'step' AS part, 'Submit form ' || l_partkey AS "clientStep", 'Check part ' || l_partkey || CASE WHEN l_discount > 0.05 THEN ' again' ELSE '' END AS "agencyAction",
  price AS fee, i || ' Minutes' AS "processingTime", 'Officer ' || l_suppkey AS "personResponsible"
FROM li JOIN base ON o_orderkey = l_orderkey
UNION ALL SELECT doc, 'requirement', item, NULL, NULL, NULL, place FROM req""")
def _(t):
    _, steps = J.job_extract(BL.full_layout(t))
    return steps.where(F.col("fee").isNotNull() | (F.col("part") == "requirement")).select(
        "doc", "part", "clientStep", "agencyAction", "fee", "processingTime", "personResponsible"
    )


@query("job_harvest", f"""
WITH u AS (SELECT *, regexp_replace(url, '#.*$', '') AS plain, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages),
r AS (SELECT page_id, url, CASE WHEN starts_with(p, '/es/5') THEN '/es/5' WHEN starts_with(p, '/fr/') THEN '/fr/' END AS rule FROM u
  WHERE plain IN (SELECT plain FROM u WHERE url NOT LIKE '%/de/%' OR page_id % 2 = 0)
  AND (starts_with(p, '/es/5') OR starts_with(p, '/fr/') OR plain NOT IN (SELECT plain FROM u WHERE page_id % 7 = 0))),
k AS (SELECT page_id, kind FROM ({ORACLE['flt_reference_pages']})),
a AS ({ORACLE['txt_article']}), ti AS ({ORACLE['txt_title']}), c AS ({ORACLE['txt_change']}),
l AS (SELECT page_id, count(*) AS links FROM ({ORACLE['txt_links']}) GROUP BY 1),
o AS (SELECT r.page_id, k.kind, r.rule, CASE WHEN r.rule IS NULL THEN ti.title END AS title, CASE WHEN r.rule IS NULL THEN a.chars END AS body_chars, CASE WHEN r.rule IS NULL THEN c.state END AS state,
  CASE WHEN r.rule IS NULL THEN coalesce(l.links, 0) END AS links
FROM r JOIN k ON k.page_id = r.page_id JOIN a ON a.page_id = r.page_id JOIN ti ON ti.page_id = r.page_id LEFT JOIN c ON c.page_id = r.page_id LEFT JOIN l ON l.page_id = r.page_id)
SELECT *, (SELECT count(*) FROM o) AS row_count, (SELECT count(rule) FROM o) AS forbidden FROM o""")
def _(t):
    from civicloom.operators import pages as P

    prev, curr = BT.crawls(t)
    kind = P.classify(F.col("url"), r"(?i)spam", r"/(en|fr)/[0-9]+/?$", r"/fr/", ["/"], "/de/")
    now = t.pages.select("page_id", "url", "html")
    index, children = BT.sitemaps(t)
    linked = t.pages.where(F.col("url").contains("/de/") & (F.col("page_id") % 2 == 0))
    seen = t.pages.where(F.col("page_id") % 7 == 0)
    path = f"{checkpoint_folder(t.spark)}/harvest-{uuid.uuid4().hex}"
    for _ in range(2):  # repeated, it changes nothing
        head, out = J.job_harvest_run(
            index, children, linked, seen, now, prev, BT.robots(t), kind, "page_id", r"^/t", path, "only", curr, {"forbidden": F.count("rule")}
        )
    rows = out.select("page_id", "kind", "rule", "title", "body_chars", "state", "links")
    return rows.withColumns({"row_count": head.select("row_count").scalar(), "forbidden": head.select("forbidden").scalar()})


# check -> (subject, other columns), from the registered queries themselves.
AUDIT = {
    "val_page_entry": ["k", "rule"],
    "val_register_status": ["k", "rule"],
    "val_section_agrees_id": ["k", "rule"],
    "val_gap_note": ["doc_id", "rule"],
    "val_held_document": ["doc_id"],
    "jn_reconcile": ["id", "kind"],
    "jn_drift": ["c_custkey", "field", "got", "expected"],
    "jn_checksum_current": ["slug", "state"],
    "jn_gap_register": ["path", "kind"],
    "jn_baseline_advance": ["key", "kind"],
    "jn_locale_coverage": ["slug", "kind"],
    "txt_framing": ["doc_id", "rule", "match", "verdict"],
    "txt_phone_scan": ["doc_id", "match"],
    "txt_fee_scope": ["doc_id", "section", "figure", "problem"],
    "txt_vocab_rules": ["p_partkey", "rule", "token"],
    "val_attempt_cited": ["k"],
    "val_bilingual_complete": ["doc_id"],
    "val_bilingual_pair": ["doc_id"],
    "val_cadence_config": ["name", "rule"],
    "val_checksum_and_id": ["page_id", "rule"],
    "val_content_needs_checksum": ["doc_id"],
    "val_content_needs_level": ["doc_id"],
    "val_enum_array": ["l_orderkey", "l_partkey", "l_suppkey", "bad"],
    "val_fact_has_source": ["field", "kind"],
    "val_level_needs_url": ["k"],
    "val_level_not_overclaimed": ["k"],
    "val_min_or_exact_count": ["l_orderkey", "rule"],
    "val_no_future_dates": ["key", "field", "value"],
    "val_no_person_in_office": ["s_suppkey"],
    "val_partial_record_complete": ["l_orderkey", "l_partkey", "l_suppkey"],
    "val_two_person": ["l_orderkey", "l_partkey", "l_suppkey", "rule"],
    "val_undeclared_class": ["key", "data_class"],
    "jn_catalogue_parity": ["key", "side", "reason"],
    "jn_changed_documents": ["file", "from_sha", "to_sha"],
    "jn_code_catalogue": ["code", "locale"],
    "jn_confidence_present": ["id", "kind"],
    "jn_figures_traceable": ["doc_id", "figure"],
    "jn_files_manifest": ["doc_id", "kind"],
    "jn_groups_whole": ["grp", "member", "kind"],
    "jn_links_resolve": ["page_id", "href", "problem"],
    "jn_misfiled": ["s_suppkey", "folder", "assigned"],
    "jn_nav_live": ["route", "side"],
    "jn_office_roster": ["verbatim", "kind"],
    "jn_register_complete": ["slug", "kind"],
    "jn_superseded": ["l_orderkey", "l_linenumber", "file"],
    "jn_title_provenance": ["id", "kind"],
    "jn_transcript_exists": ["stem"],
    "jn_twin_figures": ["slug", "figure"],
    "jn_urls_inventoried": ["url"],
    "txt_completeness": ["l_orderkey", "pos"],
    "txt_forbidden_sections": ["doc_id", "section"],
    "txt_honorific": ["doc_id"],
    "txt_internal_leak": ["item_id", "doc_id"],
    "txt_language_vocabulary": ["doc_id", "match"],
    "txt_link_shape": ["doc_id", "match"],
    "txt_list_numbers": ["l_orderkey", "l_partkey", "l_suppkey", "problem"],
    "txt_no_schedule": ["doc_id"],
    "txt_proper_names": ["phrase", "doc_id"],
    "txt_rendered_all": ["doc_id", "k"],
    "txt_required_sections": ["doc_id", "section"],
    "txt_untranslated": ["doc_id", "line_no"],
    "txt_untranslated_terms": ["doc_id", "rule", "term"],
}


def _audit_sql(name: str, cols: list[str]) -> str:
    head, *rest = cols
    detail = f"concat_ws(' ', {', '.join(f'CAST({c} AS VARCHAR)' for c in rest)})" if rest else "''"
    return f"SELECT '{name}' AS \"check\", CAST({head} AS VARCHAR) AS subject, {detail} AS detail FROM ({ORACLE[name]})"


@query("job_audit", " UNION ALL ".join(_audit_sql(n, c) for n, c in AUDIT.items()))
def _(t):
    # Findings alone are kept of a check: what it settled and shuffled goes before the next one begins.
    return J.job_audit({n: alone(lambda: QUERIES[n](t.spark, t.folder).select(*c)) for n, c in AUDIT.items()})
