from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civicloom.bindings.registry import Tables, query
from civicloom.functions import text as T
from civicloom.operators import corpus as C
from civicloom.operators import intervals as I
from civicloom.operators import reconcile as R
from civicloom.operators.skew import checkpoint_folder, lookup_join
from civicloom.sources import commits
from civicloom.sources import writers as SNK

# ---------------------------------------------------------------- bodies


def bodies(t: Tables):
    """documents as page bodies: neighbouring ids share a slug."""
    return t.documents.select(
        F.floor(F.col("doc_id") / 2).alias("slug"), "doc_id", F.col("lang").alias("locale"), F.col("text").alias("body")
    )


BODIES = "bodies AS (SELECT doc_id // 2 AS slug, doc_id, lang AS locale, text AS body FROM documents)"


@query("jn_locale_fallback", f"""WITH {BODIES},
m AS (SELECT DISTINCT slug FROM bodies),
k AS (SELECT slug, min(body) FILTER (WHERE locale = 'fr') AS fr, min(body) FILTER (WHERE locale = 'en') AS en
      FROM bodies GROUP BY 1)
SELECT m.slug, md5(coalesce(fr, en)) AS body, fr IS NULL AND en IS NOT NULL AS used_fallback,
       CASE WHEN en IS NULL THEN 'no-default-body' END AS error
FROM m LEFT JOIN k USING (slug)""")
def _(t):
    b = bodies(t)
    out = R.locale_fallback(b.select("slug").distinct(), b, ["slug"], "fr", "en")
    return out.withColumn("body", F.md5("body"))


@query("jn_locale_coverage", f"""WITH {BODIES},
k AS (SELECT slug, bool_or(locale = 'en') AS en, bool_or(locale <> 'en') AS tr FROM bodies GROUP BY 1)
SELECT slug, CASE WHEN en THEN 'untranslated' ELSE 'orphan' END AS kind,
  (SELECT CAST(floor(100.0 * count(*) FILTER (WHERE en AND tr) / count(*) FILTER (WHERE en) + 0.5) AS BIGINT) FROM k) AS percent
FROM k WHERE en <> tr""")
def _(t):
    return C.locale_coverage(bodies(t), ["slug"], "locale", "en")


@query("jn_files_manifest", """
SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    found = R.reconcile(t.documents.select("doc_id"), t.labels.select("doc_id"), ["doc_id"])
    return found.where(F.col("kind") != "duplicate")


@query("jn_reconcile", """
WITH r AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P')
SELECT id, 'missing' AS kind FROM a WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT id, 'extra' FROM r WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT id, 'duplicate' FROM r WHERE n > 1""")
def _(t):
    authority = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("id"))
    records = t.lineitem.where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("id"))
    return R.reconcile(authority, records, ["id"])


@query("jn_register_complete", """
WITH r AS (SELECT l_partkey AS slug, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'
  AND l_quantity > 40 GROUP BY 1), m AS (SELECT p_partkey AS slug FROM part WHERE p_type <> 'PROMO')
SELECT slug, 'missing' AS kind FROM m WHERE slug NOT IN (SELECT slug FROM r)
UNION ALL SELECT slug, 'extra' FROM r WHERE slug NOT IN (SELECT slug FROM m)
UNION ALL SELECT slug, 'duplicate' FROM r WHERE n > 1""")
def _(t):
    mandated = t.part.where(F.col("p_type") != "PROMO").select(F.col("p_partkey").alias("slug"))
    register = t.lineitem.where(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)
    ).select(F.col("l_partkey").alias("slug"))
    return R.reconcile(mandated, register, ["slug"])


@query("jn_misfiled", """
SELECT s_suppkey, CAST(floor(abs(s_acctbal)) AS BIGINT) % 5 AS folder, n_regionkey AS assigned
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 4
WHERE CAST(floor(abs(s_acctbal)) AS BIGINT) % 5 IS DISTINCT FROM n_regionkey""")
def _(t):
    filed = t.supplier.select(
        "s_suppkey", F.col("s_nationkey").alias("n_nationkey"), (F.floor(F.abs("s_acctbal")) % 5).alias("folder")
    )
    assigned = t.nation.where(F.col("n_regionkey") < 4).select("n_nationkey", F.col("n_regionkey").alias("assigned"))
    out = lookup_join(filed, assigned, ["n_nationkey"])
    return out.where(~F.col("folder").eqNullSafe(F.col("assigned"))).select("s_suppkey", "folder", "assigned")


SEGMENTS = {"1-URGENT": "MACHINERY", "2-HIGH": "BUILDING", "3-MEDIUM": "AUTOMOBILE", "5-LOW": "FURNITURE"}


@query("jn_drift", """
WITH r AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'MACHINERY' WHEN '2-HIGH' THEN 'BUILDING'
    WHEN '3-MEDIUM' THEN 'AUTOMOBILE' WHEN '5-LOW' THEN 'FURNITURE' END AS seg,
  CASE WHEN o_orderstatus = 'P' THEN 'customer ' || o_custkey ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS nm
  FROM orders),
j AS (SELECT * FROM r JOIN customer ON c_custkey = o_custkey)
SELECT c_custkey, o_orderkey, 'c_mktsegment' AS field, seg AS got, c_mktsegment AS expected FROM j WHERE seg IS DISTINCT FROM c_mktsegment
UNION ALL SELECT c_custkey, o_orderkey, 'c_name', nm, c_name FROM j WHERE nm IS DISTINCT FROM c_name""")
def _(t):
    seg = F.lit(None).cast("string")
    for priority, name in SEGMENTS.items():
        seg = F.when(F.col("o_orderpriority") == priority, name).otherwise(seg)
    records = t.orders.select(
        F.col("o_custkey").alias("c_custkey"),
        "o_orderkey",
        seg.alias("c_mktsegment"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("customer "), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
        .alias("c_name"),
    )
    return R.drift(records, t.customer, ["c_custkey"], ["c_mktsegment", "c_name"], carry=["o_orderkey"])


# ---------------------------------------------------------------- checksums


def archive(t: Tables):
    return t.pages.select(
        F.col("page_id").alias("file"),
        F.sha2("html", 256).alias("sha256"),
        F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1).alias("title"),
        "url",
    )


ARCHIVE = """archive AS (SELECT page_id AS file, sha256(html) AS sha256,
  regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, url, html FROM pages)"""


@query("jn_checksum_current", f"""WITH {ARCHIVE},
cited AS (SELECT file AS slug, CASE WHEN url LIKE '%#top' THEN -1 - file ELSE file END AS file,
  CASE WHEN html LIKE '%</html>%' THEN sha256 ELSE sha256(html || '!') END AS sha256,
  CASE WHEN url LIKE '%utm%' THEN upper(title) ELSE title END AS title FROM archive),
j AS (SELECT c.slug, a.file AS f, a.sha256 <> c.sha256 AS s, a.title <> c.title AS ti FROM cited c LEFT JOIN archive a ON a.file = c.file)
SELECT slug, 'unarchived' AS state FROM j WHERE f IS NULL
UNION ALL SELECT slug, 'checksum-moved' FROM j WHERE s
UNION ALL SELECT slug, 'title-differs' FROM j WHERE ti""")
def _(t):
    a = t.pages.select("page_id", "url", "html", F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1).alias("title"))
    cited = a.select(
        F.col("page_id").alias("slug"),
        F.when(F.col("url").endswith("#top"), -1 - F.col("page_id")).otherwise(F.col("page_id")).alias("file"),
        F.sha2(F.when(F.col("html").contains("</html>"), F.col("html")).otherwise(F.concat("html", F.lit("!"))), 256).alias("sha256"),
        F.when(F.col("url").contains("utm"), F.upper("title")).otherwise(F.col("title")).alias("title"),
    )
    return R.revision_state(cited, archive(t)).select("slug", "state")


def history(t: Tables):
    """Version 1 of every page; addresses with a query string have a later one."""
    first = t.pages.select(F.col("page_id").alias("file"), F.lit(1).alias("seq"), F.sha2("html", 256).alias("sha256"))
    second = t.pages.where(F.col("url").contains("?")).select(
        F.col("page_id").alias("file"), F.lit(2).alias("seq"), F.sha2(F.concat("html", F.lit("v2")), 256).alias("sha256")
    )
    return first.unionByName(second)


HISTORY = """history AS (SELECT page_id AS file, 1 AS seq, sha256(html) AS sha256 FROM pages
  UNION ALL SELECT page_id, 2, sha256(html || 'v2') FROM pages WHERE url LIKE '%?%')"""


@query("jn_changed_documents", f"""WITH {ARCHIVE}, {HISTORY},
l AS (SELECT file, arg_max(sha256, seq) AS from_sha FROM history GROUP BY 1)
SELECT l.file, from_sha, a.sha256 AS to_sha FROM l JOIN archive a ON a.file = l.file WHERE from_sha <> a.sha256""")
def _(t):
    return R.changed_documents(history(t), archive(t))


@query("win_last_version", f"""WITH {HISTORY} SELECT file, arg_max(sha256, seq) AS sha256, max(seq) AS seq FROM history GROUP BY 1""")
def _(t):
    return history(t).groupBy("file").agg(F.max_by("sha256", "seq").alias("sha256"), F.max("seq").alias("seq"))


@query("jn_superseded", f"""WITH {ARCHIVE},
d AS (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS file, CASE WHEN l_returnflag = 'A' THEN 'old' END AS mark FROM lineitem)
SELECT l_orderkey, l_linenumber, d.file FROM d JOIN archive a ON a.file = d.file WHERE mark = 'old'""")
def _(t):
    derived = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 300).alias("file"), "l_returnflag"
    )
    # A derived page cites the current checksum, or one the archive has replaced.
    current = archive(t)
    cited = lookup_join(derived, current.select("file", F.col("sha256").alias("now")), ["file"], "left").withColumn(
        "sha256", F.when(F.col("l_returnflag") == "A", F.lit("0" * 64)).otherwise(F.coalesce("now", F.lit("1" * 64)))
    )
    return R.superseded(cited, current).select("l_orderkey", "l_linenumber", "file")


@query("snk_append_versions", f"""WITH {ARCHIVE}, {HISTORY}
SELECT file, sha256 FROM history UNION ALL
SELECT file, sha256 FROM (SELECT file, CASE WHEN url LIKE '%html' THEN sha256(html || 'new') ELSE sha256 END AS sha256 FROM archive) d
WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.file = d.file AND h.sha256 = d.sha256)""")
def _(t):
    now = t.pages.select(
        F.col("page_id").alias("file"),
        F.sha2(F.when(F.col("url").endswith("html"), F.concat("html", F.lit("new"))).otherwise(F.col("html")), 256).alias("sha256"),
    )
    path, known = f"{checkpoint_folder(t.spark)}/versions-{uuid.uuid4().hex}", history(t).select("file", "sha256")
    SNK.append_versions(known, path, "first")
    # The second run is repeated, and a third finds nothing new.
    for run in ("second", "second", "third"):
        SNK.append_versions(now, path, run)
    return commits.load(t.spark, path, now.schema)


@query("job_revision", f"""WITH {ARCHIVE}, {HISTORY},
l AS (SELECT file, arg_max(sha256, seq) AS s FROM history GROUP BY 1),
ch AS (SELECT l.file FROM l JOIN archive a ON a.file = l.file WHERE l.s <> a.sha256)
SELECT 'document-changed' AS kind, CAST(file AS VARCHAR) AS file, CAST(file AS VARCHAR) AS slug FROM ch
UNION ALL SELECT 'page-to-recheck', CAST(h.file AS VARCHAR), h.file || '/' || h.seq FROM history h JOIN archive a ON a.file = h.file
  WHERE h.sha256 <> a.sha256""")
def _(t):
    from civicloom.plans.jobs import job_revision

    derived = history(t).withColumn("slug", F.concat_ws("/", "file", "seq"))
    return job_revision(history(t), archive(t), derived)


@query("jn_by_checksum", """
WITH tr AS (SELECT sha256(text) AS sha, min(d.doc_id) AS transcript FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  WHERE quality = 1 GROUP BY 1)
SELECT d.doc_id, transcript FROM documents d LEFT JOIN tr ON tr.sha = sha256(d.text)""")
def _(t):
    reviewed = t.labels.where(F.col("quality") == 1).select("doc_id")
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    slugs = R.first_per_key(
        hashed.join(reviewed, "doc_id").withColumn("transcript", F.col("doc_id")), ["sha256"], ["doc_id"], ["transcript"]
    )
    return lookup_join(hashed, slugs, ["sha256"]).select("doc_id", "transcript")


# ---------------------------------------------------------------- offices


def filed_customers(t: Tables):
    office = F.when(F.col("c_acctbal") > 9500, 99).when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))
    return t.customer.select("c_custkey", office.alias("n_nationkey"), "c_mktsegment")


FILED = """filed AS (SELECT c_custkey, CASE WHEN c_acctbal > 9500 THEN 99 WHEN c_acctbal >= 0 THEN c_nationkey END AS office,
  c_mktsegment FROM customer)"""


@query("jn_services_by_office", f"""WITH {FILED}
SELECT c_custkey, coalesce(n_name, 'unlisted office') AS office, n_name IS NULL AS error
FROM filed LEFT JOIN nation ON n_nationkey = office WHERE office IS NOT NULL ORDER BY 2, 1""")
def _(t):
    return C.by_office(filed_customers(t), t.nation, "n_nationkey", "n_name", "c_custkey")


@query("flt_office", f"""WITH {FILED}
SELECT 'known' AS asked, c_custkey FROM filed JOIN nation ON n_nationkey = office WHERE n_name = 'NATION_7'
UNION ALL SELECT 'unknown', c_custkey FROM filed""")
def _(t):
    from civicloom.operators.search import narrow

    named = lookup_join(filed_customers(t), t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    known = narrow(named, "n_name", "NATION_7").select(F.lit("known").alias("asked"), "c_custkey")
    return known.unionByName(narrow(named, "n_name", "NATION_77").select(F.lit("unknown").alias("asked"), "c_custkey"))


@query("jn_office_roster", """
WITH used AS (SELECT DISTINCT CASE WHEN s_acctbal < 500 THEN 'nation ' ELSE 'NATION_' END || s_nationkey AS verbatim FROM supplier),
roster AS (SELECT n_name AS verbatim FROM nation)
SELECT verbatim, 'unmapped' AS kind FROM used WHERE verbatim NOT IN (SELECT verbatim FROM roster)
UNION ALL SELECT verbatim, 'unused' FROM roster WHERE verbatim NOT IN (SELECT verbatim FROM used)""")
def _(t):
    used = t.supplier.select(
        F.concat(F.when(F.col("s_acctbal") < 500, "nation ").otherwise("NATION_"), F.col("s_nationkey").cast("string")).alias("verbatim")
    )
    roster = t.nation.select(F.col("n_name").alias("verbatim"))
    found = R.two_sided(used, roster, ["verbatim"])
    return found.select("verbatim", F.when(F.col("side") == "left", "unmapped").otherwise("unused").alias("kind"))


@query("jn_title_provenance", """
WITH v AS (SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN upper(p_name) ELSE p_name END AS title,
  CASE WHEN p_type = 'PROMO' THEN 'read-from-pdf' WHEN p_type = 'LARGE' AND p_size = 1 THEN 'guessed' ELSE 'extracted' END AS src,
  CASE WHEN p_size > 10 THEN 'note' END AS note, p_name AS published FROM part)
SELECT id, 'altered' AS kind FROM v WHERE src <> 'read-from-pdf' AND title IS DISTINCT FROM published
UNION ALL SELECT id, 'not-a-reading' FROM v WHERE src = 'read-from-pdf' AND title IS NOT DISTINCT FROM published
UNION ALL SELECT id, 'no-note' FROM v WHERE src = 'read-from-pdf' AND note IS NULL
UNION ALL SELECT id, 'unknown-source' FROM v WHERE src NOT IN ('extracted', 'not-in-layout', 'read-from-pdf')""")
def _(t):
    vocabulary = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 45, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"),
        F.when(F.col("p_type") == "PROMO", "read-from-pdf")
        .when((F.col("p_type") == "LARGE") & (F.col("p_size") == 1), "guessed")
        .otherwise("extracted")
        .alias("title_source"),
        F.when(F.col("p_size") > 10, "note").alias("note"),
    )
    enumerated = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("published"))
    return C.title_provenance(vocabulary, enumerated, "id")


@query("jn_groups_whole", """
WITH g AS (SELECT o_orderkey AS grp FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT DISTINCT l_orderkey AS grp, l_partkey AS member FROM lineitem),
e AS (SELECT p_partkey AS member, a AS answers FROM part JOIN (SELECT l_partkey, max(l_orderkey) AS a FROM lineitem GROUP BY 1) x
      ON l_partkey = p_partkey WHERE p_size < 48),
gm AS (SELECT m.* FROM m JOIN g USING (grp))
SELECT gm.grp, gm.member, CASE WHEN e.member IS NULL THEN 'member-missing' ELSE 'wrong-back-pointer' END AS kind
  FROM gm LEFT JOIN e USING (member) WHERE e.member IS NULL OR e.answers IS DISTINCT FROM gm.grp
UNION ALL SELECT g.grp, NULL, 'too-few-members' FROM g LEFT JOIN gm ON gm.grp = g.grp GROUP BY g.grp HAVING count(gm.member) < 2
UNION ALL SELECT answers, member, 'unknown-group' FROM e WHERE answers NOT IN (SELECT grp FROM g)""")
def _(t):
    groups = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("grp"))
    members = t.lineitem.select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("member")).distinct()
    back = t.lineitem.groupBy(F.col("l_partkey").alias("member")).agg(F.max("l_orderkey").alias("answers"))
    entries = t.part.where(F.col("p_size") < 48).select(F.col("p_partkey").alias("member")).join(back, "member")
    return C.groups_whole(groups, members, entries)


# ---------------------------------------------------------------- catalogues


@query("jn_catalogue_parity", """
WITH en AS (SELECT doc_id // 4 AS key, max(length(split_part(text, ' ', 1))) AS v FROM documents WHERE lang = 'en' GROUP BY 1),
fr AS (SELECT doc_id // 4 AS key, max(length(split_part(text, ' ', 1))) AS v FROM documents WHERE lang <> 'en' GROUP BY 1),
x AS (SELECT DISTINCT doc_id // 4 AS key FROM labels WHERE toxic = 1),
j AS (SELECT coalesce(en.key, fr.key, x.key) AS key, en.v AS a, fr.v AS b, x.key IS NOT NULL AS ex
  FROM en FULL JOIN fr ON en.key = fr.key FULL JOIN x ON x.key = coalesce(en.key, fr.key))
SELECT key, 'left' AS side, 'only-left' AS reason FROM j WHERE a IS NOT NULL AND b IS NULL
UNION ALL SELECT key, 'right', 'only-right' FROM j WHERE a IS NULL AND b IS NOT NULL
UNION ALL SELECT key, 'both', 'identical' FROM j WHERE a = b AND NOT ex
UNION ALL SELECT key, 'exempt', 'not-needed' FROM j WHERE ex AND (a = b) IS NOT TRUE""")
def _(t):
    d = t.documents.select(
        F.floor(F.col("doc_id") / 4).alias("key"), "lang", F.length(F.split_part("text", F.lit(" "), F.lit(1))).alias("text")
    )
    en = d.where(F.col("lang") == "en").groupBy("key").agg(F.max("text").alias("text"))
    other = d.where(F.col("lang") != "en").groupBy("key").agg(F.max("text").alias("text"))
    exempt = t.labels.where(F.col("toxic") == 1).select(F.floor(F.col("doc_id") / 4).alias("key")).distinct()
    return R.two_sided(
        en.withColumn("text", F.col("text").cast("string")), other.withColumn("text", F.col("text").cast("string")),
        ["key"], "text", exempt,
    )


@query("jn_gap_register", """
WITH nulls AS (SELECT 'orders.' || o_orderkey || '.price' AS path FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'orders.' || o_orderkey || '.lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
pending AS (SELECT DISTINCT 'orders.' || l_orderkey || '.price' AS path FROM lineitem WHERE l_returnflag = 'R')
SELECT path, 'unregistered' AS kind FROM nulls WHERE path NOT IN (SELECT path FROM pending)
UNION ALL SELECT path, 'no-longer-null' FROM pending WHERE path NOT IN (SELECT path FROM nulls)""")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    facts = t.orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.when(F.col("n") > 0, F.array(F.col("n"))).otherwise(F.array().cast("array<bigint>")).alias("lines"),
    )
    pending = t.lineitem.where(F.col("l_returnflag") == "R").select(
        F.format_string("orders.%s.price", F.col("l_orderkey").cast("string")).alias("path")
    )
    nulls = C.null_paths(facts, "orders", "o_orderkey", empty_lists=True)
    found = R.two_sided(nulls, pending, ["path"])
    return found.select("path", F.when(F.col("side") == "left", "unregistered").otherwise("no-longer-null").alias("kind"))


@query("val_fact_has_source", """
WITH f AS (SELECT c_custkey AS field, c_acctbal >= 0 AS filled FROM customer WHERE c_mktsegment <> 'MACHINERY'),
s AS (SELECT DISTINCT o_custkey AS field FROM orders WHERE o_totalprice > 300000)
SELECT coalesce(f.field, s.field) AS field, CASE WHEN f.field IS NULL THEN 'untracked-source'
  WHEN filled THEN 'no-source' ELSE 'source-without-value' END AS kind
FROM f FULL JOIN s ON s.field = f.field
WHERE f.field IS NULL OR (filled AND s.field IS NULL) OR (NOT filled AND s.field IS NOT NULL)""")
def _(t):
    facts = t.customer.where(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_custkey").alias("field"), (F.col("c_acctbal") >= 0).alias("filled")
    )
    sources = t.orders.where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("field"))
    return C.fact_sources(facts, sources, "field")


@query("jn_code_catalogue", """
WITH used AS (SELECT DISTINCT event_type AS code FROM events),
cat AS (SELECT DISTINCT CASE WHEN user_id < 75 THEN 'en' ELSE 'fil' END AS locale, event_type AS code FROM events WHERE value > 470)
SELECT code, locale FROM used, (VALUES ('en'), ('fil')) l(locale)
WHERE (code, locale) NOT IN (SELECT code, locale FROM cat)""")
def _(t):
    used = t.events.select(F.col("event_type").alias("code"))
    catalogue = t.events.where(F.col("value") > 470).select(
        F.when(F.col("user_id") < 75, "en").otherwise("fil").alias("locale"), F.col("event_type").alias("code")
    )
    return C.missing_in_locales(used, catalogue, "code", ["en", "fil"])


@query("jn_nav_live", """
WITH r AS (SELECT regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS route FROM pages),
s AS (SELECT lang AS route FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
x AS ((SELECT * FROM r EXCEPT ALL SELECT * FROM s)),
y AS ((SELECT * FROM s EXCEPT ALL SELECT * FROM r))
SELECT route, 'left' AS side FROM x UNION ALL SELECT route, 'right' FROM y""")
def _(t):
    routes = t.pages.select(F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1).alias("route"))
    reviewed = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id").select(F.col("lang").alias("route"))
    return R.exact_difference(routes, reviewed)


@query("set_equal", """
WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT 'orders-lineitem' AS pair, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left,
  (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right""")
def _(t):
    n = R.key_counts(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), ["k"])
    return n.agg(
        F.count_if(F.col("in_right") == 0).alias("only_left"), F.count_if(F.col("in_left") == 0).alias("only_right")
    ).withColumn("pair", F.lit("orders-lineitem"))


# ---------------------------------------------------------------- figures and containment


@query("jn_twin_figures", """
WITH f AS (SELECT DISTINCT doc_id // 2 AS slug, lang = 'en' AS en, unnest(regexp_extract_all(text, '[0-9][0-9,.]*')) AS figure FROM documents),
both_sides AS (SELECT doc_id // 2 AS slug FROM documents GROUP BY 1 HAVING bool_or(lang = 'en') AND bool_or(lang <> 'en'))
SELECT slug, figure FROM f WHERE slug IN (SELECT slug FROM both_sides) GROUP BY 1, 2 HAVING NOT bool_or(en)""")
def _(t):
    return C.twin_figures(bodies(t), ["slug"], "locale", "body", "en", r"\d[\d,.]*")


@query("jn_figures_traceable", """
WITH b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9,. ]*')) AS figure FROM documents),
s AS (SELECT doc_id + 1 AS doc_id, regexp_replace(text, '\\s+', '', 'g') AS flat FROM documents)
SELECT b.doc_id, figure FROM b LEFT JOIN s ON s.doc_id = b.doc_id WHERE flat IS NULL OR NOT contains(flat, regexp_replace(figure, '\\s+', '', 'g'))""")
def _(t):
    pages = t.documents.select("doc_id", F.col("text").alias("body"))
    source = t.documents.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("source_text"))
    return C.untraceable_figures(pages, source, ["doc_id"], "body", "source_text", r"\d[\d,. ]*")


@query("jn_transcript_exists", """
SELECT regexp_replace(regexp_replace(lower(source || ' Doc_' || doc_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS stem
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    files = t.documents.select(T.stem(F.format_string("%s Doc_%s.PDF", "source", F.col("doc_id").cast("string"))).alias("stem"))
    made = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id").select(
        T.stem(F.format_string("%s Doc_%s.pdf", "source", F.col("doc_id").cast("string"))).alias("stem")
    )
    return R.unmatched(files, made, ["stem"])


@query("jn_branch_containment", """
WITH slugs AS (SELECT DISTINCT list_sort(list_distinct([w FOR w IN string_split(c_name_words, ' ') IF w <> '' AND w NOT IN ('office', 'of', 'the')])) AS s
  FROM (SELECT p_name AS c_name_words FROM part WHERE p_size = 50 AND p_type = 'PROMO') q),
d AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part)
SELECT DISTINCT p_partkey FROM d, slugs WHERE len(s) > 0 AND len([x FOR x IN s IF NOT list_contains(w, x)]) = 0""")
def _(t):
    sets = t.part.where((F.col("p_size") == 50) & (F.col("p_type") == "PROMO")).select(
        C.distinctive_words(F.col("p_name")).alias("words")
    )
    named = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return I.contained_sets(named, "p_partkey", C.distinctive_words(F.col("name")), sets, "words")


# ---------------------------------------------------------------- ranges


def bands(t: Tables):
    return t.nation.select(
        F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("l_returnflag"),
        F.col("n_nationkey").alias("band"),
        F.when(F.col("n_nationkey") > 0, F.col("n_nationkey") * 3000.0).alias("x0"),
        F.when(F.col("n_nationkey") < 24, (F.col("n_nationkey") + 1) * 3000.0).alias("x1"),
    )


@query("jn_column_range", """
WITH b AS (SELECT f AS flag, n_nationkey AS band, CASE WHEN n_nationkey > 0 THEN n_nationkey * 3000.0 END AS x0,
  CASE WHEN n_nationkey < 24 THEN (n_nationkey + 1) * 3000.0 END AS x1 FROM nation, (VALUES ('A'), ('N'), ('R')) v(f))
SELECT l_orderkey, l_linenumber, l_extendedprice, band FROM lineitem JOIN b ON flag = l_returnflag
 AND (x0 IS NULL OR l_extendedprice >= x0) AND (x1 IS NULL OR l_extendedprice < x1)""")
def _(t):
    points = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return I.range_join(
        points, bands(t), ["l_returnflag"], "l_extendedprice", "x0", "x1", width=3000.0, span=(0.0, 72000.0)
    ).select("l_orderkey", "l_linenumber", "l_extendedprice", "band")


@query("jn_overlap_pair", """
WITH i AS (SELECT o_custkey AS page, o_orderkey AS item, epoch(o_orderdate) / 86400 AS y0, epoch(o_orderdate) / 86400 + o_totalprice / 10000 AS y1
  FROM orders WHERE o_orderstatus <> 'F'),
s AS (SELECT o_custkey AS page, o_orderkey AS source, epoch(o_orderdate) / 86400 AS y0, epoch(o_orderdate) / 86400 + o_totalprice / 2000 AS y1
  FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT s.page, s.source, count(i.item) AS hits, min(i.item) AS item FROM s LEFT JOIN i ON i.page = s.page
  AND least(i.y1, s.y1) - greatest(i.y0, s.y0) > 0 GROUP BY 1, 2),
g AS (SELECT page, bool_and(hits = 1) AND count(DISTINCT item) = count(item) AND
  count(*) <= coalesce((SELECT count(*) FROM i WHERE i.page = p.page), 0) AS clear FROM p GROUP BY 1)
SELECT p.page, p.source, CASE WHEN clear THEN item END AS item FROM p JOIN g ON g.page = p.page""")
def _(t):
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400
    base = t.orders.select(F.col("o_custkey").alias("page"), "o_orderkey", "o_orderstatus", "o_totalprice", day.alias("y0"))
    items = base.where(F.col("o_orderstatus") != "F").select(
        "page", F.col("o_orderkey").alias("item"), "y0", (F.col("y0") + F.col("o_totalprice") / 10000).alias("y1")
    )
    sources = base.where(F.col("o_orderstatus") == "F").select(
        "page", F.col("o_orderkey").alias("source"), "y0", (F.col("y0") + F.col("o_totalprice") / 2000).alias("y1")
    )
    return I.overlap_pair(items, sources, ["page"], "item", "source", "y0", "y1", chunk=365.0)


LABEL_ROLES = ("user", "system")


@query("jn_heading_asof", """
WITH l AS (SELECT source, doc_id AS pos, text, lang = 'fr' AS a, lang = 'es' AS h, length(text) > 6000 AS b FROM documents)
SELECT l.source, l.pos, (SELECT CASE WHEN arg_max(x.b, x.pos) THEN NULL ELSE arg_max(md5(x.text), x.pos) END FROM l x
   WHERE x.source = l.source AND x.pos < l.pos AND (x.b OR x.h)
     AND NOT EXISTS (SELECT 1 FROM l z WHERE z.source = l.source AND z.pos < l.pos AND z.pos > x.pos AND (z.b OR z.h))
     AND l.pos - x.pos <= 15) AS heading
FROM l WHERE a""")
def _(t):
    lines = t.documents.select("source", F.col("doc_id").alias("pos"), "text", "lang")
    return I.heading_asof(
        lines, ["source"], "pos",
        anchor=F.col("lang") == "fr", heading=F.col("lang") == "es", barrier=F.length("text") > 6000,
        value=F.md5("text"), bound=15,
    ).select("source", "pos", "heading")
