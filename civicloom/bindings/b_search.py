from __future__ import annotations

from pyspark.sql import functions as F

from civicloom.bindings.registry import Tables, query
from civicloom.functions import text as T
from civicloom.functions import urls
from civicloom.operators import search as S

QUERY = "Tion  lé"
CATEGORY = "src3"


def docs(t: Tables):
    """documents as published entries: title = first line."""
    return t.documents.select(
        "doc_id", "text", "lang", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title")
    )


def hits(t: Tables):
    return S.search(docs(t), QUERY, ["text"], "title", "source")


DOCS = """docs AS (
  SELECT doc_id, text, lang, source, split_part(text, chr(10), 1) AS title FROM documents),
folded AS (
  SELECT *, lower(strip_accents(text || ' ' || source)) AS h, lower(strip_accents(title)) AS ft FROM docs),
hits AS (
  SELECT *, contains(ft, 'tion') AND contains(ft, 'le') AS title_hit
  FROM folded WHERE contains(h, 'tion') AND contains(h, 'le'))
"""


@query("sea_search", f"WITH {DOCS} SELECT doc_id, source, title_hit FROM hits")
def _(t):
    return hits(t).select("doc_id", "source", "title_hit")


@query("sea_title_hit", f"WITH {DOCS} SELECT title_hit, count(*) AS n, sum(doc_id) AS ids FROM hits GROUP BY 1")
def _(t):
    return hits(t).groupBy("title_hit").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "srt_search_rank",
    f"WITH {DOCS} SELECT doc_id, source, title_hit, title FROM hits ORDER BY title_hit DESC, source, doc_id",
)
def _(t):
    return S.ranked(hits(t), "source", "doc_id").select("doc_id", "source", "title_hit", "title")


@query("agg_facets", f"WITH {DOCS} SELECT source AS category, count(*) AS hits FROM hits GROUP BY 1")
def _(t):
    return S.facets(hits(t), "source")


@query("sea_category_filter", f"""WITH {DOCS}
  SELECT 'known' AS asked, doc_id FROM hits WHERE source = '{CATEGORY}'
  UNION ALL SELECT 'unknown', doc_id FROM hits""")
def _(t):
    h = hits(t)
    known = S.narrow(h, "source", CATEGORY).select(F.lit("known").alias("asked"), "doc_id")
    return known.unionByName(S.narrow(h, "source", "nowhere").select(F.lit("unknown").alias("asked"), "doc_id"))


HIGHLIGHT_TERMS = "the er"


@query("sea_highlight", """
WITH f AS (SELECT doc_id, lower(strip_accents(text)) AS t, length(text) AS n FROM documents),
p AS (
  SELECT doc_id, n, 3 AS w, unnest(string_split(t, 'the')) AS piece, generate_subscripts(string_split(t, 'the'), 1) AS i,
         len(string_split(t, 'the')) AS k FROM f
  UNION ALL
  SELECT doc_id, n, 2, unnest(string_split(t, 'er')), generate_subscripts(string_split(t, 'er'), 1),
         len(string_split(t, 'er')) FROM f),
s AS (
  SELECT doc_id, n, w, i, k,
         sum(length(piece)) OVER (PARTITION BY doc_id, w ORDER BY i) + (i - 1) * w AS s FROM p),
occ AS (SELECT doc_id, n, s, s + w AS e FROM s WHERE i < k),
flag AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            THEN 0 ELSE 1 END AS opens FROM occ),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM flag),
merged AS (SELECT doc_id, n, run, min(s) AS s, max(e) AS e FROM runs GROUP BY 1, 2, 3)
SELECT doc_id, CAST(count(*) AS BIGINT) AS runs, CAST(sum(e - s) AS BIGINT) AS matched_chars,
       CAST(sum(s) AS BIGINT) AS start_sum, CAST(any_value(n) AS BIGINT) AS chars
FROM merged GROUP BY doc_id""")
def _(t):
    marked = S.highlight(t.documents.select("doc_id", "text"), "text", HIGHLIGHT_TERMS)
    # Start of every segment = running length of the ones before it.
    # Start of every segment = running length of the ones before it.
    seg = marked.select("doc_id", F.explode(F.array(F.transform(
        "segments", lambda s: F.struct(F.length(s["text"]).cast("long").alias("w"), s["matched"].alias("m"))
    ))).alias("s"))
    zero = F.lit(0).cast("long")
    totals = seg.select("doc_id", F.explode(F.array(F.aggregate(
        "s",
        F.struct(zero.alias("at"), zero.alias("runs"), zero.alias("chars"), zero.alias("starts")),
        lambda a, s: F.struct(
            (a["at"] + s["w"]).alias("at"),
            (a["runs"] + s["m"].cast("long")).alias("runs"),
            (a["chars"] + F.when(s["m"], s["w"]).otherwise(zero)).alias("chars"),
            (a["starts"] + F.when(s["m"], a["at"]).otherwise(zero)).alias("starts"),
        ),
    ))).alias("a"))
    return totals.where(F.col("a.runs") > 0).select(
        "doc_id",
        F.col("a.runs").alias("runs"),
        F.col("a.chars").alias("matched_chars"),
        F.col("a.starts").alias("start_sum"),
        F.col("a.at").alias("chars"),
    )


POPULAR = ["the", "le", "tion", "été", "ring", "is of", "src1"]


@query("sea_batch", """
WITH f AS (SELECT doc_id, source, lower(strip_accents(text || ' ' || source)) AS h FROM documents),
q(query, terms) AS (VALUES ('the', ['the']), ('le', ['le']), ('tion', ['tion']), ('été', ['ete']),
  ('ring', ['ring']), ('is of', ['is', 'of']), ('src1', ['src1']))
SELECT query, source AS category, count(*) AS hits FROM f, q
WHERE len([x FOR x IN terms IF contains(h, x)]) = len(terms) GROUP BY 1, 2""")
def _(t):
    found = S.batch(t.documents.select("doc_id", "text", "source"), POPULAR, ["text"], "text", "source")
    return found.groupBy("query", F.col("source").alias("category")).agg(F.count(F.lit(1)).alias("hits"))


@query("sea_query_clean", """
SELECT event_id, nullif(trim(replace(event_type || '%20 ' || props, '%', '')), '') AS q,
       CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'view' END AS locale
FROM events""")
def _(t):
    raw = F.concat("event_type", F.lit("%20 "), "props")
    return t.events.select(
        "event_id",
        urls.clean_query(raw).alias("q"),
        urls.locale_or_default(F.col("event_type"), ["view", "click"], "view").alias("locale"),
    )


@query("sea_logged_queries", """
WITH q AS (SELECT page_id, replace(url, '/', '%2F') AS once, replace(replace(url, '/', '%2F'), '%', '%25') AS twice,
  url || '%E0%A4%A' AS bad FROM pages)
SELECT page_id, replace(once, '%2F', '/') AS decoded, replace(once, '%2F', '/') AS decoded_twice,
       bad AS decoded_bad, true AS bad_is_malformed, false AS ok_is_malformed FROM q""")
def _(t):
    once = F.replace("url", F.lit("/"), F.lit("%2F"))
    twice = F.replace(once, F.lit("%"), F.lit("%25"))
    bad = F.concat("url", F.lit("%E0%A4%A"))
    return t.pages.select(
        "page_id",
        urls.decode_param(once).alias("decoded"),
        urls.decode_param(twice).alias("decoded_twice"),
        urls.decode_param(bad).alias("decoded_bad"),
        urls.is_malformed(bad).alias("bad_is_malformed"),
        urls.is_malformed(once).alias("ok_is_malformed"),
    )


@query("sea_nav_index", """
SELECT r_regionkey AS section, 0 AS level, r_name AS label FROM region
UNION ALL SELECT n_regionkey, 1, n_name FROM nation""")
def _(t):
    return S.nav_index(
        t.region.withColumnRenamed("r_name", "label"),
        t.nation.withColumnRenamed("n_name", "label"),
        "r_regionkey",
        "n_regionkey",
    )


@query("set_suggestions", """
SELECT p_name AS suggestion, count(*) AS uses FROM part WHERE lower(p_name) <> 'red widget' GROUP BY 1""")
def _(t):
    popular = t.part.groupBy(F.col("p_name").alias("suggestion")).agg(F.count(F.lit(1)).alias("uses"))
    return S.suggestions(popular, "suggestion", "Red WIDGET")


@query("job_search", f"""WITH {DOCS}
SELECT h.doc_id, h.source AS category, h.title_hit, f.n AS category_hits,
       coalesce(len(regexp_extract_all(h.ft, '(?:tion|le)+')), 0) AS title_runs
FROM hits h JOIN (SELECT source, count(*) AS n FROM hits GROUP BY 1) f ON f.source = h.source
WHERE h.source = '{CATEGORY}'""")
def _(t):
    from civicloom.plans.jobs import job_search

    return job_search(docs(t), QUERY, ["text"], "title", "source", "doc_id", CATEGORY, keep=["doc_id"]).select(
        "doc_id",
        "category",
        "title_hit",
        "category_hits",
        F.size(F.filter("title_segments", lambda s: s["matched"])).alias("title_runs"),
    )
