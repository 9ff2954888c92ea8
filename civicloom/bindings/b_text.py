from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from civicloom.bindings.registry import Tables, query
from civicloom.functions import text as T
from civicloom.functions import urls
from civicloom.operators import pages as P
from civicloom.operators import phrases as PH
from civicloom.operators import reconcile as R
from civicloom.operators.skew import checkpoint_folder, first_n
from civicloom.sources import commits
from civicloom.sources import readers as SRC
from civicloom.sources import writers as SNK

# ---------------------------------------------------------------- articles

STRIP = "html"
for _tag in ("script", "style", "noscript", "template"):
    STRIP = f"regexp_replace({STRIP}, '<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'gis')"


def article_sql(html: str) -> str:
    body = f"regexp_extract({STRIP.replace('html', html, 1)}, '(?is)<article\\b[^>]*>(.*?)</article>', 1)"
    body = f"regexp_replace({body}, '<[^>]+>', ' ', 'g')"
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("ndash", "–"), ("mdash", "—"), ("amp", "&")]:
        body = f"replace({body}, '&{name};', '{char}')"
    return f"trim(regexp_replace({body}, '\\s+', ' ', 'g'))"


@query("txt_article", f"SELECT page_id, md5(a) AS digest, length(a) AS chars FROM (SELECT page_id, {article_sql('html')} AS a FROM pages)")
def _(t):
    # One generated row keeps the text from being worked out once per column.
    a = t.pages.select("page_id", F.explode(F.array(P.article_text(F.col("html")))).alias("a"))
    return a.select("page_id", F.md5("a").alias("digest"), F.length("a").alias("chars"))


@query("agg_channel_tripwire", f"""
SELECT regexp_extract(url, '/([a-z]{{2}})/', 1) AS branch, count(*) AS n, count(*) FILTER (WHERE a = '') AS zeros, count(*) FILTER (WHERE a = '') = count(*) AS warn
FROM (SELECT url, {article_sql("CASE WHEN url LIKE '%/es/%' THEN replace(html, 'article', 'section') ELSE html END")} AS a FROM pages) GROUP BY 1""")
def _(t):
    from civicloom.operators.aggregate import tripwire

    broken = F.when(F.col("url").contains("/es/"), F.replace("html", F.lit("article"), F.lit("section"))).otherwise(F.col("html"))
    rows = t.pages.select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("branch"), F.length(P.article_text(broken)).alias("chars"))
    return tripwire(rows, ["branch"], F.col("chars"))


@query("txt_title", """
SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), '&amp;', '&'), '\\s*[|.]\\s*$', '')) AS title FROM pages""")
def _(t):
    return t.pages.select("page_id", P.published_title(F.col("html"), r"(?i)\s*[|.]\s*$").alias("title"))


def crawls(t: Tables):
    """Two crawls: an injected stamp, an edited word, a new and a missing page."""
    u, h = F.col("url"), F.col("html")
    prev = t.pages.where(~u.endswith(".html")).select(
        "page_id",
        F.when(u.contains("?"), F.replace(h, F.lit("<article>"), F.lit("<script>stamp=1</script><article>")))
        .when(u.endswith("#top"), F.replace(h, F.lit("</article>"), F.lit(" edited</article>")))
        .otherwise(h)
        .alias("html"),
    )
    return prev, t.pages.where(~u.contains("/es/")).select("page_id", "html")


@query("txt_change", """
SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'new' WHEN url LIKE '%/es/%' THEN 'gone' WHEN url LIKE '%#top' THEN 'changed' ELSE 'same' END AS state
FROM pages WHERE NOT (url LIKE '%.html' AND url LIKE '%/es/%')""")
def _(t):
    prev, curr = crawls(t)
    return P.changes(prev, curr, "page_id", "html")


# ---------------------------------------------------------------- links

HREF = "regexp_extract_all(html, '(?is)<a\\b[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', {g})"
LINKS = f"""a AS (SELECT page_id, unnest({HREF.format(g=1)}) AS url, unnest({HREF.format(g=2)}) AS title, generate_subscripts({HREF.format(g=1)}, 1) AS pos FROM pages),
links AS (SELECT page_id, url, arg_min(title, pos) AS title FROM a WHERE regexp_matches(url, '^/t') GROUP BY 1, 2)"""


@query("txt_links", f"WITH {LINKS} SELECT page_id, url, title FROM links")
def _(t):
    return P.links(t.pages, "page_id", "html", r"^/t")


@query("set_union_links", f"""WITH {LINKS}, f AS (SELECT url, arg_min(title, page_id) AS title FROM links GROUP BY 1)
SELECT links.url, page_id, f.title FROM links JOIN f ON f.url = links.url""")
def _(t):
    return P.union_links(P.links(t.pages, "page_id", "html", r"^/t"), "page_id")


@query("txt_title_source", f"""WITH {LINKS}
SELECT page_id, url, CASE WHEN length(title) > 4 THEN title ELSE replace(url, '-', ' ') END AS title,
  CASE WHEN length(title) > 4 THEN 'published-link-text' ELSE 'derived-from-filename' END AS source FROM links""")
def _(t):
    found = P.links(t.pages, "page_id", "html", r"^/t")
    named = P.title_source(F.when(F.length("title") > 4, F.col("title")), F.concat("url", F.lit(".PDF")))
    return found.select("page_id", "url", named.alias("t")).select("page_id", "url", "t.title", "t.source")


@query("jn_links_resolve", f"""
WITH a AS (SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) AS loc,
    unnest([CASE WHEN h LIKE '/t%' THEN '/en' || h ELSE h END FOR h IN {HREF.format(g=1)}]) AS href FROM pages),
k AS (SELECT DISTINCT '/en/' || lower(title_word) AS path FROM (SELECT unnest(string_split(lower(text), ' ')) AS title_word FROM benchmark)),
j AS (SELECT a.*, regexp_extract(href, '^/(en|fr|de|es)/', 1) AS p, k.path FROM a LEFT JOIN k ON k.path = href)
SELECT page_id, href, 'no-locale' AS problem FROM j WHERE p = '' UNION ALL SELECT page_id, href, 'crossed-locale' FROM j WHERE p <> '' AND p <> loc
UNION ALL SELECT page_id, href, 'missing' FROM j WHERE path IS NULL""")
def _(t):
    hrefs = F.transform(
        F.regexp_extract_all("html", F.lit(P.ANCHOR), F.lit(1)),
        lambda h: F.when(h.startswith("/t"), F.concat(F.lit("/en"), h)).otherwise(h),
    )
    known = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).select(F.concat(F.lit("/en/"), "w").alias("path"))
    pages = t.pages.withColumn("loc", F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1))
    return P.link_problems(pages, "page_id", "loc", hrefs, known, ["en", "fr", "de", "es"])


@query("jn_urls_inventoried", """
SELECT DISTINCT regexp_replace(url, '[),.]+$', '') AS url FROM pages
WHERE regexp_replace(url, '[),.]+$', '') NOT IN (SELECT url FROM pages WHERE url NOT LIKE '%?%')""")
def _(t):
    prose = t.pages.select(F.concat(F.lit("See "), "url", F.lit("), and more.")).alias("text"))
    inventory = t.pages.where(~F.col("url").contains("?")).select("url")
    return R.unmatched(P.cited_urls(prose, "text", r"https?://[^\s\"']+"), inventory, ["url"])


# ---------------------------------------------------------------- page classes

CLASS = """CASE WHEN regexp_matches(url, '(?i)spam') THEN 'charter' WHEN regexp_matches(url, '/(en|fr)/[0-9]+/?$') AND regexp_matches(url, '/fr/') THEN 'legislative'
  WHEN regexp_matches(url, '/(en|fr)/[0-9]+/?$') THEN 'office' WHEN regexp_matches(url, '^[a-z]+://[^/]+/de/') THEN 'reference' ELSE 'announcement' END"""


def classed(t: Tables):
    kind = P.classify(F.col("url"), r"(?i)spam", r"/(en|fr)/[0-9]+/?$", r"/fr/", ["/"], "/de/")
    return t.pages.select("page_id", "url", kind.alias("kind"))


@query("flt_reference_pages", f"SELECT page_id, {CLASS} AS kind FROM pages")
def _(t):
    return classed(t).select("page_id", "kind")


@query("set_except_classified", f"SELECT DISTINCT url FROM (SELECT url, {CLASS} AS kind FROM pages) WHERE kind = 'announcement'")
def _(t):
    c = classed(t)
    return R.unmatched(c.select("url"), c.where(F.col("kind") != "announcement").select("url"), ["url"])


@query("flt_named_urls", """
WITH s AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p, url FROM pages),
n AS (SELECT page_id, lower(regexp_replace(p, '[0-9]+', CASE WHEN url LIKE '%utm%' THEN 'visit-of-hon-cruz' WHEN url LIKE '%#top' THEN 'notice-a-b' ELSE 'notice' END)) AS p FROM s)
SELECT page_id, regexp_matches(list_last(string_split(regexp_replace(p, '/$', ''), '/')),
  '(?:^|-)(?:hon|mayor|congressman|gov|sen|cong|atty|engr)-|(?:^|-)[a-z](?:-|$)') AS held_back FROM n""")
def _(t):
    slug = F.when(F.col("url").contains("utm"), "visit-of-hon-cruz").when(F.col("url").endswith("#top"), "notice-a-b").otherwise("notice")
    path = F.lower(F.regexp_replace(urls.path_of(F.col("url")), F.lit("[0-9]+"), slug))
    return t.pages.select("page_id", P.names_a_person(F.concat(F.lit("https://x"), path)).alias("held_back"))


def robots(t: Tables):
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)
    text = ["User-agent: badbot", "Disallow: /", "", "User-Agent: *  # all", "Disallow: /fr/", "Disallow:", "disallow: /es/5 # five", "Allow: /"]
    return t.pages.select(host.alias("host")).distinct().select("host", F.posexplode(F.array(*[F.lit(x) for x in text])).alias("pos", "line"))


@query("flt_robots", """
SELECT page_id, CASE WHEN starts_with(p, '/es/5') THEN '/es/5' WHEN starts_with(p, '/fr/') THEN '/fr/' END AS rule
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)""")
def _(t):
    return P.robots_verdict(t.pages, "url", P.robots_rules(robots(t))).select("page_id", "rule")


# ---------------------------------------------------------------- scans


def noted(t: Tables):
    """documents with a sentence per source that the scans are about."""
    s = F.col("source")
    note = (
        F.when(s == "src1", " Twice the clerk refused to stamp it; this page conceals nothing now but concealed much in spring.")
        .when(s == "src2", " The ground floor has the withholding tax desk and the refuse bins.")
        .when(s == "src3", " One total stays withheld, and the lack of transparency was noted.")
        .when(s == "src4", " Phones: 086-555-1234, 086-555-0000; Atty. Cruz sees visitors from 8:30 am.")
        .when(s == "src5", " Compare [page](../a/b.md#x) with [site](/en/x). Copies are ₱50, one every 15 minutes.")
        .otherwise("")
    )
    return t.documents.withColumn("body", F.concat("text", note))


@query("txt_framing", """
SELECT doc_id, rule, match, 'violation' AS verdict FROM documents JOIN (VALUES ('src1', 'refusal', 'refused to'), ('src1', 'concealment', 'conceals'),
  ('src1', 'concealment', 'concealed'), ('src3', 'transparency', 'lack of transparency')) v(s, rule, match) ON s = source
UNION ALL SELECT doc_id, 'concealment', 'stonewall', 'stale' FROM documents WHERE source = 'src3'""")
def _(t):
    found = P.pattern_scan(noted(t), "doc_id", F.col("body"), P.FRAMINGS)
    at3 = t.documents.where(F.col("source") == "src3")
    allow = at3.select("doc_id", F.lit("concealment").alias("rule"), F.explode(F.array(F.lit("withheld"), F.lit("stonewall"))).alias("match"))
    return P.judge_scan(found, allow, "doc_id")


PHONE_SQL = "'\\b(?:\\+63|0)\\d{2}[-\\s]?\\d{3}[-\\s]?\\d{4}\\b|\\b\\d{3}-\\d{3}-\\d{4}\\b|\\(\\d{2,4}\\)\\s?\\d{3}[-\\s]?\\d{4}'"


@query("txt_phone_scan", f"""
WITH b AS (SELECT doc_id, text || CASE source WHEN 'src4' THEN ' Call 086-555-1234 or 086-555-0000 and ask' ELSE '' END AS body FROM documents)
SELECT doc_id, m AS match FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, {PHONE_SQL})) AS m FROM b) WHERE m NOT IN ('911', '086-555-0000')""")
def _(t):
    found = P.pattern_scan(noted(t), "doc_id", F.col("body"), [("phone", P.PHONE)])
    return found.where(~F.col("match").isin("911", "086-555-0000")).select("doc_id", "match")


@query("txt_pattern_scan", """
WITH m AS (SELECT DISTINCT doc_id, 'number' AS rule, unnest(regexp_extract_all(text, '[0-9]{3,}')) AS match FROM documents
  UNION SELECT DISTINCT doc_id, 'address', unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) FROM documents),
a AS (SELECT DISTINCT m.* FROM m JOIN labels l ON l.doc_id = m.doc_id WHERE quality = 1 AND rule = 'number'
  UNION SELECT DISTINCT doc_id, 'address', 'nobody@nowhere' FROM labels WHERE toxic = 1)
SELECT doc_id, rule, match, 'violation' AS verdict FROM (SELECT * FROM m EXCEPT SELECT * FROM a)
UNION ALL SELECT doc_id, rule, match, 'stale' FROM (SELECT * FROM a EXCEPT SELECT * FROM m)""")
def _(t):
    found = P.pattern_scan(t.documents, "doc_id", F.col("text"), [("number", "[0-9]{3,}"), ("address", "[a-z0-9.]+@[a-z0-9.]+")])
    good = t.labels.where(F.col("quality") == 1).select("doc_id").distinct()
    allow = found.where(F.col("rule") == "number").join(good, "doc_id", "left_semi").unionByName(
        t.labels.where(F.col("toxic") == 1).select("doc_id").distinct().select("doc_id", F.lit("address").alias("rule"), F.lit("nobody@nowhere").alias("match"))
    )
    return P.judge_scan(found, allow, "doc_id")


def feed(t: Tables):
    """documents as pages that state figures above, within and below the section for fees."""
    s = F.col("source")
    lines = F.array(
        F.when(s == "src1", "Intro costs 1,250.00 today"),
        F.lit("## History"),
        F.when(s == "src5", "Built for ₱ 900"),
        F.lit("## **Fees**  "),
        F.when(s.isin("src5", "src6"), "Copies are ₱50, PHP 70 by mail"),
        *[F.when(s == "src2", x) for x in ("~~~", "## Fake", "Php 10", "~~~")],
        F.when(s == "src3", "## Notes PHP 5").otherwise("## Notes"),
    )
    return t.documents.withColumn("body", F.concat_ws("\n", lines, F.col("text")))


FEE_SQL = "'₱\\s?[\\d,]+|\\bPHP\\s?[\\d,]+|\\bPhp\\s?[\\d,]+|\\b\\d{1,3}(?:,\\d{3})*\\.\\d{2}\\b'"


@query("txt_fee_scope", f"""
WITH p AS (SELECT doc_id, list_concat(list_filter([CASE source WHEN 'src1' THEN 'Intro costs 1,250.00 today' END, '## History', CASE source WHEN 'src5' THEN 'Built for ₱ 900' END, '## **Fees**  ',
    CASE WHEN source IN ('src5', 'src6') THEN 'Copies are ₱50, PHP 70 by mail' END, CASE source WHEN 'src2' THEN '~~~' END, CASE source WHEN 'src2' THEN '## Fake' END, CASE source WHEN 'src2' THEN 'Php 10' END,
    CASE source WHEN 'src2' THEN '~~~' END, CASE source WHEN 'src3' THEN '## Notes PHP 5' ELSE '## Notes' END], lambda x: x IS NOT NULL), string_split(text, chr(10))) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM p),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l),
h AS (SELECT *, last_value(CASE WHEN n % 2 = 0 AND regexp_matches(line, '^##\\s+\\S') THEN trim(regexp_replace(regexp_extract(line, '^##\\s+(.+?)\\s*$', 1), '[*_`]', '', 'g')) END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM f),
m AS (SELECT doc_id, section, unnest(regexp_extract_all(line, {FEE_SQL})) AS figure FROM h)
SELECT m.doc_id, section, figure, count(*) AS times, CASE WHEN l.doc_id IS NULL THEN 'untranscribed' ELSE 'outside' END AS problem
FROM m LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = m.doc_id WHERE l.doc_id IS NULL OR lower(section) IS DISTINCT FROM 'fees' GROUP BY ALL""")
def _(t):
    done = t.labels.where(F.col("quality") == 1).select("doc_id")
    return P.fee_scope(feed(t), "doc_id", "body", done, t.spark.createDataFrame([("Fees",)], "section string"))


EN_SQL = ", ".join(f"'{w}'" for w in P.ENGLISH)
FIL_SQL = ", ".join(f"'{w}'" for w in P.FILIPINO)


@query("txt_untranslated", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT doc_id, line_no, raw, regexp_extract_all(lower(raw), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM l WHERE length(trim(raw)) >= 60 AND NOT regexp_matches(raw, '^\\s'))
SELECT doc_id, line_no FROM w WHERE len([x FOR x IN ws IF x IN ({EN_SQL})]) >= 5 AND len([x FOR x IN ws IF x IN ({FIL_SQL})]) <= 1
 AND NOT regexp_matches(trim(raw), '^[-#>|]|^\\d{{1,2}}\\\\?[.)]|^[•·▪◦*]|```') AND NOT contains(raw, 'http')""")
def _(t):
    return P.untranslated_lines(t.documents, "doc_id", "text")


@query("txt_honorific", "SELECT doc_id FROM documents WHERE source = 'src4' OR regexp_matches(text, '\\b(?:Mr|Mrs|Ms|Miss|Dr|Atty|Engr|Hon|Sr|Jr)\\b\\.?\\s+[A-Z]')")
def _(t):
    return noted(t).where(F.col("body").rlike(P.HONORIFIC)).select("doc_id")


@query("txt_link_shape", "SELECT doc_id, '](../a/b.md#x)' AS match FROM documents WHERE source = 'src5'")
def _(t):
    return P.pattern_scan(noted(t), "doc_id", F.col("body"), [("md-link", P.MD_LINK)]).select("doc_id", "match")


@query("txt_no_schedule", """
SELECT DISTINCT doc_id FROM documents WHERE source IN ('src4', 'src5') OR regexp_matches(text, '(?i)\\b\\d{1,2}:\\d{2}\\s*(?:am|pm)?\\b|₱\\s*\\d|\\bevery\\s+\\d+\\s+(?:minutes?|hours?)\\b')""")
def _(t):
    return P.pattern_scan(noted(t), "doc_id", F.col("body"), [("schedule", p) for p in P.SCHEDULE]).select("doc_id").distinct()


def paged(t: Tables):
    """documents as markdown pages; some lack a heading, some carry a claim."""
    s = F.col("source")
    return t.documents.withColumn("page", F.concat(
        F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"),
        F.when(s.isin("src1", "src2"), "").otherwise("## Office hours\n"),
        F.when(s == "src3", "### The official document\n").otherwise("## The official document  \n"),
        F.when(s == "src4", "Not yet checked by a second person\n").when(s == "src5", "Verified by a second person\n").otherwise(""),
        F.col("text"),
    ))


@query("txt_required_sections", """
SELECT doc_id, 'hours' AS section FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT doc_id, 'document' FROM documents WHERE source = 'src3'""")
def _(t):
    return P.section_check(paged(t), "doc_id", F.col("page"), {
        "hours": r"(?m)^##\s*Office hours", "document": r"(?m)^##\s+(The official document|Ang opisyal na dokumento)\s*$"}, True)


@query("txt_forbidden_sections", "SELECT doc_id, 'second-person' AS section FROM documents WHERE source = 'src5'")
def _(t):
    return P.section_check(paged(t), "doc_id", F.col("page"), {
        "second-person": r"(?i)(?<!not yet )(?:checked|verified) by a second person",
        "block": "Also printed for this service"}, False)


def translated(t: Tables):
    """(pages, translations): a page sends people to a desk that the part table
    names; translations keep its name, drop it or name one more, and some lack the office or the opening words."""
    d, k = F.col("doc_id"), F.col("doc_id") % 64
    name = t.part.where(F.col("p_partkey") < 65).select(F.col("p_partkey").cast("long").alias("k"), "p_name")
    both = t.documents.withColumn("k", k).join(name, "k").join(name.select((F.col("k") - 1).alias("k"), F.col("p_name").alias("next")), "k")
    desk = F.when(d % 3 == 0, F.col("p_name")).when(d % 3 == 1, "ibang mesa").otherwise(F.concat("p_name", F.lit(" o "), "next"))
    page = F.concat(F.lit("Bring it to the "), "p_name", F.lit(" desk. "), "text")
    fil = F.concat(
        F.lit("Dalhin sa "), desk, F.lit(". "), F.when(d % 2 == 0, F.concat("source", F.lit(" "))).otherwise(""),
        F.when(d % 4 == 3, F.expr("substr(text, 31)")).otherwise(F.col("text")),
    )
    return both.select("doc_id", page.alias("body")), both.select("doc_id", "source", F.col("text").alias("title"), fil.alias("body"))


@query("txt_untranslated_terms", """
WITH n AS (SELECT p_partkey AS k, p_name FROM part WHERE p_partkey < 65), v AS (SELECT DISTINCT p_name FROM part),
b AS (SELECT doc_id, source, text, a.p_name, CASE doc_id % 3 WHEN 0 THEN a.p_name WHEN 1 THEN 'ibang mesa' ELSE a.p_name || ' o ' || b.p_name END AS desk
  FROM documents JOIN n a ON a.k = doc_id % 64 JOIN n b ON b.k = doc_id % 64 + 1),
p AS (SELECT doc_id, source, text, 'Bring it to the ' || p_name || ' desk. ' || text AS en,
  'Dalhin sa ' || desk || '. ' || CASE WHEN doc_id % 2 = 0 THEN source || ' ' ELSE '' END || CASE WHEN doc_id % 4 = 3 THEN substr(text, 31) ELSE text END AS fil FROM b),
w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(en, '[\\p{L}\\p{N}]+'), ' ') || ' ' AS en, ' ' || array_to_string(regexp_extract_all(fil, '[\\p{L}\\p{N}]+'), ' ') || ' ' AS fil FROM p),
h AS (SELECT doc_id, p_name AS term, contains(en, ' ' || p_name || ' ') AS e, contains(fil, ' ' || p_name || ' ') AS f FROM w, v),
o AS (SELECT doc_id, fil, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 24) AS opening, trim(regexp_replace(fil, '\\s+', ' ', 'g')) AS flat FROM p)
SELECT doc_id, 'lost' AS rule, term FROM h WHERE e AND NOT f UNION ALL SELECT doc_id, 'added', term FROM h WHERE f AND NOT e
UNION ALL SELECT doc_id, 'office', source FROM p WHERE NOT contains(fil, source)
UNION ALL SELECT doc_id, 'opening', opening FROM o WHERE trim(opening) <> '' AND NOT contains(fil, opening) AND NOT contains(flat, opening)""")
def _(t):
    pages, fil = translated(t)
    drifted = PH.translated_terms(pages, fil, "doc_id", "body", t.part.select(F.col("p_name").alias("term")), "term")
    asked = PH.required_terms(fil, "doc_id", "body", {"office": F.col("source"), "opening": F.col("title")})
    return drifted.select("doc_id", "rule", "term").unionByName(asked)


@query("txt_rendered_all", """
SELECT doc_id, k, length(item) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS item, generate_subscripts(string_split(text, chr(10)), 1) AS k, text AS page, source FROM documents)
WHERE source = 'src7' AND k > 1 AND regexp_matches(item, '[\\p{L}\\p{N}]') AND NOT contains(regexp_replace(lower(split_part(page, chr(10), 1)), '[^\\p{L}\\p{N}]+', '', 'g'), regexp_replace(lower(item), '[^\\p{L}\\p{N}]+', '', 'g'))""")
def _(t):
    # One source publishes only the first line of its records.
    page = F.when(F.col("source") == "src7", F.split_part("text", F.lit("\n"), F.lit(1))).otherwise(F.concat(F.lit("> "), "text"))
    records = t.documents.withColumn("items", F.split("text", "\n"))
    return P.unrendered_items(records, "doc_id", "items", page).select("doc_id", "k", F.length("item").alias("chars"))


@query("txt_internal_leak", """
WITH b AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS s FROM benchmark),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS s FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON length(b.s) > 24 AND contains(d.s, b.s)""")
def _(t):
    return P.leaked(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")


@query("txt_proper_names", """
WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+')) AS phrase FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+')) AS phrase FROM documents)
SELECT doc_id, phrase FROM d WHERE phrase IN (SELECT phrase FROM k WHERE NOT regexp_matches(phrase, 'The|Order'))""")
def _(t):
    return P.shared_phrases(t.benchmark, t.documents, "text", "doc_id", "[A-Z][a-z]+ [a-z]+", "The|Order")


@query("txt_language_vocabulary", """
SELECT DISTINCT doc_id, lower(m) AS match FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS m FROM documents) WHERE m IN ('warning', 'ring', 'storm', 'reat', 'that')""")
def _(t):
    found = P.pattern_scan(t.documents, "doc_id", F.lower("text"), [("warning", r"\b(?:warning|ring|storm|reat|that)\b")])
    return found.select("doc_id", "match")


@query("txt_vocab_rules", """
WITH v AS (SELECT p_partkey, p_name || CASE WHEN p_size > 30 THEN ' ' || p_type ELSE '' END AS title, p_name, p_type, p_size FROM part)
SELECT p_partkey, 'not-a-verb' AS rule, split_part(title, ' ', 1) AS token FROM v WHERE split_part(title, ' ', 1) NOT IN ('red', 'small', 'hot', 'cold')
UNION ALL SELECT p_partkey, 'forbidden-word', 'gear' FROM v WHERE p_name LIKE '% gear'
UNION ALL SELECT p_partkey, 'undeclared-acronym', p_type FROM v WHERE p_size > 30 AND p_type NOT IN ('PROMO', 'LARGE')
UNION ALL SELECT NULL, 'unused-acronym', 'MTOP'""")
def _(t):
    titles = t.part.withColumn("title", F.concat("p_name", F.when(F.col("p_size") > 30, F.concat(F.lit(" "), "p_type")).otherwise("")))
    return P.title_rules(titles, "p_partkey", "title", ["red", "small", "hot", "cold"], ["gear"], ["PROMO", "LARGE", "MTOP"])


@query("txt_list_numbers", """
WITH i AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' ELSE 'c' END AS k FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, unnest(CASE k WHEN 'a' THEN ['doubled-marker'] WHEN 'b' THEN ['no-information', 'fragment'] ELSE ['continues-above'] END) AS problem FROM i WHERE n <> 4""")
def _(t):
    n = (F.col("l_linenumber") % 9).cast("string")
    item = (
        F.when(F.col("l_linenumber") == 4, "4. Birth certificate")
        .when(F.col("l_returnflag") == "A", F.concat(n, F.lit(". "), n, F.lit(". Stub")))
        .when(F.col("l_returnflag") == "N", "•")
        .otherwise("with two witnesses")
    )
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
    return P.item_problems(t.lineitem.withColumn("item", item), keys, "item")


@query("set_array_except", """
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS a,
  list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\p{L}\\p{N}]+')) AS b FROM documents)
SELECT doc_id, len([x FOR x IN a IF NOT list_contains(b, x)]) AS missing FROM w""")
def _(t):
    return t.documents.select(
        "doc_id",
        F.size(F.array_except(T.tokens(F.col("text")), T.tokens(F.split_part("text", F.lit("\n"), F.lit(1))))).cast("long").alias("missing"),
    )


@query("set_distinct", "SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def _(t):
    return t.pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).distinct()


# ---------------------------------------------------------------- markdown


def markdown(t: Tables):
    """Every third line of a document a heading, some of them fenced."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.when(i % 5 == 3, F.lit("```")).when(i % 2 == 0, F.concat(F.lit("## **"), F.substring(l, 1, 3), F.lit("** [x](/y) "))).otherwise(l),
    )
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("body"))


MD = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
md AS (SELECT doc_id, i, CASE WHEN i % 5 = 3 THEN '```' WHEN i % 2 = 0 THEN '## **' || substr(l, 1, 3) || '** [x](/y) ' ELSE l END AS line FROM raw),
fe AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM md),
hd AS (SELECT doc_id, i AS pos, trim(regexp_replace(regexp_replace(regexp_extract(line, '^##\\s+(.+?)\\s*$', 1), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`]', '', 'g')) AS heading
  FROM fe WHERE f % 2 = 0 AND regexp_matches(line, '^##\\s+\\S'))"""


@query("win_outline", f"WITH {MD} SELECT doc_id, pos, heading FROM hd WHERE heading <> ''")
def _(t):
    return P.outline(markdown(t), "doc_id", "body")


@query("win_slug_dedupe", f"""WITH {MD},
b AS (SELECT doc_id, pos, regexp_replace(regexp_replace(lower(strip_accents(heading)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM hd WHERE heading <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS k FROM b WHERE base <> '')
SELECT doc_id, pos, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM n""")
def _(t):
    return P.heading_ids(P.outline(markdown(t), "doc_id", "body"), "doc_id").select("doc_id", "pos", "id")


# ---------------------------------------------------------------- sources and sinks


@query("src_manifest", """
SELECT 'services' AS section, lower(o_orderpriority) AS category, n - 1 AS pos, 'order-' || o_orderkey || '-' || n AS slug, o_orderstatus AS verification,
  strftime(o_orderdate, '%Y-%m-%d') AS checked, NULL AS error FROM orders, (VALUES (1), (2)) v(n) WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'services', lower(o_orderpriority), NULL, NULL, NULL, NULL, 'not a manifest: content/services/' || lower(o_orderpriority) || '/index.json'
FROM orders WHERE o_orderstatus = 'P'""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    entry = lambda n: F.struct(
        F.concat(F.lit("order-"), k, F.lit(f"-{n}")).alias("slug"), F.col("o_orderstatus").alias("verification"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("lastCheckedAt"), F.lit("dropped").alias("unknownField"),
    )
    text = F.to_json(F.struct(F.array(entry(1), entry(2)).alias("pages")))
    raw = t.orders.select(
        F.concat(F.lit("content/services/"), F.lower("o_orderpriority"), F.lit("/index.json")).alias("path"),
        F.when(F.col("o_orderstatus") == "P", F.lit("{not json")).otherwise(text).alias("text"),
    )
    return SRC.manifest_rows(raw, "text", "path").select("section", "category", "pos", "slug", "verification", F.col("lastCheckedAt").alias("checked"), "error")


def tree(t: Tables):
    return t.documents.select(F.when(F.col("lang") == "en", "services").otherwise("other").alias("section"), F.col("source").alias("category"), F.col("doc_id").alias("slug"))


@query("src_categories", "SELECT DISTINCT source AS category FROM documents WHERE lang = 'en'")
def _(t):
    return SRC.categories(tree(t), "services")


@query("src_section_tree", """
SELECT CASE WHEN lang = 'en' THEN 'services' ELSE 'other' END AS section, source AS category, doc_id AS slug,
  count(*) OVER (PARTITION BY lang = 'en', source) AS entries FROM documents""")
def _(t):
    return SRC.section_tree(tree(t)).select("section", "category", "slug", "entries")


@query("src_bodies", """
SELECT 'content/' || source || '/doc-' || doc_id || CASE WHEN lang <> 'en' THEN '.fil' ELSE '' END || '.md' AS path, 'doc-' || doc_id AS slug,
  CASE WHEN lang <> 'en' THEN 'fil' ELSE 'en' END AS locale, length(text) AS chars FROM documents""")
def _(t):
    name = F.concat(F.lit("content/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.when(F.col("lang") != "en", ".fil").otherwise(""), F.lit(".md"))
    return SRC.body_rows(t.documents.select(name.alias("path"), F.col("text").alias("body"))).select("path", "slug", "locale", F.length("body").alias("chars"))


@query("src_blobs", "SELECT url AS file, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages")
def _(t):
    return SRC.blob_rows(t.pages, "url", "html")


def sitemaps(t: Tables):
    """(index, children): one sitemap a language, the German one not listed."""
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1)
    children = t.pages.select(
        F.concat(F.lit("https://site/sitemap-"), lang, F.lit(".xml")).alias("sitemap"),
        F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url></urlset>")).alias("xml"),
    )
    index = t.documents.where(F.col("lang") != "de").select("lang").distinct().select(
        F.concat(F.lit("<sitemap><loc>https://site/sitemap-"), "lang", F.lit(".xml</loc></sitemap>")).alias("xml")
    )
    return index, children


@query("src_sitemap", "SELECT DISTINCT url FROM pages WHERE url NOT LIKE '%/de/%'")
def _(t):
    return P.sitemap_urls(*sitemaps(t))


def payloads(t: Tables):
    """Forecast payloads: whole, ragged, incomplete, or not a forecast at all."""
    at = lambda h: F.date_format(F.date_trunc("hour", F.col("ts")) + F.expr(f"INTERVAL {h} HOURS"), "yyyy-MM-dd'T'HH:mm")
    temp = lambda k: F.col("value").cast("decimal(10,2)") + k
    cond = F.floor(F.col("value")).cast("int") % 100
    hourly = F.struct(
        F.array(*[at(h) for h in range(5)]).alias("time"),
        F.when(F.col("event_type") == "click", F.array(temp(0), temp(1), F.lit(None).cast("decimal(11,2)"), temp(3)))
        .otherwise(F.array(*[temp(k) for k in range(5)])).alias("temperature_2m"),
        F.array(*[cond for _ in range(5)]).alias("weather_code"),
    )
    current = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), (-F.col("value")).cast("decimal(10,1)").alias("temperature_2m"),
        F.lit(80.5).alias("relative_humidity_2m"), F.lit(3.0).alias("wind_speed_10m"), cond.alias("weather_code"),
    )
    whole = F.struct(
        F.when(F.col("event_type") != "error", F.when(F.col("user_id") < 75, 28800).otherwise(-12600)).alias("utc_offset_seconds"),
        current.alias("current"), hourly.alias("hourly"), F.struct(F.array(F.lit(None).cast("double")).alias("precipitation_probability_max")).alias("daily"),
    )
    text = F.when(F.col("event_type") == "signup", F.col("props")).when(F.col("event_type") == "purchase", F.lit("oops {")).otherwise(F.to_json(whole, {"ignoreNullFields": "false"}))
    return t.events.select("event_id", text.alias("payload"))


@query("src_forecast", """
SELECT event_id, event_type IN ('view', 'click') AS usable,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(CAST(CAST(-value AS DECIMAL(10,1)) AS DOUBLE) + 0.5) AS BIGINT) END AS temperature,
  CASE WHEN event_type IN ('view', 'click') THEN 81 END AS humidity FROM events""")
def _(t):
    from civicloom.functions.dates import round_half_up

    parsed = payloads(t).select("event_id", F.explode(F.array(SRC.forecast(F.col("payload")))).alias("f"))
    return parsed.select(
        "event_id", F.col("f").isNotNull().alias("usable"), round_half_up(F.col("f.current.temperature_2m")).alias("temperature"),
        round_half_up(F.col("f.current.relative_humidity_2m")).alias("humidity"),
    )


@query("win_next_hours", """
WITH e AS (SELECT event_id, event_type, user_id, CAST(value AS DECIMAL(10,2)) AS v, CAST(floor(value) AS INTEGER) % 100 AS code, date_trunc('hour', ts) AS h, ts FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT *, unnest(range(5)) AS k FROM e),
o AS (SELECT event_id, k, code, user_id, strftime(h + to_hours(CAST(k AS INTEGER)), '%Y-%m-%dT%H:%M') AS at_, CAST(floor(CAST(v + k AS DOUBLE) + 0.5) AS BIGINT) AS temperature FROM r
  WHERE strftime(h + to_hours(CAST(k AS INTEGER)), '%Y-%m-%dT%H:%M') > strftime(ts, '%Y-%m-%dT%H:%M') AND NOT (event_type = 'click' AND k IN (2, 4))),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS i FROM o)
SELECT event_id, i, at_ || CASE WHEN user_id < 75 THEN '+08:00' ELSE '-03:30' END AS at_time, temperature,
  CASE WHEN code IN (0,1,2,3,45,48,51,53,55,56,57,61,63,65,66,67,71,73,75,77,80,81,82,85,86,95,96,99) THEN true ELSE false END AS known_code FROM n WHERE i < 3""")
def _(t):
    parsed = payloads(t).select("event_id", F.explode(F.array(SRC.forecast(F.col("payload")))).alias("f")).where(F.col("f").isNotNull())
    return parsed.select("event_id", F.posexplode(SRC.outlook(F.col("f"))).alias("i", "r")).select(
        "event_id", "i", F.col("r.at").alias("at_time"), "r.temperature", (F.col("r.condition") != "unknown").alias("known_code")
    )


@query("src_counter", """
SELECT event_id, CASE event_type WHEN 'view' THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) WHEN 'click' THEN 12 END AS total FROM events""")
def _(t):
    k = F.regexp_extract("props", "[0-9]+", 0)
    stored = (
        F.when(F.col("event_type") == "view", k).when(F.col("event_type") == "click", F.lit(" 12 "))
        .when(F.col("event_type") == "error", F.concat(F.lit("-"), k)).when(F.col("event_type") == "signup", F.lit("1.5"))
    )
    return t.events.select("event_id", SRC.counter(stored).alias("total"))


@query("snk_inventory", f"""
SELECT count(*) AS row_count, count(*) FILTER (WHERE kind = 'charter') AS charter, count(*) FILTER (WHERE kind = 'announcement') AS announcements, count(*) AS stored FROM (SELECT {CLASS} AS kind FROM pages)""")
def _(t):
    # The whole table takes the place of a part of it; a run that is repeated changes nothing.
    path, now = f"{checkpoint_folder(t.spark)}/inventory-{uuid.uuid4().hex}", classed(t)
    measures = {"charter": F.count_if(F.col("kind") == "charter"), "announcements": F.count_if(F.col("kind") == "announcement")}
    SNK.write_inventory(now.where(F.col("kind") == "charter"), path, "first", measures)
    for _ in range(2):
        head = SNK.write_inventory(now, path, "second", measures)
    return head.withColumn("stored", commits.load(t.spark, path, now.schema).agg(F.count(F.lit(1))).scalar())


@query("snk_sitemap", """
SELECT 'https://portal/' || l || '/' || source || '/' || doc_id AS url, lang AS last_modified, 'https://portal/en/' || source || '/' || doc_id AS en,
  'https://portal/fil/' || source || '/' || doc_id AS fil FROM documents, (VALUES ('en'), ('fil')) v(l) WHERE source <> 'src0'""")
def _(t):
    pages = t.documents.where(F.col("source") != "src0").withColumn("path", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")))
    out = SRC.site_map(pages, "https://portal", "path", "lang", ["en", "fil"])
    return out.select("url", "last_modified", F.col("alternates")["en"].alias("en"), F.col("alternates")["fil"].alias("fil"))
