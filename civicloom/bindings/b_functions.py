"""The column expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicloom.bindings import b_freshness as BF
from civicloom.bindings.registry import query
from civicloom.functions import dates
from civicloom.functions import text as T
from civicloom.functions import urls
from civicloom.operators import corpus as C
from civicloom.operators import records as RC

SQUASH = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')"
KEBAB = "regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("fn_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("fn_fold_char", "SELECT doc_id, length(text) AS chars, md5(lower(strip_accents(text))) AS folded FROM documents")
def _(t):
    f = t.documents.select("doc_id", F.explode(F.array(T.fold_chars(F.col("text")))).alias("f"))
    return f.select("doc_id", F.length("f").alias("chars"), F.md5("f").alias("folded"))


@query("fn_tokens", """
SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)""")
def _(t):
    w = t.documents.select("doc_id", F.explode(F.array(T.tokens(F.col("text")))).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("fn_squash", f"SELECT doc_id, md5({SQUASH}) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.squash(F.col("text"))).alias("digest"))


@query("fn_slugify", f"""
WITH x AS (SELECT doc_id, split_part(text, chr(10), 1) || ' Don’t.pdf' AS s FROM documents)
SELECT doc_id, {KEBAB.format(x="lower(strip_accents(s))")} AS slug, {KEBAB.format(x="lower(regexp_replace(s, '(?i)[.]pdf$', ''))")} AS stem,
  {KEBAB.format(x="regexp_replace(lower(s), '[’'']', '', 'g')")} AS title_slug FROM x""")
def _(t):
    s = F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" Don’t.pdf"))
    return t.documents.select("doc_id", T.slugify(s).alias("slug"), T.stem(s).alias("stem"), T.title_slug(s).alias("title_slug"))


@query("fn_tidy", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.tidy(F.col("text"))).alias("digest"))


@query("fn_fees", """
WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, 'pay ₱ ' || CAST(l_quantity AS INTEGER) || ',000 or Php' || l_suppkey || '.5; 7.25 total ' || l_linenumber AS s FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, array_to_string(regexp_extract_all(s, '(?i)(?:₱|P(?:hp?)?\\.?)\\s?\\d[\\d,]*(?:\\.\\d{1,2})?|\\b\\d[\\d,]*\\.\\d{2}\\b'), '|') AS fees FROM x""")
def _(t):
    s = F.format_string("pay ₱ %d,000 or Php%d.5; 7.25 total %d", F.col("l_quantity").cast("int"), "l_suppkey", "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.array_join(T.fees(s), "|").alias("fees"))


@query("fn_durations", """
SELECT event_id, CASE event_type WHEN 'view' THEN user_id || ' working days' WHEN 'click' THEN user_id || ' Minutes|' || user_id || '.5 hrs' WHEN 'error' THEN user_id || ' days' ELSE '' END AS durations FROM events""")
def _(t):
    u = F.col("user_id").cast("string")
    s = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("within "), u, F.lit(" working days.")))
        .when(F.col("event_type") == "click", F.concat(u, F.lit(" Minutes to "), u, F.lit(".5 hrs")))
        .when(F.col("event_type") == "error", F.concat(u, F.lit(" days a week")))
        .otherwise(F.concat(u, F.lit(" documents")))
    )
    return t.events.select("event_id", F.array_join(T.durations(s), "|").alias("durations"))


@query("fn_inline_field", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'All ' || o_custkey WHEN 'O' THEN 'Client  ' || o_custkey ELSE 'next line' END AS value FROM orders""")
def _(t):
    c = F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("Charter\n"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("  WHO MAY  AVAIL?  All "), c, F.lit(" ")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Who may avail    Client  "), c)).otherwise("Who may avail:"),
        F.lit("\nnext line"),
    )
    return t.orders.select("o_orderkey", T.inline_field(text, "Who may avail").alias("value"))


@query("fn_presence", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'present' ELSE 'absent' END AS eligibility FROM orders")
def _(t):
    value = F.when(F.col("o_orderstatus") == "F", "All").when(F.col("o_orderstatus") == "O", "")
    return t.orders.select("o_orderkey", RC.presence(value).alias("eligibility"))


@query("fn_list_marker", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'sub' WHEN 'click' THEN 'number' WHEN 'error' THEN 'bullet' WHEN 'signup' THEN 'dash' ELSE 'none' END AS kind,
  CASE event_type WHEN 'view' THEN (user_id % 90) || '.1' WHEN 'click' THEN CAST(user_id % 90 AS VARCHAR) WHEN 'error' THEN '•' WHEN 'signup' THEN '-' END AS marker,
  CASE event_type WHEN 'purchase' THEN '**You:** ' || user_id ELSE 'Item ' || user_id END AS text FROM events""")
def _(t):
    n, u = (F.col("user_id") % 90).cast("string"), F.col("user_id").cast("string")
    k = F.col("event_type")
    s = (
        F.when(k == "view", F.concat(n, F.lit(".1 Item "), u)).when(k == "click", F.concat(n, F.lit(".Item "), u))
        .when(k == "error", F.concat(F.lit("•Item "), u)).when(k == "signup", F.concat(F.lit(" – Item "), u))
        .otherwise(F.concat(F.lit("**You:** "), u))
    )
    return t.events.select("event_id", F.explode(F.array(T.list_marker(s))).alias("m")).select("event_id", "m.kind", "m.marker", "m.text")


@query("fn_escape_cell", "SELECT doc_id, md5(trim(regexp_replace(replace(source || '|' || text, '|', '\\|'), '\\n+', ' ', 'g'))) AS cell FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.escape_cell(F.concat_ws("|", "source", "text"))).alias("cell"))


@query("fn_entities", """
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&amp;', '&', 'gi')
  || ' & < > ’ é &bogus; " &#99999999999; &#55296;') AS decoded FROM documents""")
def _(t):
    s = F.concat("text", F.lit(" &amp; &LT; &gt; &#8217; &#233; &bogus; &quot; &#99999999999; &#55296;"))
    return t.documents.select("doc_id", F.md5(T.decode_entities(s)).alias("decoded"))


@query("fn_tel", "SELECT c_custkey, 'tel:' || CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS href FROM customer")
def _(t):
    digits = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    s = F.concat(F.when(F.col("c_acctbal") >= 0, " +").otherwise(" "), F.substring(digits, 1, 3), F.lit("-("), F.substring(digits, 4, 4), F.lit(") "))
    return t.customer.select("c_custkey", T.tel(s).alias("href"))


@query("fn_decode_param", "SELECT doc_id, md5(split_part(text, chr(10), 1) || '+100') AS decoded FROM documents WHERE NOT contains(split_part(text, chr(10), 1), '%')")
def _(t):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    # Encoded twice; a plus sign in a path is a plus sign.
    coded = F.replace(F.replace(F.url_encode(F.concat(first, F.lit("+100"))), F.lit("+"), F.lit("%20")), F.lit("%"), F.lit("%25"))
    return t.documents.where(~first.contains("%")).select("doc_id", F.md5(urls.decode_param(coded)).alias("decoded"))


@query("fn_malformed_url", "SELECT page_id, url LIKE '%?%' AS malformed FROM pages")
def _(t):
    s = F.when(F.col("url").contains("?"), F.concat("url", F.lit("%E0%A4"))).otherwise(F.concat("url", F.lit("%20")))
    return t.pages.select("page_id", urls.is_malformed(s).alias("malformed"))


@query("fn_strict_date", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(t):
    s = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.year("o_orderdate").cast("string"), F.lit("-02-30")))
        .otherwise(F.date_format("o_orderdate", "yyyy-M-d'T'HH:mm"))
    )
    return t.orders.select("o_orderkey", dates.strict_date(s).cast("string").alias("day"))


@query("fn_days_between", f"SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '{BF.AS_OF}') AS age FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.days_between(F.to_date("o_orderdate"), BF.as_of()).cast("long").alias("age"))


@query("fn_freshness", f"""
WITH a AS (SELECT o_orderkey, o_orderstatus, date_diff('day', CAST(o_orderdate AS DATE), DATE '{BF.AS_OF}') AS age, CAST(o_custkey AS INTEGER) AS c FROM orders)
SELECT o_orderkey, CASE WHEN age < 0 THEN 'undated' WHEN o_orderstatus = 'P' OR age > c THEN 'stale' WHEN age * 10 > c * 9 THEN 'due' ELSE 'fresh' END AS state FROM a""")
def _(t):
    state = dates.freshness(F.to_date("o_orderdate"), BF.as_of(), F.col("o_custkey"), F.col("o_orderstatus") == "P")
    return t.orders.select("o_orderkey", state.alias("state"))


@query("fn_qualify_instant", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') || CASE WHEN user_id < 75 THEN '+05:45' ELSE '-03:30' END AS instant FROM events""")
def _(t):
    naive = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    return t.events.select("event_id", dates.qualify_instant(naive, F.when(F.col("user_id") < 75, 20700).otherwise(-12600)).alias("instant"))


@query("fn_round", "SELECT c_custkey, CAST(floor(c_acctbal * 2 + 0.5) AS BIGINT) AS a, CAST(floor(floor(c_acctbal) / 2 + 0.5) AS BIGINT) AS b FROM customer")
def _(t):
    return t.customer.select(
        "c_custkey", dates.round_half_up(F.col("c_acctbal") * 2).alias("a"), dates.round_half_up(F.floor("c_acctbal") / 2).alias("b")
    )


@query("fn_code_label", """
SELECT p_partkey, CASE p_size WHEN 1 THEN 'mainlyClear' WHEN 2 THEN 'partlyCloudy' WHEN 3 THEN 'overcast' WHEN 45 THEN 'fog' WHEN 48 THEN 'freezingFog' ELSE 'unknown' END AS condition FROM part""")
def _(t):
    # Sizes end at 50, below the drizzle codes.
    labels = {k: v for k, v in dates.CONDITIONS.items() if k <= 50}
    return t.part.select("p_partkey", dates.code_label(F.col("p_size"), labels).alias("condition"))


@query("fn_locale_check", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS locale FROM documents")
def _(t):
    return t.documents.select("doc_id", urls.locale_or_default(F.col("lang"), ["en", "fr"], "en").alias("locale"))


@query("fn_null_paths", """
SELECT 'lgu.' || c_custkey || '.contact.phone' AS path FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'lgu.' || c_custkey || '.segment' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def _(t):
    facts = t.customer.select(
        "c_custkey",
        F.struct(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("phone")).alias("contact"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
        F.array().cast("array<string>").alias("hotlines"),
    )
    return C.null_paths(facts, "lgu", "c_custkey")


@query("fn_flatten", """
SELECT 'site.' || c_custkey || '.contact.name' AS path, c_name AS value FROM customer UNION ALL SELECT 'site.' || c_custkey || '.segment', c_mktsegment FROM customer""")
def _(t):
    tree = t.customer.select("c_custkey", F.struct(F.col("c_name").alias("name")).alias("contact"), F.col("c_mktsegment").alias("segment"))
    return C.flatten(tree, "site", "c_custkey").select("path", "value")


@query("fn_first_nonnull_meta", """
SELECT page_id, list_last(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', ''), '/')) AS slug FROM pages""")
def _(t):
    return t.pages.select("page_id", urls.last_segment(F.col("url")).alias("slug"))
