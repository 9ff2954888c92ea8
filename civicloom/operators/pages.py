"""Raw web pages and published text: articles, links, changes, scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.functions import text as T
from civicloom.functions import urls
from civicloom.operators import reconcile as R
from civicloom.operators.skew import Measure, lookup_join, ordinal, prefix_scan, settle

# Patterns of the published corpus.
NON_CONTENT = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1>"
ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article>"
TITLE = r"(?i)<title>([^<]*)</title>"
ANCHOR = r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
NAME_IN_URL = r"(?:^|-)(?:hon|mayor|congressman|gov|sen|cong|atty|engr)-|(?:^|-)[a-z](?:-|$)"
PHONE = r"\b(?:\+63|0)\d{2}[-\s]?\d{3}[-\s]?\d{4}\b|\b\d{3}-\d{3}-\d{4}\b|\(\d{2,4}\)\s?\d{3}[-\s]?\d{4}"
HONORIFIC = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Atty|Engr|Hon|Sr|Jr)\b\.?\s+[A-Z]"
MD_LINK = r"\]\([^)]*\.md(?:#[^)]*)?\)"
SCHEDULE = [r"(?i)\b\d{1,2}:\d{2}\s*(?:am|pm)?\b", r"₱\s*\d", r"(?i)\bevery\s+\d+\s+(?:minutes?|hours?)\b"]
FRAMINGS = [
    ("refusal", r"(?i)\brefus(?:ed|es|al|ing)\s+to\b"),
    ("refusal", r"(?i)\bdeclin(?:ed|es|ing)\s+to\s+(?:answer|provide|disclose|say)"),
    ("concealment", r"(?i)\bconceal(?:s|ed|ing|ment)?\b"),
    ("concealment", r"(?i)\bcover[-\s]?up\b"),
    ("concealment", r"(?i)\bwithh(?:eld|olding)\b(?!\s+tax)"),
    ("concealment", r"(?i)\bhiding\s+(?:it|the|this|these)\b"),
    ("transparency", r"(?i)\black(?:s|ing)?\s+of\s+transparency\b"),
    ("transparency", r"(?i)\bnot\s+transparent\b"),
    ("transparency", r"(?i)\bstonewall"),
]
ENGLISH = "the is are was were of and that which with from this these does not for it".split()
FILIPINO = "ang ng sa ay mga hindi para ito kung nang nito iyon bawat walang".split()
NOT_PROSE = r"^[-#>|]|^\d{1,2}\\?[.)]|^[•·▪◦*]|```"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- one page


def article_text(html: Column) -> Column:
    """Visible text of the first article, scripts and the like removed; a page
    without an article has the empty text."""
    body = F.regexp_extract(F.regexp_replace(html, NON_CONTENT, ""), ARTICLE, 1)
    return T.tidy(T.decode_entities(F.regexp_replace(body, r"<[^>]+>", " ")))


def published_title(html: Column, suffix: str) -> Column:
    """Page title without the site's suffix (a pattern); null without a title."""
    found = F.when(html.rlike(TITLE), F.regexp_extract(html, TITLE, 1))
    return F.trim(F.regexp_replace(T.decode_entities(found), suffix, ""))


def content_checksum(html: Column) -> Column:
    return F.sha2(article_text(html), 256)


def links(pages: DataFrame, page: str, html: str, pattern: str = r"(?i)\.pdf$") -> DataFrame:
    """page, url, title: links whose address matches `pattern`, with the first
    non-empty text they are published under; an address that only occurs
    outside an anchor has no title."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1))
    inner = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(2))
    anchors = F.zip_with(hrefs, inner, lambda h, i: F.struct(h.alias("url"), i.alias("inner")))
    bare = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(r"https?://[^\"'\s<>]+"), F.lit(0)),
        lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("inner")),
    )
    found = pages.select(page, F.posexplode(F.concat(anchors, bare)).alias("pos", "l")).select(
        page, "pos", T.decode_entities(F.col("l.url")).alias("url"), F.col("l.inner").alias("inner")
    )
    text = T.tidy(T.decode_entities(F.regexp_replace("inner", r"<[^>]+>", "")))
    texted = found.where(F.col("url").rlike(pattern)).withColumn("text", F.nullif(text, F.lit("")))
    return texted.groupBy(page, "url").agg(
        F.min_by("text", F.struct(F.col("text").isNull().alias("n"), F.col("pos").alias("p"))).alias("title")
    )


def title_source(title: Column, file: Column) -> Column:
    """STRUCT<title, source>: the published text, else one derived from the file name."""
    derived = F.replace(F.regexp_replace(file, r"(?i)\.pdf$", ""), F.lit("-"), F.lit(" "))
    return F.struct(
        F.coalesce(title, derived).alias("title"),
        F.when(title.isNotNull(), "published-link-text").otherwise("derived-from-filename").alias("source"),
    )


def union_links(found: DataFrame, page: str) -> DataFrame:
    """Every (url, page) with the url's title from the first page that gives
    one. A url linked from everywhere stays one row per page."""
    first = found.where(F.col("title").isNotNull()).groupBy("url").agg(F.min_by("title", page).alias("_t"))
    return lookup_join(found.select("url", page), first, ["url"]).select("url", page, F.col("_t").alias("title"))


# ---------------------------------------------------------------- page sets


def sitemap_urls(index: DataFrame, children: DataFrame) -> DataFrame:
    """Distinct page addresses of the child sitemaps an index names.
    index(xml); children(sitemap, xml)."""
    loc = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"<loc>([^<]+)</loc>"), F.lit(1)), lambda x: F.trim(x))
    named = index.select(F.explode(loc(F.col("xml"))).alias("sitemap")).distinct()
    return lookup_join(children, named, ["sitemap"], "left_semi").select(F.explode(loc(F.col("xml"))).alias("url")).distinct()


def classify(url: Column, charter: str, office: str, legislative: str, reference_paths: Sequence[str], under: str) -> Column:
    """charter / legislative / office / reference / announcement."""
    path = urls.path_of(url)
    return (
        F.when(url.rlike(charter), "charter")
        .when(url.rlike(office) & url.rlike(legislative), "legislative")
        .when(url.rlike(office), "office")
        .when(path.isin(*reference_paths) | path.startswith(under), "reference")
        .otherwise("announcement")
    )


def names_a_person(url: Column) -> Column:
    """Whether the last path segment looks as if it carried a person's name."""
    return F.coalesce(urls.last_segment(url).rlike(NAME_IN_URL), F.lit(False))


def robots_rules(lines: DataFrame) -> DataFrame:
    """host, rules: disallowed prefixes of the `*` group. lines(host, pos, line).
    A robots file is limited in size by its standard, so a host's rules fit."""
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    field = F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1))))
    value = F.trim(F.regexp_replace(line, "^[^:]*:?", ""))
    parsed = lines.withColumn("_f", field).withColumn("_v", value)
    agent = F.when(F.col("_f") == "user-agent", F.col("_v"))
    filled = prefix_scan(parsed, ["host"], ["pos"], F.floor(F.col("pos") / 4096), [Measure("_agent", "last", agent)])
    kept = filled.where((F.col("_agent") == "*") & (F.col("_f") == "disallow") & (F.col("_v") != ""))
    return kept.groupBy("host").agg(F.array_sort(F.collect_set("_v")).alias("rules"))


def robots_verdict(pages: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """pages with `rule`: the first prefix that forbids the address, or null."""
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)
    out = lookup_join(pages.withColumn("host", host), rules, ["host"])
    hit = F.filter("rules", lambda r: F.startswith(urls.path_of(F.col(url)), r))
    return out.withColumn("rule", F.try_element_at(hit, F.lit(1))).drop("rules")


def changes(prev: DataFrame, curr: DataFrame, key: str, html: str) -> DataFrame:
    """key, state: new / gone / changed / same, by checksum of the published text."""
    a = prev.select(key, content_checksum(F.col(html)).alias("p"), F.lit(None).cast("string").alias("c"))
    b = curr.select(key, F.lit(None).cast("string").alias("p"), content_checksum(F.col(html)).alias("c"))
    both = a.unionByName(b).groupBy(key).agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return both.select(
        key,
        F.when(F.col("p").isNull(), "new")
        .when(F.col("c").isNull(), "gone")
        .when(F.col("p") != F.col("c"), "changed")
        .otherwise("same")
        .alias("state"),
    )


def link_problems(pages: DataFrame, page: str, locale: str, hrefs: Column, known: DataFrame, locales: Sequence[str]) -> DataFrame:
    """page, href, problem: no-locale / crossed-locale / missing. known(path)."""
    found = pages.select(page, F.col(locale).alias("_l"), F.explode(F.array_distinct(hrefs)).alias("href"))
    prefix = F.regexp_extract("href", f"^/({'|'.join(locales)})/", 1)
    target = known.select(F.col("path").alias("href"), F.lit(True).alias("_known")).distinct()
    j = lookup_join(found, target, ["href"]).withColumn("_p", prefix)
    problems = F.filter(
        F.array(
            F.when(F.col("_p") == "", "no-locale"),
            F.when((F.col("_p") != "") & (F.col("_p") != F.col("_l")), "crossed-locale"),
            F.when(F.col("_known").isNull(), "missing"),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(page, "href", F.explode(problems).alias("problem"))


def cited_urls(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Distinct addresses in a text, closing punctuation trimmed."""
    raw = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    return df.select(raw.alias("url")).select(F.regexp_replace("url", r"[),.]+$", "").alias("url")).distinct()


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "#.*$", "")


def frontier(found: DataFrame, seen: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """url, rule, state of every address found, once, fragments aside: `fetch`, `forbidden` (rule: the
    prefix that says so) or `seen`. An address that robots forbid is that, seen or not.

    Each side is one row per address before they meet, so no address weighs more than another."""
    addresses = found.select(without_fragment(F.col(url)).alias(url)).where(F.coalesce(F.col(url) != "", F.lit(False))).distinct()
    known = seen.select(without_fragment(F.col(url)).alias(url), F.lit(True).alias("_seen")).distinct()
    judged = robots_verdict(addresses, url, rules).select(url, "rule").join(known, url, "left")
    state = F.when(F.col("rule").isNotNull(), "forbidden").when(F.col("_seen").isNotNull(), "seen").otherwise("fetch")
    return judged.select(url, "rule", state.alias("state"))


# ---------------------------------------------------------------- scans


def pattern_scan(docs: DataFrame, path: str, text: Column, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """path, rule, match: distinct matches per document and rule. All rules are
    tried in one pass over the text."""
    cells = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"),
            )
            for rule, pattern in rules
        ]
    )
    return (
        docs.select(path, F.inline(cells))
        .select(path, "rule", F.explode("m").alias("match"))
        .distinct()
    )


def judge_scan(found: DataFrame, allow: DataFrame, path: str) -> DataFrame:
    """path, rule, match, verdict: `violation` for a match nobody allowed, `stale`
    for an allow entry that no longer fires."""
    keys = [path, "rule", "match"]
    n = R.key_counts(found, allow, keys)
    verdict = F.when(F.col("in_right") == 0, "violation").when(F.col("in_left") == 0, "stale")
    return n.withColumn("verdict", verdict).where(F.col("verdict").isNotNull()).select(*keys, "verdict")


def untranslated_lines(docs: DataFrame, path: str, text: str, source: Sequence[str] = ENGLISH, target: Sequence[str] = FILIPINO) -> DataFrame:
    """path, line_no: prose lines of at least 60 characters with five or more
    source-language stop words and at most one of the target language."""

    def count(line, words):
        return F.regexp_count(line, F.lit(rf"(?i)\b({'|'.join(words)})\b"))

    def suspicious(raw):
        return _let(
            F.trim(raw),
            lambda line: (F.length(line) >= 60)
            & ~raw.rlike(r"^\s")
            & ~line.rlike(NOT_PROSE)
            & ~line.contains("http")
            & (count(line, source) >= 5)
            & (count(line, target) <= 1),
        )

    return docs.select(path, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).where(
        suspicious(F.col("raw"))
    ).select(path, "line_no")


def section_check(docs: DataFrame, path: str, text: Column, headings: dict[str, str], required: bool) -> DataFrame:
    """path, section: required sections a page lacks, or forbidden ones it has.
    headings: section -> pattern."""
    cells = F.array(
        *[F.when(text.rlike(p) != F.lit(required), F.lit(name)) for name, p in headings.items()]
    )
    return docs.select(path, F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("section"))


def title_rules(
    titles: DataFrame, key: str, title: str, verbs: Sequence[str], forbidden: Sequence[str], acronyms: Sequence[str]
) -> DataFrame:
    """key, rule, token: titles that open with no permitted verb, use a forbidden
    word or an undeclared acronym; and, with a null key, declared acronyms that
    no title uses."""
    col = F.col(title)
    first = F.split_part(col, F.lit(" "), F.lit(1))
    used = F.array_distinct(F.regexp_extract_all(col, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)))

    def cell(rule, token):
        return F.struct(F.lit(rule).alias("rule"), token.alias("token"))

    found = [F.when(~first.isin(*verbs), cell("not-a-verb", first))]
    found += [F.when(col.rlike(rf"(?i)\b{w}\b"), cell("forbidden-word", F.lit(w))) for w in forbidden]
    undeclared = F.transform(
        F.filter(used, lambda a: ~a.isin(*acronyms)), lambda a: cell("undeclared-acronym", a)
    )
    broken = titles.select(
        key, F.inline(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), undeclared))
    )
    # The declared list is fixed, so whether each is used is one aggregate row.
    flags = titles.agg(*[F.max(F.array_contains(used, a)).alias(a) for a in acronyms])
    unused = flags.unpivot([], list(acronyms), "token", "used").where(~F.coalesce("used", F.lit(False)))
    key_type = titles.schema[key].dataType
    return broken.unionByName(
        unused.select(F.lit(None).cast(key_type).alias(key), F.lit("unused-acronym").alias("rule"), "token")
    )


def item_problems(items: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """keys, problem: doubled marker, no letter or digit, too short, opening in
    lower case."""
    col = F.trim(F.col(item))
    cells = F.array(
        F.when(col.rlike(r"^\s*(\d{1,2})\s*\.\s*\1\s*\."), "doubled-marker"),
        F.when(~col.rlike(r"[\p{L}\p{N}]"), "no-information"),
        F.when((F.length(col) < 5) | col.rlike(r"^[•\-–—*]+$"), "fragment"),
        F.when(col.rlike(r"^[a-z(]"), "continues-above"),
    )
    return items.select(*keys, F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("problem"))


def unrendered_items(records: DataFrame, key: str, items: str, page: Column) -> DataFrame:
    """key, k, item: items (an array of texts, k from 1) that the record's page doesn't show, both
    sides without punctuation, space and case. An item without a letter or digit says nothing and is not asked for."""
    flat = records.select(key, T.squash(page).alias("_flat"), F.col(items).alias("_items"))
    lost = F.filter(
        F.transform("_items", lambda x, i: F.struct((i + 1).alias("k"), x.alias("item"))),
        lambda x: (T.squash(x["item"]) != "") & ~F.coalesce(F.col("_flat").contains(T.squash(x["item"])), F.lit(False)),
    )
    return flat.select(key, F.inline(lost))


def shared_phrases(a: DataFrame, b: DataFrame, text: str, path: str, pattern: str, common: str) -> DataFrame:
    """path, phrase: phrases of corpus `a` (by pattern, without those holding a
    common word) that also occur in a document of `b`."""
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    known = a.select(F.explode(words).alias("phrase")).where(~F.col("phrase").rlike(common)).distinct()
    return lookup_join(b.select(path, F.explode(words).alias("phrase")), known, ["phrase"], "left_semi")


# ---------------------------------------------------------------- containment of long strings

#: Characters of a block. A string of 2 * BLOCK - 1 characters holds a whole block wherever a text's blocks begin.
BLOCK = 13
LONG = 24


def _blocks(text: Column) -> Column:
    """Hashes of the blocks of a text, one after the other; what is left at its end is none."""
    return F.transform(F.regexp_extract_all(text, F.lit(f".{{{BLOCK}}}"), F.lit(0)), lambda b: F.xxhash64(b))


def leaked(titles: DataFrame, title_id: str, title: str, docs: DataFrame, path: str, text: str) -> DataFrame:
    """title_id, path: titles of more than 24 letters and digits that a document
    contains, both squashed.

    A document is cut into blocks; where it contains a title, the title's own blocks from one of its first
    BLOCK characters on are among them. Of each such row of blocks the one that fewest documents have is looked up.
    Only (path, block) is shuffled at first, and a block that many documents share is split by its measured size.
    Texts are fetched for the documents left, and tested whole."""
    t = titles.select(title_id, T.squash(F.col(title)).alias("_t")).where(F.length("_t") > LONG)
    d = docs.select(path, T.squash(F.col(text)).alias("_d"))
    rows = F.array(*[F.struct(F.lit(i).alias("_row"), _blocks(F.substring("_t", i + 1, F.length("_t"))).alias("_all")) for i in range(BLOCK)])
    own = t.select(title_id, F.xxhash64("_t").alias("_same"), F.inline(rows)).select(title_id, "_same", "_row", F.explode("_all").alias("_f"))
    own = settle(own)
    hits = d.where(F.length("_d") > LONG).select(path, F.explode(F.array_distinct(_blocks(F.col("_d")))).alias("_f"))
    hits = settle(lookup_join(hits, own.select("_f").distinct(), ["_f"], "left_semi"))
    known = lookup_join(own, hits.groupBy("_f").agg(F.count(F.lit(1)).alias("_n")), ["_f"], "left")
    # a row with a block that no document has is in none
    rarest = known.groupBy(title_id, "_same", "_row").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_f")).alias("_least"))
    key = rarest.where(F.col("_least.n") > 0).select(title_id, F.col("_least._f").alias("_f")).distinct()
    pairs = settle(lookup_join(hits, key, ["_f"], "inner").select(path, title_id).distinct())
    asked = lookup_join(d, pairs.select(path).distinct(), [path], "left_semi")
    tried = lookup_join(pairs, t, [title_id], "inner")
    return tried.join(asked, path).where(F.col("_d").contains(F.col("_t"))).select(title_id, path)


# ---------------------------------------------------------------- markdown


#: Lines of a document that are scanned in one piece.
LINES = 4096


def heading_text(line: Column) -> Column:
    """The text of a `##` heading, inline markup stripped; empty for other lines."""
    raw = F.regexp_extract(line, r"^##\s+(.+?)\s*$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"[*_`]", ""))


def unfenced(lines: DataFrame, path: str) -> DataFrame:
    """Lines (path, pos, line, ...) that aren't fences or inside of them: the number of
    fences above is a running count, so a document of any length is worked on in pieces."""
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    counted = prefix_scan(
        lines.withColumn("_fence", fence), [path], ["pos"], F.floor(F.col("pos") / LINES),
        [Measure("_above", "sum", F.col("_fence").cast("int"))],
    )
    return counted.where(~F.col("_fence") & (F.col("_above") % 2 == 0)).drop("_fence", "_above")


def outline(docs: DataFrame, path: str, text: str) -> DataFrame:
    """path, pos, heading: `##` headings outside fenced blocks, inline markup
    stripped. Only fences and headings leave the document's row."""
    lines = docs.select(path, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    marks = lines.where(F.col("line").rlike(r"^\s*(```|~~~)|^##\s+\S"))
    return unfenced(marks, path).select(path, "pos", heading_text(F.col("line")).alias("heading")).where(F.col("heading") != "")


def figures_by_section(docs: DataFrame, path: str, text: str, pattern: str) -> DataFrame:
    """path, pos, k, section, figure: every match of `pattern` with the heading above it
    (null before the first). pos: line; k: number within the line. A heading's own
    figures belong to it; a heading inside a fenced block is none.

    Headings and figures are laid out by line and the last heading is a running value; no text is carried along."""
    lines = docs.select(path, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    heads = outline(docs, path, text).select(path, "pos", F.lit(-1).alias("k"), "heading", F.lit(None).cast("string").alias("figure"))
    found = lines.select(path, "pos", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("k", "figure"))
    both = heads.unionByName(found.select(path, "pos", "k", F.lit(None).cast("string").alias("heading"), "figure"))
    filled = prefix_scan(both, [path], ["pos", "k"], F.floor(F.col("pos") / LINES), [Measure("section", "last", F.col("heading"))])
    return filled.where(F.col("k") >= 0).select(path, "pos", "k", "section", "figure")


def fee_scope(docs: DataFrame, path: str, text: str, transcribed: DataFrame, sections: DataFrame, pattern: str = T.FEE_SCOPE_PATTERN) -> DataFrame:
    """path, section, figure, problem: fee-shaped text of documents that carry no transcription
    (`untranscribed`), and of transcribed ones outside the allowed sections (`outside`).
    transcribed: path. sections: section, the allowed headings, compared without case."""
    found = figures_by_section(docs, path, text, pattern).groupBy(path, "section", "figure").agg(F.count(F.lit(1)).alias("times"))
    done = transcribed.select(path, F.lit(True).alias("_done")).distinct()
    may = sections.select(F.lower(F.trim("section")).alias("_may"), F.lit(True).alias("_allowed")).distinct()
    judged = lookup_join(found, done, [path], "left").withColumn("_may", F.lower(F.trim("section")))
    judged = lookup_join(judged, may, ["_may"], "left")
    problem = F.when(F.col("_done").isNull(), "untranscribed").when(F.col("_allowed").isNull(), "outside")
    return judged.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(path, "section", "figure", "times", "problem")


def heading_ids(headings: DataFrame, path: str) -> DataFrame:
    """Headings with their slug; repeats get -2, -3 in document order, a heading
    that slugs to nothing drops."""
    based = headings.withColumn("base", T.slugify(F.col("heading"))).where(F.col("base") != "")
    n = ordinal(based, [path, "base"], ["pos"], F.floor(F.col("pos") / 65536), "n")
    return n.withColumn("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n"))).drop("base", "n")
