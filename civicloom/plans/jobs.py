"""Composite jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.operators import search as S
from civicloom.operators.skew import lookup_join

#: Positions of steps begin here, those of requirement rows at 1.
BELOW_CHECKLIST = 1 << 40


def job_search(
    df: DataFrame,
    query: str,
    text_cols: list[str],
    title_col: str,
    category_col: str,
    pos_col: str,
    category: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Search, facet over the unfiltered hits, narrow, rank and highlight.

    The texts are read and folded once: hits are written with the columns `keep` (all, if none are named)
    and what ranking needs, and counted, narrowed and ranked from there. The facet count travels with every
    hit; facets are one row per category and small, so the optimizer broadcasts them when their measured size allows."""
    from civicloom.operators.skew import settle

    hits = S.search(df, query, text_cols, title_col, category_col)
    carried = list(dict.fromkeys([*(df.columns if keep is None else keep), title_col, category_col, pos_col, "title_hit"]))
    hits = settle(hits.select(*carried))
    counts = S.facets(hits, category_col).withColumnRenamed("hits", "category_hits")
    narrowed = hits.withColumnRenamed(category_col, "category")
    if category:
        # An unknown category leaves the result whole; the facets say which are known.
        known = F.coalesce(counts.agg(F.max(F.col("category") == category)).scalar(), F.lit(False))
        narrowed = narrowed.where(~known | (F.col("category") == category))
    out = S.ranked(narrowed.join(counts, "category"), "category", pos_col)
    return out.withColumn("title_segments", S.segments(F.col(title_col), query))


def job_revision(history: DataFrame, current: DataFrame, derived: DataFrame) -> DataFrame:
    """kind, file, slug: changed documents and the pages to re-check. A
    non-empty result is a failing status for the caller to act on."""
    from civicloom.operators import reconcile as R

    changed = R.changed_documents(history, current).select(
        F.lit("document-changed").alias("kind"),
        F.col("file").cast("string").alias("file"),
        F.col("file").cast("string").alias("slug"),
    )
    stale = R.superseded(derived, current).select(
        F.lit("page-to-recheck").alias("kind"), F.col("file").cast("string").alias("file"), "slug"
    )
    return changed.unionByName(stale)


def job_publish(
    lines: DataFrame, entries: DataFrame, known: DataFrame, key: str, facts: dict[str, Column], locales: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(content, body lines, ledger) of every record.

    lines: key, pos and the five step fields; entries: key and fact columns;
    known: key, eligibility and what the enumeration says is present."""
    from civicloom.operators import records as RC
    from civicloom.operators.skew import settle

    # Numbered once, and told once which records are filed: every later pass starts from the rows as written.
    numbered = settle(lines)
    filed_keys = entries.select(key).distinct().withColumn("_filed", F.lit(True))
    held = settle(lookup_join(RC.sectioned(numbered, [key]), filed_keys, [key], "left"))
    parted, filed = held.drop("_filed"), held.where("_filed").drop("_filed")
    says = {n: F.col("k_other") for n in ("output", "eligibility", "requirements")}
    says |= {"fees": F.col("k_fees"), "processingTime": F.col("k_time")}
    content = (
        RC.measures(parted, [key])
        .join(known, key, "left")
        .withColumn("notStated", RC.not_stated(says))
        .drop("k_other", "k_fees", "k_time")
    )
    # Written once: the ledger reads what is published, not a second rendering.
    body = settle(RC.render(entries, filed, [key], facts, locales[:1]))
    source = filed.select(key, "pos", (F.col("part") == "total").alias("is_total"), F.concat_ws(" ", *[F.col(f) for f in RC.STEP_FIELDS]).alias("text"))
    ledger = RC.unpublished(source, body, key, "pos", "text")
    return content, RC.in_locales(body, locales), ledger


def job_enumerate(lines: DataFrame, doc: str, pos: str = "pos", text: str = "text", chunk: int = 4096) -> DataFrame:
    """Text lines of documents -> one row per service: id, section, number,
    title, office, classification and which of six fields its block carries.

    A service's block runs from its anchor line to the next one. Everything
    about a block is a partial aggregate over its lines."""
    from civicloom.functions import text as T
    from civicloom.operators import records as RC
    from civicloom.operators import segments as SG
    from civicloom.operators.skew import settle

    line = F.col(text)
    kept = settle(lines.where(~line.rlike(r"(?i)^\s*\d+\s*\|\s*Page\s*$") & (F.trim(line) != "")))
    barrier = line.rlike(r"(?i)CHECKLIST\s+OF\s+REQUIREMENTS") | line.rlike(SG.TOTAL)
    noted = settle(SG.annotate(kept, doc, pos, text, bound=15, barrier=barrier, chunk=chunk))
    numbered = SG.with_ids(SG.services(noted, doc, pos), doc, T.stem(F.col(doc)), chunk)
    block = noted.where(F.col("seg") > 0).select(doc, "seg", pos, text, "below")
    # A value may stand on the line below its label, but not in the next block.
    pair = F.concat_ws("\n", line, F.when(~F.col("below").rlike(SG.ANCHOR), F.col("below")))

    # Most lines carry no label: the first word of one spares them the label patterns, and the pair of lines, onto which a label may wrap.
    labelled = line.rlike(r"(?i)^\s*(?:office|classification|who)\b")
    labels = {"_office": "Office or Division", "_class": "Classification", "_whom": "Who may avail"}
    block = block.withColumn("_label", labelled).withColumns(
        {c: F.when(F.col("_label"), T.inline_field(pair, label)) for c, label in labels.items()}
    )

    def first(value):
        return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(pos)))

    facts = block.groupBy(doc, "seg").agg(
        T.tidy(first("_office")).alias("office"),
        T.tidy(first("_class")).alias("classification"),
        first("_whom").alias("_who"),
        F.max(line.rlike(r"(?i)CHECKLIST\s+OF\s+REQUIREMENTS")).alias("_req"),
        F.max(line.rlike(r"(?i)^\s*Output\s*(?::|\s{2,})")).alias("_out"),
    )
    header = SG.header_region(block, [doc, "seg"], pos, text, line.rlike(r"(?i)CLIENT\s+STEPS"))
    out = numbered.join(facts, [doc, "seg"]).join(header, [doc, "seg"], "left")
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), "present").otherwise("absent")
    return out.select(
        doc, "id", "section", "number", "title",
        F.when(F.col("title").isNotNull(), "extracted").otherwise("not-in-layout").alias("title_status"),
        "office", "classification",
        RC.presence(F.col("_who")).alias("eligibility"),
        flag(F.col("_req")).alias("requirements"),
        flag(F.col("header").rlike("(?i)FEESTOBE")).alias("fees"),
        flag(F.col("header").rlike("(?i)PROCESSIN")).alias("processing_time"),
        RC.presence(F.col("office")).alias("owning_office"),
        flag(F.col("_out")).alias("output"),
    )


def job_extract(layout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layout lines -> (services, steps).

    services: doc, section, number, title, the labelled fields, the record measures,
    whether the requirements read as a list, how many places could not be told to an
    item, and the confidence of the extraction. steps: one row per rebuilt table row
    with the five columns and its part; requirement rows (before the steps) have the item as
    clientStep and the place as personResponsible. Lines and cells are written once
    each; every later pass starts from there."""
    from civicloom.functions import text as T
    from civicloom.operators import intervals as I
    from civicloom.operators import layout as L
    from civicloom.operators import records as RC
    from civicloom.operators import requirements as RQ
    from civicloom.operators import segments as SG
    from civicloom.operators.skew import neighbours, ordinal, settle

    line = F.col("text")
    # Reading order; a page is a piece of its document.
    order = ["page", "y0", "x0", "text"]
    kept = layout.where(~L.is_furniture(line))
    lines = settle(neighbours(kept, ["doc"], order, F.floor(F.col("page") / 16), after={"below": "text"}, number="pos"))
    barrier = line.rlike(SG.REQUIREMENTS) | line.rlike(RC.TOTAL_LABEL) | L.is_header(line)
    told = settle(SG.telling(SG.flagged(lines, "doc", "pos", "text", barrier)).drop("below"))
    found = settle(SG.services(SG.scanned(told, "doc", "pos", 18), "doc", "pos"))
    # Steps start below the steps header, else below the checklist heading. One fragment alone is no header.
    # All of these lines are among the telling ones.
    key = L.fragment_key(line)
    at = F.struct("page", "y0")
    opens_steps = key.isin("clientStep", "agencyAction")
    starts = SG.assign(told, found, "doc", "pos").groupBy("doc", "service").agg(
        F.min("pos").alias("start"),
        F.min(F.when(line.rlike(SG.REQUIREMENTS), F.col("pos"))).alias("_req"),
        F.min(F.when(line.rlike(SG.REQUIREMENTS), at)).alias("_req_at"),
        F.min(F.when(opens_steps, F.col("pos"))).alias("_steps"),
        F.min(F.when(opens_steps, at)).alias("_steps_at"),
        F.count(key).alias("_heads"),
    ).withColumns({c: F.when(F.col("_heads") >= 2, F.col(c)) for c in ("_steps", "_steps_at")})
    extras = ["_req", "_steps", "_req_at", "_steps_at"]
    opened = SG.assign(lines.drop("below"), settle(starts), "doc", "pos", own=extras)
    opened = settle(opened.withColumn("doc", F.concat_ws("#", "doc", "service")))
    body = opened.drop(*extras)
    number_of = ordinal(found, ["doc"], ["start"], F.floor(F.col("start") / 4096), "service")

    # The four labelled fields: on the label's own line, else nearest to its right.
    labels = {"office": "office or division", "classification": "classification",
              "transaction": "type of transaction", "who": "who may avail"}
    alone = {k: r"(?i)^" + v.replace(" ", r"\s+") + r"\s*[:?]?\s*$" for k, v in labels.items()}
    name = F.lit(None).cast("string")
    for k, p in alone.items():
        name = F.when(line.rlike(p), k).otherwise(name)
    marked = body.withColumn("label", name)
    beside = I.nearest_right(
        marked.where(F.col("label").isNotNull()).select("doc", "page", "label", "pos", "x1", "y0", "y1"),
        marked.where(F.col("label").isNull() & T.has_word_char(line)).select("doc", "page", "x0", "y0", "y1", "text"),
        ["doc", "page"], "pos",
    ).select("doc", "label", "pos", F.col("value.text").alias("value"))
    # A label's first word spares most lines the four patterns.
    labelled = body.where(line.rlike(r"(?im)^\s*(?:" + "|".join(v.split()[0] for v in labels.values()) + ")"))
    inline = labelled.select("doc", "pos", F.inline(F.filter(F.array(*[
        F.struct(F.lit(k).alias("label"), T.inline_field(line, v, loose=True).alias("value")) for k, v in labels.items()
    ]), lambda x: x["value"].isNotNull())))
    fields = (
        beside.where(F.col("value").isNotNull()).unionByName(inline)
        .groupBy("doc")
        .agg(*[F.min_by("value", F.when(F.col("label") == k, F.col("pos"))).alias(k) for k in labels])
    )

    table_lines = opened.where(F.col("pos") >= F.coalesce("_steps", F.col("_req") + 1, F.lit(0))).drop(*extras)
    names, cell_rows = L.table(table_lines)
    cell_rows = settle(cell_rows)
    bands, merged = L.row_bands(cell_rows)
    placed = L.demoted(L.rows(cell_rows, bands), names)
    keys = [*L.STEP_KEYS, "unlabelled"]
    # Columns beyond the five have no label; all cells of a band that have none are kept, in their order.
    placed = placed.withColumn("key", F.when(F.col("key").isin(*L.STEP_KEYS), F.col("key")).otherwise("unlabelled"))
    named = [F.max(F.when(F.col("key") == k, F.col("text"))).alias(k) for k in L.STEP_KEYS]
    others = F.collect_list(F.when(F.col("key") == "unlabelled", F.struct("y0", "text")))
    wide = placed.groupBy("doc", "page", "band").agg(*named, others.alias("held"), F.min("y0").alias("top"))
    unlabelled = F.array_join(F.transform(F.sort_array("held"), lambda c: c["text"]), "\n")
    wide = wide.withColumn("unlabelled", F.when(F.size("held") > 0, unlabelled)).select(
        "doc", "page", F.col("band").cast("double").alias("y"), F.lit(0.0).alias("x"), "top", *keys, F.lit(None).cast("string").alias("unresolved"))
    # A page without columns keeps its lines, one unresolved row each.
    flat = table_lines.where(~L.is_header(line)).join(names.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
    loose = flat.select(
        "doc", "page", F.col("y0").cast("double").alias("y"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("top"),
        *[F.lit(None).cast("string").alias(k) for k in keys], line.alias("unresolved"),
    )
    # Bands or loose lines: a page has one of them. A row's place is its number in reading order.
    read_rows = settle(wide.unionByName(loose))
    placed_rows = ordinal(read_rows, ["doc"], ["page", "y", "x", "unresolved"], F.floor(F.col("page") / 16), "pos")
    parted = settle(RC.sectioned(settle(placed_rows.drop("y", "x")), ["doc"]))
    extra = parted.where(F.col("part") == "step").groupBy("doc").agg(F.count("unresolved").alias("unresolved"))

    # The checklist: lines above the steps header, and whatever stands above the first row that states a fee or a time.
    first_timed = parted.groupBy("doc").agg(
        F.min(F.when(RC.is_timed(), F.struct("pos", "page", "top"))).alias("_first"), F.count_if(F.col("part") == "requirement").alias("_before")
    ).where("_before > 0").select("doc", F.struct(F.col("_first.page").alias("page"), F.col("_first.top").alias("y0")).alias("_until"))
    plain = opened.where(~L.is_header(line))
    listed = plain.where((at > F.col("_req_at")) & F.coalesce(at < F.col("_steps_at"), F.lit(True)))
    ran_on = lookup_join(plain.where(F.coalesce(at > F.coalesce("_steps_at", "_req_at"), F.lit(True))), first_timed, ["doc"], "inner").where(
        F.struct(F.col("page"), F.col("y0").cast("double").alias("y0")) < F.col("_until")
    ).drop("_until")
    read_in = [listed.withColumn("_pass", F.lit("1")), ran_on.withColumn("_pass", F.lit("2"))]
    read_in = settle(read_in[0].unionByName(read_in[1]).withColumn("doc", F.concat_ws("\x1f", "doc", "_pass")).drop(*extras, "_pass", "service", "pos"))
    checklist = RQ.read(read_in)

    def of_record(df):
        return df.withColumn("_pass", F.substring_index("doc", "\x1f", -1)).withColumn("doc", F.substring_index("doc", "\x1f", 1))

    reqs = settle(of_record(checklist.items))
    sound = RQ.coherent(reqs, ["doc"])
    unpaired = of_record(checklist.unpaired).groupBy("doc").agg(F.count_distinct("place").alias("unpaired"))
    spilt = of_record(checklist.dropped).select("doc").distinct().withColumn("steps_text_in_requirements", F.lit(True))
    said = of_record(checklist.texts).join(reqs.select("doc", "_pass", "page", "item", F.col("place").alias("_place")), ["doc", "_pass", "page", "item"])
    said = ordinal(said, ["doc"], ["_pass", "page", "item", "piece"], F.floor(F.col("page") / 16), "_n")
    none = F.lit(None).cast("string")
    asked = said.select(
        "doc", "page", F.lit(None).cast("double").alias("top"), F.col("text").alias("clientStep"),
        *[none.alias(k) for k in keys if k not in ("clientStep", "personResponsible")],
        F.when(F.col("piece") == 0, F.col("_place")).alias("personResponsible"), none.alias("unresolved"),
        F.col("_n").alias("pos"), F.lit("requirement").alias("part"),
    )
    # Rows above the first timed one were read through the geometry of the steps table: the checklist has them instead.
    rest = parted.where(F.col("part") != "requirement").withColumn("pos", F.col("pos") + BELOW_CHECKLIST)
    parted = settle(rest.unionByName(asked).drop("page", "top"))
    is_merged = merged.where(F.col("key").isin("fee", "processingTime")).select("doc").distinct().withColumn("_merged", F.lit(True))
    services = (
        number_of.select(F.concat_ws("#", "doc", "service").alias("doc"), "section", "number", "title")
        .join(fields, "doc", "left")
        .join(RC.measures(parted, ["doc"]), "doc", "left")
        .join(extra, "doc", "left")
        .join(is_merged, "doc", "left")
        .join(sound, "doc", "left")
        .join(unpaired, "doc", "left")
        .join(spilt, "doc", "left")
    )
    loose_rows = F.coalesce("unresolved", F.lit(0))
    level = RC.confidence(
        office=F.col("office"), merged=F.coalesce("_merged", F.lit(False)), no_columns=loose_rows > 0,
        unresolved=loose_rows, reqs_ok=F.coalesce("coherent", F.lit(True)),
    )
    services = services.withColumn("confidence", level).withColumnRenamed("coherent", "requirements_coherent")
    return services.drop("_merged"), parted


def job_harvest(
    pages: DataFrame, previous: DataFrame, robots: DataFrame, kind: Column, key: str, link_pattern: str,
    crawled: DataFrame | None = None,
) -> DataFrame:
    """One inventory row per allowed page: class, title, text checksum and size,
    change since the previous crawl and number of document links. `crawled` is
    the part of the pages fetched this time, if not all were. A forbidden page is a row with its rule; nothing is read from it."""
    from civicloom.operators import pages as P

    judged = P.robots_verdict(pages, "url", P.robots_rules(robots)).withColumn("kind", kind)
    allowed = judged.where(F.col("rule").isNull())
    # One generated row per page, so the text is extracted once for all measures.
    text = allowed.select(key, F.explode(F.array(P.article_text(F.col("html")))).alias("a"), P.published_title(F.col("html"), r"(?i)\s*[|.]\s*$").alias("title"))
    measured = text.select(key, "title", F.length("a").alias("body_chars"), F.sha2("a", 256).alias("content_sha256"))
    # Change detection, like all else, reads allowed pages only.
    may = allowed.select(key)
    now, then = [lookup_join(p.select(key, "html"), may, [key], "left_semi") for p in (pages if crawled is None else crawled, previous)]
    state = P.changes(then, now, key, "html")
    linked = P.links(allowed, key, "html", link_pattern).groupBy(key).agg(F.count(F.lit(1)).alias("links"))
    return (
        judged.select(key, "url", "kind", "rule")
        .join(measured, key, "left")
        .join(state, key, "left")
        .join(linked, key, "left")
        .withColumn("links", F.when(F.col("rule").isNull(), F.coalesce("links", F.lit(0))))
    )


def job_harvest_run(
    index: DataFrame, children: DataFrame, found: DataFrame, seen: DataFrame, pages: DataFrame, previous: DataFrame, robots: DataFrame,
    kind: Column, key: str, link_pattern: str, path: str, run: str, crawled: DataFrame | None = None, measures: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A harvest from the sitemap to the committed inventory: (header, rows).

    index and children are the sitemaps, found(url) addresses that pages link to, seen(url) addresses that earlier
    runs have dealt with, pages what can be had. Addresses already seen are left out, forbidden ones get a row with
    their rule. The rows of the run take the place of those before, together with their header; `run` names it, and run again
    it changes nothing."""
    from civicloom.operators import pages as P
    from civicloom.operators.skew import settle
    from civicloom.sources import commits
    from civicloom.sources import writers as SNK

    rules = P.robots_rules(robots)
    listed = P.sitemap_urls(index, children).unionByName(found.select("url"))
    due = settle(P.frontier(listed, seen, rules).where(F.col("state") != "seen").select(F.col("url").alias("_due")))
    asked = pages.withColumn("_due", P.without_fragment(F.col("url"))).join(due, "_due", "left_semi").drop("_due")
    rows = job_harvest(asked, previous, robots, kind, key, link_pattern, crawled)
    head = SNK.write_inventory(rows, path, run, measures)
    return head, commits.load(rows.sparkSession, path, rows.schema)


def job_freshness(
    pages: DataFrame, classes: DataFrame, as_of: Column, key: str, manifest: str, path: str, run: str,
    forced: list[str] | None = None, baseline: DataFrame | None = None, report: bool = True, record_baseline: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(header, rows, report lines, findings) of the published pages as of a day, the rows and with `report` the lines committed as `run`.

    pages: key, data_class, last_checked_at, review_role and the manifest each page stands in. findings (key, kind,
    detail): classes nobody declared, dates in the future, and, against a baseline, dates that moved without a review.
    With `record_baseline` the check dates become the next baseline."""
    from civicloom.operators import freshness as FR
    from civicloom.sources import commits
    from civicloom.sources.writers import baseline_frame

    spark = pages.sparkSession
    stated = FR.states(pages, classes, as_of, forced)
    late = F.col("state").isin("stale", "due")
    measures = {
        "manifests": F.countDistinct(manifest), "overdue": F.count_if(late), "undated": F.count_if(F.col("state") == "undated"),
        "reviewed": F.count("review_role"), "undeclared": F.count_if(F.col("cadence").isNull()),
    }
    head = commits.commit(stated, f"{path}/pages", run, "replace", measures)
    rows = commits.load(spark, f"{path}/pages", stated.schema)
    lines = FR.report(rows, classes, key)
    none = F.lit("").alias("key")
    day = F.date_format(as_of, "yyyy-MM-dd")
    title = head.select(F.lit(0).alias("section"), F.lit(0).alias("rank"), none, F.format_string(
        "Generated **%s**, against %d published pages in %d manifests.", day, F.col("row_count"), F.col("manifests")).alias("line"))
    reviews = head.select(F.lit(4).alias("section"), F.lit(0).alias("rank"), none, F.format_string(
        "%d of %d pages carry a review.", F.col("reviewed"), F.col("row_count")).alias("line"))
    lines = title.unionByName(lines).unionByName(reviews)
    if report:
        commits.commit(lines, f"{path}/report", run)
        lines = commits.load(spark, f"{path}/report", lines.schema)

    def found(df, kind, detail):
        return df.select(F.col(key).cast("string").alias("key"), kind.alias("kind"), detail.cast("string").alias("detail"))

    findings = found(FR.undeclared(rows), F.lit("undeclared-class"), F.col("data_class")).unionByName(
        found(FR.future_dates(rows, key, ["last_checked_at"], as_of), F.lit("future-date"), F.col("value")))
    if baseline is not None:
        findings = findings.unionByName(found(FR.baseline_advance(rows, baseline, key), F.col("kind"), F.col("last_checked_at")))
    if record_baseline:
        commits.commit(baseline_frame(rows, key), f"{path}/baseline", run)
    return head, rows, lines, findings


def job_audit(checks: dict[str, DataFrame]) -> DataFrame:
    """check, subject, detail: every check's findings in one violations table.
    A check contributes its first column as the subject and the others, joined,
    as the detail."""
    parts = []
    for name, found in checks.items():
        subject, *rest = found.columns
        detail = F.concat_ws(" ", *[F.col(c).cast("string") for c in rest]) if rest else F.lit("")
        parts.append(found.select(F.lit(name).alias("check"), F.col(subject).cast("string").alias("subject"), detail.alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
