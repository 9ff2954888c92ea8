"""Service records in long form: one row per line of a record.

A record's lines are never gathered. What is known about a whole record (where
its total stands, where its steps begin, how coherent its prose is) is a partial
aggregate; it goes back to the lines through a salted lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicloom.functions import text as T
from civicloom.operators.skew import lookup_join, settle

STEP_FIELDS = ["clientStep", "agencyAction", "fee", "processingTime", "personResponsible"]
TOTAL_LABEL = r"(?i)^\s*TOTAL\b[\s:]*$|^\s*TOTAL\s*[:\-]"
NOT_A_PLACE = (
    r"(?i)^\s*(?:none|free|n/a|(?:" + T.DURATION_PATTERN.replace("(?i)", "") + r")|(?:"
    + T.FEE_PATTERN.replace("(?i)", "") + r"))\s*$"
)
LOOSE_STEP = r"^\s*(?:\d{1,2}(?:\.\d{1,2})?\s*[.)]?|[•·▪◦*\-–—])\s*"
DANGLING = r"(?i)\b(and|or|of|to|the|at|for|in|with|by|from)$"


def is_timed() -> Column:
    return F.col("fee").isNotNull() | F.col("processingTime").isNotNull()


def is_total() -> Column:
    """A row labelled TOTAL, or one with a figure and nobody doing anything."""
    idle = F.col("clientStep").isNull() & F.col("agencyAction").isNull() & F.col("personResponsible").isNull()
    return F.coalesce(F.col("clientStep").rlike(TOTAL_LABEL), F.lit(False)) | (idle & is_timed())


def sectioned(lines: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Lines with `part`: rows before the first timed row are `requirement` rows
    that ran past the header (none, if no row is timed); of the others the last
    total row is the `total` and the rest are `step` rows."""
    marks = lines.groupBy(*keys).agg(
        F.max(F.when(is_total(), F.col(pos))).alias("_total"), F.min(F.when(is_timed(), F.col(pos))).alias("_first")
    )
    out = lookup_join(lines, marks, keys, "inner")
    part = (
        F.when(F.col(pos) < F.col("_first"), "requirement").when(F.col(pos) == F.col("_total"), "total").otherwise("step")
    )
    return out.withColumn("part", part).drop("_total", "_first")


def content_steps(lines: DataFrame) -> DataFrame:
    """Lines with at least one of the five published fields."""
    return lines.where(F.coalesce(*[F.col(f) for f in STEP_FIELDS]).isNotNull())


def distinct_values(parted: DataFrame, keys: Sequence[str], value: str, pos: str = "pos") -> DataFrame:
    """keys, value, at: distinct non-blank values of a record, step values in
    line order and the total's last. `at` sorts them."""
    late = F.col("part") == "total"
    stated = parted.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    return (
        stated.groupBy(*keys, F.col(value).alias("value"))
        .agg(F.min(F.struct(late.alias("is_total"), F.col(pos).alias("pos"))).alias("at"))
        .select(*keys, "value", "at")
    )


def fees_or_prose(parted: DataFrame, keys: Sequence[str], prose: str, pos: str = "pos") -> DataFrame:
    """Distinct fees of each record; fee-shaped text of its prose only where no
    step or total states one."""
    stated = distinct_values(parted, keys, "fee", pos)
    silent = parted.select(*keys).distinct().join(stated.select(*keys).distinct(), list(keys), "left_anti")
    loose = lookup_join(
        parted.select(*keys, pos, F.posexplode(T.fees(F.col(prose))).alias("_i", "value")), silent, keys, "inner"
    )
    found = loose.groupBy(*keys, "value").agg(
        F.min(F.struct(F.lit(False).alias("is_total"), F.col(pos).alias("pos"))).alias("at")
    )
    return stated.unionByName(found)


def measures(parted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per record: everything the record-level rules ask about it."""
    step, total = F.col("part") == "step", F.col("part") == "total"
    cells = [F.trim(F.regexp_replace(c, LOOSE_STEP, "")) for c in ("clientStep", "agencyAction")]

    def cell_count(test):
        return sum(
            (F.count_if(step & F.coalesce(test(c) & (F.col(n) != ""), F.lit(False))) for c, n in zip(cells, ("clientStep", "agencyAction"))),
            F.lit(0),
        )

    return parted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(step).alias("rows"),
        F.count_if(step & is_timed()).alias("timed"),
        F.count_if((F.col("part") == "requirement") & F.col("clientStep").isNotNull()).alias("requirements"),
        F.count_if(step & F.col("fee").isNotNull()).alias("fees"),
        F.count_if(step & F.col("processingTime").isNotNull()).alias("times"),
        F.max(F.when(total, F.col("fee"))).alias("totalFee"),
        F.max(F.when(total, F.col("processingTime"))).alias("totalProcessingTime"),
        cell_count(lambda c: c.isNotNull()).alias("prose"),
        cell_count(lambda c: (F.length(c) < 3) | ~c.rlike(r"\p{L}")).alias("fragments"),
        cell_count(lambda c: c.rlike(DANGLING)).alias("dangling"),
    )


def confidence(office: Column, merged: Column, no_columns: Column, unresolved: Column, reqs_ok: Column) -> Column:
    """high / needs-human over a `measures` row, from positive evidence that a
    steps table was read. Steps cohere when no cell is a fragment and at most
    three in ten are cut off at a connecting word."""
    rows, timed = F.coalesce("rows", F.lit(0)), F.col("timed")
    loose = no_columns | (rows > 20)
    coherent = (F.col("prose") == 0) | ((F.col("fragments") == 0) & (F.col("dangling") * 10 <= F.col("prose") * 3))
    return (
        F.when(office.isNull() | (rows == 0), "needs-human")
        .when(~loose & (timed == 0), "needs-human")
        .when(~loose & (timed * 2 < rows) & ~merged, "needs-human")
        .when(~loose & (unresolved * 100 > rows * 34), "needs-human")
        .when(~reqs_ok, "needs-human")
        .when(~loose & ~coherent, "needs-human")
        .otherwise("high")
    )


def requirements_coherent(reqs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, coherent, from rows (item, whereToSecure): no fragment, no item that
    continues the one above, and on a list of more than three either no source
    or a source for at least half."""
    item = F.trim(F.coalesce("item", F.lit("")))
    broken = (F.length(item) < 5) | item.rlike(r"^[•\-–—*]+$") | item.rlike(r"^[a-z(]")
    n = reqs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("bad"), F.count("whereToSecure").alias("paired")
    )
    thin = (F.col("paired") > 0) & (F.col("n") > 3) & (F.col("paired") * 2 < F.col("n"))
    return n.select(*keys, ((F.col("bad") == 0) & ~thin).alias("coherent"))


def not_stated(known: dict[str, Column]) -> Column:
    """Fields a record (a `measures` row with `eligibility`) is silent on. A
    field counts only where the extraction read nothing and the enumeration does
    not say it is present."""

    def silent(name, nothing_read):
        return F.when(nothing_read & (known[name].isNull() | (known[name] == "absent")), F.lit(name))

    def none(c):
        return F.coalesce(c, F.lit(0)) == 0

    return F.filter(
        F.array(
            F.lit("whereToGo"),
            F.lit("officeHours"),
            silent("output", F.lit(True)),
            silent("eligibility", F.col("eligibility").isNull()),
            silent("requirements", none("requirements")),
            silent("fees", none("fees") & F.col("totalFee").isNull()),
            silent("processingTime", none("times") & F.col("totalProcessingTime").isNull()),
        ),
        lambda v: v.isNotNull(),
    )


def present_missing(df: DataFrame, keys: Sequence[str], facts: dict[str, Column]) -> DataFrame:
    """keys, fact, value, present: one row per record and fact, in the order given; a blank
    value is missing like a null one. facts: name -> value."""
    said = [F.nullif(F.trim(v.cast("string")), F.lit("")) for v in facts.values()]
    cells = F.array(*[F.struct(F.lit(n).alias("fact"), v.alias("value"), v.isNotNull().alias("present")) for n, v in zip(facts, said)])
    return df.select(*keys, F.inline(cells))


def place_or_null(col: Column) -> Column:
    return F.when(col.rlike(NOT_A_PLACE), F.lit(None).cast("string")).otherwise(col)


# Block order and headings of a published record.
BLOCKS = {
    "en": {"requirements": "**Checklist of requirements**", "steps": "**Client steps**"},
    "fil": {"requirements": "**Listahan ng requirement**", "steps": "**Mga hakbang**"},
}
REQ_HEAD = "| Checklist of requirements | Where to secure |"
STEP_HEAD = "| Client steps | Agency action | Fees to be paid | Processing time | Person responsible |"


def render(
    entries: DataFrame, parted: DataFrame, keys: Sequence[str], facts: dict[str, Column], locales: Sequence[str], pos="pos"
) -> DataFrame:
    """Published body of each record and locale as lines: keys, locale, block,
    line_no, line. Ordered by (block, line_no) they are the printed page; parts a
    record does not have are absent. The headings come from one row per record,
    the table lines from the record's own lines, so no body is assembled in one
    place."""
    keys = list(keys)
    cell = T.escape_cell

    def emit(df, block, line_no, line):
        return df.select(*keys, "locale", F.lit(block).alias("block"), line_no.cast("long").alias("line_no"), line.alias("line"))

    def heads(df, block, lines):
        return df.select(
            *keys, "locale", F.lit(block).alias("block"), F.posexplode(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])).alias("line_no", "line")
        ).withColumn("line_no", F.col("line_no").cast("long") - len(lines))

    def titled(block):
        out = F.lit(None).cast("string")
        for loc in locales:
            out = F.when(F.col("locale") == loc, BLOCKS[loc][block]).otherwise(out)
        return out

    loc = F.explode(F.array(*[F.lit(x) for x in locales]))
    rows = parted.withColumn("locale", loc)
    named = F.filter(
        F.array(
            *[
                F.when(v.isNotNull(), F.concat(F.lit(f"| {label} | "), cell(v), F.lit(" |")))
                for label, v in facts.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    table = F.when(F.size(named) > 0, F.concat(F.array(F.lit("| | |"), F.lit("| --- | --- |")), named))
    fact_lines = entries.withColumn("locale", loc).select(
        *keys, "locale", F.lit(1).alias("block"), F.posexplode(table).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("long"))
    req = rows.where((F.col("part") == "requirement") & F.col("clientStep").isNotNull())
    req_lines = emit(
        req, 2, F.col(pos),
        F.concat(F.lit("| "), cell(F.col("clientStep")), F.lit(" | "), cell(F.coalesce("personResponsible", F.lit("—"))), F.lit(" |")),
    )
    step = content_steps(rows.where(F.col("part") == "step"))
    step_lines = emit(
        step, 3, F.col(pos), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f)) for f in STEP_FIELDS]), F.lit(" |"))
    )
    per_record = rows.groupBy(*keys, "locale").agg(
        F.count_if((F.col("part") == "requirement") & F.col("clientStep").isNotNull()).alias("_req"),
        F.count_if((F.col("part") == "step") & F.coalesce(*[F.col(f) for f in STEP_FIELDS]).isNotNull()).alias("_step"),
        F.max(F.when(F.col("part") == "total", F.struct("fee", "processingTime"))).alias("_total"),
    )
    req_heads = heads(per_record.where(F.col("_req") > 0), 2, [titled("requirements"), REQ_HEAD, "| --- | --- |"])
    step_heads = heads(per_record.where(F.col("_step") > 0), 3, [titled("steps"), STEP_HEAD, "| --- | --- | --- | --- | --- |"])
    total_line = emit(
        per_record.where((F.col("_step") > 0) & F.col("_total").isNotNull()), 4, F.lit(0),
        F.concat(F.lit("| **TOTAL** | | **"), cell(F.col("_total.fee")), F.lit("** | **"), cell(F.col("_total.processingTime")), F.lit("** | |")),
    )
    out = fact_lines
    for part in (req_heads, req_lines, step_heads, step_lines, total_line):
        out = out.unionByName(part)
    return out


def in_locales(body: DataFrame, locales: Sequence[str]) -> DataFrame:
    """A body rendered for one locale in all of them: only the blocks' titles differ."""
    spread = body.withColumn("locale", F.explode(F.array(*[F.lit(x) for x in locales])))
    title = F.lit(None).cast("string")
    for loc in locales:
        for block, name in ((2, "requirements"), (3, "steps")):
            title = F.when((F.col("locale") == loc) & (F.col("block") == block), BLOCKS[loc][name]).otherwise(title)
    first = F.col("block").isin(2, 3) & (F.col("line_no") == -3)
    return spread.withColumn("line", F.when(first, title).otherwise(F.col("line")))


def unpublished(source: DataFrame, body: DataFrame, key: str, line_id: str, text: str) -> DataFrame:
    """Source lines (key, line_id, is_total, text) with any token that their record's published
    lines lack. body: the rendered lines of one locale.

    Every line is compared: first with the one printed for it, whose tokens have its own in
    their order; only lines that aren't found whole there are looked up among all tokens of their record."""
    said = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(F.col(c)), " "), F.lit(" "))
    place = F.when(F.col("block") == 4, F.lit(-1).cast("long")).otherwise(F.col("line_no")).alias("_at")
    printed = body.where((F.col("block") > 1) & (F.col("line_no") >= 0)).select(
        key, place, (F.col("block") == 4).alias("is_total"), said("line").alias("_printed")
    )
    asked = source.withColumn("_at", F.when(F.col("is_total"), F.lit(-1).cast("long")).otherwise(F.col(line_id).cast("long")))
    met = asked.join(printed, [key, "_at", "is_total"], "left")
    rest = settle(met.where(~F.coalesce(F.col("_printed").contains(said(text)), F.lit(False))).select(key, line_id, text))
    # the bodies of records that still have lines to look up
    return unrendered(rest, lookup_join(body, rest.select(key).distinct(), [key], "left_semi"), [key], line_id, text)


def unrendered(source: DataFrame, rendered: DataFrame, keys: Sequence[str], line_id: str, text: str) -> DataFrame:
    """Source lines with any token that the record's published lines lack.

    Tokens are compared by (record, token), so a huge record spreads over its
    words; each side is reduced to distinct pairs first."""
    keys = list(keys)
    have = rendered.select(*keys, F.explode(T.tokens(F.col("line"))).alias("_token")).distinct()
    want = source.select(*keys, line_id, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("_token"))
    lost = lookup_join(want, have.withColumn("_have", F.lit(True)), [*keys, "_token"], "left").where(F.col("_have").isNull())
    return lost.select(*keys, line_id).distinct()


def presence(value: Column) -> Column:
    return F.when(value.isNull() | (value == ""), "absent").otherwise("present")
