"""Rebuilding tables from positioned lines.

Input rows: doc, page, page_width, block, x0, y0, x1, y1, text. A column of a
page is found from the vertical bands no line crosses, named from header
fragments, content or position, and its lines are stitched into cells and rows.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civicloom.functions import text as T
from civicloom.operators.intervals import bin_by_cuts
from civicloom.operators.skew import Measure, lookup_join, neighbours, prefix_scan, previous, settle

# Column keys in document order, header fragments and markers.
STEP_KEYS = ["clientStep", "agencyAction", "fee", "processingTime", "personResponsible"]
FRAGMENTS = {
    "clientStep": r"^CLIENT(STEPS?)?$",
    "agencyAction": r"^AGENCY(ACTIONS?)?$",
    "fee": r"^FEES?(TOBE(PAID)?)?$",
    "processingTime": r"^PROCESSIN[G]?(TIME)?$|^TIME$",
    "personResponsible": r"^PERSON(RESPONSIBLE)?$|^RESPONSIBLE$",
}
HEADER_TEXT = (
    r"^(CLIENT(STEPS?)?|STEPS?|AGENCY(ACTIONS?)?|ACTIONS?|FEES?(TOBE(PAID)?)?(\(INPHP\))?"
    r"|TOBEPAID(\(INPHP\))?|PAID(\(INPHP\))?|\(INPHP\)|PROCESSIN[G]?(TIME)?|TIME"
    r"|PERSON(RESPONSIBLE)?|RESPONSIBLE|CHECKLISTOFREQUIREMENTS?|WHERETOSECURE)$"
)
FURNITURE = r"(?i)^\s*\d{1,3}\s*\|\s*Page\s*$|^\s*Page\s+\d{1,3}(\s+of\s+\d+)?\s*$"
MARKER_ONLY = r"(?i)^\s*(?:[•·▪◦*\-–—]|\(?\d{1,2}(?:\.\d+)*\)?\.?|[a-z]\))\s*$"
MARKER_LEADING = r"(?i)^\s*(?:[•·▪◦*]|\d{1,2}(?:\.\d+)*\s*[.)]|[a-z]\))\s*\S"
NO_FEE = r"(?i)^\s*(none|free|no\s+fee)\s*$"
PAGE = ["doc", "page"]
# Piece of a page's vertical axis; a taller page is worked on in pieces.
TALL = 2000.0


def is_furniture(text: Column) -> Column:
    return text.rlike(FURNITURE) | (F.trim(text) == "")


def is_header(text: Column) -> Column:
    """A column header: set in capitals only, matched without its spacing. None has a digit."""
    return ~text.rlike("[a-z0-9]") & T.squash_header(text).rlike(HEADER_TEXT)


def centre() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def reading_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("doc", "page", "y0", "x0")


def gutters(lines: DataFrame, min_width: int = 5, wide: float = 0.55) -> DataFrame:
    """doc, page, lo, hi: bands of whole x positions that no line covers, at
    least `min_width` apart and away from both page edges. Lines wider than
    `wide` of the page have no vote.

    Lines are first reduced to one row per starting position of a page, so a
    page contributes no more rows than it is points wide."""
    start = F.greatest(F.floor("x0"), F.lit(0)).alias("lo")
    end = F.least(F.ceil("x1"), F.ceil("page_width") + 1).alias("hi")
    spans = (
        lines.where(F.col("x1") - F.col("x0") <= F.col("page_width") * wide)
        .select(*PAGE, start, end)
        .groupBy(*PAGE, "lo")
        .agg(F.max("hi").alias("hi"))
    )
    before = W.partitionBy(*PAGE).orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    gap = spans.withColumn("reach", F.max("hi").over(before))
    return gap.where(F.col("lo") - 1 - (F.col("reach") + 1) >= min_width).select(
        *PAGE, (F.col("reach") + 1).alias("lo"), (F.col("lo") - 1).alias("hi")
    )


def columns(gaps: DataFrame) -> DataFrame:
    """doc, page, col, x0, x1: ranges between gutter mid-points, open (null) at
    the ends. A page without a gutter has no columns."""
    by_cut = W.partitionBy(*PAGE).orderBy("cut")
    cuts = gaps.select(*PAGE, ((F.col("lo") + F.col("hi")) / 2).alias("cut"))
    numbered = cuts.withColumn("n", F.row_number().over(by_cut)).withColumn("after", F.lead("cut").over(by_cut))

    def column(col, x0, x1):
        return F.struct(col.cast("int").alias("col"), x0.alias("x0"), x1.alias("x1"))

    left = F.when(F.col("n") == 1, column(F.lit(0), F.lit(None).cast("double"), F.col("cut")))
    both = F.filter(F.array(left, column(F.col("n"), F.col("cut"), F.col("after"))), lambda c: c.isNotNull())
    return numbered.select(*PAGE, F.inline(both))


def page_cuts(gaps: DataFrame) -> DataFrame:
    """doc, page, cuts: the column borders of a page, of which there are at most
    its width divided by the smallest gutter."""
    return gaps.groupBy(*PAGE).agg(F.array_sort(F.collect_list((F.col("lo") + F.col("hi")) / 2)).alias("cuts"))


def column_of(x: Column) -> Column:
    return F.size(F.filter("cuts", lambda c: c <= x))


def outlines(lines: DataFrame) -> DataFrame:
    """What gutters, headers and names ask of lines: one row for the lines of a page that start and end
    at the same x, by the header fragment they are (`fragment`, null: none) and whether they are a column
    header; n, fee_n, time_n, y0 (least), `last` (greatest y0) and whether one has no y0."""
    text = F.col("text")
    marked = lines.withColumn("is_header", is_header(text)).withColumn("fragment", fragment_key(text))
    return marked.groupBy(*PAGE, "page_width", "x0", "x1", "is_header", "fragment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(T.has_fee(text) | text.rlike(NO_FEE)).alias("fee_n"),
        F.count_if(T.has_duration(text)).alias("time_n"),
        F.min("y0").alias("y0"),
        F.max("y0").alias("last"),
        F.max(F.col("y0").isNull()).alias("unplaced"),
    )


def fragment_key(text: Column) -> Column:
    """The column that a header fragment names, else null."""
    squashed = T.squash_header(text)
    key = F.lit(None).cast("string")
    for name, pattern in reversed(FRAGMENTS.items()):
        key = F.when(squashed.rlike(pattern), name).otherwise(key)
    return F.when(~text.rlike("[a-z0-9]"), key)


def header_fragments(seen: DataFrame) -> DataFrame:
    """doc, page, key, centre, first: header fragments of a page merged by key;
    pages with fewer than two fragments have none. seen: outlines."""
    merged = seen.where(F.col("fragment").isNotNull()).groupBy(*PAGE, F.col("fragment").alias("key")).agg(
        ((F.min("x0") + F.max("x1")) / 2).alias("centre"),
        F.min(F.struct(F.when(~F.col("unplaced"), F.col("y0")).alias("y0"), "x0")).alias("first"),
        F.sum("n").alias("n"),
    )
    return merged.withColumn("_all", F.sum("n").over(W.partitionBy(*PAGE))).where(F.col("_all") >= 2).drop("n", "_all")


def name_columns(seen: DataFrame, headers: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc, page, col, key, via (header / content / position). seen: outlines of lines that are content.

    A header names the column its centre falls in. Failing that, the column with
    the largest share of fee-shaped (then duration-shaped) lines takes that
    name, from four lines in ten. What is left is named by position, and says so.
    The windows run over the columns of a page, of which there are at most its
    width divided by the smallest gutter."""
    page = W.partitionBy(*PAGE)
    placed = lookup_join(seen, cuts, PAGE, "inner").withColumn("col", column_of(centre()))
    shares = placed.groupBy(*PAGE, "col").agg(*[F.sum(c).alias(c) for c in ("n", "fee_n", "time_n")])
    heads = (
        headers.join(cuts, PAGE)
        .withColumn("col", column_of(F.col("centre")))
        .groupBy(*PAGE, "col")
        .agg(F.min_by("key", "first").alias("by_header"))
    )
    out = shares.join(heads, [*PAGE, "col"], "left").withColumn("key", F.col("by_header"))

    def claim(df, key, hits):
        free = F.when(F.col("key").isNull() & (F.col("n") > 0) & (F.col(hits) > 0), F.col(hits) / F.col("n"))
        best = F.max(F.struct(free.alias("score"), (-F.col("col")).alias("left"))).over(page)
        taken = F.max(F.coalesce(F.col("key") == key, F.lit(False))).over(page)
        df = df.withColumn("_free", free).withColumn("_best", best).withColumn("_taken", taken)
        wins = ~F.col("_taken") & (F.col("_free") >= 0.4) & (F.col("_best.left") == -F.col("col")) & (
            F.col("_best.score") == F.col("_free")
        )
        return df.withColumn("key", F.when(F.coalesce(wins, F.lit(False)), key).otherwise(F.col("key"))).drop("_free", "_best", "_taken")

    out = claim(claim(out, "fee", "fee_n"), "processingTime", "time_n")
    out = out.withColumn(
        "via", F.when(F.col("by_header").isNotNull(), "header").when(F.col("key").isNotNull(), "content").otherwise("position")
    )
    used = F.collect_set("key").over(page)
    rank = F.sum(F.col("key").isNull().cast("int")).over(page.orderBy("col"))
    wanted = F.array_except(F.array(*[F.lit(k) for k in STEP_KEYS]), F.col("_used"))
    guess = F.when(
        F.size(wanted) > 0, F.try_element_at(wanted, F.least(F.col("_rank").cast("int"), F.size(wanted)))
    ).otherwise(F.concat(F.lit("column"), (F.col("_rank") - 1).cast("string")))
    return (
        out.withColumn("_used", used)
        .withColumn("_rank", rank)
        .withColumn("key", F.coalesce("key", guess))
        .select(*PAGE, "col", "key", "via")
    )


def opens_cell() -> Column:
    gate = F.greatest(F.col("y1") - F.col("y0"), F.lit(8.0)) * 1.35
    return F.col("_reach").isNull() | (F.col("y0") - F.col("_reach") >= gate)


def stitched(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lines with `cell`, the number of the cell they belong to within `by`, and
    `opens`, true for its first line. A line opens a cell unless it starts less
    than 1.35 line heights (of at least 8) below everything before it."""
    order = ["y0", "x0", "text"]
    pieced = lines.withColumn("_piece", F.floor(F.col("y0") / TALL))
    reach = prefix_scan(pieced, by, order, "_piece", [Measure("_reach", "max", F.col("y1"), inclusive=False)])
    return prefix_scan(
        reach.withColumn("opens", opens_cell()), by, order, "_piece", [Measure("cell", "sum", F.col("opens").cast("int"))]
    ).drop("_reach", "_piece")


def stitched_pieces(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """`stitched` for lines of pages that lie in one piece: nothing is carried from another."""
    win = W.partitionBy(*by).orderBy("y0", "x0", "text")
    reach = lines.withColumn("_reach", F.max("y1").over(win.rowsBetween(W.unboundedPreceding, -1)))
    cell = F.sum(F.col("opens").cast("int")).over(win.rowsBetween(W.unboundedPreceding, 0))
    return reach.withColumn("opens", opens_cell()).withColumn("cell", cell).drop("_reach")


def joined_text(order: Sequence[str]) -> Column:
    """Texts of one cell in order. A cell is a piece of one printed page."""
    return in_order(F.collect_list(F.struct(*[F.col(c) for c in [*order, "text"]])))


def in_order(packed: Column) -> Column:
    """The texts of collected lines, sorted and joined; most are one line."""
    joined = F.array_join(F.transform(F.sort_array(packed), lambda p: p["text"]), " ")
    return F.when(F.size(packed) == 1, F.coalesce(packed[0]["text"], F.lit(""))).otherwise(joined)


def by_height(cell_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of pages of one piece, all others). Cells that don't say count among the others."""
    if "is_tall" not in cell_rows.columns:
        return cell_rows.where(F.lit(False)), cell_rows
    return cell_rows.where(~F.col("is_tall")), cell_rows.where("is_tall")


def cells(placed: DataFrame, group: Sequence[str] = ("doc", "page", "key", "block")) -> DataFrame:
    """One row per cell: group, cell, y0, y1, text, is_tall. `is_tall` says of a line whether its page has more
    than one piece: only then is anything carried from piece to piece. Lines that come partitioned
    by page stay where they are until they are cells."""
    cols = [*group, "x0", "y0", "y1", "text"]

    def of(lines):
        # What opens a cell is the first of its lines in their order.
        held = F.collect_list(F.struct("y0", "x0", "text", "y1")).alias("_lines")
        found = lines.groupBy(*group, "cell").agg(held)
        one, packed = F.size("_lines") == 1, F.col("_lines")
        y0 = F.when(one, packed[0]["y0"]).otherwise(F.sort_array(packed)[0]["y0"])
        y1 = F.when(one, packed[0]["y1"]).otherwise(F.array_max(F.transform(packed, lambda p: p["y1"])))
        return found.select(*group, "cell", y0.alias("y0"), y1.alias("y1"), in_order(packed).alias("text"))

    low = of(stitched_pieces(placed.where(~F.col("is_tall")).select(*cols), list(group))).withColumn("is_tall", F.lit(False))
    return low.unionByName(of(stitched(placed.where("is_tall").select(*cols), list(group))).withColumn("is_tall", F.lit(True)))


def row_bands(cell_rows: DataFrame, page: Sequence[str] = ("doc", "page")) -> tuple[DataFrame, DataFrame]:
    """(bands, merged). Bands are cut at the mid-points between neighbouring
    cells of the spine, the column with most cells (first key in document order
    on a tie), and are open at both ends. `merged` lists columns, other than the
    client's, that have fewer cells than the spine."""
    page = list(page)
    place_of = F.coalesce(
        F.array_position(F.array(*[F.lit(k) for k in STEP_KEYS]), F.col("key")).cast("int"), F.lit(len(STEP_KEYS) + 1)
    )
    counts_of = lambda df: df.groupBy(*page, "key").agg(F.count(F.lit(1)).alias("n"))
    counts = counts_of(cell_rows)
    # The counts of a page meet in one window: joined with their own maximum, every cell would be counted twice.
    named = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in page])
    merged = counts.where(named).withColumn("_most", F.max("n").over(W.partitionBy(*page))).where(
        (F.col("n") < F.col("_most")) & (F.col("key") != "clientStep")
    ).select(*page, "key")
    rank = F.struct("n", (-place_of).alias("p"))
    low, other = by_height(cell_rows)
    # A page of one piece is brought to one place, once.
    whole, down = W.partitionBy(*page), W.partitionBy(*page).orderBy("y0", "y1")
    met = low.where(named).select(*page, "key", "y0", "y1").repartition(*page).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*page, "key")))
    met = met.withColumn("_spine", F.max_by("key", rank).over(whole)).where(F.col("key") == F.col("_spine"))
    met = met.withColumns({"_py1": F.lag("y1").over(down), "_ny0": F.lead("y0").over(down), "band": F.row_number().over(down).cast("long")})
    spine = counts_of(other).groupBy(*page).agg(F.max_by("key", rank).alias("_spine"))
    spined = lookup_join(other, spine, page, "inner").where(F.col("key") == F.col("_spine")).select(*page, "y0", "y1")
    both = neighbours(
        spined, page, ["y0", "y1"], F.floor(F.col("y0") / TALL), {"_py1": "y1"}, {"_ny0": "y0"}, number="band"
    )
    cols = [*page, "band", "y0", "y1", "_py1", "_ny0"]
    bands = met.select(*cols).unionByName(both.select(*cols)).select(
        *page,
        "band",
        ((F.col("_py1") + F.col("y0")) / 2).alias("lo"),
        ((F.col("y1") + F.col("_ny0")) / 2).alias("hi"),
    )
    return bands, merged


def rows(cell_rows: DataFrame, bands: DataFrame, page: Sequence[str] = ("doc", "page")) -> DataFrame:
    """page, band, key, text, y0: cells placed in the band their vertical centre
    falls in; several texts of one (band, key) join in y order."""
    page = list(page)
    low, other = by_height(cell_rows)
    middle = lambda df: df.select(*page, "key", "text", "y0", ((F.col("y0") + F.col("y1")) / 2).alias("_c"))
    text = [joined_text(["y0"]).alias("text"), F.min("y0").alias("y0")]
    tall = other.select(*page).distinct()
    placed = bin_by_cuts(middle(other), lookup_join(bands, tall, page, "left_semi"), page, "_c", "lo", "band", TALL)
    out = placed.groupBy(*page, "band", "key").agg(*text)
    if "is_tall" not in cell_rows.columns:
        return out
    # Cells and cuts of a page of one piece meet in one window and stay there until they are rows.
    marks = lookup_join(bands, tall, page, "left_anti").where(F.col("lo").isNotNull())
    both = middle(low).withColumn("_rank", F.lit(1)).unionByName(marks.select(*page, F.col("lo").alias("_c"), F.lit(0).alias("_rank")), allowMissingColumns=True)
    down = W.partitionBy(*page).orderBy("_c", "_rank").rowsBetween(W.unboundedPreceding, 0)
    counted = both.withColumn("band", F.count_if(F.col("_rank") == 0).over(down) + 1).where(F.col("_rank") == 1)
    return counted.groupBy(*page, "band", "key").agg(*text).unionByName(out)


def table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, cells) of the tables on every page that has columns. Headers name
    columns but are not content. Columns are found and named from the outlines of the lines;
    the lines themselves are then brought to their page once and become cells there."""
    seen = settle(outlines(lines))
    inside = seen.where(~F.col("is_header"))
    cuts = settle(page_cuts(gutters(inside)))
    names = settle(name_columns(inside, header_fragments(seen), cuts))
    piece = lambda c: F.floor(F.col(c) / TALL)
    tall = (
        inside.groupBy(*PAGE).agg(F.min("y0").alias("_from"), F.max("last").alias("_to"), F.max("unplaced").alias("_un"))
        .select(*PAGE, F.coalesce((piece("_from") != piece("_to")) | F.col("_un"), F.lit(True)).alias("is_tall"))
    )
    keys = names.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("col", "key"))).alias("keys"))
    known = settle(cuts.join(keys, PAGE).join(tall, PAGE))
    content = lines.where(~is_header(F.col("text"))).select(*PAGE, "block", "x0", "x1", "y0", "y1", "text")
    placed = lookup_join(content, known, PAGE, "inner")
    return names, cells(placed.withColumn("key", F.element_at("keys", column_of(centre()))))


def demoted(row_cells: DataFrame, named: DataFrame, page: Sequence[str] = ("doc", "page")) -> DataFrame:
    """Row cells whose fee or time column was named only by position move to
    `unlabelled`: a figure is never published under a guessed heading."""
    guess = named.where(F.col("key").isin("fee", "processingTime") & (F.col("via") == "position"))
    guessed = guess.groupBy(*page).agg(F.collect_set("key").alias("_guessed"))
    out = lookup_join(row_cells, guessed, page, "left")
    doubtful = F.coalesce(F.array_contains("_guessed", F.col("key")), F.lit(False))
    return out.withColumn("key", F.when(doubtful, "unlabelled").otherwise(F.col("key"))).drop("_guessed")


def list_items(lines: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Lines that carry text, with `item` (its number within `by`), `opens`,
    `marked` and the piece of the item's text they contribute. A marker on a
    line of its own opens the next item and is kept unless that line repeats it;
    a line without any marker continues the item above."""
    by = list(by)
    flagged = lines.withColumn("_lone", F.col("text").rlike(MARKER_ONLY)).withColumn("_at", chunk)
    prev = previous(flagged, by, order, "_at", {"_plone": "_lone", "_ptext": "text"})
    kept = prev.where(~F.col("_lone"))
    own = F.col("text").rlike(MARKER_LEADING)
    pending = F.coalesce("_plone", F.lit(False))
    numbered = prefix_scan(kept, by, order, "_at", [Measure("_before", "count", F.lit(1), inclusive=False)])
    opens = pending | own | (F.col("_before") == 0)
    piece = F.when(pending & ~own, F.concat(F.trim("_ptext"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    out = numbered.withColumn("opens", opens).withColumn("marked", opens & (pending | own)).withColumn("piece", piece)
    return prefix_scan(out, by, order, "_at", [Measure("item", "sum", F.col("opens").cast("int"))]).drop(
        "_lone", "_plone", "_ptext", "_before", "_at"
    )


def items_of(item_lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per item: lines, marked, y0, y1. The item's text stays in its
    lines' pieces, however many they are."""
    return item_lines.groupBy(*by, "item").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max("marked").alias("marked"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
    )


def adjacent_groups(lines: DataFrame, by: Sequence[str], chunk: Column) -> DataFrame:
    """Lines with `grp`: consecutive lines of one block with small gaps. A new
    group starts where the block changes or the gap reaches the gate."""
    by = list(by)
    order = ["y0", "x0", "text"]
    prev = previous(lines.withColumn("_at", chunk), by, order, "_at", {"_pblock": "block"})
    turn = F.when(F.col("_pblock").isNull() | (F.col("_pblock") != F.col("block")), 1).otherwise(0)
    runs = prefix_scan(prev.withColumn("_turn", turn), by, order, "_at", [Measure("_run", "sum", F.col("_turn"))])
    out = stitched(runs.drop("_pblock", "_turn", "_at"), [*by, "_run"])
    return out.withColumn("grp", F.struct("_run", "cell")).drop("_run", "cell", "opens")


def consecutive(numbers: DataFrame, by: Sequence[str], order: Sequence[str], value: str, chunk: Column) -> DataFrame:
    """by, consecutive: whether the numbers of a group count up by one."""
    by = list(by)
    prev = previous(numbers, by, order, chunk, {"_before": value})
    broken = F.col("_before").isNotNull() & (F.col(value) != F.col("_before") + 1)
    return prev.groupBy(*by).agg((F.count_if(broken) == 0).alias("consecutive"))
