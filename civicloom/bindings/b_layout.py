from __future__ import annotations

from pyspark.sql import functions as F

from civicloom.bindings.registry import Tables, query
from civicloom.operators import layout as L
from civicloom.operators.skew import lookup_join, ordinal, settle

WIDTH = 612.0
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
NUM = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def items(t: Tables):
    """lineitem numbered within its order."""
    base = t.lineitem.select("l_orderkey", *ORDER, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return ordinal(base, ["l_orderkey"], ORDER, F.floor(F.col("l_linenumber") / 4096), "i")


def _line(block, x0, y0, x1, text, height=10.0):
    y = y0 if not isinstance(y0, (int, float)) else F.lit(float(y0))
    return F.struct(
        block.cast("long").alias("block"),
        F.lit(float(x0)).alias("x0"),
        y.cast("double").alias("y0"),
        F.lit(float(x1)).alias("x1"),
        (y + height).cast("double").alias("y1"),
        text.alias("text"),
    )


def owned_items(t: Tables):
    owner = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"))
    return items(t).join(owner, "l_orderkey")


def table_lines(t: Tables, numbered=None):
    """Every order line as one printed table row of five cells; some office
    actions wrap onto a second line of the same block. A customer's orders are the pages of one document."""
    i = F.col("i")
    y = i * 40.0 + 200.0
    num = lambda c: F.col(c).cast("int").cast("string")
    cells = F.array(
        _line(i * 10, 40, y, 150, F.concat(F.lit("Submit form "), num("l_partkey"))),
        _line(i * 10 + 1, 170, y, 290, F.concat(F.lit("Check part "), num("l_partkey"))),
        F.when(F.col("l_discount") > 0.05, _line(i * 10 + 1, 170, y + 12.0, 250, F.lit("again"))),
        _line(i * 10 + 2, 310, y, 360, F.when(F.col("l_tax") == 0, "None").otherwise(F.concat(F.lit("PHP "), num("l_quantity"), F.lit(".00")))),
        _line(i * 10 + 3, 380, y, 440, F.concat(i.cast("string"), F.lit(" Minutes"))),
        _line(i * 10 + 4, 460, y, 560, F.concat(F.lit("Officer "), num("l_suppkey"))),
    )
    return (owned_items(t) if numbered is None else numbered).select(
        F.col("l_orderkey").alias("page"), "doc", F.lit(WIDTH).alias("page_width"), F.inline(F.filter(cells, lambda c: c.isNotNull()))
    )


def page_lines(t: Tables):
    """The head of every service: banner, heading, labelled fields, checklist and,
    for two statuses of three, the column headers."""
    s, k = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    one = F.lit(100000)
    banner = F.when(s == "F", "External Services").when(s == "O", "INTERNAL  SERVICES").otherwise("General notes")
    head = F.when(s != "P", F.array(
        _line(one + 9, 40, 160, 120, F.lit("CLIENT STEPS")),
        _line(one + 10, 170, 160, 260, F.lit("AGENCY ACTION")),
        _line(one + 11, 310, 160, 360, F.lit("FEES TO BE PAID")),
        _line(one + 12, 380, 160, 445, F.lit("PROCESSIN G TIME")),
        _line(one + 13, 460, 160, 560, F.lit("PERSON RESPONSIBLE")),
    )).otherwise(F.array().cast("array<struct<block:bigint,x0:double,y0:double,x1:double,y1:double,text:string>>"))
    fixed = F.array(
        _line(one, 40, 20, 200, banner),
        _line(one + 1, 40, 40, 300, F.concat(F.lit("7. Renew  licence "), k)),
        _line(one + 2, 40, 60, 130, F.lit("Office or Division:")),
        _line(one + 3, 200, 57, 320, F.concat(F.lit("Office "), F.col("o_orderpriority"))),
        _line(one + 4, 500, 58, 560, F.lit("Form A")),
        _line(one + 5, 40, 80, 200, F.concat(F.lit("Classification: "), s)),
        _line(one + 6, 40, 100, 200, F.lit("CHECKLIST OF REQUIREMENTS")),
        _line(one + 7, 60, 120, 140, F.lit("1. Valid ID")),
        _line(one + 8, 470, 120, 540, F.lit("Registrar")),
        _line(one + 14, 280, 3990, 320, F.lit("3 | Page")),
    )
    return t.orders.select(
        F.col("o_orderkey").alias("page"), F.inline(F.concat(fixed, head))
    )


def checklist_lines(t: Tables):
    """More of the checklist of services with a steps header, by the last digit of
    the order: a wrapped item, a marker set apart, a fragment, two places beside one
    item, and an item that runs on below the steps header."""
    one, v = F.lit(100000), F.col("o_orderkey") % 5
    fee = F.when(F.col("o_orderkey") % 2 == 0, "PHP 50.00").otherwise("Window 4")
    more = F.array(
        F.when(v == 1, _line(one + 7, 60, 131, 180, F.lit("with two copies"))),
        F.when(v == 2, _line(one + 15, 40, 133, 50, F.lit("2."))),
        F.when(v == 2, _line(one + 16, 60, 133, 150, F.lit("Barangay clearance"))),
        F.when(v == 2, _line(one + 17, 470, 133, 540, F.lit("Treasurer"))),
        F.when(v == 3, _line(one + 15, 60, 133, 90, F.lit("2. x"))),
        F.when(v == 4, _line(one + 17, 470, 125, 540, fee)),
        F.when((v == 0) & F.col("timed"), _line(one + 15, 60, 185, 150, F.lit("3. Police clearance"))),
        F.when((v == 0) & F.col("timed"), _line(one + 17, 470, 185, 540, F.lit("Station"))),
    )
    timed = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("timed", F.lit(True))
    headed = t.orders.where(F.col("o_orderstatus") != "P").join(timed, "o_orderkey", "left").withColumn("timed", F.coalesce("timed", F.lit(False)))
    return headed.select(F.col("o_orderkey").alias("page"), F.inline(F.filter(more, lambda c: c.isNotNull())))


def with_doc(t: Tables, lines):
    """A customer's orders are the pages of one document."""
    owner = t.orders.select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("doc"))
    return lines.join(owner, "page").withColumn("page_width", F.lit(WIDTH))


def table_layout(t: Tables):
    return table_lines(t)


def full_layout(t: Tables):
    return table_lines(t, settle(owned_items(t))).unionByName(with_doc(t, page_lines(t).unionByName(checklist_lines(t))))


ITEMS = f"items AS (SELECT *, o_custkey AS doc, l_orderkey AS page FROM (SELECT *, {NUM} AS i FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)"


@query("win_gutters", f"""WITH {ITEMS},
g(lo, hi) AS (VALUES (151, 169), (291, 309), (361, 379), (441, 459))
SELECT DISTINCT doc, page, lo, hi FROM items, g""")
def _(t):
    return L.gutters(table_layout(t))


@query("win_gutters_data", """
WITH s AS (SELECT l_orderkey AS page, CAST(floor(l_extendedprice / 100) AS BIGINT) AS lo, CAST(ceil(l_extendedprice / 100 + l_quantity) AS BIGINT) AS hi
  FROM lineitem WHERE l_quantity <= 1100 * 0.55),
r AS (SELECT page, lo, max(hi) OVER (PARTITION BY page ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT page, reach + 1 AS lo, lo - 1 AS hi FROM r WHERE lo - 1 - (reach + 1) >= 5""")
def _(t):
    lines = t.lineitem.select(
        F.lit(0).alias("doc"), F.col("l_orderkey").alias("page"), F.lit(1100.0).alias("page_width"),
        (F.col("l_extendedprice") / 100).alias("x0"), (F.col("l_extendedprice") / 100 + F.col("l_quantity")).alias("x1"),
    )
    return L.gutters(lines).drop("doc")


def headed_layout(t: Tables):
    """The steps tables with their column headers, where they have them. Items are numbered once: their lines are read more than once."""
    heads = page_lines(t).where(F.col("y0") == 160)
    return table_lines(t, settle(owned_items(t))).unionByName(with_doc(t, heads))


NAMED = f"""{ITEMS}, nm(col, key, guess) AS (VALUES (0, 'clientStep', 'position'), (1, 'agencyAction', 'position'), (2, 'fee', 'content'),
  (3, 'processingTime', 'content'), (4, 'personResponsible', 'position'))"""


@query("win_columns", f"""WITH {ITEMS},
g(col, x0, x1) AS (VALUES (0, NULL, 160.0), (1, 160.0, 300.0), (2, 300.0, 370.0), (3, 370.0, 450.0), (4, 450.0, NULL))
SELECT DISTINCT doc, page, col, x0, x1 FROM items, g""")
def _(t):
    return L.columns(L.gutters(table_layout(t)))


@query("win_name_columns", f"""WITH {NAMED}
SELECT DISTINCT doc, page, col, key, CASE WHEN o_orderstatus <> 'P' THEN 'header' ELSE guess END AS via FROM items, nm""")
def _(t):
    return L.table(headed_layout(t))[0]


CELLS = f"""{ITEMS}, cells AS (SELECT doc, page, i, o_orderstatus, unnest(['clientStep', 'agencyAction', 'fee', 'processingTime', 'personResponsible']) AS key,
  unnest(['Submit form ' || l_partkey, 'Check part ' || l_partkey || CASE WHEN l_discount > 0.05 THEN ' again' ELSE '' END,
    CASE WHEN l_tax = 0 THEN 'None' ELSE 'PHP ' || CAST(l_quantity AS INTEGER) || '.00' END, i || ' Minutes', 'Officer ' || l_suppkey]) AS text FROM items)"""


def cell_rows(t: Tables):
    names, found = L.table(headed_layout(t))
    return names, settle(found)


@query("win_cells", f"WITH {CELLS} SELECT doc, page, key, text, 200.0 + 40 * i AS y0 FROM cells")
def _(t):
    return L.table(headed_layout(t))[1].select("doc", "page", "key", "text", "y0")


@query("win_row_bands", f"""WITH {ITEMS}
SELECT doc, page, i AS band, CASE WHEN i > 1 THEN (200.0 + 40 * (i - 1) + 10 + 200.0 + 40 * i) / 2 END AS lo,
  CASE WHEN i < max(i) OVER (PARTITION BY page) THEN (200.0 + 40 * i + 10 + 200.0 + 40 * (i + 1)) / 2 END AS hi FROM items""")
def _(t):
    return L.row_bands(cell_rows(t)[1])[0]


@query("jn_row_band", f"WITH {CELLS} SELECT doc, page, i AS band, key, text FROM cells")
def _(t):
    _, found = cell_rows(t)
    return L.rows(found, L.row_bands(found)[0]).select("doc", "page", "band", "key", "text")


@query("win_untrusted_demote", f"""WITH {CELLS},
k AS (SELECT *, CASE WHEN l_d AND o_orderstatus = 'P' AND key = 'fee' THEN 'unlabelled' ELSE key END AS k2 FROM (SELECT *, true AS l_d FROM cells))
SELECT doc, page, i AS band, k2 AS key, text FROM k""")
def _(t):
    names, found = cell_rows(t)
    rows = L.rows(found, L.row_bands(found)[0])
    # Pages without headers: pretend the fee column was only guessed.
    doubt = names.withColumn("via", F.when((F.col("key") == "fee") & (F.col("via") == "content"), "position").otherwise(F.col("via")))
    return L.demoted(rows, doubt).select("doc", "page", "band", "key", "text")


@query("win_merged_columns", f"""WITH {ITEMS},
n AS (SELECT doc, page, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS fees FROM items GROUP BY 1, 2)
SELECT doc, page, 'fee' AS key FROM n WHERE fees > 0 AND fees < n""")
def _(t):
    base = items(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc")), "l_orderkey")
    cells = base.select(
        "doc", F.col("l_orderkey").alias("page"), (F.col("i") * 40.0).alias("y0"), (F.col("i") * 40.0 + 10).alias("y1"),
        F.explode(F.filter(F.array(F.lit("agencyAction"), F.when(F.col("l_returnflag") == "R", "fee")), lambda k: k.isNotNull())).alias("key"),
    )
    return L.row_bands(cells)[1]


@query("srt_reading_order", f"""WITH {ITEMS} SELECT doc, page, 200.0 + 40 * i AS y0, 'Submit form ' || l_partkey AS text FROM items ORDER BY 1, 2, 3""")
def _(t):
    return L.reading_order(table_layout(t).where(F.col("x0") == 40)).select("doc", "page", "y0", "text")


@query("jn_nearest_right", """
SELECT o_custkey AS doc, o_orderkey AS page, 'Office ' || o_orderpriority AS value FROM orders""")
def _(t):
    from civicloom.operators.intervals import nearest_right

    lines = with_doc(t, page_lines(t))
    labels = lines.where(F.col("text").rlike(r"(?i)^office\s+or\s+division\s*[:?]?\s*$")).withColumn("label", F.lit("office"))
    texts = lines.where(F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.col("text").rlike(r"(?i)^office\s+or\s+division"))
    return nearest_right(labels, texts, ["doc", "page"], "label").select("doc", "page", F.col("value.text").alias("value"))


# ---------------------------------------------------------------- lines of text


def conv_lines(t: Tables):
    """Turns of a conversation as ordered lines with a printed position."""
    return t.conversations.select("conv_id", "turn", "role", "text")


@query("win_segment", """
WITH l AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)
SELECT conv_id, turn, seg FROM l WHERE seg > 0""")
def _(t):
    from civicloom.operators.segments import segment

    return segment(conv_lines(t), ["conv_id"], ["turn"], F.col("role") == "user", F.floor(F.col("turn") / 4096)).select("conv_id", "turn", "seg")


@query("win_section_fill", """
WITH l AS (SELECT conv_id, turn, CASE WHEN text || ' ' || coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') ILIKE '%the%of%' THEN
   CASE WHEN role = 'user' THEN 'external' ELSE 'internal' END END AS b FROM conversations)
SELECT conv_id, turn, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'unknown') AS section FROM l""")
def _(t):
    from civicloom.operators.segments import section_fill

    return section_fill(
        conv_lines(t), ["conv_id"], ["turn"], "text",
        lambda two_lines: F.when(two_lines.rlike("(?is)the.*of"), F.when(F.col("role") == "user", "external").otherwise("internal")),
        F.floor(F.col("turn") / 4096),
    ).select("conv_id", "turn", "section")


@query("win_header_region", """
WITH f AS (SELECT conv_id, min(turn) AS s FROM conversations WHERE role = 'assistant' GROUP BY 1),
r AS (SELECT c.conv_id, turn, text FROM conversations c JOIN f ON f.conv_id = c.conv_id WHERE turn BETWEEN s AND s + 2)
SELECT conv_id, md5(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\\s+', '', 'g')) AS header FROM r GROUP BY 1""")
def _(t):
    from civicloom.operators.segments import header_region

    out = header_region(conv_lines(t), ["conv_id"], "turn", "text", F.col("role") == "assistant", 2)
    return out.select("conv_id", F.md5("header").alias("header"))


MARKS = """m AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN '-' WHEN 'user' THEN (turn % 9 + 1) || '. Item ' || turn ELSE 'more ' || turn END AS text FROM conversations)"""


def marked_lines(t: Tables):
    text = (
        F.when(F.col("role") == "system", "-")
        .when(F.col("role") == "user", F.format_string("%s. Item %s", (F.col("turn") % 9 + 1).cast("string"), F.col("turn").cast("string")))
        .otherwise(F.format_string("more %s", F.col("turn").cast("string")))
    )
    return t.conversations.select("conv_id", "turn", text.alias("text"), (F.col("turn") * 12.0).alias("y0"), (F.col("turn") * 12.0 + 9).alias("y1"))


@query("win_list_items", f"""WITH {MARKS},
p AS (SELECT *, text = '-' AS lone, lag(text = '-') OVER (PARTITION BY conv_id ORDER BY turn) AS plone FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p WHERE NOT lone),
o AS (SELECT *, coalesce(plone, false) OR text LIKE '%. Item%' OR n = 1 AS opens,
  CASE WHEN plone AND text NOT LIKE '%. Item%' THEN '- ' || text ELSE text END AS piece FROM k),
g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM o)
SELECT conv_id, turn, item, piece, bool_or(opens AND (coalesce(plone, false) OR text LIKE '%. Item%')) OVER (PARTITION BY conv_id, item) AS marked,
  min(turn * 12.0) OVER (PARTITION BY conv_id, item) AS y0 FROM g""")
def _(t):
    lines = L.list_items(marked_lines(t), ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096))
    found = L.items_of(lines, ["conv_id"]).select("conv_id", "item", "marked", "y0")
    return lookup_join(lines.select("conv_id", "item", "turn", "piece"), found, ["conv_id", "item"], "inner")


@query("win_consecutive", """
WITH n AS (SELECT conv_id, turn, length(text) % 3 + turn AS v FROM conversations),
p AS (SELECT *, lag(v) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM n)
SELECT conv_id, bool_and(b IS NULL OR v = b + 1) AS consecutive FROM p GROUP BY 1""")
def _(t):
    n = t.conversations.select("conv_id", "turn", (F.length("text") % 3 + F.col("turn")).alias("v"))
    return L.consecutive(n, ["conv_id"], ["turn"], "v", F.floor(F.col("turn") / 4096))


@query("win_adjacent_groups", """
WITH e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1000000.0 / 60 AS y0, epoch_us(ts) / 1000000.0 / 60 + value AS y1 FROM events),
c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS turn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY y0)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY y0) AS run FROM c),
x AS (SELECT *, max(y1) OVER (PARTITION BY user_id, run ORDER BY y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
o AS (SELECT *, CASE WHEN reach IS NULL OR y0 - reach >= greatest(value, 8.0) * 1.35 THEN 1 ELSE 0 END AS opens FROM x),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, run ORDER BY y0) AS cell FROM o)
SELECT user_id, run, cell, count(*) AS lines FROM g GROUP BY 1, 2, 3""")
def _(t):
    y0 = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) / 60
    lines = t.events.select(
        "user_id", F.col("event_type").alias("block"), y0.alias("y0"), (y0 + F.col("value")).alias("y1"),
        F.lit(0.0).alias("x0"), F.col("event_id").cast("string").alias("text"),
    )
    # The height of a line is its value, up to rounding of the two ends.
    grouped = L.adjacent_groups(lines, ["user_id"], F.floor(F.col("y0") / 10080.0))
    return grouped.groupBy("user_id", F.col("grp._run").alias("run"), F.col("grp.cell").alias("cell")).agg(F.count(F.lit(1)).alias("lines"))


@query("flt_page_furniture", """
WITH l AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), [doc_id || ' | Page', 'Page ' || (doc_id % 1000) || ' of 9', '  '])) AS line FROM documents)
SELECT doc_id, count(*) AS kept FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '(?i)^\\s*\\d{1,3}\\s*\\|\\s*Page\\s*$|^\\s*Page\\s+\\d{1,3}(\\s+of\\s+\\d+)?\\s*$') GROUP BY 1""")
def _(t):
    noise = F.array(
        F.concat(F.col("doc_id").cast("string"), F.lit(" | Page")),
        F.concat(F.lit("Page "), (F.col("doc_id") % 1000).cast("string"), F.lit(" of 9")),
        F.lit("  "),
    )
    lines = t.documents.select("doc_id", F.explode(F.concat(F.split("text", "\n"), noise)).alias("line"))
    return lines.where(~L.is_furniture(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("flt_header_cells", """
WITH l AS (SELECT doc_id, lang, unnest(['CLIENT STEPS', 'PROCESSIN G TIME', 'time', lang || ' TIME', upper(source), split_part(text, chr(10), 1)]) AS line FROM documents)
SELECT doc_id, line FROM l WHERE line NOT IN ('CLIENT STEPS', 'PROCESSIN G TIME')""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.array(
        F.lit("CLIENT STEPS"), F.lit("PROCESSIN G TIME"), F.lit("time"), F.concat("lang", F.lit(" TIME")), F.upper("source"),
        F.split_part("text", F.lit("\n"), F.lit(1)),
    )).alias("line"))
    return lines.where(~L.is_header(F.col("line")))
