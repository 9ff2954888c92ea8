"""Registration of the subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicloom.llm import automata, bpe, bwt, decontaminate, embedding_dedup, line_dedup, ngram_join, pii, quality, secrets, toxicity, vector_codes, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

ORACLE["op4_decontaminate"] = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i + 1 : i + 10] AS x FROM iw, unnest(range(greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
hit AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, w[s + 1 : s + n] AS x FROM dw, sizes, unnest(range(len(w) - n + 1)) t(s)) JOIN win USING (x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLE["op5_ngram_join"] = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM dw, unnest(range(greatest(len(w) - 4, 1))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM dw UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""

ORACLE["op8_automata"] = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS x FROM dw, unnest(range(len(w) - 49)) t(s)),
first AS (SELECT x, min(doc_id) AS d FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN first USING (x) WHERE d < doc_id)),
word AS (SELECT doc_id, p, w[p + 1] AS t FROM dw, unnest(range(len(w))) u(p)),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM dw LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment and mean, one table expression each."""
    parts = """
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS (SELECT vec_id, label, list_transform(v, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM kept),
p AS (SELECT vec_id, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS x FROM x, unnest(range(4)) t(p)),
b0 AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)"""
    near = "SELECT vec_id, p.p, arg_min(e, (list_dot_product(c, c) - 2 * list_dot_product(x, c), e)) AS e, any_value(x) AS x, min(list_dot_product(c, c) - 2 * list_dot_product(x, c)) + any_value(list_dot_product(x, x)) AS d FROM p JOIN {b} b ON p.p = b.p GROUP BY 1, 2"
    for r in range(1, rounds + 1):
        parts += f""",
a{r} AS ({near.format(b=f"b{r - 1}")}),
m{r} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r - 1} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""
    return parts + f""",
last AS ({near.format(b=f"b{rounds}")}),
sha AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
code AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code JOIN x USING (vec_id), sha"""


ORACLE["op13_vector_codes"] = _codes_sql()


def _query(name: str, *tables: str):
    """Registers a function of whole tables."""

    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables])
        return fn

    return register


_query("op1_pii", "documents")(pii.report)
_query("op2_line_dedup", "documents")(line_dedup.report)
_query("op3_embedding_dedup", "embeddings")(embedding_dedup.dedup)
_query("op4_decontaminate", "documents", "benchmark")(decontaminate.report)
_query("op5_ngram_join", "documents")(ngram_join.report)
_query("op6_bwt", "documents")(bwt.report)


@_query("op7_bpe", "documents")
def _bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return bpe.report(docs, public_tokenizers.path("byte_bpe_50k.json"))


_query("op8_automata", "documents")(automata.report)
_query("op9_secrets", "documents")(secrets.report)
_query("op10_quality", "documents", "labels")(quality.report)
_query("op11_toxicity", "documents", "labels")(toxicity.report)
_query("op12_whitening", "embeddings")(whitening.report)
_query("op13_vector_codes", "embeddings")(vector_codes.report)
