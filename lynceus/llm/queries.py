"""The opN_ queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import decontaminate as bench
from lynceus.llm import chat, langid, ppm, toxicity, warc
from lynceus.llm.fmindex import removed
from lynceus.llm.minhash import near_duplicates
from lynceus.llm.packing import pack
from lynceus.llm.topk import topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench.digest(bench.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(_table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ppm.fit(docs.filter(~langid.held_out("doc_id", 10)))
    scored = ppm.score(docs, model)
    return scored.select("doc_id", langid.held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id", 5))
    model = langid.fit(docs.filter("not held_out").select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~langid.held_out("doc_id", 5)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", langid.held_out("doc_id", 5).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(_table(spark, sf_dir, "conversations"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, found by its URL in the index."""
    pages = _table(spark, sf_dir, "pages")
    return warc.write(pages).fetch(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm": op1_ppm,
    "op2_langid": op2_langid,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_topk": op5_topk,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_warc": op10_warc,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
low AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM win),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM low WHERE first_doc < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, p, k, item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP9 = """
WITH m AS (SELECT conv_id, '<|im_start|>' || replace(coalesce(role, ''), '<|', '<\\|') || chr(10) || replace(coalesce(text, ''), '<|', '<\\|') || '<|im_end|>' || chr(10) AS line,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, p, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY p) AS upto FROM m),
f AS (SELECT upto, n, min(conv_id) AS conv_id FROM r WHERE p = n GROUP BY upto, n)
SELECT conv_id, n AS n_turns, upto AS rendered FROM f WHERE upto NOT IN (SELECT upto FROM r WHERE p < n)
"""

_OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS s FROM w),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(0) ORDER BY s)) AS h FROM g GROUP BY doc_id),
rep AS (SELECT h, n, min(doc_id) AS r FROM sets GROUP BY h, n),
rs AS (SELECT r, n, s FROM rep JOIN g ON doc_id = r),
pairs AS (SELECT x.r AS a, y.r AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM rs x JOIN rs y ON x.s = y.s AND x.r < y.r AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY x.r, y.r),
e AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r AS node, r AS root FROM rep UNION SELECT e2.b, reach.root FROM reach JOIN e2 ON e2.a = reach.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (h, n) LEFT JOIN comp ON node = r
"""

# base 32 by hand: each five hex digits are four digits of five bits
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || upper(substr(h, (i // 4) * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '')"
_OP10 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN m USING (h)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": _OP4,
    "op5_topk": _OP5,
    "op6_minhash_dedup": _OP6,
    "op7_decontaminate": _OP7,
    "op9_chat": _OP9,
    "op10_warc": _OP10,
}
