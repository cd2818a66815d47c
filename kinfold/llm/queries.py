"""The queries of the dealt operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, fim, licenses, mixing, ngram_join, ppm, quality, sentencepieces, suffix_dedup, token_files, topk
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), with_groups=False)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50, with_text=False)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_lm_scoring, op3_sentencepiece, op4_mixing, op5_suffix_dedup, op6_quality, op7_exact_dedup, op8_topk, op9_licenses, op10_token_files, op11_alignment, op12_fim, op13_bpe)}

ORACLE_SQL = {
    "op1_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
    """,
    "op4_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM d GROUP BY source),
        o AS (SELECT *, CAST((SELECT sum(ss) FROM s) - coalesce(sum(3 * ss) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS words,
              CAST(sum(w) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS ws FROM s),
        c AS (SELECT words, ws FROM o WHERE NOT words * w / ws > 3 * ss ORDER BY ss::DOUBLE / w, source NULLS LAST LIMIT 1),
        t AS (SELECT source, ss, CASE WHEN c.words * w / c.ws > 3 * ss THEN CAST(3 * ss AS DOUBLE) ELSE c.words * w / c.ws END AS target FROM o, c),
        g AS (SELECT *, CASE WHEN ss = 0 THEN 1 ELSE least(3, CAST(round_even(target, 0) AS BIGINT) // ss) END AS n, CASE WHEN ss = 0 THEN 0 ELSE CAST(round_even(target, 0) AS BIGINT) - least(3, CAST(round_even(target, 0) AS BIGINT) // ss) * ss END AS rest FROM t),
        r AS (SELECT d.*, g.ss, g.target, g.n, g.rest, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, ss AS source_size, target, CAST(n * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken FROM r
    """,
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM n
    """,
    "op8_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op12_fim": """
        WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, CAST(1 + 8 * k AS BIGINT), 8) AS BIGINT)) AS d FROM u),
        c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS hi,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
        p AS (SELECT doc_id, n, form, text, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p
    """,
}
