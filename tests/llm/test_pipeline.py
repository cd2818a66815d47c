"""The pipeline's stages, each on its predecessor's output, the middle ones against brute force."""

from __future__ import annotations

import collections

import corpus_pipeline
import sentencepiece
from test_operators import brute_components

from kinfold.llm import mixing, quality
from kinfold.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def checked(spark, docs, tmp_path, labels_dir):
    """Runs the stages one by one, each held against brute force on its own input; the last one's rows."""
    judge = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    columns = docs.columns
    at = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at[-1], labels_dir).write.parquet(f"{tmp_path}/{k}")
        at.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(df.columns == columns for df in at[:-1])
    given, good, exact, near, mixed = [[tuple(r) for r in df.collect()] for df in at[:-1]]
    last = at[-1].collect()
    i, t, s = (columns.index(c) for c in ("doc_id", "text", "source"))
    text = lambda row: row[t] or ""
    # 6: the rows that the fitted score keeps, and no others
    model = quality.fit(docs, spark.read.parquet(f"{labels_dir}/labels.parquet"))
    score = model.scorer()
    assert collections.Counter(good) == collections.Counter(r for r in given if score(text(r).encode()) >= 0.3)
    # 7: one row a text, with the largest id
    best: dict = {}
    for r in good:
        key = text(r).encode().lower()
        best[key] = max(best.get(key, (False, 0)), (r[i] is not None, r[i] or 0))
    assert collections.Counter((text(r).encode().lower(), (r[i] is not None, r[i] or 0)) for r in exact) == collections.Counter(best.items())
    assert not collections.Counter(exact) - collections.Counter(good)
    # 1: one row a component, with the smallest id
    number = {k: (r[i] is None, r[i] or 0, k) for k, r in enumerate(exact)}
    place = {k: n for n, k in enumerate(sorted(number, key=number.get))}
    kept = [exact[k] for k, n in place.items() if (n, n) in {(a, c) for a, _, c in brute_components([(place[k], exact[k][t]) for k in number])}]
    assert collections.Counter((r[i], text(r)) for r in near) == collections.Counter((r[i], text(r)) for r in kept)
    # 4: each source's words come near its target, no row more than three times, nothing that wasn't there
    words = lambda r: len(text(r).encode().split())
    sizes, taken = collections.Counter({r[s]: 0 for r in near}), collections.Counter()
    for r in near:
        sizes[r[s]] += words(r)
    for r in mixed:
        taken[r[s]] += words(r)
    want = mixing.targets(dict(sizes))
    longest = max(map(words, near), default=0)
    assert all(abs(taken[x] - want[x]) <= longest / 2 + 1 for x in sizes)
    times = collections.Counter(mixed)
    assert set(mixed) <= set(near) and all(n <= 3 * near.count(r) for r, n in times.items())
    # 3: the library's own ids of each whole text
    ids = lambda x: judge.encode(x)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.text, r.parity) for r in last) == collections.Counter((r[i], tuple(ids(text(r))), text(r).replace("▁", " "), True) for r in mixed)
    assert all(r.n_tokens == len(r.ids) for r in last)
    return last


def test_stages(spark, tmp_path):
    assert checked(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path, SF)


def test_stages_of_odd_rows(spark, tmp_path):
    """Null and empty texts, rows without an id, repeated rows, repeated ids with other texts, null sources, clashing column names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id AS _keep", "text AS digest", "1 AS _row", "'x' AS sources", "0 AS size", "2 AS tie", "3 AS sid", "4 AS key", "5 AS row")
    odd = docs.filter("doc_id % 5 = 0")
    docs = docs.unionByName(odd).unionByName(odd.withColumn("doc_id", odd["doc_id"] + 1)).unionByName(odd.selectExpr("cast(null AS bigint) AS doc_id", *[c for c in docs.columns if c != "doc_id"]))
    docs = docs.unionByName(docs.limit(6).selectExpr("doc_id", "cast(null AS string) AS text", *docs.columns[2:])).unionByName(docs.limit(3).selectExpr("cast(null AS bigint) AS doc_id", "'' AS text", *docs.columns[2:]))
    docs = docs.selectExpr(*[c if c != "source" else "CASE WHEN crc32(cast(text AS binary)) % 4 = 0 THEN null ELSE source END AS source" for c in docs.columns])
    docs.write.parquet(f"{tmp_path}/docs")
    assert checked(spark, spark.read.parquet(f"{tmp_path}/docs"), tmp_path, SF)


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    assert not checked(spark, docs, tmp_path, SF)


def test_run_leaves_only_its_result(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and len({f.rsplit("/", 1)[0] for f in out.inputFiles()}) == 1
