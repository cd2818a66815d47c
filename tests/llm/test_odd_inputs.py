"""Clashing names, letters that normalising takes apart, long texts: cases that the operators' other tests lack."""

import random

import numpy as np
import public_tokenizers
import pytest

from kinfold.llm import exact_dedup, licenses, mixing, ngram_join, suffix_dedup, token_files

NAMES = "doc_id long, text string, source string, _copy int, `a.b` string, _ROW int, TEXT string, `_0_column` int, _times int, row int, Doc_Id string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, s, k, "x", k + 1, "other", k + 2, k + 3, k + 4, "id") for k, (i, t, s) in enumerate(rows)], NAMES)


@pytest.mark.parametrize("operator", [mixing.mixed_documents, exact_dedup.dedup, ngram_join.representatives])
def test_columns_of_any_name_pass_through(spark, operator):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "a"), (2, text.upper(), "a"), (3, text + " thirteen", "b"), (None, "alone here", None), (5, None, "b"), (6, "", "c"), (7, "some other words entirely, without any copy", "c")]
    docs = clashing(spark, rows)
    got = operator(docs)
    assert got.columns == docs.columns
    whole = {tuple(r) for r in docs.collect()}
    made = [tuple(r) for r in got.collect()]
    assert made and set(made) <= whole
    kept = {r[0] for r in made}
    assert {None, 7} <= kept and (operator is mixing.mixed_documents or (2 in kept and 1 not in kept if operator is exact_dedup.dedup else 1 in kept and not {2, 3} & kept))
    assert operator(docs.limit(0)).columns == docs.columns and operator(docs.limit(0)).count() == 0


def test_all_stages_of_the_pipeline_carry_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(spark, [(1, text, "a"), (2, text + " thirteen", "b"), (None, None, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 3


def test_shards_follow_the_texts(spark, monkeypatch):
    """More texts than Spark's shards hold get more shards, with the same result."""
    docs = spark.createDataFrame([(k, f"text {k % 300}") for k in range(900)], "doc_id long, text string")
    want = sorted(map(tuple, exact_dedup.groups(docs).collect()))
    kept = sorted(map(tuple, exact_dedup.dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "SHARD_TEXTS", 4)
    assert exact_dedup._dealt(docs.withColumnRenamed("text", "digest"), 900).rdd.getNumPartitions() == 225
    assert sorted(map(tuple, exact_dedup.groups(docs).collect())) == want and sorted(map(tuple, exact_dedup.dedup(docs).collect())) == kept
    assert exact_dedup.live_index(docs).select("shards").first()[0] == 225


def taken_apart():
    import unicodedata

    every = map(chr, [*range(0xD800), *range(0xE000, 0x110000)])
    return [c for c in every if len(unicodedata.normalize("NFC", c)) != 1 or len(c.lower()) != 1]


def test_letters_that_normalising_takes_apart_before_marks():
    """Every character that composing or lower-casing changes in length, before each mark, after a letter and alone."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    enc = token_files.WordEncoder(path)
    texts = [f"{before}{c}{m} x" for c in taken_apart() for before in ("", "a", "é") for m in (*map(chr, token_files.MARKS), "...", ").")]
    texts += ["হয়, ...", "पेड़.", "İ.", "é, x", "ẹ́.", "ﬁ.", "ǅ!", "Å.", "क़?"]
    assert len(texts) > 500
    for t, ids, e in zip(texts, enc.batch([t.encode() for t in texts]), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == np.array(e.ids, "<u4").tobytes(), t


def test_licenses_of_a_long_collection_take_time_in_proportion():
    """Each of many copies of a license is found once, and ten times as many take no more than some twenty times as long."""
    import time

    s = licenses.Scanner(licenses.TEMPLATES)
    text = licenses.TEMPLATES["MIT-text"]
    took = []
    for n in (20, 200):
        began = time.process_time()
        got = s.scan("\n".join([text] * n).encode())
        took.append(time.process_time() - began)
        assert [m[0] for m in got] == ["MIT-text"] * n and all(m[3] == 0 for m in got)
        assert all(a[5] <= b[4] for a, b in zip(got, got[1:], strict=False))
    assert took[1] < 25 * took[0] + 0.5


def test_license_rows_without_an_id_and_repeated(spark):
    text = licenses.TEMPLATES["Apache-2.0-notice"]
    rows = [(None, text), (None, text), (3, text), (3, "x " + text), (4, None), (5, "")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"]) for r in got.collect()) == [(False, 3, 0), (False, 3, 2), (True, 0, 0), (True, 0, 0)]


def test_anchors_of_long_texts_are_those_of_the_whole(monkeypatch):
    """Read in pieces, and in one go; with runs of one byte and repeats across the pieces' ends."""
    r = random.Random(3)
    word = bytes(r.randrange(256) for _ in range(700))
    texts = [bytes(r.randrange(256) for _ in range(5000)), b"short", b"a" * 4000, word * 9, b"", b"ab" * 300 + word + b"\0" * 1500 + word]
    whole = suffix_dedup._anchors(texts)
    for size in (300, 1000, 4097):
        monkeypatch.setattr(suffix_dedup, "CHUNK", size)
        got = suffix_dedup.anchors(texts)
        assert all(np.array_equal(a, b) for a, b in zip(got, whole, strict=True))


def test_long_texts_lose_their_repeats(spark, monkeypatch):
    r = random.Random(4)
    part = "".join(r.choice("abcdefghij ") for _ in range(3000))
    text = "".join(r.choice("klmnopqrst ") for _ in range(2_500_000))
    rows = [(1, text[:1_200_000] + part + text[1_200_000:]), (2, "x" + part), (None, "y" * 150)]
    got = {x["doc_id"]: x for x in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[None]["n_removed"]) == (3000, 3000, 0)
    assert bytes(got[1]["kept"]).decode() == text and bytes(got[2]["kept"]) == b"x"
