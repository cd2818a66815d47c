"""Quality classifier (6): compression with dictionaries built from good and bad labelled text.

Each text is cut into pieces of PIECE bytes, every piece is compressed once with the dictionary of good
text and once with that of bad text. The difference of the compressed sizes over the length of the text is the one thing that
enters the score; a logistic fit on labelled texts that the dictionaries haven't seen makes it a probability. Pieces are short, so that
a text that repeats itself is compressed by the dictionaries, not by itself.
Fitting takes a bounded sample: at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes a class, in the order of a
hash of the id; of a text longer than TEXT_BYTES as many pieces as fit in, evenly spread from its start to its end, so that no text takes the sample of the
others. Scoring covers every document and all of its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, plainly_named, rows, short_batches

SAMPLE_ROWS, SAMPLE_BYTES = 2000, 12 << 20
DICTIONARY_BYTES, PIECE, LEVEL = 112_640, 1024, 3
#: What one text gives to the sample at most (whole pieces): a hundred texts fit in, however long.
TEXT_BYTES = SAMPLE_BYTES // 100 // PIECE * PIECE


def remainder(id_col: str, by: int):
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


@dataclass
class Model:
    good: bytes
    bad: bytes
    weight: float
    base: float

    def packed(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]

    def scorer(self):
        """A function from a text to its score."""
        if not self.good or not self.bad:
            flat = 1 / (1 + math.exp(-self.base))
            return lambda text: flat
        packed = self.packed()

        def score(text: bytes) -> float:
            x = self.base + self.weight * difference(text, *packed)
            return 1 / (1 + math.exp(-min(50.0, max(-50.0, x))))

        return score


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return d


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Compressed size with bad text's dictionary less that with good text's, over the length; 0 for an empty text."""
    size = 0
    for i in range(0, len(text), PIECE):
        piece = text[i : i + PIECE]
        size += len(bad.compress(piece)) - len(good.compress(piece))
    return size / len(text) if text else 0.0


def trained(texts: list[bytes]) -> bytes:
    """A zstandard dictionary from the pieces of texts; their raw end if there are too few to train on."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weight and intercept by Newton's method, with a slight pull of the weight to 0."""
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w, pull = np.zeros(2), np.array([0.05, 1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (y - p) - pull * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def spread(text: str = "text"):
    """A binary text of up to TEXT_BYTES whole; of a longer one, pieces at even distances that make TEXT_BYTES."""
    n = TEXT_BYTES // PIECE
    pieces = f"aggregate(sequence(0, {n - 1}), X'', (s, i) -> concat(s, substring({text}, cast(i * (octet_length({text}) - {PIECE}L) div {n - 1} AS int) + 1, {PIECE})))"
    return F.expr(f"CASE WHEN octet_length({text}) <= {TEXT_BYTES} THEN {text} ELSE {pieces} END")


def sample(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5) -> list[tuple[int, bytes]]:
    """At most SAMPLE_ROWS (label, text, or pieces of one beyond TEXT_BYTES) a class, in hash order, of labelled rows that aren't held out."""
    ids = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(remainder("doc_id", held_out_mod) != 0).distinct().withColumn("h", F.xxhash64("doc_id"))
    picked = ids.filter("quality = 0").orderBy("h", "doc_id").limit(SAMPLE_ROWS).unionByName(ids.filter("quality = 1").orderBy("h", "doc_id").limit(SAMPLE_ROWS))
    texts = byte_texts(docs).join(F.broadcast(picked), "doc_id").withColumn("text", spread()).dropDuplicates(["doc_id", "quality", "text"])  # at most 2 * SAMPLE_ROWS ids
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    return [(r["quality"], bytes(r["text"])) for r in texts.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES).orderBy("h", "doc_id").select("quality", "text").collect()]


def fit(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5) -> Model:
    """Dictionaries from one half of the sample, calibration on the other.

    Without four labelled texts of each class the score is the share of good labels, smoothed; texts beyond TEXT_BYTES count with pieces from all over. Rows without
    an id or a text, repeated labels, ids with two labels or two texts, and labels other than 0 and 1 do no harm: each (id, label) counts once a text, null texts as empty ones.
    """
    got = sample(docs, labels, held_out_mod)
    good, bad = [t for q, t in got if q], [t for q, t in got if not q]
    base = math.log((len(good) + 1) / (len(bad) + 1))
    if len(good) < 4 or len(bad) < 4:
        return Model(b"", b"", 0.0, base)
    model = Model(trained(good[::2]), trained(bad[::2]), 0.0, base)
    packed = model.packed()
    rest = [(t, 1) for t in good[1::2]] + [(t, 0) for t in bad[1::2]]
    model.weight, model.base = logistic(np.array([difference(t, *packed) for t, _ in rest]), np.array([float(q) for _, q in rest]))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; null and empty texts get the score of no difference; repeated rows and rows without an id are scored like others; an empty table gives no rows."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score(t) for _, t in rows([batch])], pa.float64())], ["doc_id", "score"])

    return byte_texts(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns, whatever their names; rows without an id and repeated rows are judged by their texts like others; null texts as empty ones."""
    model = fit(docs, labels)
    short_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        s = model.scorer()
        return texts.map(lambda t: s(bytes(t) if t is not None else b""))

    return plainly_named(docs, "text").filter(score(F.col("text").cast("binary")) >= threshold).toDF(*docs.columns)
