"""Token-ID output (10): flat unsigned 32-bit files plus 64-bit document offsets, memory-mapped.

Documents are dealt by ranges of doc_id and sorted; each task writes one `ids-PPPPP.bin` (little-endian
unsigned integers: 16 bits where the vocabulary and the end id fit, else 32) and one `offsets-PPPPP.bin` (little-endian int64: the start of each document within the file,
and the end). Partition bases come from a prefix sum over the tasks' token counts, which are a few
numbers a task. A task writes under its attempt's own name and the driver records in the manifest which attempts count, so
a lost executor or a repeated task leaves no half-written file in use.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, rows, short_batches, shared_dir

#: Words of one generation of the encoder's cache.
CACHE_WORDS = 500_000
#: Marks that may follow a word; the tokenizer splits there.
MARKS = b".,;:!?*$%&#|()\""
_encoders: dict[str, WordEncoder] = {}


#: How a tokenizer must split texts for its words to be encoded one by one: runs of letters, single digits, runs of marks; what is left, white space, is
#: dropped (fixed values of the public vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Encodes whole texts: word by word, each distinct word once per cache generation, where the tokenizer's own settings say that this gives the same; else each text as it is.

    The settings must be: NFC, squeezing of spaces and lower-casing as the only normalisers; SPLIT as the only rule that cuts, so that white space is
    dropped and letters never share a token with marks; added tokens without white space and options. Words are encoded many at a time in one text, around a
    NUL, which is a mark of its own.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        config = json.loads(self.tok.to_str())
        self.added = [t["content"].encode() for t in config["added_tokens"]]
        whole = config["normalizer"] or {}
        rules = whole.get("normalizers", [whole] if whole else [])
        self.words = _splits_at_space(config, rules)
        #: whether lower-casing A-Z first is what the tokenizer does anyway
        self.lower = any(r["type"] == "Lowercase" for r in rules)
        mark = self.tok.encode("\0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        suffix = config["model"].get("end_of_word_suffix")
        self.bare = None
        if self.words and suffix:
            # words of a-z need no normalising and no splitting: the model alone gives their ids, each with one token that ends it
            self.bare = tokenizers.Tokenizer(self.tok.model)
            self.bare.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _encoded(self, words: list[bytes]) -> None:
        if self.bare is not None:  # letters a-z need no normalising and no splitting
            letters = [w for w in words if w.isalpha() and w.islower()]
            words = [w for w in words if not (w.isalpha() and w.islower())]
            for i in range(0, len(letters), 1000):
                part = letters[i : i + 1000]
                (e,) = self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(part):
                    raise ValueError("a word has no end of its own")
                raw, a = ids.tobytes(), 0
                for w, b in zip(part, cuts.tolist(), strict=True):
                    self.young[w] = raw[4 * a : 4 * b]
                    a = b
        plain = [w for w in words if self.mark is not None and b"\0" not in w]
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            (e,) = self.tok.encode_batch_fast([" \0 ".join(w.decode("utf-8", "replace") for w in part)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("the separator isn't alone")
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                self.young[w] = raw[4 * a : 4 * b]
                a = b + 1
        odd = [w for w in words if self.mark is None or b"\0" in w]
        for w, e in zip(odd, self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False), strict=True):
            self.young[w] = np.array(e.ids, "<u4").tobytes()

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        if not self.words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        # the strings of added tokens are found before lower-casing
        split = [(low if self.lower and not any(a in low for a in self.added) else t).split() for t in texts for low in [t.lower()]]
        young, old = self.young, self.old
        new = set().union(*split) - young.keys() if split else set()
        found = [w for w in new if w in old]
        for w in found:
            young[w] = old[w]
        new.difference_update(found)
        # a letter of A-Z and the marks after it are never in one token; other letters may end in a mark of their own when they are normalised
        pairs = [(w, base, w[len(base) :]) for w in new if (base := w.rstrip(MARKS)) != w and base[-1:].isalpha() and not any(a in w for a in self.added)]
        new.difference_update([w for w, _, _ in pairs])
        parts = {x for _, *two in pairs for x in two} - young.keys()
        found = [w for w in parts if w in old]
        for w in found:
            young[w] = old[w]
        parts.difference_update(found)
        new |= parts
        if new:
            self._encoded(list(new))
        for w, base, marks in pairs:
            young[w] = young[base] + young[marks]
        return [b"".join(map(young.__getitem__, words)) for words in split]


def _splits_at_space(config: dict, rules: list[dict]) -> bool:
    cut = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    cuts = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = all(r["type"] in ("NFC", "Lowercase") or (r["type"], r.get("pattern"), r.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for r in rules)
    bytes_only = len(cuts) == 2 and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    whole_tokens = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for c in t["content"]) for t in config["added_tokens"])
    return plain and bytes_only and cuts[0] == cut and whole_tokens and config["post_processor"] is None


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def id_kind(vocabulary: str, end_id: int) -> str:
    """The type of an id in the files."""
    enc = encoder(vocabulary)
    return "<u2" if max(enc.tok.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def _writer(vocabulary: str, out: str, end_id: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        fs, root = pafs.FileSystem.from_uri(out)
        part = TaskContext.get().partitionId()
        name = f"{part:05d}-{uuid.uuid4().hex}"
        end, at, docs, last = struct.pack("<I", end_id), 0, 0, []
        with fs.open_output_stream(f"{root}/ids-{name}.bin") as ids, fs.open_output_stream(f"{root}/offsets-{name}.bin") as offsets, fs.open_output_stream(f"{root}/docs-{name}.bin") as names:

            def flush() -> None:
                nonlocal at, docs
                for (doc_id, _), got in zip(last, enc.batch([t for _, t in last]), strict=True):
                    whole = got + end
                    ids.write(whole if kind == "<u4" else np.frombuffer(whole, "<u4").astype(kind).tobytes())
                    offsets.write(struct.pack("<q", at))
                    names.write(struct.pack("<?q", doc_id is not None, doc_id or 0))
                    at += len(got) // 4 + 1
                    docs += 1
                last.clear()

            held = 0
            for row in rows(batches):
                last.append(row)
                held += len(row[1])
                if held > 1 << 20:
                    flush()
                    held = 0
            flush()
            offsets.write(struct.pack("<q", at))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "docs": [docs], "tokens": [at]})

    return write


def write_tokens(docs: DataFrame, vocabulary: str, out: str, end_id: int = 1) -> DataFrame:
    """Writes the files into folder `out` (any URI that pyarrow opens) and returns the manifest: part, name, docs, tokens, base, kind (numpy's name of the ids' type).

    A null text is empty (its document is the end id alone); rows without an id come first; rows that
    share an id stay side by side; texts of any length are whole; columns beside doc_id and text are left behind. An empty table gives a manifest without documents.
    """
    spark = docs.sparkSession
    short_batches(spark)
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    schema, kind = "part int, name string, docs long, tokens long", id_kind(vocabulary, end_id)
    parts = byte_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(_writer(vocabulary, out, end_id, kind), schema).collect()  # one row a task
    manifest, base = [], 0
    for r in sorted(parts, key=lambda r: r["part"]):
        manifest.append((*r, base, kind))
        base += r["tokens"]
    return spark.createDataFrame(manifest, schema + ", base long, kind string")


def mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, read otherwise."""
    if isinstance(fs, pafs.LocalFileSystem):
        import os

        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(spark: SparkSession, manifest: DataFrame, out: str, with_ids: bool = False) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32 (and ids as array<long>)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name, base, kind in zip(*(batch.column(c).to_pylist() for c in ("name", "base", "kind")), strict=True):
                ids, offsets = mapped(fs, f"{root}/ids-{name}.bin", kind), mapped(fs, f"{root}/offsets-{name}.bin", "<i8")
                names = mapped(fs, f"{root}/docs-{name}.bin", np.dtype([("has", "?"), ("id", "<i8")]))
                for a in range(0, len(names), 2000):
                    cut = offsets[a : a + 2001]
                    n = len(cut) - 1
                    own = [ids[cut[i] : cut[i + 1]] for i in range(n)]
                    cols = [
                        pa.array(names["id"][a : a + n], mask=~names["has"][a : a + n]),
                        pa.array(cut[:-1] + base),
                        pa.array(np.diff(cut)),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = T.StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    files = max(1, manifest.count())
    return manifest.select("part", "name", "base", "kind").repartitionByRange(files, "part").mapInArrow(read, schema)


def token_table(docs: DataFrame, vocabulary: str, out: str | None = None) -> DataFrame:
    """Writes and reads back in one call; `out` is a new folder under the shared one unless given. Cases as in `write_tokens`."""
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/kinfold-tokens-{uuid.uuid4().hex}"
    if "://" not in out:  # in Spark's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
        out = out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file:///") else out
    return read_tokens(spark, write_tokens(docs, vocabulary, out), out)
