"""Cross-tokenizer alignment (11) by a dictionary of groups.

Two tokenizers cut a text (with a space before it) into tokens; the byte offsets where tokens of both end cut these into groups. A group is named by its ids, `a1,a2|b1`. Few distinct groups
make up a corpus, so all work on links is done once a distinct group:

1. Tasks read documents where they lie and tokenize them part by part (a part ends before white space, where both tokenizers must end a token; each distinct part once
   a generation of the task's cache). About CHUNK_BYTES of text make a chunk, which interns its groups: a document becomes ordinals and counts, and the chunk's dictionary has a row
   for each distinct group with its occurrences and documents. Both are written.
2. The dictionaries are summed to that of the corpus; links are expanded from each distinct group, weighed by its occurrences (or documents), and summed to pairs of ids.
3. Pairs give each group its values; these go back by the group's name to the chunks that hold it, and by the chunk to its documents.

So a frequent group is one row a chunk, not one an occurrence, and no task holds more than a chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Scratch, byte_texts, rows, short_batches, written
from .sentencepieces import MARK, codec

#: White space, as both tokenizers' rules know it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and marks (digits among them) between which a part may end (fixed values; a choice among those that every version of Unicode knows as such).
LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
#: Text bytes of one chunk and of what is tokenized together, and characters of one piece of a long text.
CHUNK_BYTES, BATCH_CHARS, PIECE_CHARS = 10 << 20, 1 << 20, 1 << 20
#: Parts of one generation of the cache.
CACHE_PARTS = 200_000
_aligners: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Tokenizer A, a byte-level BPE file of the tokenizers library whose added tokens are plain text here, and B, a sentencepiece model that puts a space before a text."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as f:
            config = json.load(f)
        self.a_bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in config["model"]["vocab"].items()}
        self.b = codec(b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(MARK, " ").encode() for p, _, kind in self.b.spec.pieces]
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.fromiter(map(len, self.b_bytes), np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.named = [f"{k}{mark}" for k in range(max(len(self.a_size), len(self.b_size))) for mark in ",;"]
        cut = config["pre_tokenizer"] or {}
        by_word = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not config["normalizer"]
        self.parts = None
        if by_word and self.b.parts and self.b.normal is None and self.b.spec.dummy_prefix:
            # a part may begin at white space after something else, and at a mark or digit after a letter: A always ends a word there, and B has no piece that goes on
            every = [c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c)]
            pieces = [p for p, *_ in self.b.spec.pieces]
            joined = {c for p in pieces for c in re.findall(f"(?<=[^{SPACE}{MARK}])[{SPACE}]", p)}
            marks = "".join(re.escape(c) for c in set(MARKS) - {c for p in pieces for c in re.findall(f"(?<=[{LETTERS}])[{re.escape(MARKS)}]", p)})
            cut, inner = ("".join(c for c in every if (c in joined) is wanted) for wanted in (False, True))
            word = f"[{SPACE}]*[{LETTERS}]++(?=[{marks}{cut}]|\\Z)"
            more = f"[^{SPACE}]" + (f"|[{inner}][{SPACE}]*+(?:(?=[^{SPACE}])|\\Z)" if inner else "")
            other = f"[{SPACE}]*[^{SPACE}](?:(?!(?<=[{LETTERS}])[{marks}])(?:{more}))*+"
            self.parts = re.compile(f"{word}|{other}|[{SPACE}]+") if marks else None
            self.gap = re.compile(f"(?<=[^{SPACE}])[{cut}]")
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def pieces(self, text: str) -> Iterator[str]:
        """A long text (its space before it) in pieces that begin where parts may."""
        a = 0
        while self.parts is not None and len(text) - a > PIECE_CHARS and (found := self.gap.search(text, a + PIECE_CHARS)):
            yield text[a : found.start()]
            a = found.start()
        yield text[a:] if a else text

    def split(self, piece: str) -> list[str]:
        return [piece] if self.parts is None else self.parts.findall(piece)

    def _b_ids(self, parts: list[str]) -> list[bytes]:
        """Of each part as little-endian uint32."""
        if self.parts is None:
            split = [self.b.split(self.b.normalised(p[1:])) for p in parts]
            flat = list({w for ws in split for w in ws})
            self.b._encoded(flat)
            found = {w: self.b.young.pop(w) for w in flat}
            return [b"".join(map(found.__getitem__, ws)) for ws in split]
        self.b._encoded(parts)
        return list(map(self.b.young.pop, parts))

    def aligned(self, parts: set[str]) -> dict[str, tuple | None]:
        """Of each part (A tokens, B tokens, groups as one text), None where the tokens' bytes aren't the part's."""
        if len(self.young) > CACHE_PARTS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = [p for p in parts if p not in young]
        young.update((p, old[p]) for p in new if p in old)
        new = [p for p in new if p not in young]
        if new:
            self._align(new, [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], self._b_ids(new))
        return young

    def _align(self, parts: list[str], a_lists: list[list[int]], b_raw: list[bytes]) -> None:
        """Adds parts to the cache: the tokens of all of them stand one after the other, as their bytes do."""
        a_ids, b_ids = np.fromiter(chain.from_iterable(a_lists), np.int64), np.frombuffer(b"".join(b_raw), "<u4").astype(np.int64)
        n_a, n_b = np.fromiter(map(len, a_lists), np.int64, len(parts)), np.fromiter(map(len, b_raw), np.int64, len(parts)) // 4
        raw = [p.encode() for p in parts]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        a_last, b_last = np.cumsum(n_a), np.cumsum(n_b)
        same = len(a_ids) > 0 and len(b_ids) > 0 and np.array_equal(a_ends[a_last - 1], ends) and np.array_equal(b_ends[b_last - 1], ends)
        whole = b"".join(raw)
        if not (same and b"".join(map(self.a_bytes.__getitem__, a_ids.tolist())) == whole == b"".join(map(self.b_bytes.__getitem__, b_ids.tolist()))):
            # some part's tokens aren't its bytes: it gets no groups, the others are taken without it
            kept = []
            for k, (p, r) in enumerate(zip(parts, raw, strict=True)):
                if b"".join(map(self.a_bytes.__getitem__, a_lists[k])) == r == b"".join(map(self.b_bytes.__getitem__, np.frombuffer(b_raw[k], "<u4").tolist())):
                    kept.append(k)
                else:
                    self.young[p] = None
            if kept:
                self._align([parts[k] for k in kept], [a_lists[k] for k in kept], [b_raw[k] for k in kept])
            return
        in_b, in_a = b_ends[np.searchsorted(b_ends, a_ends)] == a_ends, a_ends[np.searchsorted(a_ends, b_ends)] == b_ends
        # a token's number with `,` or, at the end of a group, `;`
        a_groups, b_groups = ("".join(map(self.named.__getitem__, (2 * ids + last).tolist())).split(";") for ids, last in ((a_ids, in_b), (b_ids, in_a)))
        groups = list(map("|".join, zip(a_groups[:-1], b_groups[:-1], strict=True)))
        upto = np.cumsum(in_b)[a_last - 1].tolist()
        self.young.update((p, (x, y, ";".join(groups[i:j]))) for p, x, y, i, j in zip(parts, n_a.tolist(), n_b.tolist(), [0, *upto], upto, strict=False))


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each pair of vocabularies and Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


class Chunk:
    """Documents of about CHUNK_BYTES of text, with ordinals for their parts."""

    def __init__(self) -> None:
        self.id, self.bytes = uuid.uuid4().hex, 0
        self.index: dict[str, int] = {}
        self.of_part: list[tuple] = []
        self.docs: list[tuple] = []
        self.parts: list[np.ndarray] = []

    def add(self, doc_id: int | None, parts: np.ndarray, sha: str, text: str) -> None:
        self.docs.append((doc_id, sha, text))
        self.parts.append(parts)

    def batches(self, with_groups: bool) -> Iterator[pa.RecordBatch]:
        """A row for each document, then a row for each distinct group."""
        names: dict[str, int] = {}
        lists = [[names.setdefault(g, len(names)) for g in text.split(";")] for _, _, text in self.of_part]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.fromiter((g for one in lists for g in one), np.int64, int(starts[-1]))
        n_a, n_b = (np.fromiter((x[k] for x in self.of_part), np.int64, len(self.of_part)) for k in (0, 1))
        freq, held = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        cols: list[list] = [[], [], [], [], []]
        for parts in self.parts:
            part, times = np.unique(parts, return_counts=True)
            size = sizes[part]
            at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(part) else starts[part], size) + np.arange(size.sum())
            g, inverse = np.unique(flat[at], return_inverse=True)
            n = np.bincount(inverse, np.repeat(times, size), len(g)).astype(np.int64)
            freq[g] += n
            held[g] += 1
            for col, x in zip(cols, (int(n_a[parts].sum()), int(n_b[parts].sum()), int(n.sum()), g.astype(np.int32), n.astype(np.int32)), strict=True):
                col.append(x)
        docs = list(zip(*self.docs, strict=True))
        m, k = len(self.docs), len(names)
        kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "g": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}
        own = [pa.array([self.id] * m), pa.array(docs[0], pa.int64()), pa.array(docs[1], pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))]
        rest = [pa.nulls(m, t) for t in (pa.string(), pa.int32(), pa.int64(), pa.int64())] + ([pa.array(docs[2], pa.string())] if with_groups else [])
        columns = ["chunk", "doc_id", "sha", *kinds, "key", "ordinal", "freq", "docs"] + ["groups"] * with_groups
        yield pa.RecordBatch.from_arrays(own + rest, columns)
        none = [pa.nulls(k, t) for t in (pa.int64(), pa.string(), *kinds.values())]
        own = [pa.array(list(names), pa.string()), pa.array(np.arange(k, dtype=np.int32)), pa.array(freq), pa.array(held)] + ([pa.nulls(k, pa.string())] if with_groups else [])
        yield pa.RecordBatch.from_arrays([pa.array([self.id] * k, pa.string()), *none, *own], columns)


def tokenised(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """Rows of documents (key is null: chunk, doc_id, sha, n_a, n_b, n_groups, g and n: ordinals of its groups and how often it has each) and of the chunks' dictionaries (chunk,
    ordinal, key, freq, docs). Each run names chunks anew, so write the table before reading parts of it."""
    short_batches(docs.sparkSession)
    schema = "chunk string, doc_id long, sha string, n_a long, n_b long, n_groups long, g array<int>, n array<int>, key string, ordinal int, freq long, docs long" + ", groups string" * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        chunk = Chunk()
        waiting: list[tuple] = []

        def pieces_done() -> None:
            """Tokenizes what waits; the pieces of a document come one after the other."""
            split = [al.split(piece) if piece else [] for _, piece, _ in waiting]
            known = al.aligned(set().union(*split))
            index, of_part = chunk.index, chunk.of_part
            for (doc, _, last), parts in zip(waiting, split, strict=True):
                made = list(map(known.__getitem__, parts))
                doc["ok"] &= None not in made
                if doc["ok"] and parts:
                    text = ";".join([m[2] for m in made])
                    doc["sha"].update((b";" if doc["parts"] else b"") + text.encode())
                    if with_groups:
                        doc["text"].append(text)
                    for p in parts:
                        if p not in index:
                            index[p] = len(of_part)
                            of_part.append(known[p])
                    doc["parts"].append(np.fromiter(map(index.__getitem__, parts), np.int32, len(parts)))
                if last:
                    some = doc["ok"] and doc["parts"]
                    chunk.add(doc["id"], np.concatenate(doc["parts"]) if some else np.empty(0, np.int32), doc["sha"].hexdigest() if some else "", ";".join(doc["text"]) if some else "")
            waiting.clear()

        held = 0
        for doc_id, raw in rows(batches):
            doc = {"id": doc_id, "ok": True, "sha": hashlib.sha256(), "parts": [], "text": []}
            text = raw.decode("utf-8", "replace")
            for piece in al.pieces(" " + text) if text else ():
                waiting.append((doc, piece, False))
                held += len(piece)
                if held > BATCH_CHARS:
                    pieces_done()
                    held = 0
            waiting.append((doc, "", True))
            chunk.bytes += len(raw) + 64
            if chunk.bytes > CHUNK_BYTES:
                pieces_done()
                yield from chunk.batches(with_groups)
                chunk, held = Chunk(), 0
        pieces_done()
        if chunk.docs:
            yield from chunk.batches(with_groups)

    return byte_texts(docs).mapInArrow(run, schema)


def links(groups: DataFrame, a_path: str, b_path: str, link: str = "end") -> DataFrame:
    """key, a, b: the links of each distinct group (key), between tokens that end together, or with link="overlap" between all whose byte ranges overlap; `weight` goes along."""
    if link not in ("end", "overlap"):
        raise ValueError(link)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        for batch in batches:
            out: list[tuple] = []
            for key, weight in zip(batch.column("key").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                a, b = (list(map(int, x.split(","))) for x in key.split("|"))
                if link == "end":
                    met = [(len(a) - 1, len(b) - 1)]  # no token is empty, so only the last two end together
                else:
                    a_ends, b_ends = np.cumsum([al.a_size[x] for x in a]), np.cumsum([al.b_size[x] for x in b])
                    first = np.searchsorted(b_ends, np.concatenate([[0], a_ends[:-1]]), "right")
                    last = np.searchsorted(b_ends, a_ends, "left")
                    met = ((i, j) for i in range(len(a)) for j in range(first[i], last[i] + 1))
                out += [(key, a[i], b[j], weight) for i, j in met]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["key", "a", "b", "weight"])

    return groups.select("key", "weight").mapInArrow(run, "key string, a int, b int, weight long")


def group_dictionary(made: DataFrame) -> DataFrame:
    """key, freq, docs: the distinct groups of the corpus, their occurrences and the documents that hold them. made: of `tokenised`."""
    return made.filter("key IS NOT NULL").groupBy("key").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs"))


def pair_counts(expanded: DataFrame) -> DataFrame:
    """a, b, count (the weights of its links), best (no A id has a higher count with this B id). expanded: of `links`."""
    pairs = expanded.groupBy("a", "b").agg(F.sum("weight").alias("count"))
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))
    return pairs.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, link: str = "end", count: str = "freq", with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has its B id's highest count), count_sum (over links), groups_sha256 and, unless with_groups is false, groups
    (`a1,a2|b1;a3|b2,b3`). count: "freq" weighs each group's links by its occurrences, "docs" by the documents that hold it.

    Null and empty texts, and those whose tokens' bytes aren't a space and the text (as of one with B's marker in it), have no tokens: zeros, '' for the hash and groups, and
    no share in the counts. Ties for the highest count are all best. Rows repeated whole count as often as they stand there and give a row each, as do rows
    without an id or with a shared one. Texts of any length are aligned whole, in pieces; one word without white space is one part however long. Columns beside doc_id and text are left behind; an empty
    table gives no rows. The result is written; the working tables are removed.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        made = scratch.written(tokenised(docs, a_path, b_path, with_groups), "tokens")
        groups = scratch.written(group_dictionary(made).withColumnRenamed(count, "weight").select("key", "weight"), "groups")
        expanded = links(groups, a_path, b_path, link)
        pairs = scratch.written(pair_counts(expanded), "pairs")
        values = expanded.join(pairs, ["a", "b"]).groupBy("key").agg(F.count("*").alias("links"), F.sum(F.col("best").cast("long")).alias("best"), F.sum("count").alias("total"))
        back = made.filter("key IS NOT NULL").select("chunk", "ordinal", "key").join(values, "key").select(F.col("chunk").alias("home"), "ordinal", "links", "best", "total")
        more = ["groups"] if with_groups else []
        own = made.filter("key IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "sha", "g", "n", *more)
        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
        return written(own.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(_summed, schema), "alignment")


def _summed(docs: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums of their groups' values."""
    order = np.argsort(values.column("ordinal").to_numpy())
    g, n = (docs.column(c).combine_chunks() for c in ("g", "n"))
    cuts = g.offsets.to_numpy() if len(g) else np.zeros(1, np.int32)
    flat, times = g.values.to_numpy(), n.values.to_numpy().astype(np.int64)
    sums = []
    for name in ("links", "best", "total"):
        of_group = values.column(name).to_numpy().astype(np.int64)[order]
        upto = np.concatenate([[0], np.cumsum(of_group[flat] * times)]) if len(flat) else np.zeros(1, np.int64)
        sums.append(pa.array(upto[cuts[1:]] - upto[cuts[:-1]]))
    out = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + sums + [docs.column("sha")]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if "groups" in docs.column_names:
        out, names = [*out, docs.column("groups")], [*names, "groups"]
    return pa.table(dict(zip(names, out, strict=True)))
