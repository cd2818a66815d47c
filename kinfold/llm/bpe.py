"""Byte-level BPE encoding and decoding (13) by a segment tree.

A text is cut at the added tokens and then by the vocabulary's rule for words. A word's bytes are its first symbols; the leaves of a segment tree hold the rank of
each pair of neighbours (with its place), every inner node the least below it. So the root names the leftmost pair of the lowest rank; merging it
changes three leaves at most, each with a logarithmic update, until the root says that nothing can be merged. A word of n bytes takes n log n steps, so one of
a million letters is no danger. Trees of short words are rows of one array and take their steps together; each distinct short word is encoded once a generation of the task's cache.

There is no shuffle: documents are encoded where they are read, pieces of a long text one by one.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, rows, short_batches

#: The rule by which byte-level vocabularies of this kind cut words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of one generation of the cache, and the longest that is kept there (characters).
CACHE_WORDS, KEPT_CHARS = 250_000, 256
#: Bytes of the longest words that are merged together, and how many of them at once.
TOGETHER, ROWS = 64, 20_000
#: Characters of one piece of a long text, at least, and of the pieces that are encoded together.
PIECE_CHARS, BATCH_CHARS = 1 << 20, 4 << 20
_encoders: dict[tuple[str, bool], ByteBpe] = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in such a vocabulary: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a vocabulary: ranks of pairs of symbols, and what each makes. A pair that can't be merged has the rank NEVER."""

    NEVER = 1 << 40

    def __init__(self, pairs: list[tuple[int, int]], made: list[int], symbols: int):
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.made, self.symbols = np.array(made + [0], np.int64), symbols
        keys = np.array([a * symbols + b for a, b in pairs] + [1 << 62], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs; -1 stands for no symbol."""
        key = np.where((a < 0) | (b < 0), -1, a * self.symbols + b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], self.NEVER)

    def one(self, symbols: list[int]) -> list[int]:
        """The symbols of one word of any length when no pair can be merged any more.

        Leaf `width + i` of the tree holds rank * width + i for the pair that begins at place i, an inner node the less of the two below it.
        """
        n = len(symbols)
        width = 1 << (n - 1).bit_length()
        none, rank_of = self.NEVER * width, self.rank.get
        tree = [none] * (2 * width)
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
            tree[width + i] = rank_of(pair, self.NEVER) * width + i
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int) -> None:
            """The leaf of place i, and what stands above it as far up as that changes."""
            at, j = i + width, after[i]
            tree[at] = least = none if symbols[i] < 0 or j >= n else rank_of((symbols[i], symbols[j]), self.NEVER) * width + i
            while at > 1:
                least = min(least, tree[at ^ 1])
                at >>= 1
                if tree[at] == least:
                    return
                tree[at] = least

        while (least := tree[1]) < none:
            i = least % width
            j = after[i]
            symbols[i], symbols[j] = int(self.made[least // width]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j)
            put(i)
            if i:
                put(before[i])
        return [s for s in symbols if s >= 0]

    def many(self, symbols: np.ndarray) -> np.ndarray:
        """The same for many words at once: a row each, -1 after its end; columns: a power of two, and the same is returned with -1 between symbols too.

        All trees take a step together; rows that are done leave.
        """
        m, width = symbols.shape
        depth = width.bit_length() - 1
        symbols = np.concatenate([symbols, np.full((m, 1), -1, symbols.dtype)], axis=1)
        none = self.NEVER << depth
        tree = np.full((m, 2 * width), none, np.int64)
        tree[:, width:] = (self.ranks(symbols[:, :-1], symbols[:, 1:]) << depth) + np.arange(width)
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        after = np.tile(np.arange(1, width + 2), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))
        sym, nodes, nxt, prv = symbols.reshape(-1), tree.reshape(-1), after.reshape(-1), before.reshape(-1)
        rows = np.arange(m)
        while True:
            least = nodes[rows * (2 * width) + 1]
            going = least < none
            rows, least = rows[going], least[going]
            if not len(rows):
                return symbols[:, :-1]
            i, at, top = least & (width - 1), rows * (width + 1), rows * (2 * width)
            j = nxt[at + i]
            k, h = nxt[at + j], prv[at + i]
            new = self.made[least >> depth]
            sym[at + i], sym[at + j] = new, -1
            nxt[at + i], prv[at + np.minimum(k, width)] = k, i
            first = h < 0
            left = np.where(first, -1, sym[at + np.maximum(h, 0)])
            places = np.concatenate([j, i, np.where(first, j, h)])
            keys = np.concatenate([np.full(len(rows), none), (self.ranks(new, sym[at + k]) << depth) + i, (self.ranks(left, new) << depth) + np.maximum(h, 0)])
            where = np.concatenate([top, top, top])
            node = places + width
            nodes[where + node] = keys
            while depth and node[0] > 1:
                node >>= 1
                nodes[where + node] = np.minimum(nodes[where + 2 * node], nodes[where + 2 * node + 1])


class ByteBpe:
    """A byte-level vocabulary file of the tokenizers library. special_as_text: the strings of added tokens are text like other text.

    Files with a normaliser, another rule for words, options of added tokens or of the model that change ids (dropout, ignored merges, affixes) are refused. Truncation and padding are not used.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import regex

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, cut, added = config["model"], config["pre_tokenizer"] or {}, config["added_tokens"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)] + [k for t in added for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or config["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs], max(vocab.values()) + 1)
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocab.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.words = regex.compile(WORDS)
        self.cutter = None
        self.added = {} if special_as_text else {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        # of strings that begin at one place the longest is the token
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.gap = regex.compile(r"(?<=\S)\s")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens. Where the library's tables of letters and digits differ from those of this pattern, its own cutter is asked."""
        if text.isascii() or not _has_odd(text):
            return self.words.findall(text)
        if self.cutter is None:
            self.cutter = _cutter()
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def encoded_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Words of up to TOGETHER bytes are merged together with others of about their length, longer ones one by one."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        width = 1
        while width <= TOGETHER:
            chosen = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            for a in range(0, len(chosen), ROWS):
                part = chosen[a : a + ROWS]
                grid = np.frombuffer(b"".join([raw[k].ljust(width, b"\0") for k in part.tolist()]), np.uint8).reshape(-1, width)
                done = self.merges.many(np.where(np.arange(width) < lengths[part, None], self.first[grid], -1))
                kept = done >= 0
                ids, cuts = done[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
                for k, x, y in zip(part.tolist(), [0, *cuts], cuts, strict=False):
                    out[k] = ids[x:y]
            width *= 2
        for k in np.flatnonzero(lengths > TOGETHER).tolist():
            symbols = self.merges.one(self.first[np.frombuffer(raw[k], np.uint8)].tolist())
            out[k] = struct.pack(f"<{len(symbols)}I", *symbols)
        return out

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces that end where a word must end: before white space after something else."""
        a = 0
        while len(text) - a > PIECE_CHARS and (found := self.gap.search(text, a + PIECE_CHARS)):
            yield text[a : found.start()]
            a = found.start()
        yield text[a:] if a else text

    def parts(self, text: str) -> Iterator[str | bytes]:
        """A text as pieces, and the ids of the added tokens between them."""
        a = 0
        for m in self.marks.finditer(text) if self.marks is not None else ():
            if a < m.start():
                yield from self.pieces(text[a : m.start()])
            yield self.added[m[0]]
            a = m.end()
        if a < len(text):
            yield from self.pieces(text[a:] if a else text)

    def batch(self, parts: list[str | bytes]) -> list[bytes]:
        """The ids of each of `parts` as little-endian uint32; new words of all of them are merged together."""
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        split = [self.split(p) if isinstance(p, str) else p for p in parts]
        new = [w for w in set().union(*[words for words in split if isinstance(words, list)]) if w not in young]
        young.update((w, old[w]) for w in new if w in old)
        words = [w for w in new if w not in young]
        made = dict(zip(words, self.encoded_words(words), strict=True))
        young.update(made)
        out = [b"".join(map(young.__getitem__, words)) if isinstance(words, list) else words for words in split]
        for w in words:
            if len(w) > KEPT_CHARS:
                del young[w]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32."""
        return b"".join(b"".join(self.batch([part])) for part in self.parts(text))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _cutter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


_odd: list[np.ndarray] = []


def _unlike() -> np.ndarray:
    """For each code point whether it is a letter or digit to the regex library and not to the tokenizers library, which may know another version of Unicode.
    Each is put after a letter (a digit) to see whether both are one word."""
    import regex

    if not _odd:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, bool)
        for kind, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
            chars = regex.findall(kind, every)
            starts = {a for _, (a, _) in _cutter().pre_tokenize_str("".join(f"{before}{c}\n" for c in chars))}
            table[[ord(c) for k, c in enumerate(chars) if 3 * k + 1 in starts]] = True
        _odd.append(table)
    return _odd[0]


def _has_odd(text: str) -> bool:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return bool(_unlike()[codes[codes > 0xFF]].any())


def encoder(path: str, special_as_text: bool = False) -> ByteBpe:
    """One for each vocabulary and Python worker."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = ByteBpe(path, special_as_text)
    return _encoders[path, special_as_text]


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian uint32), decoded_sha256 (of the text decoded from them) and, unless with_ids is false, ids and that text.

    Null and empty texts have no ids. The strings of added tokens in a text are these tokens. Texts of any length are encoded whole, in pieces; rows repeated whole, rows without an
    id and rows that share one give a result each; columns beside doc_id and text are left behind; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, text string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        done: list[tuple] = []
        waiting: list[tuple[Result, str | bytes | None]] = []
        held = 0

        def flush() -> None:
            for (result, part), ids in zip(waiting, bpe.batch([b"" if part is None else part for _, part in waiting]), strict=True):
                if part is None:
                    done.append(result.row())
                else:
                    result.take(ids, bpe.decode(ids))
            waiting.clear()

        for doc_id, raw in rows(batches):
            result = Result(doc_id, with_ids)
            for part in bpe.parts(raw.decode("utf-8", "replace")):
                waiting.append((result, part))
                held += len(part)
                if held > BATCH_CHARS:
                    flush()
                    held = 0
            waiting.append((result, None))  # the end of the text
            if len(done) >= 500:
                yield _batch(done, with_ids)
                done = []
        flush()
        if done:
            yield _batch(done, with_ids)

    return byte_texts(docs).mapInArrow(run, schema)


class Result:
    """What is known of a document while its pieces come in order."""

    def __init__(self, doc_id: int | None, with_ids: bool):
        self.doc_id, self.n, self.with_ids = doc_id, 0, with_ids
        self.ids_hash, self.text_hash = hashlib.sha256(), hashlib.sha256()
        self.back = codecs.getincrementaldecoder("utf-8")("replace")  # a character's bytes may lie in two pieces
        self.ids: list[bytes] = []
        self.texts: list[str] = []

    def take(self, ids: bytes, decoded: bytes, last: bool = False) -> None:
        text = self.back.decode(decoded, last)
        self.n += len(ids) // 4
        self.ids_hash.update(ids)
        self.text_hash.update(text.encode())
        if self.with_ids:
            self.ids.append(ids)
            self.texts.append(text)

    def row(self) -> tuple:
        self.take(b"", b"", True)
        return (self.doc_id, self.n, self.ids_hash.hexdigest(), self.text_hash.hexdigest(), *((b"".join(self.ids), "".join(self.texts)) if self.with_ids else ()))


def _batch(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        starts = pa.array(np.cumsum([0, *cols[1]]), pa.int32())
        arrays += [pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(cols[4]), "<i4"))), pa.array(cols[5], pa.string())]
        names += ["ids", "text"]
    return pa.RecordBatch.from_arrays(arrays, names)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text from (doc_id, ids array). Null or no ids give the empty text; bytes that are no UTF-8 become U+FFFD; a null id or one outside the vocabulary ends the job with an
    error; repeated rows and rows without an id give a row each; other columns are left behind; an empty table gives no rows."""
    short_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [b"".join(map(bpe.bytes_of.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
