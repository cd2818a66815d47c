"""SentencePiece encoding and decoding (3) on the tokenizers library.

The model protobuf is parsed here (no sentencepiece needed for that): pieces with scores and types, the
trainer's model type and byte fallback, the normaliser's rules. From it a tokenizer of the tokenizers library is rebuilt: normaliser (the
precompiled character map and the squeezing of spaces, where the model has them), Metaspace marker, unigram scores or the merges that
the scores of a BPE model imply, byte fallback, user-defined pieces (found before all others), unused ones (never given out), and the decoder.
Parity with the sentencepiece library is checked on the whole text of every document.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, rows, short_batches

MARK = "▁"
CACHE_WORDS = 250_000
#: A token that stands between parts that are encoded together, and how many these are.
SEPARATOR, JOINED = "\U0010fffd", 1000
_codecs: dict[str, Codec] = {}


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[i : i + n]
        i += n


@dataclass
class Spec:
    """What the model file says. Piece types: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True


def parsed(data: bytes) -> Spec:
    spec = Spec()
    for number, value in wire(data):
        if number == 1:
            p = dict(wire(value))
            spec.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, 1)))
        elif number == 2:
            t = dict(wire(value))
            spec.bpe, spec.byte_fallback = t.get(3, 1) == 2, bool(t.get(35, 0))
        elif number == 3:
            n = dict(wire(value))
            spec.charsmap, spec.dummy_prefix, spec.squeeze = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1))
    return spec


class Codec:
    """Encodes and decodes as the model file says.

    Texts are encoded in parts: a run of spaces with what follows up to the next space, when no
    piece has a marker after another character (checked on loading; else whole texts). Each distinct part is
    encoded once per cache generation, in multithreaded batches where the worker may use threads. Known departure, shown by parity: with a unigram
    model that lacks the characters < 0 x >, the text "<0x41>" is taken for the byte's piece.
    """

    def __init__(self, path: str):
        import tokenizers as tk
        from tokenizers import Regex, decoders, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            self.spec = spec = parsed(f.read())
        self.path = path
        # the names of control and unknown pieces are text like other text: here they get names that no text has
        names = [p + "\U0010fffe" if kind in (2, 3) else p for p, _, kind in spec.pieces]
        unknown = next((p for p, (*_, kind) in zip(names, spec.pieces, strict=True) if kind == 2), None)
        vocab = {p: i for i, p in enumerate(names)}
        self.unused: dict[int, list[int]] = {}
        if spec.bpe:
            made = []
            for p, score, kind in spec.pieces:
                if kind in (1, 5) and len(p) > 1:
                    made += [(-score, vocab[p], vocab[p[:k]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]
            made.sort(key=lambda m: m[:3])
            merges = [(a, b) for *_, a, b in made]
            model = models.BPE(vocab, merges, unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
            parts = {}
            for a, b in merges:
                parts.setdefault(a + b, (a, b))
            for p, _, kind in spec.pieces:
                if kind == 5:  # what an unused piece was merged from, down to pieces that are used
                    todo, self.unused[vocab[p]] = [p], []
                    while todo:
                        x = todo.pop()
                        if spec.pieces[vocab[x]][2] == 5 and x in parts:
                            todo += reversed(parts[x])
                        else:
                            self.unused[vocab[p]].append(vocab[x] if spec.pieces[vocab[x]][2] != 5 else vocab[unknown])
        else:
            least = min((s for _, s, kind in spec.pieces if kind == 1), default=0.0) - 1000
            model = models.Unigram([(p, s if kind == 1 else least) for p, (_, s, kind) in zip(names, spec.pieces, strict=True)], unk_id=vocab.get(unknown), byte_fallback=spec.byte_fallback)
        # `alone` for single parts, `tok` for parts that are joined by a separator
        self.alone, self.tok = tk.Tokenizer(model), tk.Tokenizer(model)
        rules = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.squeeze:
            rules += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
        self.normal = normalizers.Sequence(rules) if rules else None
        self.parts = not any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces) and not any(kind == 4 for *_, kind in spec.pieces)
        steps = [decoders.Replace(unknown, " ⁇ ")] if unknown else []
        steps += [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        for t in (self.alone, self.tok):
            t.add_tokens([tk.AddedToken(p, normalized=False, special=False) for p, _, kind in spec.pieces if kind == 4])
            # the prefix is added to the whole text (see `split`); markers are the library's
            t.pre_tokenizer = pre_tokenizers.Metaspace(MARK, "never", split=False)
            t.decoder = decoders.Sequence(steps)
        self.tok.add_special_tokens([tk.AddedToken(SEPARATOR, normalized=False, special=True)])
        # what the decoder makes of each piece alone; bytes from 0x80 on need their neighbours
        self.text_of = self.alone.decode_batch([[i] for i in range(len(names))], skip_special_tokens=False)
        self.in_pairs = np.array([kind == 6 and int(p[3:5], 16) > 127 for p, _, kind in spec.pieces])
        # no piece goes beyond a line: its end is a byte
        self.lines = self.parts and spec.byte_fallback and not any("\n" in p for p in names)
        self.control = np.array([kind == 3 for *_, kind in spec.pieces])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.judge = None

    def normalised(self, text: str) -> str:
        return self.normal.normalize_str(text) if self.normal is not None else text

    def split(self, text: str) -> list[str]:
        """A normalised text in parts that are encoded one by one: spaces with what follows up to the next space or end of a line, and these ends."""
        if not text:
            return []
        if self.spec.dummy_prefix:
            text = " " + text
        if not self.parts:
            return [text]
        if self.lines and "\n" in text:
            whole, *rest = text.split("\n")
            return [*self._words(whole), *chain.from_iterable(["\n", *self._words(line)] for line in rest)]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        first, *more = text.split(" ")
        if "" not in more:
            return ([first] if first else []) + [" " + w for w in more]
        out, run = [first] if first else [], " "
        for w in more:
            if w:
                out.append(run + w)
                run = " "
            else:
                run += " "
        return out + [run[:-1]] * (len(run) > 1)

    def judged(self):
        if self.judge is None:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self.judge

    def _encoded(self, new: list[str]) -> None:
        """Encodes parts many at a time, as one text around a token of its own."""
        odd = [w for w in new if SEPARATOR in w]
        for w, e in zip(odd, self.alone.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.young[w] = np.array(self._used(e.ids), "<u4").tobytes()
        new = [w for w in new if SEPARATOR not in w] if odd else new
        chunks = [new[a : a + JOINED] for a in range(0, len(new), JOINED)]
        between = self.tok.token_to_id(SEPARATOR)
        for chunk, e in zip(chunks, self.tok.encode_batch_fast([SEPARATOR.join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(self._used(e.ids), "<u4")
            cuts = 4 * np.flatnonzero(ids == between)
            raw = ids.tobytes()
            for w, a, b in zip(chunk, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True):
                self.young[w] = raw[a:b]

    def _used(self, ids: list[int]) -> list[int]:
        return [x for i in ids for x in self.unused.get(i, (i,))] if self.unused else ids

    def coded(self, texts: list[str]) -> list[tuple[bytes, bool, str, bool]]:
        """Of each text its ids as little-endian uint32, whether the sentencepiece library gives the same for the whole text, the text decoded from them, and whether
        that is the text as the model normalises it. Each distinct part is encoded once per cache generation."""
        if len(self.young) > CACHE_WORDS or not self.parts:  # whole texts aren't kept
            self.young, self.old = {}, self.young if self.parts else {}
        plain = [self.normalised(t) for t in texts]
        split = [self.split(t) for t in plain]
        young, old = self.young, self.old
        found = [list(map(young.get, parts)) for parts in split]
        again = [k for k, made in enumerate(found) if None in made]
        new = {w for k in again for w, made in zip(split[k], found[k], strict=True) if made is None}
        for w in [w for w in new if w in old]:
            young[w] = old[w]
            new.discard(w)
        if new:
            self._encoded(list(new))
        for k in again:
            found[k] = [young[w] for w in split[k]]
        out = []
        for text, made, sure in zip(plain, found, self.judged().encode(texts, num_threads=1), strict=True):
            ids = b"".join(made)
            same = array("I", sure).tobytes() == ids
            back = self._text(np.frombuffer(ids, "<u4"), sure if same else None)
            out.append((ids, same, back, back == text.replace(MARK, " ")))
        return out

    def _text(self, ids: np.ndarray, listed: list[int] | None = None) -> str:
        """The text of ids: that of each piece, by the decoder, one after the other; where bytes belong together, the decoder's text of all."""
        listed = ids.tolist() if listed is None else listed
        text = self.alone.decode(listed, skip_special_tokens=False) if self.in_pairs[ids].any() else "".join(map(self.text_of.__getitem__, listed))
        return text[1:] if self.spec.dummy_prefix and text[:1] == " " else text

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Each text's ids as little-endian uint32, and whether the sentencepiece library gives the same for the whole text."""
        return [made[:2] for made in self.coded(texts)]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of ids, without the prefix that encoding added."""
        arrays = [np.frombuffer(x, "<u4") for x in ids]
        if any(len(x) and int(x.max()) >= len(self.control) for x in arrays):
            raise ValueError("an id is outside the vocabulary")
        return [self._text(x[~self.control[x]]) for x in arrays]


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian uint32), parity, round_trip (decoding gives the text back), and if asked for ids and text (decoded from them).

    A null text is empty: 0 ids. round_trip compares with the text as the model normalises it (a marker in the text counts as a space). Texts of any length are
    encoded and compared whole; repeated rows and rows without an id give a result each; columns beside doc_id and text are left behind; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            all_rows = list(rows([batch]))
            a = 0
            while a < len(all_rows):
                b, held = a, 0
                while b < len(all_rows) and held < 1 << 20:
                    held += len(all_rows[b][1])
                    b += 1
                texts = [t.decode("utf-8", "replace") for _, t in all_rows[a:b]]
                out: list[tuple] = []
                for (doc_id, _), (ids, same, back, again) in zip(all_rows[a:b], c.coded(texts), strict=True):
                    out.append((doc_id, len(ids) // 4, zlib.crc32(ids), same, again, ids, back))
                a = b
                *cols, all_ids, backs = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                arrays, names = [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    starts = pa.array(np.cumsum([0, *cols[1]]), pa.int32())
                    arrays += [pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(all_ids), "<i4"))), pa.array(backs, pa.string())]
                    names += ["ids", "text"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return byte_texts(docs).mapInArrow(run, SCHEMA + ", ids array<int>, text string" * with_ids)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from (doc_id, ids array); null ids give the empty text; ids outside the vocabulary raise; repeated rows give a row each; other columns are left behind; an empty table gives no rows."""
    short_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = c.decode([np.array(ids or [], "<u4").tobytes() for ids in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
