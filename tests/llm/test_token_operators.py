"""Operators 11 to 13 against brute force and the libraries."""

import hashlib
import random
import struct
from collections import Counter

import public_tokenizers
import pytest

from kinfold.llm import alignment, bpe, fim

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
POOL = "ab cd 's't'll\n\r\t  \xa0　▁.,!?12\xe9字\xdf'́\U0001f600\x1c\x85\x00՘\U00011de0<|endoftext|><s><0x41>"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "one two\r\n three\r\n\r\n  four  "), (5, "one two\r\n three\r\n\r\n  four  "), (5, "same id"), (None, "no id"), (None, "no id"), (None, None),
    (6, "<|endoftext|> in the <|endoftext|>middle<|endoftext|>"), (7, "marker ▁ here"), (8, "▁"), (9, "a" * 5000), (10, "x y　z ;\r\n;\r \r;"), (11, "<P>x"), (12, "a<S>b\nc"), (13, "\n\n\n"),
    (14, "<\nP>\n<P\n>"), (15, "ال \U00011de0՘\U00011de0 1१²"), (16, "it's we'll I'd they've 'S"), (17, " lead"), (18, "é́‍\U0001f468"), (19, "tail \x1c\x1d \x85  x"),
]


def odd_texts():
    rnd = random.Random(11)
    made = [(100 + k, "".join(rnd.choice(POOL) if rnd.random() < 0.9 else chr(rnd.choice([rnd.randrange(0x20, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(rnd.randrange(60)))) for k in range(600)]
    long = " ".join(rnd.choice(["alpha", "beta's", "\n", "gamma  12", "über"]) for _ in range(700_000))
    return ODD + made + [(1000, long)]


def frame(spark, rows):
    """Extra columns whose names clash with those used inside, among them one with a dot and one that differs by case."""
    schema = "doc_id long, text string, K1 long, `a.b` string, ids string, form string, TEXT int, g int"
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 2, 3) for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_texts()).repartition(5)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def in_order(rows):
    return sorted(rows, key=repr)


def library(special_as_text=False):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = special_as_text
    return tok


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_against_the_library(odd):
    tok = library()
    texts = odd_texts()
    want = []
    for (i, t), e in zip(texts, tok.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        want.append((i, len(e.ids), sha(packed(e.ids)), sha(tok.decode(e.ids, skip_special_tokens=False).encode())))
    assert in_order(map(tuple, bpe.encoded(odd, BYTES, with_ids=False).collect())) == in_order(want)


def test_bpe_ids_and_text_come_back(spark, odd):
    made = bpe.encoded(odd, BYTES).cache()
    assert in_order((r.doc_id, r.text) for r in made.collect()) == in_order((i, t or "") for i, t in odd_texts())
    again = bpe.decoded(made.select("doc_id", "ids", "n_tokens"), BYTES)
    assert in_order(map(tuple, again.collect())) == in_order((i, t or "") for i, t in odd_texts())


def test_bpe_decodes_what_is_no_text(spark):
    tok, rnd = library(), random.Random(3)
    lists = [[rnd.randrange(50257) for _ in range(rnd.randrange(12))] for _ in range(300)]
    rows = spark.createDataFrame([(k, x, "e") for k, x in enumerate(lists)] + [(None, None, "e")], "doc_id long, ids array<int>, text string")
    want = [(k, tok.decode(x, skip_special_tokens=False)) for k, x in enumerate(lists)] + [(None, "")]
    assert in_order(map(tuple, bpe.decoded(rows, BYTES).collect())) == in_order(want)


def test_trees_merge_as_a_plain_search_does():
    b = bpe.ByteBpe(BYTES)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aehnorst.=_é") for _ in range(rnd.randrange(1, 150))) for _ in range(400)]

    def plain(s):
        while True:
            found = min(((b.merges.rank.get((x, y), 1 << 50), k) for k, (x, y) in enumerate(zip(s, s[1:], strict=False))), default=(1 << 50, 0))
            if found[0] == 1 << 50:
                return s
            s = [*s[: found[1]], int(b.merges.made[found[0]]), *s[found[1] + 2 :]]

    for w, ids in zip(words, b.encoded_words(words), strict=True):
        first = b.first[list(w.encode())].tolist()
        assert ids == packed(plain(first)) == packed(b.merges.one(list(first)))


def test_bpe_takes_a_very_long_word():
    b, tok = bpe.ByteBpe(BYTES), library()
    for text in ("a" * 300_000, "=-" * 100_000, " " * 200_000 + "x", "ab" * 70_000 + "'s"):
        assert b.encode(text) == packed(tok.encode(text, add_special_tokens=False).ids)


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def fim_of(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    n = len(lines)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}".encode())
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text.encode()), sha(text.encode()), text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:lo], lines[lo:hi], lines[hi:]))
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < spm_rate else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return (doc_id, n, form, len(pre), len(mid), sha(out.encode()), sha(text.encode()), out)


@pytest.mark.parametrize("settings", [{}, {"seed": 3, "rate": 60, "spm_rate": 20}])
def test_fim_against_brute_force(odd, settings):
    want = [fim_of(*r, **settings) for r in odd_texts()]
    got = [tuple(r) for r in fim.transformed(odd, **settings).collect()]
    assert in_order(got) == in_order(want)
    assert {r[2] for r in got} == {"plain", "psm", "spm"} and all(r[6] == sha((t or "").encode()) for r, (_, t) in zip(sorted(want, key=repr), sorted(odd_texts(), key=lambda x: repr(fim_of(*x, **settings))), strict=True))


def test_fim_takes_other_units(spark):
    docs = frame(spark, [(k, "one two  three four") for k in range(40)])
    for r in fim.transformed(docs, units=r"\s*\S+").collect():
        assert r.n == 4 and r.restored_sha256 == sha(b"one two  three four")


def test_fim_shuffles_texts_once_and_joins_no_pairs(spark, odd):
    plan = fim.transformed(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def alignment_of(rows, link="end", count="freq"):
    """By the libraries on whole texts, offset by offset."""
    import sentencepiece

    tok, sp = library(True), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    docs = []
    for doc_id, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for x in parts:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, ties, i, j = [], [], 0, 0
        for end in both:
            i0, j0 = i, j
            while i < len(a) and spans[0][i][1] <= end:
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                j += 1
            groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
            for x in range(i0, i):
                for y in range(j0, j):
                    (a0, a1), (b0, b1) = spans[0][x], spans[1][y]
                    if a1 == b1 if link == "end" else a0 < b1 and b0 < a1:
                        ties.append((a[x], b[y], groups[-1]))
        docs.append((doc_id, a, b, groups, ties))
    pairs = Counter()
    if count == "freq":
        pairs.update((x, y) for *_, ties in docs for x, y, _ in ties)
    else:
        held = Counter(g for *_, groups, _ in docs for g in set(groups))
        once = {}
        for *_, groups, ties in docs:
            for g in set(groups):
                times = groups.count(g)
                own = Counter((x, y) for x, y, of in ties if of == g)
                once[g] = {k: v // times for k, v in own.items()}
        for g, own in once.items():
            for k, v in own.items():
                pairs[k] += v * held[g]
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    out = []
    for doc_id, a, b, groups, ties in docs:
        text = ";".join(groups)
        best, total = sum(pairs[x, y] == top[y] for x, y, _ in ties), sum(pairs[x, y] for x, y, _ in ties)
        out.append((doc_id, len(a), len(b), len(groups), len(ties), best, total, sha(text.encode()) if groups else "", text))
    return out


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 3_000)


@pytest.mark.parametrize("chunks", ["small", "usual"])
@pytest.mark.parametrize(("link", "count"), [("end", "freq"), ("overlap", "freq"), ("overlap", "docs")])
def test_alignment_against_the_libraries(spark, request, chunks, link, count):
    if chunks == "small":
        request.getfixturevalue("small_chunks")
    rows = odd_texts()[:-1] + [(2000 + k, "the same words in every text; some ▁" if k % 7 == 0 else "the same words in every text, it's 12 o'clock") for k in range(60)]
    if link == "end":
        rows.append(odd_texts()[-1])
    got = alignment.aligned(frame(spark, rows).repartition(4), BYTES, PIECES, link=link, count=count)
    assert in_order(map(tuple, got.collect())) == in_order(alignment_of(rows, link, count))


def test_alignment_pieces_of_a_long_text_are_parts(spark):
    al = alignment.Aligner(BYTES, PIECES)
    rnd = random.Random(9)
    text = " " + "".join(rnd.choice(["a", "b;", "\r", "\n", " ", "\t", "　", "\xa0", "x\r\n", "  "]) for _ in range(5000))
    whole = al.split(text)
    for size in (1, 50, 777):
        alignment.PIECE_CHARS, keep = size, alignment.PIECE_CHARS
        try:
            assert [p for piece in al.pieces(text) for p in al.split(piece)] == whole and "".join(whole) == text
        finally:
            alignment.PIECE_CHARS = keep


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bpe.encoded(none, BYTES).count() == bpe.decoded(bpe.encoded(none, BYTES), BYTES).count() == fim.transformed(none).count() == alignment.aligned(none, BYTES, PIECES).count() == 0
