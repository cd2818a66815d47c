"""Each operator against a brute-force version on a small table with nulls, empty, short, long and repeated texts, and clashing columns."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from kinfold.llm import common, exact_dedup, licenses, mixing, ngram_join, ppm, quality, sentencepieces, suffix_dedup, token_files, topk
from kinfold.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rk bigint, home int, n int, sid bigint, digest string, _keep bigint, key string, size int, token int"


def words(r, n):
    return [r.choice(["alpha", "Beta", "gamma", "delta", "é", "zeta", "eta", "theta", "iota", "kappa"]) + str(r.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base = words(r, 120)
    near = [base[:i] + [f"edit{i}"] + base[i + 1 :] for i in (10, 60, 110)]
    passage = " ".join(words(r, 60))
    out = [None, "", " \n\t", "one", "One two three", "one  TWO three", " ".join(base), " ".join(base), " ".join(base).upper()]
    out += [" ".join(x) for x in near] + [" ".join(words(r, 30)) + " " + passage + " " + " ".join(words(r, 20)) for _ in range(4)]
    out += [passage, "ab" * 400, "x" * 199, "x" * 200, "x" * 201, "\0nul \0", "tab\tand\x0bvt", "été « ligne » ▁ mark", "a　b c", "<|endoftext|> Ω ΣΑΣ don't"]
    out += [" ".join(words(r, r.randrange(1, 80))) for _ in range(40)] + [" ".join(words(r, 30_000))] + ["long" * 40_000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", [None, "b", "a", "ü"][i % 4], None, i, i, None, 5, "d", 1, None, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id, repeated ids with the same and with another text."""
    rows = [(None, "no id here"), (None, None), (1, "same words again and again"), (1, "same words again and again"), (2, "same words again and again"), (2, "other"), (3, None)]
    return spark.createDataFrame([(a, b, "en", None, None, 0, 0, 0, 0, "", 0, "", 0, 0) for a, b in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=[10 << 20, 20_000])
def homes(request, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", request.param)
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", request.param)


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def low(t):
    return (t or "").encode().lower()


def numbered(texts):
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


# 1


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = low(t).split()
        out[i] = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()
    return out


def brute_components(rows):
    sets = shingle_sets(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def test_ngram_join(docs, texts, homes):
    assert plain(ngram_join.join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute_components(numbered(texts)), key=repr)


@pytest.mark.parametrize(("chunk", "shingles", "whole", "heads"), [(2, 10**6, 30_000, 2), (1500, 10**6, 30_000, 1), (3, 10**6, 1, 1), (1500, 60, 30_000, 1)])
def test_ngram_join_of_chains(spark, monkeypatch, chunk, shingles, whole, heads):
    """Families near the threshold: chains of links, borderline pairs, sets of a few shingles, small chunks, families dealt by shingle, prefixes settled often."""
    for name, value in (("CHUNK", chunk), ("CHUNK_SHINGLES", shingles), ("WHOLE", whole), ("HEADS", heads)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(ngram_join, "HELD", 200)
    r = random.Random(chunk)
    rows = []
    for _ in range(14):
        w = words(r, r.choice([6, 9, 14, 40, 90]))
        for _ in range(r.randrange(2, 9)):
            w = list(w)
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = words(r, r.randrange(2))
            rows.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert plain(ngram_join.join(df), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=repr)


def test_tree_finds_the_links_of_brute_force():
    r = np.random.default_rng(1)
    for _ in range(60):
        base = r.integers(0, 60, 40)
        sets = [np.unique(np.concatenate([base[r.random(40) < 0.9], r.integers(0, 80, r.integers(0, 6))])).astype(np.uint64) for _ in range(12)]
        label = list(range(12))
        for i in range(12):
            for j in range(i):
                if ngram_join.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))):
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        got = dict(ngram_join.tree_links(list(range(12)), sets))
        assert [got.get(i, i) for i in range(12)] == label
        # between components, with the shingles of one set alone left out
        known = [int(x) for x in r.integers(0, 5, 12)]
        tokens, count = np.unique(np.concatenate(sets), return_counts=True)
        joined = ngram_join.tree_links(list(range(12)), [np.intersect1d(s, tokens[count > 1]) for s in sets], known, [len(s) for s in sets])
        assert all(known[a] != known[b] and ngram_join.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))) for a, b in joined)
        both, wanted = list(known), list(known)
        pairs = [(i, j) for i in range(12) for j in range(i) if ngram_join.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))]
        for c, edges in ((both, joined), (wanted, pairs)):
            for a, b in edges:
                c[:] = [c[a] if x == c[b] else x for x in c]
        assert len({*zip(both, wanted, strict=True)}) == len({*both}) == len({*wanted})


def test_ngram_join_through_rows_without_an_id(spark):
    """An id-less near copy lends nothing but its links; an id-less bridge connects what doesn't link itself."""
    w = [f"w{k}" for k in range(36)]
    a, bridge, b = w[:30], w[3:33], w[6:36]  # 26 shingles each: neighbours share 23 of 29, the ends 20 of 32
    other = [f"o{k}" for k in range(30)]
    rows = [(4, " ".join(a)), (None, " ".join(bridge)), (9, " ".join(b)), (7, " ".join(other)), (None, " ".join(other[1:])), (None, " ".join(other[1:])), (12, "not linked at all with anything")]
    got = collections.Counter(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).select("doc_id", "component_id").collect()))
    assert got == collections.Counter({(4, 4): 1, (None, 4): 1, (9, 4): 1, (7, 7): 1, (None, 7): 2, (12, 12): 1})


def test_representatives_keep_all_columns(docs, texts):
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for *_, c in brute_components(numbered(texts))})


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    with common.Scratch(spark) as scratch:
        got = {x["node"]: x["component"] for x in ngram_join.components(spark.createDataFrame(edges, "u bigint, v bigint"), scratch).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


# 2


def test_lm_scoring(docs, texts, homes, monkeypatch):
    monkeypatch.setattr(ppm, "HOMES", 3)
    rows = numbered(texts)
    trains = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    words_, contexts = collections.Counter(), collections.defaultdict(collections.Counter)

    def symbols(t):
        before = bytes(ppm.ORDER)
        for x in [*low(t), 256]:
            yield before, x
            before = before[1:] + bytes([x % 256])

    for i, t in rows:
        if trains(i):
            words_.update(low(t).split())
            words_[b" "] += 1
            for h, x in symbols(t):
                for k in range(ppm.ORDER + 1):
                    contexts[h[ppm.ORDER - k :]][x] += 1
    n, v = sum(words_.values()), len(words_)

    @functools.cache
    def chance(h, x):
        out, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            t = {s: c for s, c in contexts.get(h[ppm.ORDER - k :], {}).items() if s not in out}
            if t:
                total = 2 * sum(t.values()) - (len(t) if len(out) + len(t) == 257 else 0)
                if x in t:
                    return p * (2 * t[x] - 1) / total
                p *= len(t) / total
                out |= set(t)
        return p / (257 - len(out))

    for h in [h for h in contexts if len(h) == ppm.ORDER][::997]:
        assert sum(chance(h, x) for x in range(257)) == pytest.approx(1)
    got = {r["doc_id"]: r for r in ppm.scored(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        tokens = [*low(t).split(), b" "]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not trains(i), len(tokens), sum(words_[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((words_[w] + 1) / (n + v + 1)) for w in tokens))
        assert r["score"] == pytest.approx(sum(math.log10(chance(h, x)) for h, x in symbols(t)))


def test_lm_without_training(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    rest = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    r = ppm.scored(df.selectExpr(f"bigint({rest[0]}) AS doc_id", "text")).first()
    assert (r["held_out"], r["n_known"], r["train_tokens"]) == (True, 0, 0)
    assert r["score"] == pytest.approx(3 * math.log10(1 / 257))


def test_long_texts_are_learnt_and_scored_in_pieces(monkeypatch):
    texts = [b"", b" ", b"Ab", b"one word  and\tanother " * 40 + b"x", b"\n" * 30, bytes(range(256)) * 3, b"nospaceatall" * 20]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.binary())})
    key = (pa.scalar(3, pa.int32()),)

    def made() -> tuple:
        counted = ppm.counter(7, 2)(key, docs).to_pylist()
        model = pa.table({"word": pa.array([r["word"] for r in counted], pa.binary()), "gram": pa.array([r["gram"] for r in counted], pa.int64()), "value": pa.array([float(r["n"]) for r in counted])})
        rows = ppm.finisher(100, 10, 7, 2)(key, docs, model).to_pylist()
        return sorted(counted, key=lambda r: (r["word"] or b"", r["gram"] or 0)), [(*list(r.values())[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in rows]

    whole = made()
    for chunk, unmerged in ((1, 0), (3, 50), (64, 200), (500, 1 << 22)):
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        monkeypatch.setattr(ppm, "UNMERGED", unmerged)
        assert made() == whole
        for t in texts:
            assert np.concatenate(list(ppm.packed_pieces(t))).tolist() == ppm.packed([t.lower()]).tolist()
            assert [w for split in ppm.word_pieces(t) for w in split] == t.lower().split()


# 3


def test_sentencepiece(docs, texts):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in sentencepieces.encoded(docs, vocabulary("piece_bpe_32k.model"), with_ids=True).collect()}
    for i, t in numbered(texts):
        ids = judge.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["parity"] and got[i]["round_trip"]
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    back = sentencepieces.decoded(sentencepieces.encoded(docs, vocabulary("piece_bpe_32k.model"), with_ids=True), vocabulary("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: (t or "").replace("▁", " ") for i, t in numbered(texts)}


def test_sentencepiece_queries_return_tokens_and_text(spark):
    """op3 and the pipeline's last stage hold each document's ids and the text decoded from them."""
    import corpus_pipeline
    import sentencepiece

    from kinfold.llm.queries import op3_sentencepiece

    sf = "/root/testdata/sf0.001"
    judge = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for made in (op3_sentencepiece(spark, sf), corpus_pipeline.encode_stage(spark, docs, sf)):
        got = made.collect()
        assert len(got) == len(given)
        assert all(r["ids"] == judge.encode(given[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["text"] == given[r["doc_id"]].replace("▁", " ") for r in got)


def handmade(path, pieces, *, bpe, byte_fallback, normal=b"", squeeze=False, prefix=True):
    """A model file written field by field (pieces: text, score, type), and sentencepiece's own reading of it."""
    import struct

    import sentencepiece

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(n, kind, data):
        return varint(n << 3 | kind) + (varint(len(data)) if kind == 2 else b"") + data

    raw = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    trainer = field(3, 0, bytes([1 + bpe])) + field(35, 0, bytes([byte_fallback]))
    normaliser = field(1, 2, b"own" if normal else b"identity") + (field(2, 2, normal) if normal else b"") + field(3, 0, bytes([prefix])) + field(4, 0, bytes([squeeze]))
    path.write_bytes(raw + field(2, 2, trainer) + field(3, 2, normaliser))
    return sentencepieces.Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))


START = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
BYTES = [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
LETTERS = [("▁", -3.0), ("▁ab", -1.0), ("a", -2.0), ("b", -2.5), ("ba", -1.5), ("c", -4.0)]


def test_sentencepiece_unigram_model(tmp_path):
    """A unigram model with byte fallback."""
    c, judge = handmade(tmp_path / "u.model", START + BYTES + [(p, s, 1) for p, s in LETTERS], bpe=False, byte_fallback=True)
    assert not c.spec.bpe and c.spec.byte_fallback
    tests = ["ab", "abba cab", "ba  ab", "zab", "", " a", "é ab", "<s> a<unk>", f"a{sentencepieces.SEPARATOR}b c"]
    got = c.encode(tests)
    for t, (ids, same), back in zip(tests, got, c.decode([ids for ids, _ in got]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == judge.encode(t) and same
        assert back == t == judge.decode(np.frombuffer(ids, "<u4").tolist())


@pytest.mark.parametrize("bpe", [False, True])
def test_sentencepiece_user_defined_and_unused_pieces(tmp_path, bpe):
    """User-defined pieces are found before all others, unused ones never come out, and the text of a control piece is text."""
    normal = [(p, s) for p, s in LETTERS] + [("ab", -1.2), ("▁a", -1.4), ("bac", -9.0), ("cc", -6.0), ("<", -8.0), ("s", -8.1), (">", -8.2)]
    pieces = START + BYTES + [(p, s, 1) for p, s in normal] + [("abc", 0.0, 4), ("<sep>", 0.0, 4), ("cca", -2.0, 5), ("▁ca", -2.2, 5)]
    c, judge = handmade(tmp_path / "m.model", pieces, bpe=bpe, byte_fallback=True)
    r = random.Random(bpe)
    tests = ["abc", "ccabc", "a<sep>b", "cca ca", "<s>", "</s>ab", ""] + ["".join(r.choice(["a", "b", "c", " ", "<sep>", "é"]) for _ in range(r.randrange(1, 14))) for _ in range(150)]
    got = c.encode(tests)
    assert sum(same for _, same in got) == len(tests)
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == [judge.encode(t) for t in tests]
    unused = {len(pieces) - 1, len(pieces) - 2}
    assert not unused & {i for ids, _ in got for i in np.frombuffer(ids, "<u4").tolist()}
    assert c.decode([ids for ids, _ in got]) == [judge.decode(np.frombuffer(ids, "<u4").tolist()) for ids, _ in got]


@pytest.mark.parametrize("bpe", [False, True])
def test_sentencepiece_parity_is_compared_for_every_text(tmp_path, bpe):
    """A model with a character map and squeezed spaces has parity; with another tokenizer in its place no text that differs passes."""
    import sentencepiece
    from tokenizers import AddedToken, Tokenizer, models

    # the library's own character map: its normaliser's model holds it
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = dict(sentencepieces.wire(dict(sentencepieces.wire(spec))[3]))[2]
    r = random.Random(4)
    lines = [" ".join(words(r, 12)) for _ in range(100)]
    letters = sorted(set("".join(lines)) - {" "})
    pieces = START + [("▁", -4.0, 1)] + [(x, -5.0 - k / 100, 1) for k, x in enumerate(letters)] + [(p, -2.0 - k / 10, 1) for k, p in enumerate(["al", "ga", "▁d", "mm", "gamm", "▁del", "el", "ta", "alph"])]
    c, judge = handmade(tmp_path / "m.model", pieces, bpe=bpe, byte_fallback=False, normal=charsmap, squeeze=True)
    assert c.normal is not None and c.spec.squeeze and c.spec.charsmap
    tests = ["", *lines[:80], "  alpha1   Beta2 ", "ａｌｐｈａ１ ⅷ", "gamma3\u00a0delta4\ttheta5", " ", "\u3000"]
    got = c.encode(tests)
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == [judge.encode(t) for t in tests] and all(same for _, same in got)
    assert c.decode([ids for ids, _ in got]) == [judge.decode(np.frombuffer(ids, "<u4").tolist()) for ids, _ in got]
    c.tok = Tokenizer(models.WordLevel({"<unk>": 0}, unk_token="<unk>"))
    c.text_of, c.in_pairs = ["?"] * 5, np.zeros(5, bool)
    c.tok.add_special_tokens([AddedToken(sentencepieces.SEPARATOR, normalized=False, special=True)])
    c.young, c.old = {}, {}
    wrong = c.encode(tests)
    assert [same for _, same in wrong] == [np.frombuffer(ids, "<u4").tolist() == judge.encode(t) for t, (ids, _) in zip(tests, wrong, strict=True)]
    assert sum(not same for _, same in wrong) >= 80


# 4


def test_mixing_agrees_for_repeated_rows_and_ids(spark):
    r = random.Random(4)
    rows = [(i, f"{'w ' * r.randrange(9)}{r.randrange(3)}", r.choice(["a", "b", None])) for i in [None, None, 1, 1, 1, 2, 2, 3, *range(4, 40)] for _ in range(r.randrange(1, 4))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    full = lambda n: sorted(map(repr, mixing.mix(df.repartition(n)).select("doc_id", "size", "source_size", "taken").collect()))
    assert full(1) == full(3) == full(7)
    taken = collections.Counter()
    for x in mixing.mix(df).collect():
        taken[x["sources"][0]] += x["taken"]
        assert 0 <= x["taken"] <= 3 * x["size"]
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = mixing.targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_flow_against_enumeration():
    """The largest flow, and of those the cheapest, of small tables; separate groups give the same as one."""
    r = random.Random(8)
    for _ in range(25):
        names = ["a", "b", "c"][: r.randrange(1, 4)]
        patterns = [(tuple(sorted(r.sample(names, r.randrange(1, len(names) + 1)))), r.randrange(1, 3)) for _ in range(r.randrange(1, 3))]
        quotas = {s: r.randrange(0, 5) for s in names}
        price = lambda size, words: sum((words - k * size if words < (k + 1) * size else size) * k * k for k in range(3) if words > k * size)
        best = None

        def tried(i, left, total, cost):
            nonlocal best
            if i == len(patterns):
                best = min(best or (0, 1 << 30), (-total, cost))
                return
            sources, size = patterns[i]
            splits = [{}]
            for s in sources:
                splits = [d | {s: w} for d in splits for w in range(left[s] + 1)]
            for d in splits:
                if sum(d.values()) <= 3 * size:
                    tried(i + 1, {s: q - d.get(s, 0) for s, q in left.items()}, total + sum(d.values()), cost + price(size, sum(d.values())))

        tried(0, quotas, 0, 0)
        for solve in (mixing.flow, mixing.flows):
            got = solve(patterns, quotas)
            assert (-sum(got), sum(price(size, w) for (_, size), w in zip(patterns, got, strict=True))) == best


def test_mixing(docs, texts):
    rows = mixing.mix(docs).collect()
    size = {i: len(low(t).split()) for i, t in numbered(texts)}
    source = {i: [None, "b", "a", "ü"][k % 4] for k, (i, _) in enumerate(numbered(texts))}
    total = collections.Counter()
    for i, s in source.items():
        total[s] += size[i]
    want = mixing.targets(total)
    taken = collections.Counter()
    for r in rows:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == total[source[i]] and r["target"] == pytest.approx(want[source[i]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[i]] += r["taken"]
    assert len(rows) == len(texts)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert plain(mixing.mix(docs.repartition(2)), "doc_id", "taken") == plain(mixing.mix(docs), "doc_id", "taken")


def test_targets_cap_and_share():
    got = mixing.targets({"a": 10, "b": 10, "c": 980, None: 0})
    assert got["a"] == 30 and got["b"] == 30 and got[None] == 0
    assert sum(got.values()) == pytest.approx(1000)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_is_cheapest():
    # the shared pattern serves b, as a has words of its own; repetitions are spread
    assert mixing.flow([(("a",), 10), (("a", "b"), 10), (("b",), 1)], {"a": 10, "b": 11}) == [10, 10, 1]
    assert mixing.flow([(("a",), 10), (("a", "b"), 10)], {"a": 20, "b": 10}) in ([10, 20], [20, 10])
    assert mixing.flow([(("a",), 5)], {"a": 15}) == [15]


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 40 else ["a", "b"] if i < 80 else ["b"]) for i in range(100)], "doc_id bigint, text string, source array<string>")
    rows = mixing.mix(df, "source").collect()
    assert sum(r["taken"] for r in rows) == 1000
    assert all(r["taken"] <= 30 for r in rows)


def test_mixed_documents(docs):
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    times = {r["doc_id"]: r["times"] + (r["size"] > 0 and 2 * r["part"] >= r["size"]) for r in mixing.mix(docs).collect()}
    assert collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == collections.Counter({i: n for i, n in times.items() if n})


def test_mixed_documents_without_ids_and_with_repeated_ids(spark):
    """Each row, whatever its id, comes out as often as the mix took it."""
    r = random.Random(12)
    rows = [(None if n % 4 == 0 else n // 2, " ".join(words(r, r.randrange(1, 60))), "abc"[n % 3], n) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _row bigint").repartition(3)
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all(rows[x["_row"]] == tuple(x) for x in got)
    sizes, had = collections.Counter(), collections.Counter()
    for x in got:
        had[x["source"]] += len(x["text"].split())
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    want = mixing.targets(sizes)
    assert all(abs(had[s] - want[s]) <= 60 for s in sizes), (had, want)
    held, row = common.keyed(docs)
    times = {x["row"]: x["times"] + (x["size"] > 0 and 2 * x["part"] >= x["size"]) for x in mixing.mix(held, row=row).collect()}
    of = {x[row]: x["_row"] for x in held.collect()}
    assert sorted(collections.Counter(x["_row"] for x in got).values()) == sorted(n for n in times.values() if n) and len(of) == len(rows)
    assert any(x["doc_id"] is None for x in got)


# 5


def brute_suffixes(rows):
    w = suffix_dedup.WINDOW
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + w] for i in range(len(b) - w + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if seen[b[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


FIVE = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_dedup(docs, texts, homes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    rows = [(i, t if len(t or "") < 20_000 else t) for i, t in numbered(texts)]
    assert plain(suffix_dedup.dedup(docs), *FIVE) == sorted(brute_suffixes(rows), key=repr)


@pytest.mark.parametrize("pairs", [1, 20])
def test_suffix_dedup_of_shifted_and_tiny_alphabets(spark, monkeypatch, pairs):
    monkeypatch.setattr(suffix_dedup, "PAIRS", pairs)
    monkeypatch.setattr(common, "GROUP_BYTES", 4000)
    r = random.Random(pairs)
    base = "".join(r.choice("ab") for _ in range(900))
    rows = []
    for i in range(40):
        a = r.randrange(600)
        rows.append((i, "".join(r.choice("ab") for _ in range(r.randrange(60))) + base[a : a + r.randrange(150, 300)] + "".join(r.choice("ab") for _ in range(r.randrange(60)))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert plain(suffix_dedup.dedup(df), *FIVE) == sorted(brute_suffixes(rows), key=repr)


@pytest.mark.parametrize("hot", [1, 6])
def test_suffix_dedup_of_hot_anchors(spark, docs, texts, monkeypatch, hot):
    """Anchors above HOT are dealt by windows: passages in contexts of their own, copies in one home and in several, rows that share an id."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(common, "GROUP_BYTES", 4000)
    r = random.Random(hot)
    passage = " ".join(words(r, 60))
    rows = [(i, " ".join(words(r, r.randrange(40))) + passage[r.randrange(2) * 9 : len(passage) - r.randrange(3) * 7] + " ".join(words(r, r.randrange(40)))) for i in range(60)]
    rows += [(60 + i, rows[i % 5][1]) for i in range(20)] + [(100, "ab" * 500), (101, None), (102, "")] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert plain(suffix_dedup.dedup(df), *FIVE) == sorted(brute_suffixes(rows), key=repr)
    monkeypatch.setattr(common, "GROUP_BYTES", 200_000)
    assert plain(suffix_dedup.dedup(docs), *FIVE) == sorted(brute_suffixes(numbered(texts)), key=repr)


def test_merge_is_sorted_with_its_prefixes():
    r = random.Random(1)
    runs = [sorted((bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))), b"", 0, 0, False) for _ in range(r.randrange(0, 30))) for _ in range(7)]
    out = list(suffix_dedup.merged([suffix_dedup.decoded(k, list(suffix_dedup.coded(run))) for k, run in enumerate(runs)]))
    keys = [e[0] for e, _ in out]
    assert keys == sorted(e[0] for run in runs for e in run)
    assert [n for _, n in out[1:]] == [suffix_dedup.shared(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_suffix_spans_and_text(spark):
    p = "".join(chr(97 + i * i % 23) for i in range(250))
    df = spark.createDataFrame([(1, "head " + p + " tail"), (2, p)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(df).collect()}
    assert got[1]["spans"] == [[5, 255]] and bytes(got[1]["kept"]) == b"head  tail" and bytes(got[2]["kept"]) == b""


# 6


def labelled(spark, n=240):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = words(r, r.randrange(20, 200))
        rows.append((i, " ".join(w) + "." if good else "!! ".join(x.upper() + "%%%" for x in w)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(spark, docs):
    train, labels = labelled(spark)
    model = quality.fit(train, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.scored(train, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and sum((got[i] >= 0.3) == truth[i] for i in held) / len(held) > 0.95
    again = quality.fit(train.repartition(7), labels.union(labels))
    assert (again.good, again.bad, again.base) == (model.good, model.bad, model.base)
    packed = model.packed()
    for r in quality.scored(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        t = (r["text"] or "").encode()
        sizes = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t[k : k + 1024])) for k in range(0, len(t), 1024)) for d in (model.good, model.bad)] if len(t) < 5000 else None
        if sizes and t:
            assert quality.difference(t, *packed) == pytest.approx((sizes[1] - sizes[0]) / len(t))
        assert 0 <= r["score"] <= 1


def test_quality_fit_and_scores_against_brute_force(spark):
    """The sample in the order of Spark's hash, dictionaries of every second text, and the likeliest logistic curve of the others, found by steepest ascent."""
    train, labels = labelled(spark)
    order = {r["doc_id"]: r["h"] for r in train.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    text = {r["doc_id"]: r["text"].encode() for r in train.collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    mine = sorted((i for i in truth if zlib.crc32(str(i).encode()) % 5), key=order.get)
    by = {q: [text[i] for i in mine if truth[i] == q] for q in (1, 0)}
    pieces = lambda t: [t[k : k + 1024] for k in range(0, len(t), 1024)]
    packed = []
    for q in (1, 0):
        d = [p for t in by[q][::2] for p in pieces(t)]
        try:
            d = zstandard.train_dictionary(112_640, d).as_bytes()
        except zstandard.ZstdError:
            d = b"\n".join(d)[-112_640:]
        packed.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False))
    x = lambda t: sum(len(packed[1].compress(p)) - len(packed[0].compress(p)) for p in pieces(t)) / len(t)
    at = np.array([x(t) for q in (1, 0) for t in by[q][1::2]])
    y = np.array([q for q in (1, 0) for _ in by[q][1::2]])
    z, w, b = at / at.std(), 0.0, 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(w * z + b)))
        w += 0.05 * ((y - p) @ z - 0.05 * w)
        b += 0.05 * (y - p).sum()
    scores = {r["doc_id"]: r["score"] for r in quality.scored(train, quality.fit(train, labels)).collect()}
    for i in list(text)[:80]:
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-(w * x(text[i]) / at.std() + b))), abs=0.002)


def test_quality_of_odd_rows(spark):
    """Rows without an id or text, repeated rows and labels, ids with two labels: a score for every row, and the same fit for any order of rows."""
    train, labels = labelled(spark, 60)
    odd = train.unionByName(train.filter("doc_id < 9")).unionByName(spark.createDataFrame([(None, "x y"), (None, None), (3, None), (4, "")], train.schema))
    more = labels.unionByName(labels.filter("doc_id < 9")).unionByName(spark.createDataFrame([(None, 1, 0), (5, 0, 0), (5, 1, 0), (6, None, 0), (7, 9, 0), (3, 1, None)], labels.schema))
    a, b = quality.fit(odd.repartition(5), more), quality.fit(odd.repartition(2), more.repartition(3))
    assert (a.good, a.bad, a.weight, a.base) == (b.good, b.bad, b.weight, b.base)
    assert quality.scored(odd, a).count() == odd.count() and quality.accepted(odd, more).columns == odd.columns


def test_quality_takes_labels_only_where_allowed(spark):
    train, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = quality.fit(train, labels), quality.fit(train, flipped)
    assert (a.good, a.bad, a.weight, a.base) == (b.good, b.bad, b.weight, b.base)


def test_quality_of_a_huge_text_first_in_order(spark):
    """A labelled text beyond the whole sample's bytes, first in hash order, leaves the others of its class in."""
    train, labels = labelled(spark)
    bad = labels.filter("quality = 0 AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()
    huge = f"CASE WHEN doc_id = {bad[0]['doc_id']} THEN repeat(text || ' ', cast(ceil({quality.SAMPLE_BYTES} / length(text)) AS int)) ELSE text END AS text"
    train = train.selectExpr("doc_id", huge)
    got = quality.sample(train, labels)
    assert sum(not q for q, _ in got) == len(bad) and sum(len(t) for q, t in got if not q) <= quality.SAMPLE_BYTES
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.scored(train, quality.fit(train, labels)).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.3) == truth[i] for i in held) / len(held) > 0.95


def test_quality_samples_long_texts_from_start_to_end(spark):
    n, piece = quality.TEXT_BYTES, quality.PIECE
    for size in (0, 1, n - 1, n, n + 1, 2 * n + 77, 9 * n):
        text = random.Random(size).randbytes(size)
        row = spark.createDataFrame([(bytearray(text),)], "text binary").select(quality.spread().alias("t")).first()
        k = n // piece
        want = text if size <= n else b"".join(text[i * (size - piece) // (k - 1) :][:piece] for i in range(k))
        assert bytes(row["t"]) == want and (size <= n or want.endswith(text[-piece:]))


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, none)
    assert {r["score"] for r in quality.scored(docs, model).collect()} == {0.5}
    assert quality.accepted(docs, none).columns == docs.columns
    assert quality.scored(empty, model).count() == 0


# 7


def test_exact_dedup(docs, texts, odd):
    by = collections.defaultdict(list)
    for i, t in numbered(texts):
        by[low(t)].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest()) for t, g in by.items() for i in g)
    assert plain(exact_dedup.groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.dedup(docs).columns == docs.columns
    assert sorted(r["doc_id"] for r in exact_dedup.dedup(docs).select("doc_id").collect()) == sorted(max(g) for g in by.values())
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.groups(odd).collect())
    assert got == collections.Counter({(None, None, 1): 1, (None, 3, 2): 1, (3, 3, 2): 1, (1, 2, 3): 2, (2, 2, 3): 1, (2, 2, 1): 1})


def repeated(spark):
    """A source loaded twice, ids repeated with other texts, groups of copies without ids; each with a number of its own."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    rows = [(5, a), (9, a), (5, b), (5, b), (7, c), (7, c), (None, "d e f g h i"), (None, "D e f g h i"), (None, a), (3, None), (None, None)]
    return spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, _row bigint").repartition(4), rows


def test_exact_dedup_keeps_one_row_a_text(spark):
    docs, rows = repeated(spark)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all(rows[r["_row"]] == (r["doc_id"], r["text"]) for r in got)
    by = collections.defaultdict(list)
    for i, t in rows:
        by[low(t)].append(-1 if i is None else i)
    assert sorted((low(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in got) == sorted((t, max(g)) for t, g in by.items())


def test_near_dedup_keeps_one_row_a_class(spark):
    docs, rows = repeated(spark)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert all(rows[r["_row"]] == (r["doc_id"], r["text"]) for r in got)
    by = collections.defaultdict(list)
    for n, (i, t) in enumerate(rows):  # texts without words link with nothing
        by[low(t) or n].append(math.inf if i is None else i)
    assert sorted((low(r["text"]), math.inf if r["doc_id"] is None else r["doc_id"]) for r in got) == sorted((t if isinstance(t, bytes) else b"", min(g)) for t, g in by.items())


def test_cuckoo_index_against_a_set():
    r = random.Random(4)
    index, live = exact_dedup.CuckooIndex(2), {}
    for step in range(6000):
        d = hashlib.sha256(str(r.randrange(2500)).encode()).digest()
        if r.random() < 0.65:
            if index.get(d) is None:
                assert d not in live
                index.insert(d, step)
                live[d] = step
        else:
            assert index.delete(d) == (live.pop(d, None) is not None)
    assert {e[0]: e[1] for e in index.entries()} == live and index.n == len(live)
    assert all(index.get(d) is None for d in (hashlib.sha256(f"x{i}".encode()).digest() for i in range(1000)))


def test_live_index_takes_changes(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    index = exact_dedup.live_index(make([(1, "a"), (2, "A"), (3, "b"), (4, None)]), shards=3)
    after = exact_dedup.changed_index(index, added=make([(9, "c"), (10, "b"), (0, "d")]), removed=make([(0, "a"), (0, "zzz")]))
    name = {hashlib.sha256(t).digest(): t for t in (b"a", b"b", b"c", b"d", b"")}
    assert sorted((name[bytes(r["digest"])], r["keep_id"]) for r in after.collect()) == [(b"", 4), (b"b", 10), (b"c", 9), (b"d", 0)]


@pytest.mark.parametrize("n", [0, 3, 1000])
def test_live_index_with_its_own_number_of_shards(spark, n):
    """Deletion, insertion and growth against a dictionary, however few of the shards are in use."""
    make = lambda ids: spark.createDataFrame([(i, f"Text {i % 700}") for i in ids], "doc_id bigint, text string")
    index, wanted = exact_dedup.live_index(make(range(n))), {}
    for i in range(n):
        wanted.setdefault(hashlib.sha256(f"text {i % 700}".encode()).digest(), []).append(i)
    for added, removed in ((range(0), range(0, n, 2)), (range(2000, 4000), range(1, n, 7)), (range(5), range(0))):
        for i in removed:
            wanted.pop(hashlib.sha256(f"text {i % 700}".encode()).digest(), None)
        for i in added:
            wanted.setdefault(hashlib.sha256(f"text {i % 700}".encode()).digest(), []).append(i)
        index = exact_dedup.written(exact_dedup.changed_index(index, added=make(added), removed=make(removed)), "index")
        got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in index.collect()}
        assert got == {d: (max(ids), len(ids)) for d, ids in wanted.items()}


# 8


@pytest.mark.parametrize("dim,block", [(1, 64), (7, 64), (64, 4096)])
def test_top_k(spark, monkeypatch, dim, block):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(topk, "LIMIT_PART", 4)
    monkeypatch.setattr(topk, "PAIRS", 50)
    r = random.Random(dim)
    rows = [(i, [r.choice([-1.5, 0.25, r.random() - 0.5]) for _ in range(dim)], i % 3) for i in range(500)]
    rows += [(500 + i, rows[0][1], 0) for i in range(60)]  # ties
    rows += [(600, None, 0), (700, [], 0), (800, [None] * dim, 0), (900, [float("nan")] * dim, 0), (1000, [float("inf")] * dim, 0), (1100, [0.5] * (dim + 1), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    v = topk.quantised(df)
    got = plain(topk.top_k(v.filter("vec_id % 100 = 0"), v), "query_id", "rank", "vec_id", "score")
    ok = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for i, q in ok:
        if i % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i and len(x) == len(q)))[:10]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want, key=repr)


def test_bounds_prune_clustered_vectors(spark):
    """The bounds leave out most pairs before any exact score, resolution by resolution, and never one of the k best."""
    r = np.random.default_rng(2)
    # an uneven spread of energy, turned at random, in clusters
    turn = np.linalg.qr(r.normal(size=(64, 64)))[0]
    centres = r.normal(size=(40, 64)) * 3000 / np.arange(1, 65)
    v = np.floor((centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 64)) * 200 / np.arange(1, 65)) @ turn).astype(np.int64)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    turned = topk.fitted_turns(df)[64]
    assert np.allclose(turned.T @ turned, np.eye(64))
    q, x = topk.Rows(v[::100], turned), topk.Rows(v, turned)
    scores = v[::100] @ v.T
    scores[np.arange(40), np.arange(0, 4000, 100)] = -(1 << 60)
    limit = -np.sort(-scores, axis=1)[:, 9].astype(float)
    i, j, left = topk.survivors(q, x, limit, np.arange(0, 4000, 100)[:, None] != np.arange(4000))
    assert set(zip(*np.nonzero(scores >= limit[:, None]), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert left == sorted(left, reverse=True) and left[0] < 0.5 * scores.size and left[-1] < 0.02 * scores.size
    got = plain(topk.top_k(df.filter("vec_id % 100 = 0"), df), "query_id", "rank", "vec_id", "score")
    best = [(100 * a, k, b, s) for a in range(40) for k, (s, b) in enumerate(sorted(((-int(scores[a, b]), b) for b in np.argsort(-scores[a], kind="stable")[:60].tolist()))[:10], 1)]
    assert got == sorted(((a, k, b, -s) for a, k, b, s in best), key=repr)


@pytest.mark.parametrize("fit_dim,part", [(3, 1 << 21), (3, 100), (1024, 100)])
def test_top_k_in_many_parts_with_and_without_cells(spark, monkeypatch, fit_dim, part):
    """Vectors too long to be turned are all in one cell without a box; a cell of many rows is split over parts. A third of the rows are the same vector."""
    monkeypatch.setattr(topk, "FIT_DIM", fit_dim)
    monkeypatch.setattr(topk, "PART_NUMBERS", part)
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(topk, "LIMIT_PART", 4)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8)) * 500
    v = np.floor(centres[r.integers(0, 6, 300)] + r.normal(size=(300, 8)) * 20).astype(np.int64)
    v[::3] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>").repartition(3)
    got = plain(topk.top_k(df.filter("vec_id % 50 = 0"), df), "query_id", "rank", "vec_id", "score")
    want = []
    for a in range(0, 300, 50):
        best = sorted((-int(v[a] @ v[b]), b) for b in range(300) if b != a)[:10]
        want += [(a, k, b, -s) for k, (s, b) in enumerate(best, 1)]
    assert got == sorted(want, key=repr)


def test_top_k_of_repeated_ids(spark):
    v = spark.createDataFrame([(0, [2, 1]), (0, [2, 1]), (0, [-3, 5]), (1, [1, 1]), (1, [1, 1]), (7, [4, 0]), (8, [1, 1])], "vec_id bigint, v array<long>")
    got = collections.Counter(map(tuple, topk.top_k(v.filter("vec_id = 0"), v, 3).collect()))
    assert got == collections.Counter([(0, 1, 7, 8), (0, 2, 1, 3), (0, 3, 1, 3), (0, 1, 1, 2), (0, 2, 1, 2), (0, 3, 8, 2)])


def test_top_k_of_large_numbers(spark):
    df = spark.createDataFrame([(i, [1e9 + i, -3e8 * i]) for i in range(0, 300, 10)], "vec_id bigint, embedding array<double>")
    v = topk.quantised(df)
    got = plain(topk.top_k(v.filter("vec_id % 100 = 0"), v, 3), "query_id", "rank", "vec_id", "score")
    x = {i: [math.floor(1024 * (1e9 + i)), math.floor(1024 * (-3e8 * i))] for i in range(0, 300, 10)}
    want = []
    held = lambda v: max(-(2**63), min(2**63 - 1, v))
    for q in (0, 100, 200):
        best = sorted((-held(x[q][0] * x[j][0] + x[q][1] * x[j][1]), j) for j in x if j != q)[:3]
        want += [(q, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want, key=repr)


# 9


def test_license_scan(spark, docs):
    rows = [
        (1, "Some text.\nThis work is licensed under the GNU General Public License, version 3.\nMore."),
        (2, "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0."),
        (3, "A license to drive is under review, version 3."),
        (4, None),
        (5, "RELEASED   under the\nMIT license!"),
        (6, licenses.TEMPLATES["MIT-text"].replace("copies", "copys").replace("without restriction", "with no restriction")),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by = sorted((r["doc_id"], r["license"], r["n_diff"], dict(rows)[r["doc_id"]][r["start"] : r["end"]]) for r in got)
    assert [x[:2] for x in by] == [(1, "GPL-3.0"), (2, "CC-BY-4.0"), (2, "CC-BY-NC-4.0"), (5, "MIT"), (6, "MIT-text")]
    assert by[0][3] == "This work is licensed under the GNU General Public License, version 3"
    assert by[1][3] == "Licensed under CC BY 4.0" and by[3][3] == "RELEASED   under the\nMIT license"
    assert 0 < by[4][2] <= 8 and all(r["reduction"] > 0 for r in got)
    assert licenses.scan(docs).count() == 0


def test_license_scan_misses_nothing_within_tolerance():
    """Every stretch that brute force finds within tolerance of a template is matched, by it or by a better ranked one."""
    r = random.Random(6)
    s = licenses.Scanner(licenses.TEMPLATES)
    for _ in range(150):
        t = r.choice(s.templates)
        w = list(t.words)
        for _ in range(r.randrange(0, t.slack + 1)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["changed"], [w[k], "more"]])
        text = " ".join(words(r, 12) + w + words(r, 12)).encode()
        if licenses.fitted(t.words, [x.lower() for x in licenses.WORD.findall(text.decode())], t.slack):
            assert s.scan(text), text


def test_license_scan_names_each_exact_wording():
    """Every template's own wording, alone in random contexts, comes out under its own name with no differing word."""
    r = random.Random(8)
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for _ in range(40):
            low = " ".join([*words(r, r.randrange(25)), text, *words(r, r.randrange(25))])
            assert [(m[0], m[3]) for m in s.scan(low.encode())] == [(name, 0)], low


def test_license_scan_keeps_near_copies_of_long_texts_whole():
    """A short notice that begins a long text doesn't take the place of a near copy of that text."""
    s = licenses.Scanner(licenses.TEMPLATES)
    text = licenses.TEMPLATES["Apache-2.0-notice"].replace("compliance", "accordance")
    assert [(m[0], m[3]) for m in s.scan(text.encode())] == [("Apache-2.0-notice", 1)]
    both = licenses.TEMPLATES["GPL-2.0"] + " " + licenses.TEMPLATES["GPL-3.0"]
    assert [(m[0], m[3]) for m in s.scan(both.encode())] == [("GPL-2.0", 0), ("GPL-3.0", 0)]


def test_license_scan_against_brute_force(spark):
    """Blocks, ranks, reductions, winners and edits worked out anew: every stretch of a block against every template, word by word."""
    r = random.Random(12)
    short = {k: t for k, t in licenses.TEMPLATES.items() if len(licenses.WORD.findall(t)) < 48}
    word = lambda t: [w.lower() for w in licenses.WORD.findall(t)]
    clean = lambda t: " ".join(t.lower().split())

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def best_stretch(t, block, slack):
        found = [(edits(t, block[a:b]), b, a) for a in range(len(block)) for b in range(a + max(1, len(t) - slack), min(len(block), a + len(t) + slack) + 1)]
        return min(found, default=None)

    def brute(text):
        words_ = word(text)
        windows = []
        for name, t in short.items():
            t, n = word(t), len(word(t))
            d = n // 10
            size = n // (d + 1)
            for j in range(d + 1):
                for i in range(len(words_) - size + 1):
                    if words_[i : i + size] == t[j * size : (j + 1) * size]:
                        windows.append((max(0, i - j * size - d), min(len(words_), i - j * size + n + d), name))
        blocks = []
        for a, b, name in sorted(windows):
            if blocks and a < blocks[-1][1]:
                blocks[-1] = (blocks[-1][0], max(b, blocks[-1][1]), blocks[-1][2] | {name})
            else:
                blocks.append((a, b, {name}))
        out = []
        for a, b, names in blocks:
            data = " ".join(words_[a:b]).encode()
            plain_ = len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(data))
            size = {n: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(clean(short[n]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False).compress(data)) for n in names}
            order = sorted(names, key=lambda n: (size[n], n))
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                fits = []
                for rank, n in enumerate(order, 1):
                    t = word(short[n])
                    got = best_stretch(t, words_[x:y], len(t) // 10)
                    if got and got[0] <= len(t) // 10:
                        fits.append((2 * got[0] - len(t), rank, n, got))
                if fits:
                    _, rank, n, (diff, end, start) = min(fits)
                    out.append((n, round((plain_ - size[n]) / plain_, 9), rank, diff, x + start, x + end))
                    todo += [(x, x + start), (x + end, y)]
        return sorted(out, key=lambda m: m[4:])

    texts_ = []
    for _ in range(25):
        parts = []
        for name in r.sample(sorted(short), r.randrange(1, 4)):
            w = short[name].split()
            for _ in range(r.randrange(3)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["other"], [w[k], "more"]])
            parts += [*words(r, r.randrange(6)), *w]
        texts_.append(" ".join(parts))
    got = collections.defaultdict(list)
    df = spark.createDataFrame(list(enumerate(texts_)) + [(None, texts_[0]), (0, texts_[0])], "doc_id bigint, text string")
    for m in licenses.scan(df, short).collect():
        places = [(x.start(), x.end()) for x in licenses.WORD.finditer(texts_[m["doc_id"] or 0])]
        a = next(k for k, p in enumerate(places) if p[0] == m["start"])
        b = next(k for k, p in enumerate(places) if p[1] == m["end"]) + 1
        got[m["doc_id"]].append((m["license"], round(m["reduction"], 9), m["rank"], m["n_diff"], a, b))
    assert sum(map(len, got.values())) > 25
    for i, t in enumerate(texts_):
        assert sorted(got[i], key=lambda m: m[4:]) == (brute(t) if i else sorted(brute(t) * 2, key=lambda m: m[4:]))
    assert sorted(got[None], key=lambda m: m[4:]) == brute(texts_[0])


def test_license_scan_of_whole_long_licenses(tmp_path):
    """Long texts from a folder, with words changed, and a long text full of a template's words: found in time, and nothing else."""
    import time

    r = random.Random(3)
    vocabulary_ = [f"w{k}" for k in range(900)]
    long_ = {name: [r.choice(vocabulary_) for _ in range(n)] for name, n in (("Long-1.0", 5000), ("Long-2.0", 2500), ("Short", 300))}
    for name, w in long_.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(w))
    s = licenses.Scanner(licenses.from_folder(str(tmp_path)) | licenses.TEMPLATES)
    began = time.time()
    for name, w in long_.items():
        w = list(w)
        for _ in range(len(w) // 12):
            w[r.randrange(len(w))] = "changed"
        got = s.scan(" ".join(words(r, 50) + w + words(r, 50)).encode())
        assert [m[0] for m in got] == [name] and 0 < got[0][3] <= len(w) // 12
    assert s.scan(" ".join(r.choice(long_["Long-1.0"]) for _ in range(30_000)).encode()) == []
    assert time.time() - began < 20


# 10


def test_token_files(docs, texts, tmp_path):
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(docs, vocabulary("word_bpe_49k.json"), out)
    got = sorted(map(tuple, token_files.read_tokens(docs.sparkSession, manifest, out, with_ids=True).collect()))
    at, want = 0, []
    for (i, t), e in zip(numbered(texts), tok.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert got == want
    assert sum(p.stat().st_size for p in (tmp_path / "t").glob("ids-*.bin")) == 2 * at
    assert manifest.agg({"tokens": "sum"}).first()[0] == at


def test_token_files_of_wide_ids(docs, tmp_path):
    out = f"file://{tmp_path}/t"
    m = token_files.write_tokens(docs.limit(3), vocabulary("word_bpe_49k.json"), out, end_id=70_000)
    assert m.first()["kind"] == "<u4"
    assert all(r["ids"][-1] == 70_000 for r in token_files.read_tokens(docs.sparkSession, m, out, with_ids=True).collect())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_ids_of_the_library(texts, name):
    """Whatever the vocabulary: case, spaces, added tokens in any case, marks, broken characters."""
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(vocabulary(name))
    enc = token_files.WordEncoder(vocabulary(name))
    assert enc.words == (name == "word_bpe_49k.json")
    r = random.Random(1)
    tests = [t or "" for t in texts] + ["Hello World  two\n spaces", "<|ENDOFTEXT|> A<|endoftext|>B.", "<|endoftext|", "don't DON'T 12.5% (a)b \u0301c É́", "ﬁ Å\u00a0x\u2028y", "İstanbul"]
    tests += ["".join(r.choice("aB c.\n'!9é<|>\0 _") for _ in range(40)) for _ in range(300)]
    got = enc.batch([t.encode() for t in tests])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tok.encode_batch(tests, add_special_tokens=False)]


# all


def test_empty_tables(spark, empty):
    assert ngram_join.join(empty).count() == 0
    assert ppm.scored(empty).count() == 0
    assert sentencepieces.encoded(empty, vocabulary("piece_bpe_32k.model")).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns
    assert suffix_dedup.dedup(empty).count() == 0
    assert exact_dedup.groups(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert token_files.token_table(empty, vocabulary("word_bpe_49k.json")).count() == 0
    v = topk.quantised(spark.createDataFrame([], "vec_id bigint, embedding array<double>"))
    assert topk.top_k(v, v).count() == 0


def test_odd_rows(odd):
    n = odd.count()
    j = collections.Counter(map(tuple, ngram_join.join(odd).select("doc_id", "n_shingles", "component_id").collect()))
    assert j == collections.Counter({(None, 1, None): 1, (None, 0, None): 1, (1, 1, 1): 2, (2, 1, 1): 1, (2, 1, 2): 1, (3, 0, 3): 1})
    assert ppm.scored(odd).count() == n and sentencepieces.encoded(odd, vocabulary("piece_bpe_32k.model")).count() == n
    assert mixing.mix(odd).count() == n and suffix_dedup.dedup(odd).count() == n
    t = token_files.token_table(odd, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in t] == [None, None, 1, 1, 2, 2, 3]
