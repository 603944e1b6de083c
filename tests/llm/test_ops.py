"""The training-data operators on small fixtures, against brute force and the libraries themselves."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from scriptorium.llm import bytebpe, decontaminate, licences, minhash, repeats, secrets, sharding, tokenids, topk, toxicity
from scriptorium.llm.components import components

SCHEMA = "doc_id long, text string, source string, score double, h long"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(120), say(90)
    out = [base, base, base + " tail", " ".join(base.split()[2:]), None, "", " ", "one", "one", "One", "two words", "a  b\n \tc   d ", "x" * 900, "ab" * 500, "It's 42!   ok\x1f"]
    out += [say(40) + " " + passage + " " + say(30) for _ in range(6)] + [say(r.randint(1, 60)) for _ in range(20)] + [say(4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s", 1.0, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words1(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_decontamination(spark, docs, texts, none):
    items = spark.createDataFrame([(1, " ".join(texts[0].split()[5:30]).upper()), (2, "One"), (3, None), (4, ""), (5, "two words"), (6, "absent words here"), (7, texts[20])], "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, items))
    wins = set()
    for r in items.collect():
        w = words1(r.text)
        n = min(10, len(w))
        wins |= {(str(r.item_id), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    for i, t in enumerate(texts):
        w, hit, its = words1(t), set(), set()
        for item, p in wins:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    its.add(item)
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(w), len(hit), sorted(its)), i
    assert decontaminate.decontaminate(none, items).count() == 0
    assert sum(r.n_hit for r in decontaminate.decontaminate(docs, items.limit(0)).collect()) == 0
    near = decontaminate.proximity(docs.where("doc_id = 10").unionByName(spark.createDataFrame([(99, "words x two", "s", 1.0, 2)], SCHEMA)), items.where("item_id = 5"), 1)
    assert {r.doc_id for r in near.collect()} == {10, 99}


def test_token_file(spark, docs, texts, none):
    path = P.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    blocks, _ = tokenids.write_file(docs, path)
    got = by_id(tokenids.starts(tokenids.read_file(blocks)))
    at = 0
    for i, t in enumerate(texts):
        want = coder.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i].ids == want and got[i].start == at and got[i].n_tokens == len(want)
        assert got[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    blocks, _ = tokenids.write_file(none, path)
    assert tokenids.read_file(blocks).count() == 0


def test_length_limited_codes():
    counts = np.array([1 << min(k, 40) for k in range(60)])
    for limit in (6, 8, 16):
        lens = tokenids.code_lengths(counts, limit).astype(int)
        assert lens.max() <= limit and sum(2.0**-x for x in lens) == 1
    r = np.random.default_rng(1)
    ids = r.integers(0, 60, 5000)
    lens = tokenids.code_lengths(np.bincount(ids), 16)
    stream, ends = tokenids.pack(ids, lens, tokenids.canonical_codes(lens))
    starts, n = ends[:-1:100], np.full(50, 100)
    assert (tokenids.unpack(stream, starts, n, *tokenids.decode_table(lens)) == ids).all()


def test_minhash(docs, texts, none):
    got = by_id(minhash.classes(docs, 2, 80, 100))
    sets = {}
    for i, t in enumerate(texts):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())
    assert minhash.classes(none).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50}


def test_byte_bpe(docs, texts, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bytebpe.decode(bytebpe.encode(docs, path, P.PATTERN), path))
    for i, t in enumerate(texts):
        assert got[i].ids == coder.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode(), i
    assert bytebpe.decode(bytebpe.encode(none, path, P.PATTERN), path).count() == 0


def test_encoders_on_odd_strings():
    """Both encoders equal their libraries on strings of marks, spaces, accents and letters that lower oddly."""
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    r = random.Random(1)
    odd = "aAz.,;:!?'sS\n\t 9\x01\u0130\u0130\u00df\u03a3\u2260\u00f1\u6f22\u0345\u0307\u0301\u0338\u00c5\u00a0\u037e"
    texts = [None, "", " ", "  a", "a "] + ["".join(r.choices(odd, k=r.randint(1, 30))) for _ in range(3000)]
    word, ranks = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
    library = Tokenizer.from_file(word)
    bytewise = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(ranks), special_tokens={})
    memo, coder = tokenids.PieceMemo(word), bytebpe.Coder(ranks, P.PATTERN)
    assert memo.fine
    for of, own in ((lambda t: library.encode(t, add_special_tokens=False).ids, lambda x: tokenids.ids_of_texts(memo, x)), (bytewise.encode_ordinary, coder.ids_of_texts)):
        flat, counts = own(pa.array(texts))
        ends = np.append(0, np.cumsum(counts))
        for i, t in enumerate(texts):
            assert flat[ends[i] : ends[i + 1]].tolist() == of(t or ""), repr(t)


@pytest.mark.parametrize("hot", [1024, 2])
def test_repeats(docs, texts, none, hot):
    got = by_id(repeats.remove_repeats(docs, length=80, k=32, stride=40, hot=hot))
    data = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + 80] for b in data for i in range(len(b) - 79))
    for i, b in enumerate(data):
        gone = set()
        for k in range(len(b) - 79):
            if n[b[k : k + 80]] > 1:
                gone |= set(range(k, k + 80))
        assert sum(s.end - s.start for s in got[i].spans) == len(gone), i
        if gone:
            assert bytes(got[i].kept) == bytes(c for k, c in enumerate(b) if k not in gone)
    assert repeats.remove_repeats(none).count() == 0


def test_secrets(spark, none):
    hexes = hashlib.sha1(b"1").hexdigest()
    rows = [(1, f'say token = "{hexes}" end', None, 1.0, 2), (2, f"at commit {hexes} of it", "s", 1.0, 2), (3, "card 9807915762804490 ok", "s", 1.0, 2), (4, None, "s", 1.0, 2), (5, "", "s", 1.0, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    forest = secrets.default_forest()
    got = {r.doc_id: [f for f in r.findings if f.score >= secrets.CUT] for r in secrets.scan(df, forest).collect()}
    assert [f.secret for f in got[1]] == [hexes] and not got[2] and not got[3] and not got[4] and not got[5]
    clean = {r.doc_id: r.text for r in secrets.redact(df, forest).collect()}
    assert clean[1] == 'say token = "[REDACTED]" end' and clean[2] == rows[1][1] and clean[4] is None
    assert secrets.scan(none, forest).count() == 0
    held_out = secrets.labelled_findings(600, seed=99)
    score = forest.predict(np.array([secrets.features(*f[:4]) for f in held_out]))
    assert np.mean((score >= secrets.CUT) == np.array([f[4] for f in held_out])) > 0.9


def test_licences(spark, none):
    mit = licences.SENTENCES["mit.grant"] + ". " + licences.SENTENCES["mit.condition"] + "."
    rows = [(1, "Words.\nReleased under the MIT License.", "", 1.0, 1), (2, mit, "", 1.0, 1), (3, "All rights reserved.", "", 1.0, 1), (4, None, "", 1.0, 1), (5, "", "", 1.0, 1), (6, "x. LICENSED under the Apache License, Version 2.0.", "", 1.0, 1)]
    got = by_id(licences.licences(spark.createDataFrame(rows, SCHEMA)))
    assert {k: (r.licences, r.unclaimed) for k, r in got.items()} == {1: (["MIT"], []), 2: (["MIT"], []), 3: ([], ["reserved"]), 4: ([], []), 5: ([], []), 6: (["Apache-2.0"], [])}
    assert licences.licences(none).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 40)).astype("float32")
    v[100:140] = v[100]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(900, None, 1), (901, [None] * 40, 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] + [0.0] * 39, 1)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = collections.defaultdict(list)
    for x in topk.top_k(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    q = np.floor(64 * v.astype(float)).astype(int)
    for i in range(0, 300, 20):
        s = q @ q[i]
        want = sorted(((-int(s[j]), j) for j in range(300) if j != i))[:20]
        assert got[i] == [(j, -x) for x, j in want]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_sharding(docs, texts, none):
    got = by_id(sharding.shard_by_bytes(docs, 5))
    size = [len((t or "").encode()) + 16 for t in texts]
    at, total = 0, sum(size)
    slots = collections.Counter()
    for i, t in enumerate(texts):
        s = min(4, (2 * at + size[i]) * 5 // (2 * total))
        assert (got[i].size, got[i].text_crc32, got[i].shard, got[i].slot) == (size[i], zlib.crc32((t or "").encode()), s, slots[s])
        slots[s] += 1
        at += size[i]
    assert sharding.shard_by_bytes(none).count() == 0


def test_toxicity(spark, none):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["sun", "tree", "river", "walk", "blue"]) for _ in range(n))
    rows = [(i, say(30) + (" you vile goblin " if i % 4 == 0 else " ") + say(10), "s", 1.0, 2) for i in range(300)] + [(900, None, "s", 1.0, 2), (901, "", "s", 1.0, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = by_id(toxicity.score(df, model))
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(300))
    assert 0 <= got[900].score == got[901].score <= 1
    assert toxicity.score(none, toxicity.learn(none, labels.limit(0))).count() == 0
