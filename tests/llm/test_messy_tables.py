"""Every opN_ query and the pipeline on one messy set of tables, against brute force and the libraries.

The tables hold null ids and texts, empty and long texts, repeated rows, rows that
share only the id, ties, and extra columns whose names the operators use inside.
"""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from scriptorium.llm import repeats, toxicity

CLASHES = "text_key d t w k h a b c g row rank shard spans kept bands node score query bytes _d _gone md5 component_id items".split()
PASSAGE = "the quick brown fox jumps over the lazy dog while nine tired judges count every grey stone"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def made_texts():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghijéß") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, shared, frame = say(150), say(120), say(100).split()
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "One"), (5, "two words"), (None, None), (None, base), (None, "lonely row"), (6, base), (6, base), (7, base), (8, base + " tail"), (9, " ".join(base.split()[1:]))]
    out += [(20 + i, say(50) + " " + shared + " " + say(60)) for i in range(5)]
    # near a frame, but mostly not near each other
    for i in range(40):
        w = list(frame)
        for j in r.sample(range(100), 2 + i % 5):
            w[j] = say(1)
        out.append((100 + i, " ".join(w)))
    out += [(200 + i, say(r.randint(1, 80))) for i in range(40)] + [(300, say(30) + " " + PASSAGE.upper() + "! " + say(5)), (301, PASSAGE + " " + PASSAGE), (302, say(12_000))]
    out += [(310, "x" * 1500), (311, "ab\x00" * 500), (312, "say <|endoftext|> and <|ENDOFTEXT|> x<|startoftext|>y"), (313, 'password = "hunter2abc" ' + say(20)), (314, "It's 42!  it’s okİ \x1f\x01 \U0001f600")]
    out += [(400 + i, say(30) + " you vile goblin scum " + say(10)) for i in range(60)]
    return out


def write(folder, texts, items, labels, vectors):
    os.makedirs(folder, exist_ok=True)
    extra = lambda n: {c: ["x"] * n for c in CLASHES}
    docs = {"doc_id": pa.array([d for d, _ in texts], pa.int64()), "text": pa.array([t for _, t in texts], pa.string()), "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": pa.array([len(t or "") for _, t in texts], pa.int64())}
    pq.write_table(pa.table(docs | {k: pa.array(v, pa.string()) for k, v in extra(len(texts)).items()}), f"{folder}/documents.parquet", row_group_size=50)
    some = lambda cols, n: pa.table(cols | {k: pa.array(v, pa.string()) for k, v in extra(n).items() if k not in cols})
    pq.write_table(some({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}, len(items)), f"{folder}/benchmark.parquet")
    pq.write_table(some({"doc_id": pa.array([d for d, *_ in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([t for _, t in labels], pa.int32())}, len(labels)), f"{folder}/labels.parquet")
    pq.write_table(some({"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32()))}, len(vectors)), f"{folder}/embeddings.parquet")


def made_vectors():
    r = np.random.default_rng(4)
    v = r.normal(size=(240, 40)).astype("float32")
    v[60:100] = v[60]
    out = [(i, x.tolist()) for i, x in enumerate(v)]
    return out + [(20, v[20].tolist()), (33, v[33].tolist()), (None, v[1].tolist()), (900, None), (920, []), (940, [None] * 40), (901, [float("nan")] * 40), (960, [float("inf")] + [0.0] * 39), (980, [1.0, 2.0, 3.0]), (981, [1.0, 2.5, 3.0]), (1000, (v[3] * 1e30).tolist())]


ITEMS = [(1, PASSAGE), (2, "One"), (3, None), (4, ""), (5, "absent words here"), (6, PASSAGE.title()), (None, "two words")]


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def sf(tmp_path_factory, texts):
    folder = str(tmp_path_factory.mktemp("messy"))
    labels = [(d, int("goblin" in (t or ""))) for d, t in texts] + [(None, 1), (99_999, 1), (200, None)]
    write(folder, texts, ITEMS, labels, made_vectors())
    return folder


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(folder, [], [], [], [])
    return folder


def result(spark, sf, name):
    return [tuple(r) for r in entry.queries()[name](spark, sf).collect()]


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


@pytest.mark.parametrize("name", [*sorted(n for n in entry.queries() if re.match(r"op\d+_", n)), "pipeline"])
def test_empty_tables(spark, empty, name):
    assert result(spark, empty, name) == []


def words1(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


@pytest.mark.parametrize("limit", [None, 0])
def test_op1(spark, sf, texts, limit, monkeypatch):
    if limit is not None:  # the way without broadcasts
        from scriptorium.llm import decontaminate

        monkeypatch.setattr(decontaminate.corpus_counts, "__defaults__", (0,))
        monkeypatch.setattr(decontaminate.index, "__defaults__", (0,))
    wins = set()
    for item, text in ITEMS:
        w = words1(text)
        n = min(10, len(w))
        wins |= {(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n}
    want = []
    for d, t in texts:
        w, hit, items = words1(t), set(), set()
        for item, p in wins:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items.add(item)
        ids = sorted(str(i) for i in items if i is not None)
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    same(result(spark, sf, "op1_decontamination"), want)


def test_op1_shuffles_no_texts(spark, sf):
    from scriptorium.llm import decontaminate

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = decontaminate._tokens(docs)
    from pyspark.sql import functions as F

    plan = every.select("doc_id", "w", F.posexplode_outer("w").alias("pos", "term")).join(F.broadcast(spark.sql("select 'x' term")), "term")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan  # no second tokenisation for a filter


def test_op2(spark, sf, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(result(spark, sf, "op2_token_ids"), key=lambda r: r[1])
    ids = {(d, t): [*coder.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts}
    want = [(d, len(x := ids[d, t]), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in texts]
    same([(r[0], r[2], r[3]) for r in got], want)
    at = 0
    for d, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == sorted((d for d, _ in texts), key=lambda d: -1 if d is None else d)


def test_op3(spark, sf, texts):
    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset({tuple(w)} if w else ())

    sets = [shingles(t) for _, t in texts]
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and texts[i][0] is not None and texts[j][0] is not None and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = [(d, len(s), None if d is None else least[find(i)], None if d is None else d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True))]
    same(result(spark, sf, "op3_minhash"), want)
    assert 2 < len({r[2] for r in want if r[0] and 100 <= r[0] < 140}) < 40


def test_op4(spark, sf, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in texts:
        ids = coder.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(result(spark, sf, "op4_byte_bpe"), want)


@pytest.mark.parametrize("piece, hot", [(None, None), (3000, None), (None, 2000)])
def test_op5(spark, sf, texts, piece, hot, monkeypatch):
    if piece:
        monkeypatch.setattr(repeats, "PIECE", piece)
    if hot:
        monkeypatch.setattr(repeats.remove_repeats, "__defaults__", (repeats.LENGTH, repeats.K, repeats.STRIDE, hot))
    data = [(d, (t or "").encode()) for d, t in texts]
    n = collections.Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    want = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if n[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=False) if not x)).hexdigest()))
    same(result(spark, sf, "op5_suffix_dedup"), want)


def test_op6_and_op7_give_every_row(spark, sf, texts):
    for name in ("op6_secrets", "op7_licences"):
        same([r[0] for r in result(spark, sf, name)], [d for d, _ in texts])
    secret = {r[0]: r[2] for r in result(spark, sf, "op6_secrets")}
    assert secret[313] == 1 and secret[2] == 0 and secret[302] == 0


def test_op8(spark, sf):
    rows = [(i, np.floor(64 * np.array(v, np.float64))) for i, v in made_vectors() if i is not None and v and None not in v and np.isfinite(v).all()]
    exact = [(i, [max(-(2**63), min(2**63 - 1, int(x))) for x in v]) for i, v in rows]
    want = []
    for q, qv in {(i, tuple(v)) for i, v in exact if i % 20 == 0}:
        score = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qv, v, strict=True)))), i) for i, v in exact if i != q and len(v) == len(qv))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(score[:20])]
    same(result(spark, sf, "op8_topk"), want)


def test_op9(spark, sf, texts):
    got = sorted(result(spark, sf, "op9_sharding"), key=lambda r: (r[4], r[5]))
    same([(r[0], r[1], r[2]) for r in got], [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts])
    assert [r[0] for r in got] == sorted((d for d, _ in texts), key=lambda d: -1 if d is None else d)
    total, at, slots = sum(r[1] for r in got), 0, collections.Counter()
    for _, size, _, law, shard, slot, grown in got:
        assert (law, grown, shard, slot) == ("bytes", None, min(39, (2 * at + size) * 40 // (2 * total)), slots[shard])
        slots[shard] += 1
        at += size


def test_op10(spark, sf, texts):
    got = result(spark, sf, "op10_toxicity")
    same([(r[0], r[1]) for r in got], [(d, d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in texts])
    assert all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.7) for r in got)
    toxic = {d for d, t in texts if "goblin" in (t or "")}
    held = [r for r in got if r[1]]
    assert sum(r[3] == 1 for r in held if r[0] in toxic) >= 0.9 * sum(r[0] in toxic for r in held)
    assert not any(r[3] for r in held if r[0] not in toxic)


def test_character_ngrams_in_pieces(monkeypatch):
    texts = pa.array(["Élan vital ÉÉÉ " * 9, None, "", "ab", "übergroß\U0001f600 " * 30])
    whole = toxicity.present(texts, None)
    monkeypatch.setattr(toxicity, "PIECE", 20)
    assert all((a == b).all() for a, b in zip(whole, toxicity.present(texts, None), strict=True))
    # a character counts once, whatever its bytes
    assert len(toxicity.present(pa.array(["éàü"]), None)[0]) == 1


def brute_pipeline(spark, sf, texts):
    """The five stages row by row; scores and the forest come from the trained models, all else is written anew."""
    import tiktoken

    from scriptorium.llm import secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = []
    for d, t in texts:
        _, bucket = toxicity.present(pa.array([t], pa.string()), model.weights != 0)
        if 1 / (1 + np.exp(-(model.intercept + model.weights[bucket].astype(float).sum()))) < 0.7:
            rows.append((d, t))

    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())

    sets = {t: shingles(t) for _, t in rows}
    nodes = [(d, t) for d, t in dict.fromkeys(rows) if d is not None and sets[t]]
    of = {x: {x} for x in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            x, y = sets[a[1]], sets[b[1]]
            if 100 * len(x & y) >= 80 * len(x | y) and of[a] is not of[b]:
                of[a] |= of[b]
                for z in of[b]:
                    of[z] = of[a]
    kept, seen = [], set()
    keys = {t: k for t, k in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").selectExpr("t", "xxhash64(t) k").collect()}
    for d, t in rows:
        if (d, t) not in of:
            if d is None or (d, t) not in seen:
                kept.append((d, t))
        elif (d, t) not in seen and (d, t) == min(of[d, t], key=lambda x: (x[0], keys[x[1]])):
            kept.append((d, t))
        seen.add((d, t))
    wins = set()
    for _, text in ITEMS:
        w = words1(text)
        n = min(10, len(w))
        wins |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    clean = []
    for d, t in kept:
        w = words1(t)
        if not any(tuple(w[i : i + n]) in wins for n in {len(x) for x in wins} for i in range(len(w) - n + 1)):
            clean.append((d, t))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in clean:
        if t:
            for a, e, s in reversed(secrets.judged([t], ["s"], secrets.default_forest())[0]):
                t = t[:a] + "[REDACTED]" + t[e:] if s >= secrets.CUT else t
        ids = coder.encode_ordinary(t or "")
        out.append((d, len(ids), tuple(ids), t or ""))
    return out


def test_pipeline(spark, sf, texts, monkeypatch):
    import corpus_pipeline

    seen, write = {}, corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, label: (seen.update({label: df.columns}), write(df, label))[1])
    got = [(r.doc_id, r.n_tokens, tuple(r.ids), r.text) for r in entry.queries()["pipeline"](spark, sf).collect()]
    want = brute_pipeline(spark, sf, texts)
    same(got, want)
    assert 60 < len(want) < len(texts) - 60
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(seen[f"pipeline-{name}"] == columns for name, _ in corpus_pipeline.STAGES[:-1])


def test_sizes_are_measured(spark):
    from scriptorium.llm.shared import measured_bytes

    df = spark.createDataFrame(pd.DataFrame({"a": ["x" * 1000] * 10, "b": [["yy", "z"]] * 10, "c": [1] * 10}))
    assert 10_000 < measured_bytes(df) < 12_500
    assert measured_bytes(df.limit(0)) == 0


def test_components_need_no_number_of_rounds(spark):
    from scriptorium.llm.components import components

    r = random.Random(2)
    ids = r.sample(range(10**6), 600)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {x.component for x in components(links).collect()} == {min(ids)}


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from scriptorium.llm.shared import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf)))
