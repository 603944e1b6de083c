"""Near-duplicate classes: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact links.

1. Each document's set of word shingles is hashed (64 bits each).  Its sorted
   distinct hashes are divided into BINS bins by their leading bits; each bin's
   least hash is its value.  An empty bin takes the value of the first filled
   bin on its own pseudo-random probe sequence (optimal densification).
2. Documents with equal sets are one node; nodes get ids of their own.
3. BANDS bands of ROWS bins are bucket keys.  The node of a bucket that meets
   most others in all its buckets is its star's centre; only (centre, member)
   edges are candidates, so their number is at most nodes times bands, and where
   all are near one text, it is the centre of most of their buckets.
4. Candidates are confirmed on the full sets, exactly: intersection * den >=
   union * num.  Connected components of confirmed links give classes.
5. A star can miss a link between two members that are not both linked to the
   centre.  Buckets that still hold several components are joined to groups of
   components that meet, and a prefix index settles them: a node's shingles are
   ordered by how rare they are in its group, and two sets that are similar
   enough share one among the first n - ceil(n * num / den) + 1, early enough in
   both.  Only such pairs of different components, one of them outside its
   group's largest component, are confirmed like the others.  This loses no link
   between nodes of a bucket that would change a class, and where many documents
   lie just below the threshold, what they share is common, hence late, and
   what is rare differs: few pairs are left.

With the defaults a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8**4)**40, below 1e-9.

Nulls: a null text has no words: an empty set, linked with nothing.  Fewer words
than a shingle has: the whole sequence is the one shingle.  Null doc_ids take no
part in links and stand for themselves.  Repeated rows fall into one class; each
row is returned.  Rows that share doc_id but not the text are judged apart.  Ties:
a class is named by its smallest doc_id, whatever the order of links.  A very
long text is a slice of its own: a task holds about ten times its bytes.  Empty
tables give no rows.  Only doc_id and text are read, so extra columns, whatever
their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.components import components, extended
from scriptorium.llm.shared import distinct, lean, sized, slices, table, text_bytes, written

BANDS, ROWS = 40, 4
BIN_BITS = 8  # 256 bins; BANDS * ROWS of them, taken in a fixed order, fill the bands
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text end to end, and the borders of each text."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy(zero_copy_only=False)][filled] if len(flat) else np.zeros(0, np.uint64)
    borders = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    borders = np.append(0, np.cumsum(filled))[borders]  # of the words that aren't empty
    n = np.diff(borders)
    docs = np.repeat(np.arange(len(n)), n)
    # the shingle that starts at each word, where it fits; a shorter text is one shingle as a whole
    size = np.minimum(n, width)[docs]
    fits = np.arange(len(h)) + size <= borders[1:][docs]
    s = np.full(len(h), np.uint64(width))
    padded = np.append(h, np.zeros(width, np.uint64))
    for k in range(width):
        use = size > k
        s = np.where(use, mixed((s + STEP) ^ padded[k : k + len(h)]), s)
    s, docs = s[fits], docs[fits]
    counts = np.bincount(docs, minlength=len(n))
    ends = np.append(0, np.cumsum(counts))
    sets = [distinct(s[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)


def band_keys(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each set, a 64-bit key for each band; the band's number is mixed in.  Empty sets have keys of no meaning."""
    k, n = 1 << BIN_BITS, len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    slot = doc * k + (sets >> np.uint64(64 - BIN_BITS)).astype(np.int64)  # ascending: sets are sorted
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    value, have = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    value[slot[first]], have[slot[first]] = sets[first], True
    fill, tries = value.copy(), np.uint64(0)
    empty = np.flatnonzero(~have & np.repeat(np.diff(ends) > 0, k))
    while len(empty):
        bin_ = (empty % k).astype(np.uint64)
        probe = empty - empty % k + (mixed(bin_ * np.uint64(k) * np.uint64(977) + tries + np.uint64(1)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        ok = have[probe]
        fill[empty[ok]] = value[probe[ok]]
        empty, tries = empty[~ok], tries + np.uint64(1)
    rows = fill.reshape(n, k)[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1).astype(np.uint64) * STEP, (n, BANDS))
    for r in range(ROWS):
        key = mixed(key ^ rows[:, :, r])
    return key.view(np.int64)


def _digests(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits that stand for each set, as two columns of 64."""
    import xxhash

    own = [np.frombuffer(xxhash.xxh3_128_digest(sets[a:e].tobytes()), "<i8") for a, e in zip(ends[:-1], ends[1:], strict=True)]
    return np.array(own, np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, d1, d2 (128 bits that stand for the set), bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                sets, ends = shingle_sets(b.column(1), width)
                n = np.diff(ends)
                whole = _digests(sets, ends)
                bands = band_keys(sets, ends)[n > 0].ravel()
                at = np.append(0, np.cumsum((n > 0) * BANDS)).astype(np.int32)
                cols = [b.column(0), b.column(2), pa.array(n), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.ListArray.from_arrays(pa.array(at), pa.array(bands))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, n, shingles (its sorted 64-bit hashes as bytes) of the nodes (node, doc_id, d1, d2), one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                sets, ends = shingle_sets(b.column(1), width)
                whole = _digests(sets, ends)
                same = (whole[:, 0] == b.column(2).to_numpy()) & (whole[:, 1] == b.column(3).to_numpy())
                raw = pa.array([sets[a:e].tobytes() for a, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), raw], ["node", "n", "shingles"]).filter(pa.array(same))

    picked = docs.join(sized(nodes), "doc_id").select("node", "text", "d1", "d2")
    sets = written(picked.mapInArrow(lean(run), "node long, n long, shingles binary"), "minhash-sets")
    # a node's row may be repeated in docs
    return sets if sets.count() == nodes.count() else written(sets.dropDuplicates(["node"]), "minhash-sets")


def confirmed(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those edges (a, b) whose full shingle sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2):
                keep = []
                for i, (raw, other) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                    x, y = (np.frombuffer(r.as_buffer(), np.uint64) for r in (raw, other))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if den * common >= num * (len(x) + len(y) - common):
                        keep.append(i)
                got = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["a", "b"])

    sizes = sized(sets.select("node", "n"))
    # sets of too different sizes can't be similar enough; sizes meet before the sets are moved
    alike = edges.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b").where(F.least("n", "m") * den >= F.greatest("n", "m") * num)
    members = alike.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    pairs = members.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    return pairs.mapInArrow(lean(run), "a long, b long")


def torn_pairs(buckets: DataFrame, sets: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs of nodes of different components that meet in a bucket and may be similar enough, by a prefix index."""
    labelled = written(buckets.join(comp, "node", "left").select("k", "node", F.coalesce("component", "node").alias("c")), "minhash-labels")
    torn = labelled.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    held = written(labelled.join(torn.select("k", "low"), "k").select("node", "c", "low").distinct(), "minhash-torn")
    groups = components(held.select(F.col("low").alias("a"), F.col("c").alias("b")).where("a <> b").distinct())
    loose = written(held.select("node", "c").distinct().join(groups.toDF("c", "g"), "c"), "minhash-loose")
    largest = loose.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "c")).alias("top")).select("g", F.col("top.c").alias("top"))
    loose = written(loose.join(largest, "g").select("node", "c", "g", (F.col("c") != F.col("top")).alias("outer")), "minhash-outer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2):
                n = pc.binary_length(b.column(2)).to_numpy() // 8
                raw, _ = text_bytes(b.column(2))
                # a shingle of a group: both in one number
                group = mixed(b.column(1).to_numpy().astype(np.uint64) + STEP)
                key = mixed(raw.view(np.uint64) ^ np.repeat(group, n)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(key)], ["node", "key"])

    shingles = loose.join(sets, "node").select("node", "g", "shingles").mapInArrow(lean(run), "node long, key long")
    shingles = written(shingles, "minhash-shingles")
    shared = shingles.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    common = shingles.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("common"))
    placed = loose.join(sets.select("node", "n"), "node").join(common, "node")
    single = F.col("n") - F.size("common")  # shingles that no other node of the group has come first
    prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    index = placed.select("node", "c", "outer", "n", single.alias("single"), F.posexplode(F.slice("common", F.lit(1), F.greatest(prefix - single, F.lit(0)).cast("int"))).alias("at", "x"))
    index = written(index.select(F.col("x.key").alias("key"), "node", "c", "outer", "n", (F.col("single") + F.col("at")).alias("pos")), "minhash-index")
    other = index.where("outer").select("key", *(F.col(x).alias(f"o_{x}") for x in ("node", "c", "n", "pos")))
    once = "c <> o_c and (not outer or node < o_node)"
    alike = F.least("n", "o_n") * den >= F.greatest("n", "o_n") * num
    # what is left of both sets from this shingle on bounds the intersection
    early = (1 + F.least(F.col("n") - F.col("pos") - 1, F.col("o_n") - F.col("o_pos") - 1)) * (num + den) >= (F.col("n") + F.col("o_n")) * num
    return index.join(other, "key").where(once).where(alike & early).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))


def classes(docs: DataFrame, width: int = 2, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sig = written(signatures(docs, width), "minhash")
    real = sig.where("n_shingles > 0 and doc_id is not null")
    reps = real.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    # once written, the ids stay what they are
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n_shingles", F.col("r.doc_id").alias("doc_id"), F.col("r.bands").alias("bands")), "minhash-nodes")
    keys = reps.select("node", F.explode("bands").alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    # the rows of buckets that have more than one set, and nothing else, are kept for what follows
    met = written(keys.join(shared, "k"), "minhash-met")
    often = met.groupBy("node").agg(F.sum("size").alias("often"))
    centres = met.join(often, "node").groupBy("k").agg(F.max(F.struct("often", "node"))["node"].alias("centre"))
    buckets = written(met.select("k", "node").join(centres, "k"), "minhash-buckets")
    stars = written(buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "minhash-edges")
    nodes = written(reps.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "d1", "d2"), "minhash-members")
    sets = full_sets(docs, nodes, width)
    links = written(confirmed(stars, sets, num, den), "minhash-links")
    comp = components(links)
    rest = written(torn_pairs(buckets, sets, comp, num, den).distinct().join(stars, ["a", "b"], "left_anti"), "minhash-rest")
    found = written(confirmed(rest, sets, num, den), "minhash-links")
    comp = extended(comp, found)
    named = reps.select("node", "doc_id").join(comp, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = reps.select("node", "d1", "d2", F.col("doc_id").alias("own")).join(comp, "node", "left").join(named, "component", "left")
    whole = written(whole.select("d1", "d2", F.coalesce("component_id", "own").alias("component_id")), "minhash-classes")
    out = sig.select("doc_id", "text_key", "n_shingles", "d1", "d2").join(whole, ["d1", "d2"], "left")
    # a set without shingles, or a row without id, stands for itself
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates: shingles of two words, similarity 0.8 or more."""
    found = classes(table(spark, sf_dir, "documents"), 2, 80, 100)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


# Components need iteration; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
