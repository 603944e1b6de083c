"""Suffix-array dedup: removes every byte of a string of LENGTH bytes that also starts elsewhere.

Buckets.  Each window of LENGTH bytes is owned by its minimiser: the least hash
of the K-byte strings in it (leftmost on ties).  Equal windows have equal
minimisers at equal places, so only segments - runs of windows with one
minimiser - with the same minimiser hash can hold repeats, and segments whose
hash occurs once are dropped before any text is moved.

Shards.  The segments of a bucket are dealt to two shards.  A segment is read as
STRIDE strings over symbols of STRIDE bytes (one for each residue), so LENGTH
bytes are LENGTH / STRIDE symbols.  The alphabet's order is free; symbols are
ranked by a hash, and a second hash tells symbols apart that share the first.
Each shard's suffixes are sorted by doubling; its Burrows-Wheeler transform lists
the symbol before each suffix.

Merge.  The two transforms are merged by iterative interleave refinement: the
interleaving by h symbols, sorted stably by the preceding symbols, is the one by
h + 1 symbols.  Borders of blocks that appear in round h mark common prefixes of
h - 1 symbols.  The repeated intervals are the stretches whose common prefixes
reach LENGTH / STRIDE symbols.  Suffixes are never re-sorted across shards.

Hot buckets (more than HOT bytes).  A segment's windows are divided into SLICES
by their distance from the minimiser; all windows of a slice hold a core of
bytes around it, so slices meet only where their cores are equal.  Slices whose
whole contents are equal are repeats without more ado and one of them stands for
all; what differs is merged as above, in a bucket for each core.  Where even
such a bucket has more than HOT bytes (or a segment has several minimisers), it
is dealt to several tasks by a hash, and what is single in its task is compared
across tasks by 128-bit hashes of the windows, each block counting once a task.
All of this is exact and gathers no bucket in a task.

Exact copies: all rows of one text of LENGTH bytes or more are removed whole;
one of them stays as a partner for other texts.

Nulls: a null text is empty.  A null doc_id is a document like others.  Repeated
rows are copies of each other.  Ties don't matter: all occurrences go.  Texts
below LENGTH bytes are kept.  Very long texts are searched in pieces of PIECE
bytes that overlap by LENGTH - 1, so memory follows the piece; what is left of a
text is put together in one row.  Empty tables give no rows.  Only doc_id and
text are read, so extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.shared import lean, sized, slices, table, text_bytes, written

LENGTH = 400
K = 64
STRIDE = 100
HOT = 600_000
SLICES = 16
BATCH_BYTES = 1_000_000
PIECE = 1 << 20
PLACE_BITS = 26  # of a place within a slice of texts; a slice has SLICE or PIECE bytes at most


# --- minimisers ---


def rolling(raw: np.ndarray, k: int, seed: int = 0x1234567) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on (the last k - 1 are of what there is)."""
    h, done, power = raw.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed), 1, 0xD1342543DE82EF95
    while done < k:  # strings of `done` bytes are joined to twice as many, as long as that fits
        step = min(done, k - done)
        shifted = np.zeros_like(h)
        shifted[: len(h) - step] = h[step:] if step < len(h) else h[:0]
        h = h * np.uint64(power) + (shifted ^ (shifted >> np.uint64(31)))
        power = (power * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF
        done += step
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def segments(raw: np.ndarray, borders: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, minimiser hash, minimisers merged, minimiser's place) of each segment; positions within the text."""
    sizes = np.diff(borders)
    starts = np.flatnonzero(np.repeat(sizes >= length, sizes))
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none, none
    h = rolling(raw, k)
    if len(h) > 1 << PLACE_BITS:
        raise ValueError("more bytes than places")
    # hash above, position below: minima are the leftmost of the least
    packed = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h)).astype(np.uint64)
    width, done = length - k + 1, 1
    least = packed
    while done < width:
        step = min(done, width - done)
        moved = least[step:]
        least = np.minimum(least[: len(moved)], moved)
        done += step
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(len(least))
    text = text_of[window]
    whole = window + length <= borders[1:][text]
    window, text = window[whole], text[whole]
    at = (least[window] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    owner = h[at].view(np.int64)
    # a run goes on while text and hash stay; windows of one text are consecutive
    new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(owner, prepend=owner[0] ^ 1) != 0))
    last = np.append(new[1:], len(window)) - 1
    merged = np.add.reduceat((np.diff(at, prepend=-1) != 0).astype(np.int64), new)
    t = text[new]
    return t, window[new] - borders[t], window[last] - borders[t], owner[new], np.maximum(merged, 1), at[new] - borders[t]


# --- Burrows-Wheeler transforms of a shard, and their merge ---


def ranked(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 on."""
    order = np.argsort(key)
    own = key[order]
    new = np.empty(len(key), np.int64)
    new[order] = np.cumsum(np.append(True, own[1:] != own[:-1])[: len(key)])
    return new


def symbols(data: np.ndarray, stride: int) -> np.ndarray:
    """Ranks from 1 on of the stride bytes from each position on, in the order of their hashes."""
    h, other = rolling(data, stride), rolling(data, stride, 0x7654321)
    order = np.argsort(h)
    own, second = h[order], other[order]
    same = own[1:] == own[:-1]
    if (second[1:] != second[:-1])[same].any():  # different strings of one hash
        order = np.lexsort((other, h))
        own, second = h[order], other[order]
        same = (own[1:] == own[:-1]) & (second[1:] == second[:-1])
    out = np.empty(len(data), np.int64)
    out[order] = np.cumsum(np.append(True, ~same)[: len(data)])
    return out


class Shard:
    """Suffixes of segments, sorted by `depth` symbols, and the symbol before each."""

    def __init__(self, symbol: np.ndarray, pos: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray, stride: int, depth: int):
        # pos: the positions of this shard; seg_start, seg_end: of each position's segment
        inside = np.full(len(symbol) + 1, -1, np.int64)
        inside[pos] = np.arange(len(pos))

        def ahead(rank: np.ndarray, by: int) -> np.ndarray:
            to = pos + by
            return np.where(to < seg_end, rank[inside[np.minimum(to, len(symbol))]], 0)

        rank, done, known = ranked(symbol[pos]), 1, {}
        known[1] = rank
        while done < depth:
            add = max(d for d in known if d <= min(done, depth - done))
            rank = ranked(rank << 32 | ahead(known[add], done * stride))
            done += add
            known[done] = rank
        order = np.argsort(rank)
        self.pos = pos[order]
        first = seg_start[order]
        before = self.pos - stride
        self.symbol = np.where(before >= first, symbol[np.maximum(before, 0)], 0)
        ends = pos[pos + stride >= seg_end]  # the last position of each string: what stands before its end
        self.end_symbol = symbol[ends]
        self.suffixes, self.ends = len(pos), len(ends)


def merge(a: Shard, b: Shard, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves two shards; (position, common prefix with the one before, in symbols up to `rounds`) in merged order."""
    ends, n = a.ends + b.ends, a.suffixes + b.suffixes
    bwt_a, bwt_b = np.append(a.end_symbol, a.symbol), np.append(b.end_symbol, b.symbol)
    head = np.append(np.zeros(a.ends, bool), np.ones(b.ends, bool))
    z = np.concatenate([head, np.zeros(a.suffixes, bool), np.ones(b.suffixes, bool)])
    block = np.zeros(ends + n, np.int64)  # by no symbol at all; from the first round on, string ends are never equal
    lcp = np.full(ends + n, -1)
    lcp[: ends + 1] = 0
    shift = int(ends + n).bit_length()
    mask = (1 << shift) - 1
    place = np.arange(ends + n)
    for h in range(rounds):
        from_b = np.cumsum(z)
        symbol = np.empty(len(z), np.int64)
        symbol[z] = bwt_b[: int(from_b[-1]) if len(z) else 0]
        symbol[~z] = bwt_a
        moved = symbol > 0
        key = np.sort(symbol[moved] << shift | place[moved])
        at = key & mask
        own = key >> shift
        own_block = block[at]
        border = np.append(True, (own[1:] != own[:-1]) | (own_block[1:] != own_block[:-1])) if len(at) else np.zeros(0, bool)
        z = np.append(head, z[at])
        block = np.append(np.arange(ends), ends - 1 + np.cumsum(border))
        tail = lcp[ends:]
        tail[border & (tail < 0)] = h
    pos = np.empty(ends + n, np.int64)
    pos[~z] = np.append(np.full(a.ends, -1), a.pos)
    pos[z] = np.append(np.full(b.ends, -1), b.pos)
    common = lcp[ends:]
    return pos[ends:], np.where(common < 0, rounds, common)


def repeated(data: np.ndarray, sizes: np.ndarray, second: np.ndarray, length: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of parts end to end: whether the string of `length` bytes from it on starts twice or more; interval ids (-1: shorter).

    second: whether a part belongs to the second shard.
    """
    ends = np.cumsum(sizes)
    # parts are kept apart by stride bytes, so that no symbol of a window crosses a border
    begin = ends - sizes + np.arange(len(sizes)) * stride
    pos = np.repeat(begin - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    apart = np.zeros(len(data) + len(sizes) * stride, np.uint8)
    apart[pos] = data
    symbol = symbols(apart, stride)
    start, end = np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)
    side = np.repeat(second, sizes)
    depth = length // stride
    where, common = merge(*(Shard(symbol, pos[m], start[m], end[m], stride, depth) for m in (~side, side)), depth)
    of = np.full(len(apart), -1, np.int64)
    of[where] = np.cumsum(common < depth)  # an interval ends where the common prefix is shorter
    whole = pos + length <= end
    intervals = np.where(whole, of[pos], -1)
    counts = np.bincount(intervals[whole], minlength=1)
    return whole & (counts[np.maximum(intervals, 0)] > 1), intervals


# --- the distributed operator ---

FOUND = "doc_id long, text_key long, first int, last int, d1 long, d2 long, n long"


def pieces(borders: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) of all texts of `length` bytes or more, those of more than PIECE bytes in overlapping pieces."""
    for t, size in enumerate(np.diff(borders).tolist()):
        at = 0
        while size - at >= length:
            yield t, at, min(size, at + PIECE)
            if at + PIECE >= size:
                break
            at += PIECE - length + 1


def _minimisers(length: int, k: int):
    """mapInArrow over doc_id, text_key, text: the segments of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2, PIECE):
                raw, borders = text_bytes(b.column(2))
                parts = list(pieces(borders, length)) if b.num_rows == 1 else None
                for _, low, high in parts if parts is not None else [(0, 0, len(raw))]:
                    part, own = (raw[low:high], np.array([0, high - low])) if parts is not None else (raw, borders)
                    t, first, last, owner, merged, place = segments(part, own, length, k)
                    cols = [b.column(0).take(pa.array(t)), b.column(1).take(pa.array(t)), *(pa.array((x + low).astype(np.int32)) for x in (first, last)), pa.array(owner), pa.array(merged), pa.array((place + low).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "first", "last", "h", "merged", "place"])

    return run


def _cut(length: int):
    """mapInArrow over doc_id, text_key, text, segments: a row a segment with its bytes."""
    names = ["h", "salt", "several", "doc_id", "text_key", "first", "last", "place", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2, PIECE):
                raw, borders = text_bytes(b.column(2))
                lists = b.column(3)
                each = lists.flatten()
                of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                field = {x: each.field(x).to_numpy(zero_copy_only=False) for x in ("h", "salt", "several", "first", "last", "place")}
                begin = borders[of] + field["first"]
                size = field["last"].astype(np.int64) - field["first"] + length
                upto = np.cumsum(size)
                at = 0
                while at < len(size):  # about PIECE bytes a batch
                    before = upto[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(upto, before + PIECE, side="right")))
                    s = slice(at, end)
                    where = np.repeat(begin[s] - (upto[s] - size[s] - before), size[s])
                    where += np.arange(len(where))
                    offsets = np.append(0, upto[s] - before).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[where].tobytes())])
                    who = pa.array(of[s])
                    cols = [pa.array(field["h"][s]), pa.array(field["salt"][s]), pa.array(field["several"][s]), b.column(0).take(who), b.column(1).take(who), *(pa.array(field[x][s]) for x in ("first", "last", "place")), data]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    at = end

    return run


def _compare(length: int, stride: int):
    """mapInArrow over rows sorted by bucket: runs of repeated windows, and hashes where a bucket is dealt to several tasks."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def solve(b: pa.RecordBatch, bucket: np.ndarray) -> pa.RecordBatch:
        data, borders = text_bytes(b.column(6))
        sizes, first = np.diff(borders), b.column(5).to_numpy()
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        turn = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.append(starts, len(bucket))))
        hit, interval = repeated(data, sizes, turn % 2 == 1, length, stride)  # alternately within a bucket
        # no run crosses parts: the last bytes of a part start no window
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        low, high = edge[::2], edge[1::2] - 1
        part = np.searchsorted(borders, low, side="right") - 1
        runs = [part, first[part] + low - borders[part], first[part] + high - borders[part]]
        out = [runs + [None] * 3]
        several = np.repeat(b.column(2).to_numpy(zero_copy_only=False), sizes) & (interval >= 0)
        if several.any():
            single = np.flatnonzero(several & ~hit)
            again = np.flatnonzero(several & hit)
            again = again[np.unique(interval[again], return_index=True)[1]]
            at = np.append(single, again)
            part = np.searchsorted(borders, at, side="right") - 1
            own = first[part] + at - borders[part]
            two = [rolling(data, length, seed)[at].view(np.int64) for seed in (0x1234567, 0x7654321)]
            out.append([part, own, own, *two, np.repeat([1, 2], [len(single), len(again)])])
        made = []
        for part, *rest in out:
            who = pa.array(part)
            cols = [b.column(3).take(who), b.column(4).take(who), *(pa.nulls(len(part), pa.int64()) if x is None else pa.array(x) for x in rest)]
            made.append(pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names))
        return pa.Table.from_batches(made).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Solves the whole buckets of rows, about BATCH_BYTES at once; returns the rest."""
            h, salt = (rows.column(i).to_numpy() for i in (0, 1))
            bucket = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])))
            bounds = np.flatnonzero(np.diff(bucket, prepend=0)).tolist() + [len(h)] * last
            upto = np.append(0, np.cumsum(pc.binary_length(rows.column(6)).to_numpy().astype(np.int64)))
            at, parts = 0, []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if x > at and upto[y] - upto[at] > BATCH_BYTES:
                    parts.append((at, x))
                    at = x
            for x, y in [*parts, (at, bounds[-1])]:
                if y > x:
                    yield from solve(rows.slice(x, y - x).combine_chunks().to_batches()[0], bucket[x:y])
            return rows.slice(bounds[-1])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(6).nbytes
            if size > 4 * BATCH_BYTES:
                rest = yield from ready(pa.Table.from_batches(held), False)
                held, size = rest.combine_chunks().to_batches(), rest.column(6).nbytes
        if held:
            yield from ready(pa.Table.from_batches(held), True)

    return run


def _cut_out(length: int):
    """mapInArrow over doc_id, text_key, text, runs: the removed spans, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for big in batches:
            for b in slices(big, 2, PIECE):
                spans, kept = [], []
                for text, own in zip(b.column(2), b.column(3), strict=True):
                    data = memoryview(text.as_buffer())
                    first, last = (own.values.field(x).to_numpy() for x in ("first", "last"))  # sorted by first
                    upto = np.maximum.accumulate(last) + length
                    new = np.append(True, first[1:] > upto[:-1])
                    low = first[new]
                    high = upto[np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)]
                    kept.append(b"".join(data[x:y] for x, y in zip([0, *high.tolist()], [*low.tolist(), len(data)], strict=True)))
                    spans.append([{"start": x, "end": y} for x, y in zip(low.tolist(), high.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())], ["d", "t", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, stride: int = STRIDE, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, n_bytes, spans array<struct<start, end>> (removed bytes), kept binary or null where nothing was removed."""
    if length % stride or k > length:
        raise ValueError("length must be a multiple of stride, and not below k")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    meta = written(docs.select("doc_id", "text_key", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("n_bytes")), "repeats-texts")
    long_ = meta.where(F.col("n_bytes") >= length)
    copies = long_.groupBy("md5").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("rep")).where("n > 1")
    copied = written(long_.join(copies, "md5").select("doc_id", "text_key", (F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.text_key") == F.col("text_key"))).alias("stays")).distinct(), "repeats-copies")

    partners = docs.where(F.octet_length("text") >= length).select("doc_id", "text_key", "text")
    rows = written(partners.mapInArrow(lean(_minimisers(length, k)), "doc_id long, text_key long, first int, last int, h long, merged long, place int"), "repeats-minimisers")
    gone = copied.where("not stays").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
    rows = rows.join(sized(gone), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left_anti")
    size = F.col("last") - F.col("first") + length
    shared = rows.groupBy("h").agg(F.sum(size.cast("long")).alias("bytes"), F.sum("merged").alias("all")).where("all > 1").select("h", "bytes")
    tasks = F.ceil(F.col("bytes") / hot)
    # -1: to be sliced; else the task of a bucket, one of several where several is set
    salt = F.when(tasks == 1, 0).when(F.col("merged") == 1, -1).otherwise(F.pmod(F.xxhash64("doc_id", "text_key", "first"), tasks)).cast("int")
    hits = rows.join(shared, "h").select("doc_id", "text_key", F.struct("first", "last", "h", "place", salt.alias("salt"), (tasks > 1).alias("several")).alias("s"))
    own = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_list("s").alias("segments"))  # as long as the text
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    texts = partners.join(own, same).select("doc_id", "text_key", "text", "segments").dropDuplicates(["doc_id", "text_key"])
    texts = written(texts, "repeats-partners")

    each = texts.mapInArrow(lean(_cut(length)), "h long, salt int, several boolean, doc_id long, text_key long, first int, last int, place int, bytes binary")
    each = written(each, "repeats-segments")
    bytes_of = lambda a, b: F.substring("bytes", a - F.col("first") + 1, b - a)
    plain = each.where("salt >= 0").select("h", "salt", "several", "doc_id", "text_key", "first", "bytes")
    wide = -(-(length - k + 1) // SLICES)
    sliced = each.where("salt < 0").withColumn("top", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda j: F.col("place") - j * wide)))
    sliced = sliced.withColumns({"a": F.greatest("first", F.col("top") - wide + 1), "b": F.least("last", "top")}).where("a <= b")
    # the core: all windows of a slice hold the bytes from its last window's start to its first window's end
    core = F.substring("bytes", F.col("top") - F.col("first") + 1, F.lit(length - wide + 1))
    content = bytes_of(F.col("a"), F.col("b") + length)
    sliced = sliced.select(F.xxhash64("h", F.col("place") - F.col("top"), core).alias("core"), F.md5(content).alias("content"), "doc_id", "text_key", "a", "b", content.alias("bytes"))
    sliced = written(sliced, "repeats-slices")
    contents = written(sliced.groupBy("core", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "a", "bytes")).alias("one")), "repeats-contents")
    equal = sliced.drop("bytes").join(contents.where("n > 1").select("core", "content"), ["core", "content"]).select("doc_id", "text_key", F.col("a").alias("first"), F.col("b").alias("last"))
    cores = contents.groupBy("core").agg(F.count("*").alias("m"), F.sum(F.octet_length("one.bytes").cast("long")).alias("size")).where("m > 1")
    among = F.ceil(F.col("size") / hot)
    differing = contents.join(cores, "core").select(
        F.col("core").alias("h"), F.pmod(F.xxhash64("content"), among).cast("int").alias("salt"), (among > 1).alias("several"),
        "one.doc_id", "one.text_key", F.col("one.a").alias("first"), "one.bytes",
    )
    cut = plain.unionByName(differing)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(lean(_compare(length, stride)), FOUND)
    found = written(found, "repeats-found")
    hashes = found.where("d1 is not null")
    across = hashes.groupBy("d1", "d2").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") == 1, F.struct("doc_id", "text_key", "first", "last"))).alias("at"))
    across = across.where("n > 1").select(F.explode("at").alias("x")).select("x.*")
    runs = found.where("d1 is null").select("doc_id", "text_key", "first", "last").unionByName(across).unionByName(equal)
    by_doc = runs.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    some = texts.select("doc_id", "text_key", "text").join(by_doc, same).select("doc_id", "text_key", "text", "runs")
    some = some.mapInArrow(lean(_cut_out(length)), "d long, t long, spans array<struct<start int, end int>>, kept binary")
    whole = copied.select(F.col("doc_id").alias("cd"), F.col("text_key").alias("ct"))
    out = meta.join(some, same, "left").join(whole, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("text_key") == F.col("ct")), "left")
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return out.select(
        "doc_id", "text_key", "n_bytes",
        F.when(F.col("ct").isNotNull(), all_).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
        F.when(F.col("ct").isNotNull(), F.lit(b"").cast("binary")).otherwise(F.col("kept")).alias("kept"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings, as digests."""
    docs = table(spark, sf_dir, "documents")
    out = remove_repeats(docs)
    touched = out.select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    ).where("n_spans > 0").dropDuplicates(["d", "t"])
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64(data).alias("text_key"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data.cast("binary"), 256).alias("own"))
    joined = base.join(touched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


# Tests hold the query against brute force; strings of 400 bytes at every byte are too much for SQL.
ORACLE_SQL: dict[str, str] = {}
