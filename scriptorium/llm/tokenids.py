"""Token ids, and a binary file format for them with canonical Huffman codes.

Encoding splits each text at ASCII white space (the tokenizer never joins
across it) and, where the tokenizer's file allows it, between a letter and a
mark, encodes every distinct piece of a batch once with the tokenizers
library and keeps a bounded memo of pieces in each Python worker.  A text that
holds an added token of the tokenizer, in whatever case, is encoded whole.

File format.  A codebook row (block -1) holds the code length of every id: the
optimal prefix code with at most MAX_BITS bits (package-merge) for the global
counts; codes are canonical, so lengths are all there is to store.  Every other
row is a block of whole documents in ascending doc_id order: the documents'
ids in one bit stream, and a checkpoint - the bit offset - for every CHUNK ids
of a document.  A block decodes without any other block, and any document from
its own checkpoints; all streams of a block are decoded in step by one table of
2**MAX_BITS entries.

Nulls: a null text encodes like an empty one (only the end id).  A null doc_id
sorts first.  Repeated rows are kept, each with its own stream.  Ties: rows that
share doc_id are in the order of their texts' hashes, and of their texts where
those are equal too, so starts follow the file's order.  A very long text is a
slice of its own while it is encoded (about ten times its bytes) and lies in one
block; its ids decode in step from its checkpoints.  An empty table gives an
empty file.  Only doc_id and text are read, so extra columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.shared import gathered, kept, lean, slices, table, text_bytes, written

MAX_BITS = 16
CHUNK = 256
BLOCK_IDS = 1 << 20
MEMO = 1_200_000
LONGEST = 64
SLICE = 16_000_000
END_ID = 2
#: How a tokenizer's file says that A-Z are lowered, and that letters part from what follows (fixed values).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters (but U+0130, lowered to two characters) before a mark: always a border of SPLIT.
BORDER = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,;:!?])"
#: Stands alone between pieces; no other id belongs to it.
MARK = "\x01"


class Memo:
    """Ids of pieces: one flat store of ids and the place of each piece in it.

    After more than `most` pieces or 16 times as many ids it starts afresh.  Pieces
    longer than LONGEST stay in the store until then, but aren't looked up.
    """

    most = MEMO

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.store, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the count of each."""
        raise NotImplementedError

    def ids(self, pieces: list[str], picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces[picks] end to end, and the count of each; the pieces are distinct."""
        if len(self.at) > self.most or len(self.store) > 16 * self.most:
            self._clear()
        at = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            flat, counts = self.encode(new)
            at[missing] = own = np.arange(len(self.lens), len(self.lens) + len(new))
            self.at.update((p, i) for p, i in zip(new, own.tolist(), strict=True) if len(p) <= LONGEST)
            self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(counts) - counts])
            self.lens = np.concatenate([self.lens, counts])
            self.store = np.concatenate([self.store, flat])
        at = at[picks]
        each = self.lens[at]
        total = np.cumsum(each)
        where = np.repeat(self.starts[at] - (total - each), each)
        where += np.arange(len(where))
        return self.store[where], each


class PieceMemo(Memo):
    def __init__(self, vocab_file: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(vocab_file)
        self.size = self.coder.get_vocab_size()
        mark = self.coder.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        with open(vocab_file, encoding="utf-8") as f:
            said = json.load(f)
        normalizers = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (said.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.added = "|".join(re.escape(x["content"]) for x in said.get("added_tokens") or [])
        self.fine = normalizers == NORMALIZERS and splits[:1] == [SPLIT]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 200):
            some = pieces[at : at + 200]
            if self.mark is not None:
                ids = np.array(self.coder.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, np.int32)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) == len(some) - 1:  # no piece holds the mark itself
                    flats.append(np.delete(ids, cuts))
                    counts.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                    continue
            each = [e.ids for e in self.coder.encode_batch_fast(some, add_special_tokens=False)]
            flats.append(np.array([i for x in each for i in x], np.int32))
            counts.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flats), np.concatenate(counts)


def ids_of_texts(memo: PieceMemo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the count of each text."""
    texts = pc.fill_null(texts, "")
    if memo.added:
        odd = pc.match_substring_regex(texts, memo.added, ignore_case=True)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            flat, counts = ids_of_texts(memo, pc.if_else(odd, "", texts))
            own = [np.array(memo.coder.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.int32) for i in whole]
            ends = np.append(0, np.cumsum(counts))
            parts = np.split(flat, ends[whole])
            counts[whole] = [len(x) for x in own]
            return np.concatenate([parts[0], *(y for x in zip(own, parts[1:], strict=True) for y in x)]), counts
    if memo.fine:  # fewer distinct pieces, the same ids
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), BORDER, r"\1 \2")
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    flat, each = memo.ids(words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False))
    ends = np.append(0, np.cumsum(each))
    bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return flat, np.diff(ends[bounds])


def encode(docs: DataFrame, vocab_file: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text, with end_id at the end if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(f"pieces:{vocab_file}", lambda: PieceMemo(vocab_file))
        for b in gathered(batches, 1, SLICE):
            flat, counts = ids_of_texts(memo, b.column(1))
            if end_id is not None:
                flat = np.insert(flat, np.cumsum(counts), np.int32(end_id))
                counts = counts + 1
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, f"pieces:{vocab_file}"), "doc_id long, ids array<int>")


# --- canonical length-limited Huffman codes ---


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, by package-merge; 0: no code."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # levels[k]: for the k-th list, which of its entries (ascending) are single symbols
    w, levels = weight, []
    for _ in range(limit - 1):
        pairs = w[: len(w) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        w = both[by]
    take, bits = 2 * (n - 1), np.zeros(n, np.int64)
    for single in reversed(levels):
        k = int(single[:take].sum())
        bits[:k] += 1
        take = 2 * (take - k)
    bits[:take] += 1
    out[order] = bits
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    lens = lengths[order].astype(np.int64)
    top = int(lens.max(initial=1))
    steps = np.cumsum(1 << (top - lens)) - (1 << (top - lens))
    codes[order] = steps >> (top - lens)
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next `limit` bits: the symbol and its code's length."""
    symbol, length = np.zeros(1 << limit, np.int32), np.ones(1 << limit, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    k = int(spans.sum())
    symbol[:k] = np.repeat(order, spans)
    length[:k] = np.repeat(lengths[order], spans)
    return symbol, length


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset of each id (with the end)."""
    lens = lengths[ids].astype(np.int64)
    ends = np.append(0, np.cumsum(lens))
    offset = ends[:-1]
    words = np.zeros(int(ends[-1] + 63) // 32 + 2, np.uint64)
    # a code of up to 16 bits lies in a 64-bit window that starts at a multiple of 32 bits
    value = codes[ids].astype(np.uint64) << (64 - (offset & 31) - lens).astype(np.uint64)
    slot = offset >> 5
    heads = np.flatnonzero(np.diff(slot, prepend=-1))
    if len(heads):
        sums = np.bitwise_or.reduceat(value, heads)
        words[slot[heads]] |= sums >> np.uint64(32)
        words[slot[heads] + 1] |= sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], ends


def unpack(stream: bytes, starts: np.ndarray, counts: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Decodes counts[k] ids from bit starts[k] on, all streams in step; ids end to end."""
    data = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]  # 24 bits from each byte on
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].astype(np.int64), counts[order]
    base = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.int32)
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")  # streams with more than k ids
    for k, n in enumerate(live):
        p = at[:n]
        key = (window[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[base[:n] + k] = symbol[key]
        p += length[key]
    return out


def crcs(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """The crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def global_counts(tokens: DataFrame, ids: str = "ids") -> DataFrame:
    """id, n over all documents; each task sums into one vector of the vocabulary before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 10, np.int64)
        for big in batches:
            for b in slices(big, 0):
                n = np.bincount(text_bytes(b.column(0))[0].view("<u2"))
                if len(n) > len(total):
                    total = np.append(total, np.zeros(len(n) - len(total), np.int64))
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokens.select(ids).mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK = "block long, doc_ids array<long>, counts array<long>, checkpoints array<long>, stream binary"


def write_file(docs: DataFrame, vocab_file: str, end_id: int = END_ID) -> tuple[DataFrame, np.ndarray]:
    """Encodes docs and writes the file described above; returns its blocks and the code lengths.

    Ids are 16 bits wide between the two passes; vocabularies beyond that are refused.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(f"pieces:{vocab_file}", lambda: PieceMemo(vocab_file))
        if memo.size > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        for b in gathered(batches, 1, SLICE):
            flat, counts = ids_of_texts(memo, b.column(1))
            flat = np.insert(flat, np.cumsum(counts), np.int32(end_id)).astype("<u2")
            ends = np.append(0, np.cumsum(counts + 1)) * 2
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), raw, pa.array(crcs(flat, ends // 2), pa.int64())], ["doc_id", "ids", "crc"])

    tokens = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, f"pieces:{vocab_file}"), "doc_id long, ids binary, crc long")
    tokens = written(tokens, "token-ids")
    found = global_counts(tokens).collect()  # a row an id: the vocabulary's size at most
    counts = np.zeros(max([0, *(r.id for r in found)]) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple[int, np.ndarray]], no: int) -> pa.RecordBatch:
            n = np.array([len(x) for _, x in rows], np.int64)
            stream, bits = pack(np.concatenate([x for _, x in rows]), lengths, codes)
            first = np.cumsum(n) - n
            marks = np.concatenate([np.arange(a, a + k, CHUNK) for a, k in zip(first, n, strict=True)])
            cols = [pa.array([no], pa.int64()), pa.array([[d for d, _ in rows]], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([bits[marks]], pa.list_(pa.int64())), pa.array([stream], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "counts", "checkpoints", "stream"])

        rows, size, no = [], 0, 0
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((d, np.frombuffer(raw, "<u2")))
                size += len(raw) // 2
                if size >= BLOCK_IDS:
                    yield block(rows, no)
                    rows, size, no = [], 0, no + 1
        if rows:
            yield block(rows, no)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("doc_id").asc_nulls_first(), "crc"]  # rows of one doc_id, or of none, spread too
    ordered = tokens.repartitionByRange(parts, *key).sortWithinPartitions(*key, F.octet_length("ids"), "ids").select("doc_id", "ids")
    made = ordered.mapInArrow(lean(blocks), BLOCK)
    book = spark.createDataFrame([(-1, None, [int(x) for x in lengths], None, None)], BLOCK)
    return written(made.unionByName(book), "token-file"), lengths


def read_file(blocks: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and (with ids) the ids of every document of a file, block by block."""
    book = np.array(blocks.where("block = -1").select("counts").first()[0], np.uint8)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, length = decode_table(book)
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["counts"], np.int64)
                pieces = -(-n // CHUNK)
                size = np.full(int(pieces.sum()), CHUNK, np.int64)
                last = np.cumsum(pieces) - 1
                size[last[n > 0]] = (n - (pieces - 1) * CHUNK)[n > 0]
                flat = unpack(r["stream"], np.array(r["checkpoints"], np.int64), size, symbol, length)
                ends = np.append(0, np.cumsum(n))
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(n), pa.array(crcs(flat, ends), pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return blocks.where("block >= 0").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def starts(read: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before, in doc_id order; totals of ranges first, then sums inside each."""
    from pyspark.sql import Window

    spark = read.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens"]  # the file's order
    read = written(read, "token-read")  # a range exchange samples its input: nothing is decoded twice
    placed = written(read.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()), "token-counts")
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.withColumn("upto", F.sum("n_tokens").over(inside))
    return sums.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("upto") - F.col("n_tokens")).drop("part", "before", "upto")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the file that was written."""
    import public_tokenizers

    blocks, _ = write_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return starts(read_file(blocks, ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


# A tokenizer can't be written in SQL; tests hold the query against the library itself.
ORACLE_SQL: dict[str, str] = {}
