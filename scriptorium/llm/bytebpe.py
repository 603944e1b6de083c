"""Byte-level BPE through a sentencepiece model that is serialised from the ranks.

Each byte is mapped to a printable character, so a vocabulary entry becomes a
piece; its score is its negative rank, hence sentencepiece merges in the order
of the ranks.  Normalisation is the identity and no dummy prefix is added.
The id of a piece is its place in ascending rank order, mapped back to the rank.

A text is cut at single spaces before visible characters - always a border of
the pattern's matches - and each distinct cut of a batch is matched and encoded
once; a bounded memo keeps cuts in each Python worker.  Texts with runs of
spaces are matched as a whole.  Decoding maps ids back to bytes.

Nulls: a null text encodes to no ids, like an empty one; null ids decode to no
bytes.  Repeated rows are kept, and there are no ties: each row is its own.  A
very long text is a slice of its own, about ten times its bytes in memory.  Empty
tables give empty results.  Only doc_id and text (doc_id and ids) are read, so
extra columns don't matter.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.shared import gathered, kept, lean, table
from scriptorium.llm.tokenids import Memo


SLICE_IDS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_chars() -> list[str]:
    """A character for each byte: itself where it is printable in Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(no: int, value: bytes | str | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(no << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(no << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(no << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto (BPE, identity normaliser) of the vocabulary; the unknown piece comes last."""
    chars = byte_chars()
    entries = sorted(ranks, key=ranks.__getitem__)
    # SentencePiece: piece 1, score 2, type 3 (1 normal, 2 unknown)
    pieces = [_field(1, _field(1, "".join(chars[b] for b in e)) + _field(2, float(-ranks[e])) + _field(3, 1)) for e in entries]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    # TrainerSpec: model_type 3 (2 BPE), vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43
    trainer = _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # NormalizerSpec: name 1, precompiled_charsmap 2, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5
    normalizer = _field(1, "identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Coder(Memo):
    """Ids of cuts of texts, with the memo of tokenids."""

    most = 150_000

    def __init__(self, ranks_file: str, pattern: str):
        super().__init__()
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_file)
        self.rank = np.array(sorted(ranks.values()), np.int32)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.match = regex.compile(pattern).findall
        self.to_chars = dict(enumerate(byte_chars()))

    def encode(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.match(cut) for cut in cuts]
        tokens = [t.encode() for x in found for t in x]
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(len(cuts), np.int64)
        # the byte FF is never part of UTF-8 and is mapped to itself: it parts the tokens
        mapped = b"\xff".join(tokens).decode("latin-1").translate(self.to_chars).split("\xff")
        ids = self.model.encode(mapped, num_threads=1)
        ends = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
        flat = self.rank[np.fromiter(chain.from_iterable(ids), np.int64, int(ends[-1]))]
        borders = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
        return flat, np.diff(ends[borders])

    def ids_of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the count of each text."""
        texts = pc.fill_null(texts, "")
        # white space after a space, or at the end, or first: no such cut
        odd = pc.match_substring_regex(texts, r"[ \x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}][\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ ]$|^[ ]|[ ]\z")
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts if not len(whole) else pc.if_else(odd, "", texts), " ")
        lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = lists.flatten().dictionary_encode()
        picks = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = parts.dictionary.to_pylist()
        firsts = np.cumsum(lens) - lens
        # the first cut of a text has no space before it
        heads, back = np.unique(picks[firsts], return_inverse=True)
        cuts = [" " + w for w in words] + [words[i] for i in heads]
        picks[firsts] = len(words) + back
        if len(whole):
            cuts += [texts[int(i)].as_py() for i in whole]
            picks[firsts[whole]] = len(cuts) - len(whole) + np.arange(len(whole))
        used, picks = np.unique(picks, return_inverse=True)
        flat, each = self.ids([cuts[i] for i in used.tolist()], picks)
        ends = np.append(0, np.cumsum(each))
        return flat, np.diff(ends[np.append(0, np.cumsum(lens))])


def _encoding(ranks_file: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(f"bytebpe:{ranks_file}:{pattern}", lambda: Coder(ranks_file, pattern))
        for b in gathered(batches):
            flat, counts = coder.ids_of_texts(b.column(1))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return run


def _decoding(ranks_file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ranks = read_ranks(ranks_file)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for e, r in ranks.items():
            size[r] = len(e)
        data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        return data, np.cumsum(size) - size, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, size = kept(f"bytes:{ranks_file}", tables)
        for big in batches:
            upto, at = np.cumsum(pc.fill_null(pc.list_value_length(big.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
            while at < big.num_rows:  # about SLICE_IDS ids at once; a longer list is alone
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_IDS, side="right")))
                b, at = big.slice(at, end - at), end
                lists = b.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                each = size[flat]
                total = np.cumsum(each)
                where = np.repeat(starts[flat] - (total - each), each)
                where += np.arange(len(where))
                ends = np.append(0, total)[np.append(0, np.cumsum(counts))].astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[where].tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0), lists, out], ["doc_id", "ids", "decoded"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of each whole text, without special tokens."""
    return _texts(docs).mapInArrow(lean(_encoding(ranks_file, pattern), f"bytebpe:{ranks_file}:{pattern}"), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(lean(_decoding(ranks_file), f"bytes:{ranks_file}"), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one pass of one Python worker a task."""
    into, back = _encoding(ranks_file, pattern), _decoding(ranks_file)
    both = lean(lambda batches: back(into(batches)), f"bytebpe:{ranks_file}:{pattern}", f"bytes:{ranks_file}")
    return _texts(docs).mapInArrow(both, "doc_id long, ids array<int>, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests."""
    import public_tokenizers

    ranks_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = round_trip(table(spark, sf_dir, "documents"), ranks_file, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# A tokenizer can't be written in SQL; tests hold the query against tiktoken and the exact round trip.
ORACLE_SQL: dict[str, str] = {}
