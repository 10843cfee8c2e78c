"""Byte-level BPE over a public rank file: global distinct-word shuffle.

Pre-tokens are cut per document and numbered within a block, which is closed once it has block_chars characters (checked every
8 MB of text). A document is the sequence of its pre-tokens' numbers, so places are positions in that sequence. What is
shuffled is each block's distinct pre-tokens with their numbers, dealt into buckets by their hash: a bucket meets in one task, holds a
pre-token of all blocks, and encodes it once. The ids are joined back to the blocks on (block, number); documents
lie in a table bucketed by block and so don't move, and each is reassembled by position. Decoding joins the ids
with the token-byte table of the rank file (fixed size). The pre-tokens of a block and bucket travel as one packed
row: a row for each of them was estimated at over twice the shuffled bytes, beyond the disk that this may use.
Working tables stay in the shared folder, one of them named bpe_blocks_<uuid> in the catalog.

Rows are independent: repeated ids or repeated rows give a row each. A null text counts as empty and
gives no ids. A very long text is a block of its own, in one task, as its row is. Columns besides the id and the text are left out, so clashing names cannot arise.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, slices, table

#: Characters of text after which a task closes its block; it bounds a block's memory.
BLOCK_CHARS = 32_000_000
BLOCKS = "block bigint, bucket int, doc_id bigint, numbers binary, words binary"
#: Pre-tokens that a task remembers the ids of, at most; beyond that a pre-token may be encoded again, to the same ids.
MOST_WORDS = 1_000_000


class _Numbers(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@lru_cache(maxsize=2)
def rank_table(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}


#: Takes a text as one pre-token.
WHOLE = r"(?s:.+)"


@lru_cache(maxsize=2)
def encoding(raw: bytes, pattern: str = WHOLE):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=rank_table(raw), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(raw: bytes) -> dict[int, bytes]:
    return {n: token for token, n in rank_table(raw).items()}


def pack(numbers: np.ndarray) -> bytes:
    """Byte planes of the numbers, compressed: the high planes are nearly all zero."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes, codec) -> np.ndarray:
    planes = np.frombuffer(codec.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_bytes(parts: list[bytes]) -> bytes:
    """Byte strings as their lengths and what they hold, compressed."""
    import zstandard

    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zstandard.ZstdCompressor(level=3).compress(len(parts).to_bytes(4, "little") + lengths.astype("<u4").tobytes() + b"".join(parts))


def unpack_bytes(data: bytes, codec) -> list[bytes]:
    raw = codec.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _cut(batches: Iterator[pa.RecordBatch], pattern: str, block_chars: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (bucket is null) and, once a block is full, one for each bucket of its pre-tokens."""
    import regex
    import xxhash

    find = regex.compile(pattern).findall
    task, blocks, held, numbers = TaskContext.get().partitionId(), 0, 0, _Numbers()

    def words(block):
        parts: dict[int, list[bytes]] = {}
        for w in sorted(numbers):
            key = w.encode()
            parts.setdefault(xxhash.xxh3_64_intdigest(key) % buckets, []).append(key)
        for bucket, keys in parts.items():
            at = np.fromiter((numbers[k.decode()] for k in keys), np.uint32, len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), pa.array([pack(at)], pa.binary()), pa.array([pack_bytes(keys)], pa.binary())],
                ["block", "bucket", "doc_id", "numbers", "words"],
            )

    for batch in batches:
        for part in slices(batch, most_bytes=min(block_chars, 8 << 20)):
            block, data = (task << 24) + blocks, []
            for text in part.column(1).to_pylist():
                found = find(text or "")
                held += len(text or "")
                data.append(pack(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))))
            n = len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), part.column(0), pa.array(data, pa.binary()), pa.nulls(n, pa.binary())],
                ["block", "bucket", "doc_id", "numbers", "words"],
            )
            if held >= block_chars:
                yield from words(block)
                blocks, held, numbers = blocks + 1, 0, _Numbers()
    yield from words((task << 24) + blocks)


def _encode_words(batches: Iterator[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    import zstandard

    encode, codec = encoding(raw).encode_ordinary, zstandard.ZstdDecompressor()
    known: dict[bytes, bytes] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            part, out = batch.slice(row, 1), []
            for w in unpack_bytes(part.column(2)[0].as_py(), codec):
                ids = known.get(w)
                if ids is None:
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    known[w] = ids = np.array(encode(w.decode()), "<u4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack_bytes(out)], pa.binary())], ["of_block", "bucket", "ids"])


def _reassemble(docs: pa.Table, encoded: pa.Table, raw: bytes) -> pa.Table:
    import zstandard

    codec, of = zstandard.ZstdDecompressor(), _token_bytes(raw)
    found = dict(zip(encoded.column("bucket").to_pylist(), encoded.column("ids").to_pylist()))
    ids: dict[int, bytes] = {}
    for bucket, numbers in zip(docs.column("bucket").to_pylist(), docs.column("numbers").to_pylist()):
        if bucket is not None:
            ids.update(zip(unpack(numbers, codec).tolist(), unpack_bytes(found[bucket], codec)))
    texts = {k: b"".join(map(of.__getitem__, np.frombuffer(x, "<u4").tolist())) for k, x in ids.items()}
    docs = docs.filter(docs.column("bucket").is_null())
    out_ids, out_texts = [], []
    for data in docs.column("numbers").to_pylist():
        at = unpack(data, codec).tolist()
        out_ids.append(b"".join(map(ids.__getitem__, at)))
        out_texts.append(b"".join(map(texts.__getitem__, at)))
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.array(out_ids, pa.large_binary()).cast(pa.binary()), "decoded": pa.array(out_texts, pa.large_binary()).cast(pa.binary())})


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per document: doc_id, ids (little-endian unsigned 32-bit integers) and decoded (bytes).

    ranks_path is the driver's path of a rank file; its bytes (under 1 MB) go with the tasks.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = bucketed(texts.mapInArrow(lambda it: _cut(it, pattern, block_chars, buckets), BLOCKS), "bpe_blocks", buckets, "block")
    words = cut.where("bucket is not null").select("block", "bucket", "words").repartition(buckets, "bucket")
    encoded = words.mapInArrow(lambda it: _encode_words(it, raw), "of_block bigint, bucket int, ids binary")
    return (
        cut.select("block", "bucket", "doc_id", "numbers").groupBy("block")
        .cogroup(encoded.groupBy("of_block"))
        .applyInArrow(lambda d, w: _reassemble(d, w, raw), "doc_id bigint, ids binary, decoded binary")
    )


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of ids alone (little-endian unsigned 32-bit): a join with the token-byte table, which has a fixed size. Null ids give empty bytes."""
    with open(ranks_path, "rb") as f:
        raw = f.read()

    def run(batches):
        of = _token_bytes(raw)
        for b in batches:
            data = [b"".join(map(of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id bigint, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))
