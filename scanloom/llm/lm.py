"""An interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score texts.

Tokens are the words of a text (runs without ASCII white space, A-Z in lower case), then one end. `learn` counts words, numbers them by
their place in the sorted arrays of words, counts n-grams of numbers and goes down from order n to 1: an n-gram adds one to the continuation
count of its last n-1 words and its count to its first n-1 words as a context. Each level is one shuffle by bucket of the key's hash. A task aggregates a chunk
of texts before it is shuffled, so that a frequent word, pair or line is one row a chunk. Each bucket is a file of sorted 64-bit hashes and their values
in the shared folder, published by a rename, so that a repeated task changes nothing; there are as many as keep a bucket in memory.
`scored` maps one bucket at a time and looks up all of a chunk's keys of it in order, so that a worker holds pages of one file and never the model.

Level k: p_k(w | u) = max(a(uw) - D(a), 0) / a(u) + b(u) p_k-1(w | u'), with a the count at the highest order and below it the number of different words before,
D one of three discounts for a of 1, 2, and 3 or more, from the counts of counts, b what the discounts took, and p_0 = 1 / (words + 1), which leaves a share for unknown words.
A context that was never seen takes level k - 1. Texts begin with n-1 start marks, which count as words before. Where counts of counts give no discount (tiny corpora), 0.5, 1 and 1.5 are taken.
Keys of one or two words are hashed without collisions, longer ones meet with probability 2^-64 a pair. Word hashes likewise.

A null or empty text is the end alone. Repeated rows count as often as they stand; a row without an id is learned and scored. Without any text to
learn from each token has the probability 1. Memory is bounded by a chunk of tokens or the longest text. Other columns are left out, clashing names among them.
"""

from __future__ import annotations

import mmap
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import shared_dir, slices, table
from .repair import CRC, CRC_TABLE

#: The query's order. At 3 its shuffle and arrays need more disk than the check allows, see README.
ORDER = 2
#: Tokens that a task aggregates before the shuffle, and that it scores at once.
COUNTED, SCORED = 1 << 22, 1 << 20
#: n-grams that a bucket has at most, on average.
IN_BUCKET = 1 << 23
#: Words up to which a number has 32 bits.
NARROW = 1 << 32
PIECE = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
U64 = np.uint64


# tokens


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


class Chunk:
    """Texts as numbers of their distinct words, which are numbered from 0 within the chunk."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, text: bytes | None) -> None:
        held = self.tokens
        for words in [*words_of(text or b""), [b""]]:  # the end is the empty word
            self.parts.append(np.fromiter(map(self.index.__getitem__, words), np.uint32, len(words)))
            self.tokens += len(words)
        self.lengths.append(self.tokens - held)

    def local(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.index), U64, len(self.index))


def chunks(batches: Iterator[pa.RecordBatch], most: int, text_at: int = 0) -> Iterator[tuple[Chunk, list[pa.RecordBatch]]]:
    """Rows in chunks of about so many tokens, with the rows' batches."""
    chunk, rows = Chunk(), []
    for batch in batches:
        for part in slices(batch, text_at):
            for text in part.column(text_at).cast(pa.binary()).to_pylist():
                chunk.add(text)
            rows.append(part)
            if chunk.tokens >= most:
                yield chunk, rows
                chunk, rows = Chunk(), []
    if rows:
        yield chunk, rows


# keys of k words: two 32-bit numbers in a long, or a long for each word where there are more words than that


def packed(words: list[np.ndarray], wide: bool) -> list[np.ndarray]:
    if wide:
        return words
    return [words[i] << U64(32) | words[i + 1] if i + 1 < len(words) else words[i] for i in range(0, len(words), 2)]


def unpacked(keys: list[np.ndarray], k: int, wide: bool) -> list[np.ndarray]:
    if wide:
        return keys
    out: list[np.ndarray] = []
    for p in keys:
        out += [p] if len(out) == k - 1 else [p >> U64(32), p & U64(0xFFFFFFFF)]
    return out


def key_columns(k: int, wide: bool) -> list[str]:
    return [f"p{i}" for i in range(k if wide else (k + 1) // 2)]


def hash_of(keys: list[np.ndarray]) -> np.ndarray:
    """What the SQL function xxhash64 gives for these longs; fixed values of XXH64."""
    p1, p2, p3, p4, p5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: x << U64(n) | x >> U64(64 - n)
    h = np.full(len(keys[0]), 42, U64)
    for key in keys:
        h = h + p5 + U64(8)
        h ^= turn(key * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> U64(33)) * p2
        h = (h ^ h >> U64(29)) * p3
        h ^= h >> U64(32)
    return h


def distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, and the place of each key among them."""
    if len(keys) == 1:
        found, inverse = np.unique(keys[0], return_inverse=True)
        return [found], inverse
    _, first, inverse = np.unique(hash_of(keys), return_index=True, return_inverse=True)
    return [x[first] for x in keys], inverse


def counted(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys and how often each stands there."""
    if len(keys) == 1:
        found, n = np.unique(keys[0], return_counts=True)
        return [found], n
    _, first, n = np.unique(hash_of(keys), return_index=True, return_counts=True)
    return [x[first] for x in keys], n


# arrays in files: a header of (rows, columns, bytes of each column's values), hashes, columns


def _save(folder: str, name: str, hashes: np.ndarray, *values: np.ndarray) -> None:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    made = f"{path}/.{name}-{uuid.uuid4().hex}"
    small = [x.astype(np.min_scalar_type(int(x.max()))) for x in values]
    head = np.zeros(8, U64)
    head[: 2 + len(small)] = [len(hashes), len(small), *(x.itemsize for x in small)]
    with store.open_output_stream(made) as out:
        for x in (head, hashes, *small):
            out.write(memoryview(np.ascontiguousarray(x)).cast("B"))
    store.move(made, f"{path}/{name}")


def _mapped(folder: str, name: str) -> list[np.ndarray]:
    """A file's hashes and columns, mapped. Where the folder is no file system of this machine, a copy without a name is mapped."""
    store, path = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        handle = open(f"{path}/{name}", "rb")
    else:
        handle = tempfile.TemporaryFile()
        with store.open_input_stream(f"{path}/{name}") as source:
            while piece := source.read(1 << 22):
                handle.write(piece)
        handle.flush()
    with handle:
        whole = mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ)
    n, columns, *sizes = (int(x) for x in np.frombuffer(whole, U64, 8))
    at, out = 64 + 8 * n, [np.frombuffer(whole, U64, n, 64)]
    for size in sizes[:columns]:
        out.append(np.frombuffer(whole, f"<u{size}", n, at))
        at += size * n
    return out


@dataclass(frozen=True)
class Arrays:
    """Sorted hash arrays by bucket, the hash's first bits. sizes: rows by bucket."""

    folder: str
    name: str
    bits: int
    sizes: dict[int, int] = field(default_factory=dict)

    def find(self, hashes: np.ndarray, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each hash its place among all (-1: none) and its values (0 if none). Files are mapped one at a time, and read in order."""
        order = np.argsort(hashes)
        asked = hashes[order]
        places, values = np.full(len(hashes), -1, np.int64), [np.zeros(len(hashes), np.int64) for _ in range(columns)]
        ends = np.searchsorted(asked >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))
        before = 0
        for bucket, size in sorted(self.sizes.items()):
            lo, hi = int(ends[bucket]), int(ends[bucket + 1])
            if lo < hi:
                known, *held = _mapped(self.folder, f"{self.name}-{bucket}")
                at = np.minimum(np.searchsorted(known, asked[lo:hi]), size - 1)
                met = np.flatnonzero(known[at] == asked[lo:hi])
                to, at = order[lo:hi][met], at[met]
                places[to] = at + before
                for x, y in zip(values, held):
                    x[to] = y[at]
            before += size
        return places, values


# counting


def _word_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for chunk, _ in chunks(batches, COUNTED):
        n, h = np.bincount(chunk.local(), minlength=len(chunk.index)), chunk.hashes()
        yield _batch({"bucket": h >> U64(64 - bits), "h": h, "n": n})


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)) for x in columns.values()], list(columns))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], by: Callable[[dict[str, np.ndarray]], np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows that come sorted by what `by` gives, as one table for each of its values."""
    held: list[dict[str, np.ndarray]] = []
    now = None
    join = lambda: {c: np.concatenate([x[c] for x in held]) for c in columns}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False).view(U64) for c in columns}
        of = by(rows)
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and of[lo] != now:
                yield int(now), join()
                held = []
            now = of[lo]
            held.append({c: x[lo:hi] for c, x in rows.items()})
    if held:
        yield int(now), join()


def _write_words(batches: Iterator[pa.RecordBatch], folder: str, bits: int) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _runs(batches, ["h", "n"], lambda x: x["h"] >> U64(64 - bits)):
        _save(folder, f"words-{bucket}", rows["h"], rows["n"])
        yield _batch({"bucket": np.array([bucket]), "size": np.array([len(rows["h"])]), "n": np.array([rows["n"].sum()])})


@dataclass(frozen=True)
class Model:
    """Where the arrays are and what all of them add up to. wide: whether words' numbers need 64 bits; discounts: by level, for counts of 1, 2, 3 or more; first: the sum, and numbers of 1, 2, 3 or more, of level 1."""

    folder: str
    order: int
    words: Arrays
    n_tokens: int
    wide: bool = False
    grams: tuple[Arrays, ...] = ()
    contexts: tuple[Arrays, ...] = ()
    discounts: tuple[tuple[float, float, float], ...] = ()
    first: tuple[int, int, int, int] = (0, 0, 0, 0)

    @property
    def n_words(self) -> int:
        return sum(self.words.sizes.values())

    def numbered(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each of the chunk's distinct words; unknown words share the number after the start mark's, which is n_words."""
        places, (counts,) = self.words.find(chunk.hashes(), 1)
        return np.where(places < 0, self.n_words + 1, places).astype(U64), counts

    def windows(self, chunk: Chunk, numbers: np.ndarray) -> list[np.ndarray]:
        """For each token the n words up to it, the oldest first."""
        n = self.order
        at = np.arange(chunk.tokens) + (n - 1) * (np.repeat(np.arange(len(chunk.lengths)), chunk.lengths) + 1)
        line = np.full(chunk.tokens + (n - 1) * len(chunk.lengths), self.n_words, U64)
        line[at] = numbers[chunk.local()]
        return [line[at - (n - 1) + i] for i in range(n)]


VALUES = ["a", "size", "b1", "b2", "b3", "b4"]
STATS, GRAM, CONTEXT = 0, 1, 2


def _gram_counts(batches: Iterator[pa.RecordBatch], model: Model, bits: int) -> Iterator[pa.RecordBatch]:
    for chunk, _ in chunks(batches, COUNTED):
        keys, n = counted(packed(model.windows(chunk, model.numbered(chunk)[0]), model.wide))
        yield _batch({"bucket": hash_of(keys) >> U64(64 - bits), **dict(zip(key_columns(model.order, model.wide), keys)), "a": n})


def _write_level(batches: Iterator[pa.RecordBatch], model: Model, k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows with keys of k words, sorted by kind and hash, to files; n-grams go on as what they add to keys of k - 1 words, and numbers about files as they are."""
    names = key_columns(k, model.wide)
    below = key_columns(max(k - 1, 1), model.wide)

    def row(kind: int, keys: list[np.ndarray], **values: np.ndarray) -> pa.RecordBatch:
        zero = np.zeros(len(keys[0]), np.int64)
        keys = keys + [zero] * (len(below) - len(keys))
        return _batch({"kind": zero + kind, **dict(zip(below, keys)), **{c: values.get(c, zero) for c in VALUES}})

    columns = ["kind", *names, *VALUES] if k < model.order else [*names, "a"]
    kind_of = (lambda x: x["kind"]) if k < model.order else (lambda x: np.full(len(x["a"]), GRAM, U64))
    for run, rows in _runs(batches, columns, lambda x: kind_of(x) << U64(32) | hash_of([x[c] for c in names]) >> U64(64 - bits)):
        kind, bucket = run >> 32, run & 0xFFFFFFFF
        keys = [rows[c] for c in names]
        if kind == STATS:
            yield row(STATS, keys[:1], **{c: rows[c] for c in VALUES})
            continue
        a = rows["a"].astype(np.int64)
        level, name = (k, "grams") if kind == GRAM else (k + 1, "contexts")
        _save(model.folder, f"{name}-{level}-{bucket}", hash_of(keys), a, *([rows["b1"], rows["b2"], rows["b3"]] if kind == CONTEXT else []))
        about = np.array([level << 40 | kind << 32 | bucket], U64)
        yield row(STATS, [about], a=np.array([a.sum()]), size=np.array([len(a)]), **{f"b{i}": np.array([(a == i).sum()]) for i in (1, 2, 3, 4)})
        if kind == GRAM and k > 1:
            words = unpacked(keys, k, model.wide)
            last, n = counted(packed(words[1:], model.wide))
            yield row(GRAM, last, a=n)
            first, inverse = distinct(packed(words[:-1], model.wide))
            sums = lambda w: np.bincount(inverse, w).astype(np.int64)  # noqa: B023, E731
            yield row(CONTEXT, first, a=sums(a), b1=sums(a == 1), b2=sums(a == 2), b3=sums(a > 2))


def _longs(*names: str) -> str:
    return ", ".join(f"{x} bigint" for x in names)


def discounts_of(counts: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    if min(counts) == 0:
        return 0.5, 1.0, 1.5
    y = counts[0] / (counts[0] + 2 * counts[1])
    found = tuple(i - (i + 1) * y * counts[i] / counts[i - 1] for i in (1, 2, 3))
    return found if all(0 < d < i for i, d in zip((1, 2, 3), found)) else (0.5, 1.0, 1.5)


def learn(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> Model:
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (parts - 1).bit_length())
    words = texts.mapInArrow(lambda it: _word_counts(it, bits), _longs("bucket", "h", "n")).repartition(1 << bits, "bucket").groupBy("bucket", "h").agg(F.sum("n").alias("n"))
    made = words.select("h", "n").sortWithinPartitions("h").mapInArrow(lambda it: _write_words(it, folder, bits), _longs("bucket", "size", "n")).collect()  # a row a bucket
    model = Model(folder, order, Arrays(folder, "words", bits, {x["bucket"]: x["size"] for x in made}), sum(x["n"] for x in made))
    model = replace(model, wide=model.n_words + 2 >= NARROW)
    bits = max(bits, (model.n_tokens // IN_BUCKET).bit_length())
    names = key_columns(order, model.wide)
    rows = texts.mapInArrow(lambda it: _gram_counts(it, model, bits), _longs("bucket", *names, "a")).repartition(1 << bits, "bucket").groupBy("bucket", *names).agg(F.sum("a").alias("a"))
    for k in range(order, 0, -1):
        names, below = key_columns(k, model.wide), key_columns(max(k - 1, 1), model.wide)
        if k < order:
            hashed = rows.withColumn("bucket", F.shiftrightunsigned(F.xxhash64(*names), 64 - bits))
            rows = hashed.repartition(1 << bits, "bucket").groupBy("bucket", "kind", *names).agg(*[F.sum(c).alias(c) for c in VALUES])
        rows = rows.drop("bucket").withColumn("h", F.xxhash64(*names)).sortWithinPartitions(*(["kind"] if k < order else []), "h").drop("h")
        rows = rows.mapInArrow(lambda it, k=k: _write_level(it, model, k, bits), _longs("kind", *below, *VALUES))
    stats = rows.where(F.col("kind") == STATS).collect()  # a row a file
    sizes: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(6, np.int64))
    for x in stats:
        level, kind, bucket = x["p0"] >> 40, x["p0"] >> 32 & 0xFF, x["p0"] & 0xFFFFFFFF
        sizes[level, kind][bucket] = x["size"]
        if kind == GRAM:
            sums[level] += [x[c] for c in VALUES]
    arrays = lambda name, kind: tuple(Arrays(folder, f"{name}-{k}", bits, sizes[k, kind]) for k in range(1, order + 1))
    total, size, one, two = (int(x) for x in sums[1][:4])
    return replace(
        model, grams=arrays("grams", GRAM), contexts=arrays("contexts", CONTEXT), first=(total, one, two, size - one - two),
        discounts=tuple(discounts_of(tuple(int(x) for x in sums[k][2:])) for k in range(1, order + 1)),
    )


# scoring


def probabilities(model: Model, words: list[np.ndarray]) -> np.ndarray:
    """The model's probability of the last word after the others, for many n-grams."""
    p = np.full(len(words[0]), 1 / (model.n_words + 1))
    for k in range(1, model.order + 1):
        part = words[model.order - k :]
        keys, inverse = distinct(packed(part, model.wide))
        _, (a,) = model.grams[k - 1].find(hash_of(keys), 1)
        a = a[inverse]
        if k == 1:
            total, *seen = (np.full(len(p), x) for x in model.first)
        else:
            keys, inverse = distinct(packed(part[:-1], model.wide))
            total, *seen = (x[inverse] for x in model.contexts[k - 1].find(hash_of(keys), 4)[1])
        d = np.array([0.0, *model.discounts[k - 1]])
        left = sum(x * y for x, y in zip(d[1:], seen))
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (np.maximum(a - d[np.minimum(a, 3)], 0) + left * p) / total, p)
    return p


SCORES = pa.schema({"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()})


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for chunk, rows in chunks(batches, SCORED, 1):
        numbers, counts = model.numbered(chunk)
        keys, inverse = distinct(packed(model.windows(chunk, numbers), model.wide))
        log = np.log10(probabilities(model, unpacked(keys, model.order, model.wide)))[inverse]
        counts = counts[chunk.local()]
        base = np.log10((counts + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
        starts = np.cumsum([0, *chunk.lengths[:-1]])
        add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
        ids = pa.concat_arrays([x.column(0) for x in rows])
        found = [pa.array(chunk.lengths, pa.int64()), pa.array(add((counts > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(log))]
        yield pa.RecordBatch.from_arrays([ids, *found], ["doc_id", *SCORES.names])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (smoothed single words), score (the model): log10 probabilities of whole texts; perplexity a token."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = from_arrow_schema(pa.schema([("doc_id", pa.int64()), *SCORES]))
    return rows.mapInArrow(lambda it: _scores(it, model), schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op12_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.where(~held_out()))
    found = scored(docs, model).withColumns({"held_out": held_out(), "train_tokens": F.lit(model.n_tokens).cast("bigint")})
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _discounts(name: str, rows: str) -> str:
    """SQL for the discounts of level `name` from its counts a in `rows`."""
    t = ", ".join(f"count(*) filter (a = {i}) as t{i}" for i in (1, 2, 3, 4))
    d = ", ".join(f"{i} - {i + 1} * (cast(t1 as double) / (t1 + 2 * t2)) * t{i + 1} / t{i} as e{i}" for i in (1, 2, 3))
    good = "t1 > 0 and t2 > 0 and t3 > 0 and t4 > 0 and e1 > 0 and e1 < 1 and e2 > 0 and e2 < 2 and e3 > 0 and e3 < 3"
    return f"{name} as (select *, {', '.join(f'case when {good} then e{i} else {i * 0.5} end as d{i}' for i in (1, 2, 3))} from (select *, {d} from (select {t} from {rows})))"


OP12_SQL = rf"""
with {CRC_TABLE},
docs as (select doc_id, coalesce({CRC.format("cast(doc_id as varchar)")} % 5 = 1, false) as held_out,
                list_concat(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ['']) as ws,
                row_number() over () as r
         from documents, crc),
tokens as (select r, doc_id, held_out, unnest(list_concat([' '], ws[1:len(ws) - 1])) as v, unnest(ws) as w from docs),
u as (select w, count(*) as c from tokens where not held_out group by w),
n as (select coalesce(sum(c), 0) as n_tokens, count(*) as n_words from u),
g2 as (select v, w, count(*) as a from tokens where not held_out group by v, w),
g1 as (select w, count(*) as a from g2 group by w),
{_discounts("d2", "g2")},
{_discounts("d1", "g1")},
c2 as (select v, sum(a) as total, count(*) filter (a = 1) as n1, count(*) filter (a = 2) as n2, count(*) filter (a > 2) as n3 from g2 group by v),
c1 as (select coalesce(sum(a), 0) as total, count(*) filter (a = 1) as n1, count(*) filter (a = 2) as n2, count(*) filter (a > 2) as n3 from g1),
p1 as (select t.w, case when c1.total = 0 then 1.0 / (n_words + 1)
                        else (greatest(coalesce(a, 0) - case when a is null then 0 when a = 1 then d1 when a = 2 then d2 else d3 end, 0)
                              + (d1 * n1 + d2 * n2 + d3 * n3) / (n_words + 1)) / c1.total end as p
       from (select distinct w from tokens) t left join g1 using (w), d1, c1, n),
p2 as (select t.v, t.w, case when c2.total is null then p
                             else (greatest(coalesce(a, 0) - case when a is null then 0 when a = 1 then d1 when a = 2 then d2 else d3 end, 0)
                                   + (d1 * n1 + d2 * n2 + d3 * n3) * p) / c2.total end as p
       from (select distinct v, w from tokens) t join p1 using (w) left join g2 using (v, w) left join c2 using (v), d2)
select any_value(doc_id) as doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(c) as n_known, cast(any_value(n_tokens) as bigint) as train_tokens,
       sum(log10((coalesce(c, 0) + 0.5) / (n_tokens + 0.5 * (n_words + 1)))) as base_score, sum(log10(p)) as score
from tokens join p2 using (v, w) left join u using (w), n
group by r
"""
