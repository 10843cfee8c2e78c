"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the multiset of its five-word shingles. Texts with the same words are copies and form one
text first. For a signature of m slots, each shingle of weight w sends points at the times of a Poisson
process of rate w to random slots; a slot keeps the shingle of its earliest point, and a shingle stops once
its next point would come after every slot's earliest. Two signatures agree in a slot with the
probability Jaccard similarity of the texts. Slots are banded; texts with an equal band share a bucket.

Links are pairs of one bucket with a weighted Jaccard similarity of at least 0.8, verified on the texts.
First each bucket's members are verified against one leader, the member that shares most buckets with others (in a
group of copies that is the text they were made from), and components of the links are taken. A bucket of one component
needs nothing more. In the others, members outside the bucket's largest component are compared with its members in
other components: a pair goes on to be verified if its signatures agree in enough of their slots, and in the first
bucket that it shares only. So no bucket is capped, pairs within a component are never formed, and a group of
near copies costs a row for each member and band.

With 24 bands of 6 slots a pair of similarity 0.8 shares a bucket with probability 0.9993, of 0.9 with 1 - 1e-8. The
agreement is read from 4 bits of each of 248 slots: the estimate of a pair of similarity 0.8 has a standard deviation of
0.026 and is below 0.72 with probability 0.001, that of one of 0.85 with 1e-7. least_agreement=None does without that
estimate. An upper bound from bit maps of the shingles, which no pair of the threshold fails, spares most others the verification. A bucket of n texts that are all alike up to just below the threshold, but not linked, costs n * n such estimates
(a few machine words each, in generated code; adaptive execution splits the bucket), and each near pair a verification.

Null and empty texts are copies of each other, and texts without a word are copies if they are equal. Rows without an
id get a class of null and link nothing. Repeated rows and ids each get a row. Texts are read whole, a few at a time if
they are long; columns besides the id and the text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, written
from .components import components
from .shingles import WordHashes, mixed, shingle_hashes, words_of

BANDS, ROWS = 24, 6
SHINGLE, SIMILARITY = 5, 0.8
#: Slots of a signature: those of the bands, ten bands to a 64-bit word (so that none is cut), and the rest of the words.
SLOTS = 248
WORDS, PLANES, BANDS_A_WORD = 4, 4, 10
#: 64-bit words of the bit map of a text's shingles, which stand after the planes.
MAP_WORDS = 32
#: Slots that must agree, as a share, for a pair outside the leaders' ones to be verified.
LEAST_AGREEMENT = 0.72


def text_key(text: str | None) -> bytes:
    """Equal for texts with the same words, and for equal texts without a word."""
    return xxhash.xxh3_128_digest(" ".join(words_of(text)) or f"\n{text or ''}")


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """ProbMinHash signatures of weighted sets (hashes, weights), none of them empty: an array of sets x m hashes."""
    n = len(sets)
    h = np.concatenate([x for x, _ in sets])
    w = np.concatenate([x for _, x in sets]).astype(float)
    d = np.repeat(np.arange(n), [len(x) for x, _ in sets])
    first, owner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    at, state = np.zeros(len(h)), h.copy()
    while len(h):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        at = at - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
        slot = d * m + (mixed(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        owner[slot[won]] = h[won]
        going = at < first.reshape(n, m).max(1)[d]
        h, w, d, at, state = h[going], w[going], d[going], at[going], state[going]
    return owner.reshape(n, m)


def _places() -> np.ndarray:
    """The bit of each slot in the words of a plane."""
    slots = np.arange(BANDS * ROWS)
    own = slots // (ROWS * BANDS_A_WORD) * 64 + slots % (ROWS * BANDS_A_WORD)
    last = (BANDS - 1) // BANDS_A_WORD
    free = np.arange(last * 64 + (BANDS - last * BANDS_A_WORD) * ROWS, WORDS * 64)
    return np.concatenate([own, free])[:SLOTS]


def planes(signature: np.ndarray) -> np.ndarray:
    """4 bits of each slot, as PLANES x WORDS 64-bit words."""
    low = mixed(signature)
    bits = np.zeros((len(signature), PLANES, WORDS * 64), np.uint8)
    for i in range(PLANES):
        bits[:, i, _places()] = (low >> np.uint64(i)) & np.uint64(1)
    return np.packbits(bits, axis=2, bitorder="little").view("<i8").reshape(len(signature), -1)


def agreement(a: str, b: str) -> str:
    """SQL for the share of slots that agree beyond chance, from two arrays of planes."""
    words = ["(" + " | ".join(f"({a}[{p * WORDS + w}] ^ {b}[{p * WORDS + w}])" for p in range(PLANES)) + ")" for w in range(WORDS)]
    equal = f"({SLOTS} - " + " - ".join(f"bit_count({w})" for w in words) + f") / {float(SLOTS)}"
    return f"(({equal}) - {2.0**-PLANES}) / {1 - 2.0**-PLANES}"


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle hash."""
    bits = np.zeros(MAP_WORDS * 64, np.uint8)
    bits[(mixed(shingles) % np.uint64(MAP_WORDS * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def may_reach(least: float, a: str, b: str, size: str, other_size: str) -> str:
    """SQL that is true for every pair of similarity `least` or more.

    A bit that one map has and the other hasn't stands for a shingle that only one text holds, so that the sum of all differences of counts is at
    least the number of such bits, x. As the similarity is (s - d) / (s + d) for a sum of sizes s and of differences d, it is at most (s - x) / (s + x).
    """
    at = PLANES * WORDS
    x = "(" + " + ".join(f"bit_count({a}[{at + i}] ^ {b}[{at + i}])" for i in range(MAP_WORDS)) + ")"
    return f"({size} + {other_size} - {x}) >= {least} * ({size} + {other_size} + {x})"


def first_shared(a: str, b: str, band: str) -> str:
    """SQL: no band before this one has equal hashes in two arrays of them. The planes cannot tell: their 4 bits may agree by chance."""
    return "not (" + " or ".join(f"({band} > {i} and {a}[{i}] = {b}[{i}])" for i in range(BANDS - 1)) + ")"


def banded(signature: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of each signature."""
    rows = signature[:, : bands * ROWS].reshape(len(signature), bands, ROWS)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        out = mixed(out + rows[:, :, i])
    return out.astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part in slices(batch, most_rows=500, most_bytes=2 << 20):
            texts = part.column(1).to_pylist()
            all_shingles = [shingle_hashes(hashes.of(x), SHINGLE) for x in texts]
            full = [i for i, x in enumerate(all_shingles) if len(x)]
            bands: list = [[] for _ in texts]
            marks: list = [[] for _ in texts]
            if full:
                found = signatures([np.unique(all_shingles[i], return_counts=True) for i in full], SLOTS)
                for i, x, y in zip(full, banded(found, BANDS), planes(found)):
                    bands[i], marks[i] = x, np.concatenate([y, bit_map(all_shingles[i])])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([text_key(x) for x in texts], pa.binary()), pa.array([len(x) for x in all_shingles], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "mark", "text_key", "size", "bands", "planes"],
            )


class Weighed(dict):
    """Shingle counts of the texts seen last."""

    def __init__(self):
        self.hashes = WordHashes()

    def __missing__(self, text):
        if len(self) >= 64:
            self.clear()
        self[text] = found = Counter(shingle_hashes(self.hashes.of(text), SHINGLE).tolist())
        return found


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the sum of the lower counts by the sum of the higher."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[h]) for h, n in a.items() if h in b)
    total = a.total() + b.total() - both
    return both / total if total else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. texts: text_key, text."""

    @F.arrow_udf("boolean")
    def alike(a_keys: pa.Array, a_texts: pa.Array, b_keys: pa.Array, b_texts: pa.Array) -> pa.Array:
        seen, out = Weighed(), []
        # a batch's texts leave Arrow one at a time
        for ka, a, kb, b in ((x.as_py() for x in row) for row in zip(a_keys, a_texts, b_keys, b_texts)):
            # where an id is repeated, a text may not be the one that the key is of
            out.append(text_key(a) == ka and text_key(b) == kb and similarity(seen[a or ""], seen[b or ""]) >= least)
        return pa.array(out, pa.bool_())

    side = lambda x: texts.select(F.col("text_key").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(alike("a", "a_text", "b", "b_text")).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, least_agreement: float | None = LEAST_AGREEMENT) -> DataFrame:
    """doc_id, class_id (the lowest id of its class), mark (xxhash64 of the text, which tells rows of one id apart) for every row. least_agreement None: every pair of different components in a bucket is verified."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = written(texts.where("doc_id is not null").mapInArrow(_signed, "doc_id bigint, mark bigint, text_key binary, size bigint, bands array<bigint>, planes array<bigint>"), "signatures")
    kinds = signed.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.min("size").alias("size"), F.first("bands").alias("bands"))
    banded_rows = kinds.select("text_key", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = banded_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(banded_rows.join(written(shared, "shared-buckets"), "bucket"), "bucket-members")
    named = written(kinds.select("text_key", "first_id").join(members.select("text_key").distinct(), "text_key"), "candidates")
    # texts of candidates only; the shuffled side is built from them, so that texts are not sorted
    wanted = written(texts.join(named.withColumnRenamed("first_id", "doc_id").hint("shuffle_hash"), "doc_id").select("text_key", "text"), "candidate-texts")

    fits = F.least("size", "other_size") >= F.lit(least) * F.greatest("size", "other_size")
    met = members.groupBy("text_key").agg(F.sum(F.col("n") - 1).alias("met"))
    ranked = members.join(met, "text_key").select("bucket", "text_key", "size", "met")
    leader = F.max_by(F.struct(F.col("text_key").alias("b"), F.col("size").alias("other_size")), F.struct("met", "text_key"))
    first = written(ranked.groupBy("bucket").agg(leader.alias("x")).select("bucket", "x.*"), "leaders")
    pairs = members.join(first, "bucket").where((F.col("text_key") != F.col("b")) & fits).select(F.col("text_key").alias("a"), "b")
    links = written(_verified(written(pairs.distinct(), "pairs"), wanted, least), "links")
    labels = components(links)

    of = members.join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("component", F.coalesce("component", "text_key"))
    of = written(of.select("bucket", "band", "text_key", "size", "component"), "bucket-components")
    sizes = of.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1").select("bucket", F.col("most.component").alias("largest"))
    several = several.join(first.select("bucket", F.col("b").alias("leader")), "bucket")
    unresolved = of.join(written(several, "open-buckets"), "bucket")
    marked = written(unresolved.join(signed.groupBy("text_key").agg(F.first("planes").alias("planes"), F.first("bands").alias("bands")), "text_key"), "open-members")
    agree = agreement("planes", "other_planes")
    other = marked.where("component <> largest").select("bucket", F.col("text_key").alias("b"), F.col("size").alias("other_size"), F.col("component").alias("other_component"), F.col("planes").alias("other_planes"), F.col("bands").alias("other_bands"))
    # both outside the largest component: one of the two orders is enough
    once = (F.col("component") == F.col("largest")) | (F.col("text_key") < F.col("b"))
    # pairs with the leader have been verified
    new = (F.col("text_key") != F.col("leader")) & (F.col("b") != F.col("leader"))
    apart = (F.col("component") != F.col("other_component")) & once & new & fits
    likely = F.lit(True) if least_agreement is None else F.expr(f"{agree} >= {least_agreement}")
    near = marked.join(other, "bucket").where(apart & likely & F.expr(may_reach(least, "planes", "other_planes", "size", "other_size")) & F.expr(first_shared("bands", "other_bands", "band")))
    more = written(near.select(F.col("text_key").alias("a"), "b"), "pairs")
    if not more.isEmpty():
        # components grow by links between them: those are few, whatever the number of links within
        part = labels.select(F.col("node"), "component")
        of_side = lambda x: part.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part"))
        found = _verified(more, wanted, least).join(of_side("a"), "a", "left").join(of_side("b"), "b", "left")
        between = written(found.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")).distinct(), "links")
        joined = components(between)
        moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        alone = joined.join(labels.select("node"), "node", "left_anti")
        labels = written(moved.unionByName(alone), "labels")
    whole = kinds.select("text_key", "first_id").join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("component", F.coalesce("component", "text_key"))
    lowest = whole.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_key = written(whole.join(lowest, "component").select("text_key", "class_id"), "classes")
    return signed.select("doc_id", "mark", "text_key").join(by_key, "text_key").select("doc_id", "class_id", "mark").unionByName(
        texts.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id"), "mark")
    )


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
