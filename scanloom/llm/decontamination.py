"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Each document is read as windows of as many words as an item has. A window's 64-bit SimHash is looked up by its eight
bytes: an item within the radius r differs in some byte by at most r // 8 bits, so the byte tables give every item
within it. Items within the radius are then verified by the exact weighted Jaccard similarity of the shingles.

Windows are screened before they are fingerprinted: one that holds too few shingles of every item can have no similar item,
so passing it over loses nothing (an exact bound, not a guess). At sf0.1 the screen leaves 2,816 of 154.5 million windows,
nearly all of them in the 247 documents that hold items; without it, every window of every item length would be fingerprinted. At
similarity 0.8 fingerprints differ in 9.7 of 64 bits on average (standard deviation 2.9), so the radius of 23
lies 4.6 deviations above that; a random item shares some byte within 2 bits with probability 0.71, which is why the
tables alone select little at such a similarity.

Items come to the tasks in parts of at most part_words words, one part in each pass over the documents,
so that what is broadcast has a bound. Texts or items without a word match nothing; an item shorter than
five words is a single shingle. Repeated items and documents give a row for each pair of ids; rows without an id stay in (null). Texts are read whole,
a few at a time if they are long. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .shingles import WordHashes, shingle_hashes

#: Words of items in one pass over the documents.
PART_WORDS = 2_000_000
RADIUS = 23
BITS = 22


def simhash(shingles: np.ndarray) -> int:
    """The majority of each bit; a tie is 0."""
    ones = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    return int(np.packbits(ones * 2 > len(shingles)).view(np.uint64)[0])


class Items:
    """The index of one part of the benchmark."""

    def __init__(self, rows: list[tuple[int | None, str | None]], k: int = 5, similarity: float = 0.8, radius: int = RADIUS):
        self.k, self.similarity, self.radius = k, similarity, radius
        self.ids, self.sizes, self.marks, self.counts, self.weights = [], [], [], [], []
        hashes, of, texts = WordHashes(), defaultdict(list), {}
        for item_id, text in rows:
            words = hashes.of(text)
            if not len(words):
                continue
            key = words.tobytes()
            if key in texts:
                self.ids[texts[key]].append(item_id)
                continue
            texts[key] = at = len(self.ids)
            self.ids.append([item_id])
            self.sizes.append(len(words))
            shingles = shingle_hashes(words, k)
            self.marks.append(simhash(shingles))
            self.weights.append(len(shingles))
            self.counts.append(dict(zip(*(x.tolist() for x in np.unique(shingles, return_counts=True)))))
            for h in self.counts[at]:
                of[h].append(at)
        self.short = sorted({n for n in self.sizes if n < k})
        self.known = np.array(sorted(of), np.uint64)
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[(self.known & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        self.of = of
        self.marks = np.array(self.marks, np.uint64)
        # by byte and value: where the items with that byte begin, sorted by value
        self.tables = []
        for b in range(8):
            own = (self.marks >> np.uint64(8 * b)).astype(np.int64) & 255
            order = np.argsort(own, kind="stable").astype(np.int32)
            self.tables.append((np.searchsorted(own[order], np.arange(257)).tolist(), order))
        self.near = [[v for v in range(256) if (v ^ x).bit_count() <= radius // 8] for x in range(256)]

    def within(self, mark: int) -> list[int]:
        """Items within the radius of a fingerprint, by the byte tables."""
        some = [order[starts[v] : starts[v + 1]] for b, (starts, order) in enumerate(self.tables) for v in self.near[mark >> 8 * b & 255] if starts[v] < starts[v + 1]]
        if not some:
            return []
        found = np.unique(np.concatenate(some))
        return found[np.bitwise_count(self.marks[found] ^ np.uint64(mark)) <= self.radius].tolist()

    def exact(self, shingles: np.ndarray, at: int) -> float:
        own, other = self.counts[at], dict(zip(*(x.tolist() for x in np.unique(shingles, return_counts=True))))
        both = sum(min(n, own.get(h, 0)) for h, n in other.items())
        return both / (len(shingles) + self.weights[at] - both)

    def _hits(self, shingles: np.ndarray) -> dict[int, list[int]]:
        """By item, the places of its shingles."""
        maybe = np.flatnonzero(self.filter[(shingles & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        found = defaultdict(list)
        for place in maybe.tolist():
            for at in self.of.get(int(shingles[place]), ()):
                found[at].append(place)
        return found

    def _starts(self, places: list[int], width: int, last: int, need: int) -> set[int]:
        """Starts of the windows of width shingles that hold at least need of the places."""
        found: set[int] = set()
        for i in range(len(places) - need + 1):
            low, high = places[i + need - 1] - width + 1, places[i]
            found.update(range(max(0, low), min(high, last) + 1))
        return found

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """By item, the best window: similarity, first word, words."""
        best: dict[int, tuple[float, int, int]] = {}
        for k in [*self.short, self.k]:
            if len(words) < k and k != self.k:
                continue
            shingles = shingle_hashes(words, k)
            windows: dict[tuple[int, int], None] = {}
            for at, places in self._hits(shingles).items():
                own = self.weights[at]
                if min(self.k, self.sizes[at]) != min(k, len(words)):
                    continue
                width = min(own, len(shingles))
                need = max(1, int(np.ceil((own + width) * self.similarity / (1 + self.similarity) - 1e-9)))
                if len(places) >= need:
                    windows.update(dict.fromkeys((s, width) for s in sorted(self._starts(places, width, len(shingles) - width, need))))
            for start, width in windows:
                part = shingles[start : start + width]
                for at in self.within(simhash(part)):
                    if min(self.weights[at], len(shingles)) != width or min(self.k, self.sizes[at]) != min(k, len(words)):
                        continue
                    sim = self.exact(part, at)
                    if sim >= self.similarity and (at not in best or (sim, -start) > (best[at][0], -best[at][1])):
                        best[at] = (sim, start, min(self.sizes[at], len(words)))
        return best


def parts(items: DataFrame, id_col: str = "item_id", text_col: str = "text", part_words: int = PART_WORDS, **options) -> Iterator:
    """A broadcast index for each part of the items; a part has about part_words words at most."""
    spark = items.sparkSession
    size = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\W+"))
    n = -(-(items.agg(F.sum(size)).first()[0] or 0) // part_words)
    for part in range(n):
        rows = items.where(F.pmod(F.xxhash64(text_col), F.lit(n)) == part).select(F.col(id_col).cast("bigint"), text_col).collect()
        yield spark.sparkContext.broadcast(Items([tuple(r) for r in rows], **options))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, start_word, n_words, similarity (of the best window, the first of equals)."""

    def run(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        hashes, index = WordHashes(), sent.value
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, (similarity, start, n) in sorted(index.search(hashes.of(text)).items()):
                    rows += [(doc_id, item_id, start, n, similarity) for item_id in index.ids[at]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, start_word int, n_words int, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for sent in parts(items, **options):
        found = found.unionByName(texts.mapInArrow(lambda it, sent=sent: run(it, sent), schema))
    return found


def _holds(sent) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, index = WordHashes(), sent.value
        for texts in batches:
            yield pa.array([bool(index.search(hashes.of(x))) for x in texts.to_pylist()], pa.bool_())

    return test


def contaminated(items: DataFrame, text: Column, **options) -> Column:
    """True where the text holds an item; never null."""
    found = F.lit(False)
    for sent in parts(items, **options):
        found = found | _holds(sent)(text)
    return found


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
