"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Learning. At most `most_labelled` labelled rows are taken, half of them toxic if there are enough, in the order of a
hash of the id; equal texts of a label (case aside) stand once. Of these rows at most `most_examples`, half of each
class, are examples, and all calibrate. These two numbers are the only bounds. The terms are
all words that an example holds. A term weighs in a text (1 + log count) x inverse document frequency x relevance:
document frequencies are counted over all documents, and the relevance, between `floor` and 1, is how much of the difference of
the term's shares in the two classes of the sampled rows lies beyond chance, by the sum of the shares. Plain TF-IDF (relevance 1) is what most_relevant=False gives; README has both accuracies.

Scoring. Postings of the examples' unit vectors are cut into blocks with each term's largest weight in it. A text's
upper bound for each block follows from those; the blocks of the highest bounds are scored first, and of the others
those whose bound reaches the k-th best cosine so far, so the k nearest are exact (cosines are equal to 9 digits; ties: the
example that is lower by label and id as text first).
Their votes, weighted by 1 / (distance + 0.05) and by the labelled rows that an example of its class stands for, give
a raw score. Isotonic regression turns it into a share of toxic texts: its points are the raw scores of all sampled rows, those of examples without
their own posting, weighted to the class shares of all labelled rows. The raw score itself stands beside it as PRIOR rows of the
smaller class would, so that scores rise with the vote however few rows are labelled. If a class has no row,
the vote is the score. Texts that share no term with any example get the share among such calibrating rows.

Null and empty texts have no term and get that share as well. Whole texts are read, whatever their length. Rows are
independent; only the id and the text are read, so other columns of any name do no harm. If an id has several labels,
toxic wins; labels of rows without an id or a label are left out. Without labelled rows every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .shingles import words_of

MOST_LABELLED = 20_000
MOST_EXAMPLES = 2048
NEIGHBOURS = 15
#: Rows of the smaller class that the raw score counts for beside the regression.
PRIOR = 15
#: Examples of a block, and blocks that are scored before the others are held against the k-th best.
BLOCK, FIRST_BLOCKS = 256, 1
#: Least relevance of a term, what is added to the sum of its shares (rare terms tell little), and the standard deviations that count as chance.
FLOOR, DAMPING, CHANCE = 0.02, 0.01, 1.0


def _flushed(batches: Iterator[pa.RecordBatch], known: set[str]) -> Iterator[pa.RecordBatch]:
    """term, toxic rows, other rows: documents that hold the term. Column 0 is the label, column 1 the text."""
    counts = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update(known.intersection(words_of(text)))
    terms = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[w] for w in terms], pa.int64()) for c in counts[::-1])], ["term", "toxic", "other"])


def document_frequencies(rows: DataFrame, known) -> DataFrame:
    """term, toxic, other over rows (label int, text), for the terms of a broadcast set; a task's counts are bounded by that set."""
    counts = rows.mapInArrow(lambda it: _flushed(it, known.value), "term string, toxic bigint, other bigint")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, most_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, id, text, role, turn) of the sample, role being example or count; and by class the number of labelled documents."""
    marks = labels.where("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("label")).where("id is not null")
    marks = marks.withColumn("order", F.xxhash64("id"))
    sizes = {int(r[0]): r[1] for r in marks.groupBy("label").count().collect()}
    share = {1: min(sizes.get(1, 0), max(most // 2, most - sizes.get(0, 0)))}
    share[0] = min(sizes.get(0, 0), most - share[1])
    picked = [marks.where(F.col("label") == c).orderBy("order", "id").limit(share[c]) for c in (0, 1)]
    # a window over at most `most` ids and labels, which bounds the broadcast side too
    chosen = picked[0].unionByName(picked[1]).withColumn("turn", F.row_number().over(W.partitionBy("label").orderBy("order", "id")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen.select("id", "label", "turn")), "id")
    one = texts.groupBy("label", F.sha2(F.lower("text"), 256).alias("key")).agg(F.min_by(F.struct("id", "text", "turn"), F.struct("turn", "id")).alias("x")).select("label", "x.*")
    role = F.when(F.col("turn") <= most_examples // 2, "example").otherwise("count")
    return written(one.withColumn("role", role), "toxicity-sample"), sizes


class Index:
    """Block-max inverted index of the examples' unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, rank: np.ndarray | None = None):
        self.rank = np.arange(len(vectors)) if rank is None else rank
        self.n, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        terms = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
        weights = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        owners = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        order = np.lexsort((owners, terms))
        self.owners, self.weights = owners[order].astype(np.int32), weights[order]
        cell = terms[order] * self.blocks + self.owners // BLOCK
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1)).astype(np.int32)
        most = np.zeros(n_terms * self.blocks)
        np.maximum.at(most, cell, self.weights)
        # bounds are kept in 32 bits, a little too high rather than too low
        self.most = np.nextafter(most.astype(np.float32), np.float32(np.inf), where=most > 0, out=np.zeros(len(most), np.float32)).reshape(n_terms, self.blocks)

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        cells = terms[:, None] * self.blocks + blocks
        first = self.starts[cells]
        sizes = self.starts[cells + 1] - first
        full = sizes > 0
        first, weights, sizes = first[full], np.broadcast_to(weights[:, None], sizes.shape)[full], sizes[full]
        if not len(sizes):
            return np.zeros(self.n)
        ends = np.cumsum(sizes, dtype=np.int32)
        postings = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)
        return np.bincount(self.owners[postings], self.weights[postings] * np.repeat(weights, sizes), self.n)

    def _first(self, found: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
        return sorted(found, key=lambda x: (-x[0], self.rank[x[1]]))[:k]

    def _best(self, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k] - 1e-8]
        return self._first(list(zip(np.round(scores[found], 9).tolist(), found.tolist())), k)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(cosine, example), best first; only cosines above 0."""
        if not self.n or not len(terms):
            return []
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        best = self._best(self._scores(terms, weights, order[:FIRST_BLOCKS]), k)
        low = best[-1][0] - 1e-6 if len(best) == k else 0.0
        rest = order[FIRST_BLOCKS:]
        rest = rest[bounds[rest] > low]
        if len(rest):
            best = self._first(best + self._best(self._scores(terms, weights, np.sort(rest)), k), k)
        return best


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points (x, value) of the non-decreasing steps nearest to y, both ends of each step, to be joined by lines."""
    steps: list[list[float]] = []
    for at in np.argsort(x, kind="stable"):
        steps.append([x[at], x[at], y[at] * w[at], w[at]])
        while len(steps) > 1 and (steps[-2][1] == steps[-1][0] or steps[-2][2] / steps[-2][3] >= steps[-1][2] / steps[-1][3]):
            top = steps.pop()
            steps[-1] = [steps[-1][0], top[1], steps[-1][2] + top[2], steps[-1][3] + top[3]]
    return np.array([e for s in steps for e in s[:2]]), np.array([s[2] / s[3] for s in steps for _ in (0, 1)])


class Places(dict):
    """Place by term; -1 for others, which it doesn't keep."""

    def __missing__(self, term):
        return -1


class Model:
    """terms: place by word; value: what one occurrence of each weighs; stand_for: labelled rows for each example, by class."""

    def __init__(self, terms: dict[str, int], value: np.ndarray, examples: list[tuple[int, int, dict[str, int]]], labelled: dict[int, int], k: int = NEIGHBOURS):
        self.terms, self.value, self.k = Places(terms), value, k
        vectors = [self.vector_of(counts) for _, _, counts in examples]
        # like examples share blocks, which tightens the bounds
        order = sorted(range(len(examples)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:4]].tolist(), str(examples[i][1])))
        self.labels, self.ids = np.array([examples[i][0] for i in order], float), [examples[i][1] for i in order]
        rank = np.argsort(sorted(range(len(order)), key=lambda at: (examples[order[at]][0], str(examples[order[at]][1]))))
        self.index = Index([vectors[i] for i in order], len(terms), rank)
        self.place = {i: at for at, i in enumerate(self.ids)}
        held = Counter(label for label, _, _ in examples)
        self.stand_for = {c: labelled.get(c, 0) / n for c, n in held.items()}
        self.steps, self.none, self.prior = (np.zeros(0), np.zeros(0)), 0.0, 1.0

    def vector_of(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        at, n = (np.fromiter(x, np.int64, len(counts)) for x in (map(self.terms.__getitem__, counts), counts.values()))
        known = at >= 0
        at, n = at[known], n[known]
        weights = (1 + np.log(n)) * self.value[at]
        norm = np.linalg.norm(weights)
        return (at, weights / norm) if norm else (np.zeros(0, np.int64), np.zeros(0))

    def near(self, text: str | None, without: object = None) -> list[tuple[float, int]]:
        """The k nearest examples; without: an example's id, which is left out."""
        own = self.place.get(without)
        found = self.index.nearest(*self.vector_of(Counter(words_of(text))), self.k + (own is not None))
        return [x for x in found if x[1] != own][: self.k]

    def voted(self, near: list[tuple[float, int]]) -> float:
        votes = [(self.stand_for[int(self.labels[i])] / (1 - min(1.0, c) + 0.05), self.labels[i]) for c, i in near]
        return round(float(sum(v * y for v, y in votes) / sum(v for v, _ in votes)), 9)

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.near(text)
        if not near or not len(self.steps[0]):
            return self.none, near
        raw = self.voted(near)
        return float((1 - self.prior) * np.interp(raw, *self.steps) + self.prior * raw), near

    def calibrate(self, rows: list[tuple[int, float | None]], labelled: dict[int, int]) -> None:
        """rows: label and raw vote (None: no neighbour) of each calibrating row."""
        held = Counter(label for label, _ in rows)
        weight = {c: labelled[c] / n for c, n in held.items()}
        raws = [(raw, label, weight[label]) for label, raw in rows if raw is not None]
        none = [(label, weight[label]) for label, raw in rows if raw is None]
        if raws:
            self.steps = isotonic(*(np.array(c, float) for c in zip(*raws)))
        few = min((held.get(c, 0) for c in (0, 1)), default=0)
        self.prior = PRIOR / (PRIOR + few)
        total = sum(labelled.values())
        self.none = sum(y * w for y, w in none) / sum(w for _, w in none) if none else labelled.get(1, 0) / total if total else 0.0


def relevance(toxic: np.ndarray, other: np.ndarray, rows: dict[int, int], floor: float = FLOOR, damping: float = DAMPING, chance: float = CHANCE) -> np.ndarray:
    """How far a term's shares in the classes differ, from floor to 1; 1 where a class is empty, as nothing can be told then."""
    if not rows.get(0) or not rows.get(1):
        return np.ones(len(toxic))
    a, b = toxic / rows[1], other / rows[0]
    return np.maximum(floor, (abs(a - b) - chance * np.sqrt(a / rows[1] + b / rows[0])) / (a + b + damping))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, most_examples: int = MOST_EXAMPLES, k: int = NEIGHBOURS, most_relevant: bool = True) -> Model:
    """labels: the rows to learn from (id_col, toxic). The driver holds the examples' words with their counts, and a number for each calibrating row."""
    sc = docs.sparkSession.sparkContext
    sample, labelled = labelled_sample(docs, labels, id_col, text_col, most_labelled, most_examples)

    def counted(batches):
        for batch in batches:
            found = [Counter(words_of(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c.items()) for c in found], pa.map_(pa.string(), pa.int64()))], ["label", "id", "counts"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.where("role = 'example'").select("label", "id", "text").mapInArrow(counted, f"label int, id {kind}, counts map<string,bigint>").toArrow()
    examples = [(label, i, dict(counts)) for label, i, counts in zip(*(c.to_pylist() for c in rows.columns))]
    examples.sort(key=lambda x: (x[0], str(x[1])))
    terms = {w: i for i, w in enumerate(sorted({w for _, _, c in examples for w in c}))}
    known = sc.broadcast(frozenset(terms))

    def frequencies(of: DataFrame) -> np.ndarray:
        out = np.zeros((2, len(terms)))
        found = document_frequencies(of, known).toArrow()
        at = np.array([terms[w] for w in found.column(0).to_pylist()], np.int64)
        for i in (0, 1):
            out[i, at] = found.column(1 + i).to_numpy()
        return out

    frequency = frequencies(docs.select(F.lit(0).alias("label"), F.col(text_col).cast("string").alias("text")))[1]
    value = np.log((1 + docs.count()) / (1 + frequency)) + 1
    if most_relevant:
        sizes = {int(r[0]): r[1] for r in sample.groupBy("label").count().collect()}
        value = value * relevance(*frequencies(sample.select("label", "text")), sizes)
    known.unpersist()
    model = Model(terms, value, examples, labelled, k)
    sent = sc.broadcast(model)

    def votes(batches):
        m = sent.value
        for batch in batches:
            found = [m.near(x, own) for x, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.voted(x) if x else None for x in found], pa.float64())], ["label", "raw"])

    own = F.when(F.col("role") == "example", F.col("id"))
    held = sample.select("label", "text", own.alias("own")).repartition(max(1, sc.defaultParallelism))
    model.calibrate([(int(r[0]), r[1]) for r in held.mapInArrow(votes, "label int, raw double").collect()], labelled)
    sent.unpersist()
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column score, evidence (the nearest examples: id, toxic, cosine)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, evidence array<struct<id:bigint,toxic:int,cosine:double>>")
    def run(texts: pa.Array) -> pa.Array:
        m = sent.value
        found = [m.score(x) for x in texts.to_pylist()]
        near = [[{"id": int(m.ids[i]), "toxic": int(m.labels[i]), "cosine": c} for c, i in x] for _, x in found]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array(near, kind)], ["score", "evidence"])

    return run(F.col(text_col).cast("string"))


def held_out(id_col: str = "doc_id", mod: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == 0, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), scored(docs, model).alias("x"))
    return found.select("doc_id", "held_out", "x.score", (F.col("x.score") >= 0.5).cast("int").alias("predicted"), F.col("x.evidence.id").alias("evidence"))
