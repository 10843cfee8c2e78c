"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A word's probability in a language is the sum, over all its segmentations into pieces of the
vocabulary, of the product of the language's piece probabilities (a forward algorithm). Piece
probabilities are learned by expectation-maximisation: each distinct word of the learning documents,
counted over all of them, gives expected piece counts by a forward and a backward pass. A text's
score is the product over its words; words are runs of letters, in lower case.

Languages are learned and scored in blocks of LANGUAGES_A_BLOCK. Learning holds one block's piece table (languages x vocabulary)
in a task and on the driver at a time, however many values `lang` has. Scoring reads the texts once, with a scorer for each block in the same stage:
a task's Python workers hold the tables of all blocks between them, one each. A text's best language and the sum over all languages are put
together from the blocks. Sums that get near the smallest number are done again in scaled form.

Null texts and texts without a letter are `und` with score 0, and so is every text if nothing can be learned. Of
languages with equal scores the first by name is taken. Whole texts are read, whatever their length.
Rows are independent; repeated rows count as often as they stand; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, table, written

WORDS = re.compile(r"[^\W\d_]+").findall
START = "▁"
#: Entries after which a task hands on its counts, or forgets the words that it has scored.
MOST_WORDS = 1_000_000
#: Words scored together.
BATCH_WORDS = 20_000
#: Characters up to which a word's sums are tried unscaled; longer words, and sums below LEAST_SUM, take the scaled path.
PLAIN_CHARS, LEAST_SUM = 24, 1e-280
#: Languages that are learned and scored together: a piece table is languages x vocabulary.
LANGUAGES_A_BLOCK = 256


def vocabulary(model_path: str) -> list[str]:
    """Pieces of a sentencepiece file that lower-cased words can hold: letters, perhaps after a word start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return [p for p in pieces if p == START or (x := p.removeprefix(START)).isalpha() and x == x.lower()]


class Lattices:
    """Sums over the segmentations of many words at once, as arrays over words of one length.

    Pieces are found by rolling hashes of all substrings: first a bit table, then a sorted array. A character that
    isn't a piece stands for itself.
    """

    MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
    BITS = 22

    def __init__(self, pieces: list[str]):
        self.pieces, self.n = pieces, len(pieces)
        self.at = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        keys = np.zeros(self.n, np.uint64)
        for size in {len(p) for p in pieces}:
            own = [i for i, p in enumerate(pieces) if len(p) == size]
            keys[own] = self._substrings(self._codes([pieces[i] for i in own], size), size)[-1][:, 0]
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    @staticmethod
    def _codes(words: list[str], size: int) -> np.ndarray:
        return np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64)

    def _substrings(self, codes: np.ndarray, longest: int) -> list[np.ndarray]:
        """By length from 1 on, hashes of the substrings at each place."""
        out, h = [], np.zeros_like(codes)
        for k in range(1, min(longest, codes.shape[1]) + 1):
            h = (h[:, : codes.shape[1] - k + 1] + codes[:, k - 1 :] + np.uint64(1)) * self.MIX
            h = h ^ (h >> np.uint64(29))
            out.append(h * self.STEP)
        return out

    def _arcs(self, words: list[str], size: int) -> list[np.ndarray]:
        """By length, the piece at each place of each word (words x places): n if there is none, n + 1 for a lone character."""
        out = []
        for k, h in enumerate(self._substrings(self._codes(words, size), self.longest), 1):
            found = np.full(h.shape, self.n if k > 1 else self.n + 1, np.int32)
            where = np.nonzero(self.maybe[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
            some = h[where]
            i = np.minimum(np.searchsorted(self.keys, some), max(0, self.n - 1))
            if self.n:
                hit = self.keys[i] == some
                found[where[0][hit], where[1][hit]] = self.order[i[hit]]
            out.append(found)
        return out

    def _groups(self, words: list[str]):
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for size, own in by.items():
            yield size, np.array(own), [START + words[i] for i in own]

    def log_forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """words x languages. table: (n + 2) x languages, with 0 in row n."""
        out = np.zeros((len(words), table.shape[1]))
        for size, own, some in self._groups(words):
            if size > PLAIN_CHARS:
                out[own] = [self.scaled_forward(w, table) for w in some]
                continue
            arcs = self._arcs(some, size)
            alpha = [np.ones((len(some), table.shape[1]))]
            for end in range(1, size + 1):
                a = 0.0
                for k in range(1, min(end, len(arcs)) + 1):
                    a = a + alpha[end - k] * table[arcs[k - 1][:, end - k]]
                alpha.append(a)
            low = (alpha[-1] < LEAST_SUM).any(1)
            with np.errstate(divide="ignore"):
                out[own] = np.log(alpha[-1])
            for i in np.flatnonzero(low).tolist():
                out[own[i]] = self.scaled_forward(some[i], table)
        return out

    def expected(self, words: list[str], counts: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one language (row: n + 2 probabilities), each word as often as counted."""
        uses = np.zeros(self.n + 2)
        for size, own, some in self._groups(words):
            if size > PLAIN_CHARS:
                for w, c in zip(some, counts[own].tolist()):
                    self.scaled_expected(w, c, row, uses)
                continue
            arcs = self._arcs(some, size)
            alpha, beta = np.zeros((size + 1, len(some))), np.zeros((size + 1, len(some)))
            alpha[0] = beta[size] = 1.0
            for end in range(1, size + 1):
                for k in range(1, min(end, len(arcs)) + 1):
                    alpha[end] += alpha[end - k] * row[arcs[k - 1][:, end - k]]
            low = alpha[size] < LEAST_SUM
            for i in np.flatnonzero(low).tolist():
                self.scaled_expected(some[i], float(counts[own[i]]), row, uses)
            weight = np.where(low, 0.0, counts[own]) / np.where(low, 1.0, alpha[size])
            for begin in range(size - 1, -1, -1):
                for k in range(1, min(size - begin, len(arcs)) + 1):
                    piece = arcs[k - 1][:, begin]
                    share = row[piece] * beta[begin + k]
                    beta[begin] += share
                    uses += np.bincount(piece, share * alpha[begin] * weight, self.n + 2)
        return uses

    def _plain_arcs(self, s: str, end: int):
        for begin in range(max(0, end - self.longest), end):
            piece = self.at.get(s[begin:end])
            if piece is not None or begin == end - 1:
                yield begin, self.n + 1 if piece is None else piece

    def scaled_forward(self, s: str, table: np.ndarray) -> np.ndarray:
        """One long word; the last positions are scaled up together before they get small."""
        alpha, scale = [np.ones(table.shape[1])], np.zeros(table.shape[1])
        for end in range(1, len(s) + 1):
            alpha.append(sum(alpha[begin] * table[piece] for begin, piece in self._plain_arcs(s, end)))
            low = alpha[-1] < 1e-100
            if low.any():
                for i in range(max(0, end + 1 - self.longest), end + 1):
                    alpha[i] = np.where(low, alpha[i] * 1e100, alpha[i])
                scale -= low * math.log(1e100)
        return np.log(alpha[-1]) + scale

    def scaled_expected(self, s: str, count: float, row: np.ndarray, uses: np.ndarray) -> None:
        """One long word, in logarithms."""
        logs = np.log(np.where(row > 0, row, 1e-300))
        alpha, arcs = [0.0], [list(self._plain_arcs(s, end)) for end in range(1, len(s) + 1)]
        for own in arcs:
            alpha.append(float(np.logaddexp.reduce([alpha[b] + logs[p] for b, p in own])))
        beta = [-math.inf] * len(s) + [0.0]
        for end in range(len(s), 0, -1):
            for b, p in arcs[end - 1]:
                beta[b] = float(np.logaddexp(beta[b], beta[end] + logs[p]))
        for end in range(1, len(s) + 1):
            for b, p in arcs[end - 1]:
                uses[p] += count * math.exp(alpha[b] + logs[p] + beta[end] - alpha[-1])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out():
        for lang, c in counts.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(WORDS((text or "").lower()))
            if sum(map(len, counts.values())) > MOST_WORDS:
                yield from out()
                counts = {}
    yield from out()


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, n over all the given documents; counts meet in a task before they are shuffled."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, pieces: list[str], lang_col: str = "lang", text_col: str = "text", rounds: int = 2, alpha: float = 0.1, block: int = LANGUAGES_A_BLOCK) -> dict:
    """Languages and, by block of languages, a broadcast model. The driver gathers one block's piece counts at a time: block x pieces numbers at most."""
    words = written(word_counts(docs, lang_col, text_col), "language-words")
    langs = sorted(x[0] for x in words.select("lang").distinct().collect())
    sc, lattices = docs.sparkSession.sparkContext, Lattices(pieces)
    blocks = [langs[i : i + block] for i in range(0, len(langs), block)]
    own = (lambda some: words) if len(blocks) == 1 else (lambda some: words.where(F.col("lang").between(some[0], some[-1])))
    return {"langs": langs, "blocks": [sc.broadcast({"langs": some, "lattices": lattices, "table": _table(own(some), some, lattices, rounds, alpha)}) for some in blocks]}


def _table(words: DataFrame, langs: list[str], lattices: Lattices, rounds: int, alpha: float) -> np.ndarray:
    """Piece probabilities of a block of languages, pieces x languages, after some rounds."""
    v, at = lattices.n, {x: i for i, x in enumerate(langs)}
    table = np.tile(np.append(np.full(v, 1 / (v + 1)), [0.0, 1 / (v + 1)])[:, None], (1, len(langs)))
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast((lattices, at, table))

        def expect(batches, sent=sent):
            lattices, at, table = sent.value
            uses: dict[str, np.ndarray] = {}
            for batch in batches:
                own, some, n = (np.array(c.to_pylist(), object) for c in batch.columns)
                for lang in dict.fromkeys(own.tolist()):
                    mine = own == lang
                    found = lattices.expected(some[mine].tolist(), n[mine].astype(float), table[:, at[lang]])
                    uses[lang] = uses[lang] + found if lang in uses else found
            for lang, u in uses.items():
                some = np.flatnonzero(u)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(u[some])], ["lang", "piece", "n"])

        sums = words.mapInArrow(expect, "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros_like(table)
        table[sums.column(1).to_numpy(), np.array([at[x] for x in sums.column(0).to_pylist()], np.int64)] = sums.column(2).to_numpy()
        table = (table + alpha) / (table.sum(0) + alpha * (v + 1))
        table[v] = 0
    return table


class Scorer:
    """The best of a block's languages, its log probability, and the log of the sum over the block; each distinct word is scored once."""

    def __init__(self, model: dict):
        self.langs, self.lattices, self.table = model["langs"], model["lattices"], model["table"]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))

    def know(self, words: list[str]) -> None:
        for i in range(0, len(words), BATCH_WORDS):
            some = words[i : i + BATCH_WORDS]
            begin = len(self.at)
            while begin + len(some) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[begin : begin + len(some)] = self.lattices.log_forward(some, self.table)
            self.at.update(zip(some, range(begin, begin + len(some))))

    def __call__(self, texts: list[str | None]) -> list[tuple[str | None, float, float]]:
        found = [WORDS((x or "").lower()) for x in texts]
        if len(self.at) > MOST_WORDS:
            self.forget()
        # characters such as superscript digits count as word characters, but a word needs a letter
        self.know([w for w in dict.fromkeys(chain.from_iterable(found)) if w not in self.at and any(map(str.isalpha, w))])
        out = []
        for words in found:
            at = [i for w in words if (i := self.at.get(w)) is not None]
            if not at:
                out.append((None, 0.0, 0.0))
                continue
            total = self.rows[at].sum(0)
            best = int(total.argmax())
            out.append((self.langs[best], float(total[best]), float(total[best] + np.log(np.exp(total - total[best]).sum()))))
        return out


def _block_scores(sent) -> Callable[[Column], Column]:
    @F.arrow_udf("lang string, best double, total double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for texts in batches:
            found = [x for part in slices(pa.record_batch([texts], ["text"]), 0) for x in scorer(part.column(0).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))], ["lang", "best", "total"])

    return run


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """A struct column lang_pred, score (the posterior of lang_pred over all languages)."""
    text = F.col(text_col).cast("string")
    if not model["blocks"]:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def put_together(s: Column) -> Column:
        """Of the blocks' scores: the first best one, and its share of the sum over all."""
        best = F.array_max(F.transform(s, lambda x: x["best"]))
        lang = F.get(F.transform(F.filter(s, lambda x: x["best"] == best), lambda x: x["lang"]), F.lit(0))
        share = 1.0 / F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x["total"] - best))
        return F.struct(F.coalesce(lang, F.lit("und")).alias("lang_pred"), F.when(lang.isNull(), 0.0).otherwise(share).alias("score"))

    # a lambda variable stands for the scores, so that they are computed once
    return F.transform(F.array(F.array(*[_block_scores(sent)(text) for sent in model["blocks"]])), put_together)[0]


def fold(mod: int, id_col: str = "doc_id") -> Column:
    """The contract's remainder; a null id counts as remainder 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)), F.lit(1))


def op3_language(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(fold(4) != 2), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return docs.select("doc_id", (fold(4) == 2).alias("held_out"), identify(docs, model).alias("x")).select("doc_id", "held_out", "x.lang_pred", "x.score")
