"""The language model against a plain one in dictionaries, at several orders and chunk sizes, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import lm

ODD = [None, "", " \t\n", "A a A\x0bb", "É é é", "x", "x", "long Word " * 3000]


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), b""]


class Plain:
    def __init__(self, texts, order):
        self.order, self.levels = order, []
        grams = Counter(tuple(g) for t in texts for g in self.windows(tokens(t)))
        self.counts = Counter(w for t in texts for w in tokens(t))
        for k in range(order, 0, -1):
            self.levels.insert(0, grams)
            grams = Counter(g[1:] for g in grams)
        self.discounts = [lm.discounts_of(tuple(sum(a == i for a in g.values()) for i in (1, 2, 3, 4))) for g in self.levels]
        self.contexts = []
        for g in self.levels:
            under = defaultdict(list)
            for k, a in g.items():
                under[k[:-1]].append(a)
            self.contexts.append(under)

    def windows(self, words):
        line = ["<s>"] * (self.order - 1) + words
        return [line[i : i + self.order] for i in range(len(words))]

    def p(self, gram):
        if not gram:
            return 1 / (len(self.counts) + 1)
        k = len(gram) - 1
        under = self.contexts[k].get(tuple(gram[:-1]))
        low = self.p(gram[1:])
        if not under:
            return low
        d = [0, *self.discounts[k]]
        a = self.levels[k].get(tuple(gram), 0)
        return (max(a - d[min(a, 3)], 0) + sum(d[min(x, 3)] for x in under) * low) / sum(under)

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.windows(tokens(text)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 2, 3, 5])))
    return ODD + [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(60)]


@pytest.mark.parametrize(("order", "chunk"), [(1, 1 << 20), (2, 40), (3, 200), (4, 1 << 20)])
def test_scores_equal_a_plain_model(spark, texts, order, chunk, monkeypatch):
    monkeypatch.setattr(lm, "SCORED", chunk)
    monkeypatch.setattr(lm, "COUNTED", chunk)
    monkeypatch.setattr(lm, "PIECE", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    learned = docs.where("doc_id % 3 <> 1")
    model, plain = lm.learn(learned, order), Plain(texts[0::3] + texts[2::3], order)
    assert model.n_tokens == sum(plain.counts.values()) and model.n_words == len(plain.counts)
    assert list(model.discounts) == plain.discounts
    got = {r["doc_id"]: r for r in lm.scored(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = tokens(t)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(ws), sum(w in plain.counts for w in ws))
        assert got[i]["score"] == pytest.approx(plain.score(t), rel=1e-9)
        n, v = model.n_tokens, model.n_words
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((plain.counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert got[i]["perplexity"] == pytest.approx(10 ** (-plain.score(t) / len(ws)), rel=1e-9)


def test_probabilities_add_up_to_one(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm.learn(docs, 3)
    every = np.append(np.arange(model.n_words, dtype=np.uint64), np.uint64(model.n_words + 1))
    for u, v in ((model.n_words, model.n_words), (model.n_words, 0), (1, 2), (3, model.n_words + 1)):
        p = lm.probabilities(model, [np.full(len(every), u, np.uint64), np.full(len(every), v, np.uint64), every])
        assert p.sum() == pytest.approx(1) and (p > 0).all()


@pytest.mark.parametrize("wide", [False, True])
def test_keys_pack_and_hash_as_in_sql(spark, wide):
    words = [np.array(x, np.uint64) for x in ([1, 2, 7], [0, 5, 1 << 31], [9, 9, 9])]
    keys = lm.packed(words, wide)
    assert [x.tolist() for x in lm.unpacked(keys, 3, wide)] == [x.tolist() for x in words]
    rows = [tuple(int(x) for x in r) for r in zip(*keys)]
    df = spark.createDataFrame(rows, ", ".join(f"p{i} bigint" for i in range(len(keys))))
    assert sorted(r[0] for r in df.select(F.xxhash64(*df.columns)).collect()) == sorted(lm.hash_of(keys).view(np.int64).tolist())


def test_wide_numbers_give_the_same_scores(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scores = lambda: {r["doc_id"]: round(r["score"], 6) for r in lm.scored(docs, lm.learn(docs, 3)).collect()}
    narrow = scores()
    monkeypatch.setattr(lm, "NARROW", 0)
    assert scores() == narrow


def test_nothing_to_learn_from_and_nothing_to_score(spark, texts):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("bucket", "h", "score", "kind")})
    empty = lm.learn(docs.limit(0))
    assert sorted((r["n_tokens"], r["score"], r["base_score"]) for r in lm.scored(docs, empty).collect()) == [(1, 0.0, 0.0), (3, 0.0, 0.0)]
    assert lm.scored(docs.limit(0), lm.learn(docs)).count() == 0


def test_query_equals_sql_on_odd_rows(spark, texts, tmp_path):
    rows = [*enumerate(texts), (None, "no id"), (None, None), (7, "again"), (7, "again")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op12_lm(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(lm.OP12_SQL)
    at = [want.columns.index(c) for c in got.columns]
    plain = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    assert Counter(plain(r) for r in got.collect()) == Counter(plain([r[i] for i in at]) for r in want.fetchall())
    held = {r["doc_id"]: r["held_out"] for r in got.where("doc_id is not null").collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in held}
