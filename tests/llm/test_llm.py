"""The training-data operators: brute force, round trips, and the cases that every operator must define."""

import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import bpe, chat, components, decontamination, language_id, licenses, line_dedup, near_dedup, quality, sharding, shingles, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
#: Nulls, empties, repeats, ties, odd white space, a long text, and columns whose names the operators use too.
ODD = [
    (1, None), (2, ""), (3, "  \n\t\n"), (4, "same text here and there"), (5, "same text here and there"), (5, "same text here and there"), (None, "no id"), (None, None),
    (6, "long word " * 30_000), (7, "naïve 日本語 \U0001f600 <|im_end|> it's"), (8, "!!! ... ---"), (9, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    for name in ("drops", "made", "n_lines", "measures", "lines", "kept", "n_words", "component", "bucket", "lang"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# 4

def test_bpe_equals_tiktoken_and_round_trips(spark, odd, empty):
    with open(RANKS, "rb") as f:
        whole = bpe.encoding(f.read(), P.PATTERN)
    got = bpe.encode_decode(odd, RANKS, P.PATTERN, block_chars=1000).collect()
    want = Counter((d, np.array(whole.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in ODD)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode_decode(empty, RANKS, P.PATTERN).count() == 0
    back = bpe.decode(spark.createDataFrame(got), RANKS).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((d, (t or "").encode()) for d, t in ODD)


# 7

def dedup_by_hand(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(line_dedup.WHITE))
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held.get(key(x), ())) < 3 or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(spark, odd, empty):
    a, b = "This line repeats across documents", "Another line that repeats a lot, too"
    docs = ODD + [(20, f"{a}\nown\n{b}"), (21, f"\t{a.upper()} \n{a}\n"), (22, f"{b}\n{a}"), (22, a), (23, f"{b}\nshort"), (24, "short"), (25, "short"), (None, a)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == dedup_by_hand(docs)
    out = line_dedup.dedup_lines(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.columns[-2:] == ["n_lines_", "n_dropped"] and out.count() == len(ODD)
    assert line_dedup.dedup_lines(empty).count() == 0


# 5

def test_quality_measures_and_order(spark, odd, empty):
    rng = random.Random(3)
    texts = [" ".join(words(rng, n, v)) for n, v in ((2, 5), (3, 1), (80, 3), (200, 400), (60, 1))] + ["a b c a b c d", "x\nx\n\nx y", "# * $ a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, (_, t) in enumerate(ODD)], "doc_id bigint, text string")
    orders = list(quality.rules(*[{k: F.lit(1) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, {"measures": "m", "lines": "l"}]))
    got = {r["doc_id"]: r for r in quality.cascade(df, order=orders).collect()}
    for r in got.values():
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", r["text"] or "") if x]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        lines = [x for x in (r["text"] or "").split("\n") if x.strip(line_dedup.WHITE)]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_repeat_words"] == len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in r["text"] or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    back = {r["doc_id"]: r["kept"] for r in quality.cascade(df, order=orders[::-1]).collect()}
    assert back == {k: r["kept"] for k, r in got.items()}
    assert quality.cascade(odd).count() == len(ODD) and quality.cascade(empty).count() == 0


def test_quality_order_is_the_same_each_time_and_best_first(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng, 80)) + " #" * (20 * (i % 2)) + "\nx" * (60 * (i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    first = quality.estimate(df)
    assert first == quality.estimate(df) and sorted(k for k, _, _ in first) == sorted(quality.costs({"measures": "m", "lines": "l"}))
    # half of the rows have symbols (one comparison), of the others a third repeats lines (one comparison), and nothing else rejects
    assert [k for k, _, _ in first][:2] == ["symbols", "repeated_lines"] and abs(first[0][1] - 0.5) < 0.01 and abs(first[1][1] - 1 / 3) < 0.01
    assert {r["rule_order"] for r in quality.cascade(df).select("rule_order").collect()} == {", ".join(k for k, _, _ in first)}


# 3

def test_lattice_equals_all_segmentations():
    lattice = language_id.Lattices(["a", "b", "ab", "▁", "▁a", "ba", "aba", "c"])
    table = np.random.default_rng(1).random((10, 2))
    table[8] = 0
    for word in ("a", "ab", "abcab", "zz", "abababc"):
        s, total, uses = "▁" + word, 0.0, np.zeros(10)
        for cut in range(1 << (len(s) - 1)):
            ends = [i for i in range(1, len(s)) if cut >> (i - 1) & 1] + [len(s)]
            ids = [lattice.at.get(s[a:b], 9 if b - a == 1 else 8) for a, b in zip([0, *ends], ends)]
            p = math.prod(table[i, 1] for i in ids)
            total += p
            for i in ids:
                uses[i] += p
        assert math.isclose(lattice.log_forward([word], table)[0, 1], math.log(total)) and math.isclose(lattice.scaled_forward(s, table)[1], math.log(total))
        want = uses / total
        assert np.allclose(lattice.expected([word], np.array([1.0]), table[:, 1]), want)
        slow = np.zeros(10)
        lattice.scaled_expected(s, 1.0, table[:, 1], slow)
        assert np.allclose(slow, want)


def test_language_of_odd_texts(spark, odd, empty):
    pieces = language_id.vocabulary(P.path("piece_bpe_32k.model"))
    rows = [(i, "the house and the garden are green", "en") for i in range(20)] + [(i, "das haus und der garten sind nicht grün", "de") for i in range(20)] + [(99, None, "en"), (98, "text", None)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), pieces)
    assert model["langs"] == ["de", "en"]
    got = odd.select("text", language_id.identify(odd, model).alias("x")).collect()
    assert all((r["x"]["lang_pred"] == "und") == (r["text"] is None or not any(map(str.isalpha, r["text"]))) for r in got)
    test = spark.createDataFrame([("der garten",), ("the garden",), ("x" * 500,)], "text string")
    assert [r["x"]["lang_pred"] for r in test.select(language_id.identify(test, model).alias("x")).collect()][:2] == ["de", "en"]
    nothing = language_id.learn(empty, pieces)
    assert odd.select(language_id.identify(odd, nothing)["lang_pred"]).distinct().collect()[0][0] == "und"


def test_lattice_sums_do_not_underflow():
    lattice = language_id.Lattices(["a", "▁"])
    table = np.full((4, 2), 1e-14)
    table[2] = 0
    for word in ("z" * 23, "z" * 40, "a" * 22):
        got = lattice.log_forward([word], table)
        assert np.isfinite(got).all() and np.allclose(got, (len(word) + 1) * math.log(1e-14))
        assert np.allclose(lattice.expected([word], np.array([2.0]), table[:, 0]).sum(), 2 * (len(word) + 1))


def test_many_languages_in_blocks(spark):
    """More languages than a block holds: predictions as with a single block, scores between 0 and 1."""
    pieces = [x for x in language_id.vocabulary(P.path("piece_bpe_32k.model")) if set(x) <= set("abcdefghij▁")]
    rng = random.Random(2)
    own = {f"l{i:03d}": ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3)] for i in range(300)}
    rows = [(i, " ".join(w * 3), lang) for i, (lang, w) in enumerate(own.items())]
    df = spark.createDataFrame(rows + [(999, "...", "x")], "doc_id bigint, text string, lang string")
    got = []
    for size in (256, 70, 1000):
        model = language_id.learn(df, pieces, block=size)
        assert len(model["langs"]) == 300 and len(model["blocks"]) == -(-300 // size)
        got.append({r["doc_id"]: (r["x"]["lang_pred"], round(r["x"]["score"], 9)) for r in df.select("doc_id", language_id.identify(df, model).alias("x")).collect()})
    assert got[0] == got[1] == got[2] and got[0][999] == ("und", 0.0)
    assert all(0 < s <= 1 for d, (_, s) in got[0].items() if d != 999) and sum(got[0][i][0] == lang for i, _, lang in rows) > 280


# 2

def test_nearest_equals_dense_cosine(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(300):
        at = np.sort(rng.choice(50, rng.integers(1, 6), replace=False))
        w = rng.random(len(at))
        vectors.append((at, w / np.linalg.norm(w)))
    vectors[40] = vectors[7]  # equal examples: the lower one first
    index = toxicity.Index(vectors, 50)
    dense = np.zeros((300, 50))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for at, w in vectors[:60]:
        scores = np.round([sum((dense[i, at] * w).tolist()) for i in range(300)], 12)
        want = sorted(((s, i) for i, s in enumerate(scores.tolist()) if s > 0), key=lambda x: (-x[0], x[1]))[:15]
        got = index.nearest(at, w, 15)
        assert np.allclose([s for s, _ in got], [s for s, _ in want]) and {i for s, i in got if s > got[-1][0] + 1e-9} == {i for s, i in want if s > want[-1][0] + 1e-9}
    assert [i for _, i in index.nearest(*vectors[7], 2)] == [7, 40]


def toxicity_by_hand(docs, sample, labelled, k=15):
    """Scores of all texts from the sample's rows by dense vectors, all pairs, and the max-min form of isotonic regression."""
    bag = {i: Counter(shingles.words_of(t)) for i, t in enumerate(t for _, t in docs)}
    shown = sorted((r for r in sample if r["role"] == "example"), key=lambda r: (r["label"], str(r["id"])))
    examples = [(r["label"], Counter(shingles.words_of(r["text"]))) for r in shown]
    terms = sorted({w for _, c in examples for w in c})
    told = [(r["label"], set(shingles.words_of(r["text"]))) for r in sample]
    n1, n0 = (sum(y == c for y, _ in told) for c in (1, 0))
    value = []
    for w in terms:
        a, b = sum(w in s for y, s in told if y == 1) / n1, sum(w in s for y, s in told if y == 0) / n0
        rel = max(0.02, (abs(a - b) - math.sqrt(a / n1 + b / n0)) / (a + b + 0.01))
        value.append((math.log((1 + len(docs)) / (1 + sum(w in c for c in bag.values()))) + 1) * rel)

    def unit(c):
        v = np.array([(1 + math.log(c[w])) * x if c[w] else 0.0 for w, x in zip(terms, value)])
        return v / (np.linalg.norm(v) or 1)

    units, labels = np.array([unit(c) for _, c in examples]), [y for y, _ in examples]
    stand = {c: labelled[c] / labels.count(c) for c in (0, 1)}

    def raw(c, own=None):
        cos = np.round(units @ unit(c), 9)
        top = [i for i in np.argsort(-cos, kind="stable") if cos[i] > 0 and shown[i]["id"] != own][:k]
        votes = [(stand[labels[i]] / (1.05 - min(1, cos[i])), labels[i]) for i in top]
        return round(float(sum(v * y for v, y in votes) / sum(v for v, _ in votes)), 9) if votes else None

    held = [(r["label"], raw(Counter(shingles.words_of(r["text"])), r["id"])) for r in sample]
    weight = {c: labelled[c] / sum(y == c for y, _ in held) for c in (0, 1)}
    rows = sorted((x, y, weight[y]) for y, x in held if x is not None)
    xs = sorted({x for x, _, _ in rows})
    mean = lambda a, b: sum(y * w for x, y, w in rows if a <= x <= b) / sum(w for x, _, w in rows if a <= x <= b)
    level = {x: max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x) for x in xs}
    none = [(y, weight[y]) for y, x in held if x is None]
    default = sum(y * w for y, w in none) / sum(w for _, w in none) if none else labelled[1] / sum(labelled.values())
    prior = 15 / (15 + min(sum(y == c for y, _ in held) for c in (0, 1)))
    return [default if (x := raw(c)) is None else float((1 - prior) * np.interp(x, xs, [level[v] for v in xs]) + prior * x) for c in bag.values()]


def test_toxicity_equals_brute_force(spark, tmp_path):
    """The whole query, with odd rows among the learned ones too."""
    rng = random.Random(1)
    docs = [(i, " ".join(words(rng, rng.randrange(20, 90)) + rng.choices(["vile", "awful", "mean"], k=4 if i % 4 == 0 else 0))) for i in range(240)]
    docs += [(300, None), (301, ""), (302, "..."), (303, "unseen words only"), (304, docs[0][1]), (305, docs[1][1].upper()), (306, "vile " * 20_000), (None, "vile awful")]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(200)] + [(300, 0, 0), (301, 1, 1), (302, 0, 0), (304, 0, 1), (305, 0, 0), (306, 0, 1), (None, 0, 1), (3, 0, None), (8, 0, 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, str(tmp_path)).collect()}
    df, learned = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet").where(~toxicity.held_out())
    sample, labelled = toxicity.labelled_sample(df, learned, "doc_id", "text", toxicity.MOST_LABELLED, toxicity.MOST_EXAMPLES)
    want = toxicity_by_hand(docs, sample.collect(), labelled)
    assert not [(d, got[d]["score"], s) for (d, _), s in zip(docs, want) if abs(got[d]["score"] - s) > 1e-6]
    assert len({round(s, 6) for s in want}) > 3 and all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (__import__("zlib").crc32(str(d).encode()) % 5 == 0) for d, r in got.items() if d is not None)
    held = [(d, d % 4 == 0) for d in range(240) if got[d]["held_out"] and d != 8]
    assert sum((got[d]["score"] >= 0.5) == y for d, y in held) >= 0.95 * len(held) and len(held) > 30


def test_toxicity_of_small_samples(spark, odd, empty):
    """A sample of a few rows gives scores that vary; nothing to learn from gives 0; a model scores odd texts and clashing columns."""
    docs = spark.createDataFrame([(i, "vile awful text" if i % 2 else f"a calm text of words {i}") for i in range(24)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    got = [r["score"] for r in docs.select("doc_id", toxicity.scored(docs, model)["score"].alias("score")).orderBy("doc_id").collect()]
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in enumerate(got))
    assert all(0 <= r[0] <= 1 for r in odd.select(toxicity.scored(odd, model)["score"]).collect())
    none = toxicity.learn(empty, labels.limit(0))
    assert {r[0] for r in odd.select(toxicity.scored(odd, none)["score"]).collect()} == {0.0}
    learned = toxicity.learn(odd, spark.createDataFrame([(d, i % 2) for i, d in enumerate(range(1, 10))], "doc_id bigint, toxic int"))
    assert all(0 <= r[0] <= 1 for r in odd.select(toxicity.scored(odd, learned)["score"]).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxicity_scores_rise_with_the_vote_on_few_labels(spark, sf):
    """On the given small tables, whose labels are few: scores vary, rise strictly with the raw vote, and keep clean documents."""
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    texts = [r["text"] for r in docs.select("text").collect()]
    pairs = sorted((model.voted(near), model.score(t)[0]) for t in texts if (near := model.near(t)))
    assert len({round(s, 6) for _, s in pairs}) > len(texts) / 10
    assert all(b[1] > a[1] for a, b in zip(pairs, pairs[1:]) if b[0] > a[0] + 1e-6)
    held = {r["doc_id"]: r["toxic"] for r in labels.where(toxicity.held_out()).collect()}
    found = {r["doc_id"]: r["s"] for r in docs.where(toxicity.held_out()).select("doc_id", toxicity.scored(docs, model)["score"].alias("s")).collect()}
    clean = [found[d] >= 0.5 for d, y in held.items() if y == 0 and d in found]
    assert sum(clean) <= 0.02 * len(clean)


def test_toxicity_calibrates_to_the_labelled_shares(spark):
    """Most of the toxic rows become examples, but few of the others: the score still is the share among labelled rows."""
    rng = random.Random(4)
    kinds = [("vile", 1)] * 240 + [("vile", 0)] * 80 + [("calm", 1)] * 160 + [("calm", 0)] * 1120
    rng.shuffle(kinds)
    df = spark.createDataFrame([(i, " ".join([word] + words(rng, 20, 1_000_000))) for i, (word, _) in enumerate(kinds)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, toxic) for i, (_, toxic) in enumerate(kinds)], "doc_id bigint, toxic int")
    model = toxicity.learn(df, labels, most_examples=400)
    got = Counter()
    for r in df.select("doc_id", toxicity.scored(df, model)["score"].alias("s")).collect():
        got[kinds[r["doc_id"]][0]] += r["s"]
    assert abs(got["vile"] / 320 - 0.75) < 0.15 and abs(got["calm"] / 1280 - 0.125) < 0.06


# 6

def by_hand(docs):
    hashes, rep, parent = shingles.WordHashes(), {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, t in sorted(docs):
        parent[d] = rep.setdefault(near_dedup.text_key(t), d)
    sets = {d: Counter(shingles.shingle_hashes(hashes.of(t), 5).tolist()) for d, t in docs if parent[d] == d}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near_dedup.similarity(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in docs}


def test_near_dedup_equals_brute_force_in_a_wide_group(spark):
    """Copies of one text with few to many edits: some are near the text, some only near other copies, some near nothing."""
    rng = random.Random(7)
    base = words(rng, 120, 10_000)
    docs = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"edit{i}{rng.random()}"
        docs.append((i, " ".join(w)))
    chain = list(base[:60])
    for i in range(120, 150):
        chain = chain[1:] + [f"c{i}"]
        docs.append((i, " ".join(chain)))
    docs += [(200 + i, " ".join(words(rng, 80, 10_000))) for i in range(30)] + [(300, docs[5][1].upper()), (301, docs[125][1])]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    want = by_hand(docs)
    # pairs at the very threshold may share no bucket (probability below 0.002 each)
    assert sum(got[d] != want[d] for d in want) <= 1
    every = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id bigint, text string"), least_agreement=None).collect()}
    assert sum(every[d] != want[d] for d in want) <= 1


def test_near_dedup_links_pairs_away_from_leaders(spark):
    """Families of two near texts within twenty longer ones that are near neither: the longer ones lead the buckets, so only the second round meets the pair."""
    docs, families = [], 150
    for family in range(families):
        rng = random.Random(family)
        core = words(rng, 179, 1_000_000)
        texts = [core[:162], core[17:]]  # 158 and 158 shingles, 141 of them shared: similarity 0.806
        for _ in range(20):
            at = rng.randrange(31)
            texts.append(words(rng, at, 1_000_000) + core + words(rng, 30 - at, 1_000_000))
        docs += [(100 * family + i, " ".join(x)) for i, x in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert all(got[100 * f + 2 + i] != got[100 * f + j] for f in range(families) for i in range(20) for j in (0, 1))
    # bands and agreement miss 0.002 of such pairs
    assert sum(got[100 * f] != got[100 * f + 1] for f in range(families)) <= 1


def test_near_dedup_of_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.classes(odd).drop("mark").collect())
    assert got == Counter([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (5, 4), (None, None), (None, None), (6, 6), (7, 7), (8, 8), (9, 9)])
    assert near_dedup.classes(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 62, 40).astype(np.uint64)])
    one = np.ones(400)
    s = near_dedup.signatures([(a, one), (b, one), (a, one), (a[:1], one[:1])], 1024)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 360 / 440) < 0.06 and (s[3] == a[0]).all()


def test_bit_maps_bound_the_similarity(spark):
    """No pair fails the bound at its own similarity; dissimilar pairs do at 0.8."""
    rng = random.Random(6)
    rows, sims = [], []
    for i in range(200):
        a = words(rng, rng.randrange(5, 300), 50 if i % 5 == 0 else 5000)
        b = [w if rng.random() > i % 10 / 40 else f"x{rng.random()}" for w in a] + a[: rng.randrange(3)]
        x, y = (shingles.shingle_hashes(shingles.WordHashes().of(" ".join(t)), 5) for t in (a, b))
        sims.append(near_dedup.similarity(Counter(x.tolist()), Counter(y.tolist())))
        rows.append((i, [0] * 16 + near_dedup.bit_map(x).tolist(), [0] * 16 + near_dedup.bit_map(y).tolist(), len(x), len(y), sims[-1] * (1 - 1e-12)))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>, m bigint, n bigint, sim double")
    assert df.where(near_dedup.may_reach("sim", "a", "b", "m", "n")).count() == 200
    far = {i for i, s in enumerate(sims) if s < 0.6}
    assert len(far & {r["i"] for r in df.where(near_dedup.may_reach(0.8, "a", "b", "m", "n")).collect()}) < len(far) / 10 and len(far) > 50


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


# 9

def test_decontamination_equals_all_windows(spark, odd, empty):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n, 2000))) for i, n in enumerate((20, 33, 50, 3, 20))] + [(9, None), (10, "..."), (11, None)]
    items.append((12, items[0][1].upper()))
    docs = list(ODD) + [(None, items[0][1])]
    for i in range(40):
        w = words(rng, 150, 2000)
        part = items[i % 5][1].split()
        for _ in range(i // 10):
            part[rng.randrange(len(part))] = f"edit{rng.random()}"
        at = rng.randrange(150)
        docs.append((100 + i, " ".join(w[:at] + (part if i % 4 else []) + w[at:])))
    docs.append((999, items[1][1][: len(items[1][1]) // 2]))
    docs.append((998, " ".join(words(rng, 3000, 2000)) + " " + items[2][1] + " " + " ".join(words(rng, 3000, 2000))))
    df, known = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want, hashes = {}, shingles.WordHashes()
    for d, t in docs:
        dw = hashes.of(t)
        for i, x in items:
            iw = hashes.of(x)
            if not len(iw) or not len(dw):
                continue
            k = min(5, len(iw))
            if len(dw) < k:
                continue
            a, b = Counter(shingles.shingle_hashes(iw, k).tolist()), shingles.shingle_hashes(dw, k).tolist()
            width = min(a.total(), len(b))
            best = max(near_dedup.similarity(a, Counter(b[s : s + width])) for s in range(len(b) - width + 1))
            if best >= 0.8:
                want[(d, i)] = round(best, 9)
    for size in (2_000_000, 30):
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.matches(df, known, part_words=size).collect()}
        assert got == want and len(want) >= 10
    # the byte tables give what a look at every fingerprint gives
    index = decontamination.Items(items)
    for i in range(200):
        mark = rng.getrandbits(64) if i % 2 else int(index.marks[i % len(index.marks)]) ^ sum(1 << b for b in rng.sample(range(64), i % 30))
        assert index.within(mark) == [at for at, m in enumerate(index.marks.tolist()) if (m ^ mark).bit_count() <= decontamination.RADIUS]
    flags = {r["doc_id"]: r["x"] for r in df.select("doc_id", decontamination.contaminated(known, F.col("text")).alias("x")).collect()}
    assert all(flags[d] == any(k[0] == d for k in want) for d in flags)
    assert decontamination.matches(empty, known).count() == 0 and decontamination.matches(odd, known.limit(0)).count() == 0


# 10

def test_chat_rotation(spark, odd):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob b", "yo <|im_end|>"), (1, 2, "ann", None), (1, None, "", "lost"), (None, 1, "ann", "x"), (2, 1, "system", "alone"), (1, 2, "ann", None), (1, 3, "bob_b", "y" * 300_000), (1, 4, "\u592a\u90ce", "z"), (1, 5, "\u82b1\u5b50\n<|im_end|>", "z")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("z") for c in ("speaker", "said", "tie", "block", "people", "of")})
    got = chat.rotated(df).collect()
    people = ("ann", "bob b", "unknown", "bob_b", "\u592a\u90ce", "\u82b1\u5b50\n<|im_end|>")
    assert Counter(r["conv_id"] for r in got) == {1: 9 * len(people), None: 1}
    for who in people:
        own = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == who), key=lambda r: r["start"])
        whole = "".join(r["rendered"] for r in own)
        assert all(whole[r["start"] : r["end"]] == r["rendered"] for r in own)
        assert all((r["speaker"] == who) == r["learned"] and (r["learned"] == (r["learn_start"] is not None)) for r in own)
        assert all(whole[r["learn_start"] : r["learn_end"]].endswith("<|im_end|>") for r in own if r["learned"])
        assert whole.count("<|im_end|>") == len(own) and [r["turn"] for r in own] == [None, 0, 1, 2, 2, 2, 3, 4, 5]
        # distinct speakers keep distinct names, of one line each
        names = {r["speaker"]: r["rendered"].split("\n")[0] for r in own if not r["learned"]}
        assert len(set(names.values())) == len(names) and (who == people[4] or f"<|im_start|>user name={people[4]}" in names.values())
    assert chat.rotated(df.limit(0)).count() == 0


def test_chat_places_of_turns_without_numbers(spark):
    """One dialogue of many turns with one number, none, and repeats: places follow each other without gaps."""
    turns = [(5, None, "ab"[i % 2], f"text {i % 50}") for i in range(3000)] + [(5, 7, "a", "same")] * 2000
    got = chat.rotated(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).where("perspective = 'a'").select("turn", "start", "end").collect()
    spans = sorted((r["start"], r["end"], r["turn"]) for r in got)
    assert len(spans) == 5000 and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [t for _, _, t in spans] == [None] * 3000 + [7] * 2000


def test_chat_rows_without_a_dialogue_never_meet(spark, tmp_path):
    """4,000 rows without an id, of 500 speakers, give a row each; the SQL says the same."""
    turns = [(None, i % 3, f"s{i % 500}" if i % 100 else "system", f"text {i}") for i in range(4000)] + [(1, 0, "ann", "hi"), (1, 1, "bob", None)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op10_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(chat.OP10_SQL)
    at = [want.columns.index(c) for c in got.columns]
    found = Counter(tuple(r) for r in got.collect())
    assert found == Counter(tuple(r[i] for i in at) for r in want.fetchall()) and sum(found.values()) == 3960 + 4
    assert all(r[3] == r[1] and r[5] and r[6] == 0 for r in found if r[0] is None)


# 8

def test_licenses(spark, odd, empty):
    mit = next(t for i, t in licenses.KNOWN if len(t) > 500 and i == "MIT")
    docs = [(1, "Copyright (c) 2020 Me\n" + mit.upper().replace(",", " ")), (2, "text\nreleased under the MIT  Licence!\nmore"), (3, "Released under the MIT License, maybe"), (2, "Released under the MIT License."), (4, "Licensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["license_id"]): (r["n_lines"], r["whole"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(1, "MIT"): (0, True), (2, "MIT"): (2, True), (4, "CC-BY-NC-4.0"): (1, True)}
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    web = mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS\u00a0IS\u201d").replace(" ", "\u2009", 3)
    more = spark.createDataFrame([(7, web), (8, "\u2014 Released under the MIT\u00a0License. \u2014\n" + "long line " * 50_000)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["license_id"], r["n_lines"], r["whole"]) for r in licenses.scan(more).collect()} == {(7, "MIT", 0, True), (8, "MIT", 1, False)}
    # a known text without any anchor is found as well
    plain = licenses.scan(spark.createDataFrame([(1, "Do what\nyou, WANT."), (2, "x\nyou want")], "doc_id bigint, text string"), [("X", "Do what you want"), ("Y", "you want")])
    assert {(r["doc_id"], r["license_id"], r["n_lines"], r["whole"]) for r in plain.collect()} == {(1, "X", 0, True), (1, "Y", 1, False), (2, "Y", 1, False)}


def test_whole_licenses_in_sql(spark, tmp_path):
    """The query and its SQL on documents that are whole licences, in three forms, and on parts of them."""
    docs = []
    for i, (_, text) in enumerate(licenses.whole_texts()):
        docs += [(10 * i, text), (10 * i + 1, "Copyright 2020 Me\n" + text.upper()), (10 * i + 2, text + " more"), (10 * i + 3, text[: len(text) // 3])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(licenses.OP8_SQL)
    got = licenses.op8_licenses(spark, str(tmp_path))
    at = [want.columns.index(c) for c in got.columns]
    found = Counter(tuple(r) for r in got.collect())
    assert found == Counter(tuple(r[i] for i in at) for r in want.fetchall()) and sum(found.values()) > len(docs) / 3


def test_whole_licenses(spark):
    """Licences longer than any of KNOWN, as they stand, in upper case with a copyright line, and with a line for each paragraph."""
    docs, want = [], {}
    for i, path in enumerate(sorted(licenses.TEXTS.glob("*.txt"))):
        text = path.read_text(encoding="utf-8")
        flowing = "\n\n".join(" ".join(x.split()) for x in text.replace("\f", "").split("\n\n"))
        for j, form in enumerate((text, "Copyright (c) 2020 Me\n\n" + text.upper(), flowing, text.partition("END OF TERMS AND CONDITIONS")[0], text[: len(text) // 2], text + "and more")):
            docs.append((10 * i + j, form))
            if j < 4:
                want[(10 * i + j, path.stem.split("__")[0])] = (0, True)
    got = {(r["doc_id"], r["license_id"]): (r["n_lines"], r["whole"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want and {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {k for _, k in want}


# 1

def test_store_keeps_rows_and_commits_once(spark, odd, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    for _ in range(3):
        store.append(odd.repartition(4), shard_rows=2)
    before = store.manifest().count()
    assert store.versions() == [1, 2, 3] and store.manifest().agg(F.sum("rows")).first()[0] == 3 * len(ODD)
    version = store.compact(odd.schema, least_bytes=1 << 20)
    assert version == 4 and store.manifest().count() < before / 4 and store.compact(odd.schema) is None
    want = Counter((d, t) for d, t in ODD * 3)
    assert Counter((r["doc_id"], r["text"]) for r in store.read(odd.schema).collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in store.read(odd.schema, 2).collect()) == Counter((d, t) for d, t in ODD * 2)
    with pytest.raises(Exception):
        store.commit(store.manifest(), 3)  # version 4 exists
    assert store.vacuum(keep=1) == 0 and len(store.versions()) == 4  # all is young
    assert store.vacuum(keep=1, grace_s=0) >= before and store.versions() == [4]
    assert Counter((r["doc_id"], r["text"]) for r in store.read(odd.schema).collect()) == want


def test_store_loses_nothing_to_vacuum_or_other_writers(spark, odd, tmp_path):
    """A run that is written and not yet committed survives a vacuum; a failed commit leaves no trace; a writer that loses commits on top of the winner."""
    store, rows = sharding.Store(spark, f"file://{tmp_path}/v"), Counter(ODD)
    store.append(odd)
    odd.write.parquet(f"{store.root}/runs/late")
    listed = store._listed("late", odd.schema)
    assert store.vacuum() == 0
    other = sharding.Store(spark, store.root)
    base, first = store.versions()[-1], [True]
    seen = store.versions
    # the late writer looks up the last version, then another one commits
    store.versions = lambda: seen() if not first or not first.pop() else (other.append(odd), [base])[1]
    assert store.add(listed) == base + 2
    store.versions = seen
    assert Counter((r["doc_id"], r["text"]) for r in store.read(odd.schema).collect()) == Counter({k: 3 * n for k, n in rows.items()})
    left = [x for x in (tmp_path / "v/manifest").iterdir() if x.name.startswith("_")]
    assert len(left) == 1 and store.vacuum(grace_s=0) >= 0
    assert not [x for x in (tmp_path / "v/manifest").iterdir() if x.name.startswith("_")]
    assert store.read(odd.schema).count() == 3 * len(ODD)


def test_a_compaction_that_comes_second_is_planned_again(spark, odd, tmp_path):
    """While shards are merged another writer appends, then another one compacts: nothing is lost and nothing stands twice."""
    store, rows = sharding.Store(spark, f"file://{tmp_path}/r"), Counter(ODD)
    for _ in range(5):
        store.append(odd)
    other, write, turns = sharding.Store(spark, store.root), store._write_each, ["append", "compact"]

    def meanwhile(bins, path):
        write(bins, path)
        if turns:
            other.append(odd) if turns.pop(0) == "append" else other.compact(odd.schema)

    store._write_each = meanwhile
    before = len(store.versions())
    assert store.compact(odd.schema) == before + 2
    assert Counter((r["doc_id"], r["text"]) for r in store.read(odd.schema).collect()) == Counter({k: 6 * n for k, n in rows.items()})
    for _ in range(4):
        store.append(odd)
    store.compact(odd.schema)
    assert not turns and Counter((r["doc_id"], r["text"]) for r in store.read(odd.schema).collect()) == Counter({k: 10 * n for k, n in rows.items()})


def test_shards_of_a_tier_are_packed_in_groups(spark, odd, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/g")
    store.append(odd.repartition(12), shard_rows=1)
    n = store.manifest().where("rows > 0").count()
    assert store.compact(odd.schema, group_shards=4) == 2 and 1 < store.manifest().where("rows > 0").count() < n
    assert Counter((r["doc_id"], r["text"]) for r in store.read(odd.schema).collect()) == Counter(ODD)


def test_empty_store(spark, empty, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/e")
    assert store.compact(empty.schema) is None and store.read(empty.schema).count() == 0
    store.append(empty)
    assert store.read(empty.schema).count() == 0


# all in a row

def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    bench = [(i, " ".join(words(rng, 30, 5000))) for i in range(3)]
    docs = []
    for i in range(120):
        w = words(rng, 120, 5000)
        if i % 6 == 0:
            w += ["vile", "awful", "vile"]
        if i % 10 == 3:
            w += bench[i % 3][1].split()
        docs.append((i, " ".join(w[:60]) + ("\nThis footer stands in many documents" if i % 4 == 1 else "") + "\n" + " ".join(w[60:])))
    docs += [(200 + i, docs[2 * i + 1][1].replace("w1 ", "w2 ")) for i in range(5)] + [(300, None), (301, "")]
    # a second text of an id stays, although the first one goes as a near copy
    twice = (200, " ".join(words(rng, 100, 5000)))
    for name, rows, ddl in (
        ("documents", [(d, t, "en", "s", len(t or "")) for d, t in [*docs, twice]], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("benchmark", bench, "item_id bigint, text string"),
        ("labels", [(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    second = [r for r in out if r["doc_id"] == 200]
    assert [r["decoded_sha256"] for r in second] == [hashlib.sha256(twice[1].encode()).hexdigest()]
    got = {r["doc_id"]: r for r in out if r["doc_id"] != 200}

    left = [(d, t) for d, t in docs if d >= 120 or d % 6]
    left = [(d, text) for (d, _, _, text), n in dedup_by_hand(left).items() for _ in range(n)]
    cls = by_hand(left)
    left = [(d, t) for d, t in left if cls[d] == d]
    items = decontamination.Items(bench)
    hashes = shingles.WordHashes()
    left = [(d, t) for d, t in left if not items.search(hashes.of(t))]
    assert set(got) == {d for d, _ in left}
    assert all(got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in left)


def test_pipeline_stages_bound_what_workers_hold(spark, tmp_path, monkeypatch):
    """After any stage has been made, texts reach Python in batches of few rows and bytes, and blocks of pre-tokens are short."""
    schemas = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, ddl in schemas.items():
        spark.createDataFrame([(i, f"document {i}", None, "s", 1) for i in range(5)] if name == "documents" else [], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    many = spark.range(0, 3000, 1, 1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    def largest(text):
        return many.withColumn("text", text).mapInArrow(sizes, "rows bigint, bytes bigint").agg(F.max("rows"), F.max("bytes"), F.sum("rows")).first()

    blocks, encode = [], corpus_pipeline.bpe.encode_decode
    monkeypatch.setattr(corpus_pipeline.bpe, "encode_decode", lambda *a, **b: blocks.append(b.get("block_chars", corpus_pipeline.bpe.BLOCK_CHARS)) or encode(*a, **b))
    for _, stage in corpus_pipeline.STAGES:
        for name in corpus_pipeline.BATCH:
            spark.conf.unset(name)
        stage(spark, docs, str(tmp_path))
        short, long = largest(F.lit("x")), largest(F.repeat(F.lit("x"), 20_000))
        assert short[0] <= 1000 and short[2] == 3000
        assert long[1] <= 5 << 20 and long[2] == 3000
    assert blocks == [corpus_pipeline.BLOCK_CHARS] and blocks[0] <= 8_000_000


def test_pipeline_of_empty_tables(spark, tmp_path):
    """No documents give no rows; without labels and benchmark items every document stays but near copies."""
    schemas = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, ddl in schemas.items():
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/none/{name}.parquet")
        rows = [(i, f"document {i} " + " ".join(words(random.Random(i), 60)), None, "s", 1) for i in range(6)] + [(9, None, None, None, None)] if name == "documents" else []
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/some/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/some").select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 9]
