"""The prefix trie against SQL and a plain trie, with splitters that cut shared prefixes, hot paths and odd rows."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from scanloom.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(convs):
    """convs: conv_id -> [(digest, size)]. All nodes by their prefix."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(x for x, _ in turns[:d]), []).append(c)
    size = {tuple(x for x, _ in t[:d]): t[d - 1][1] for t in convs.values() for d in range(1, len(t) + 1)}
    out = Counter()
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(k)))
        out[
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(y) == len(k) + 1 and y[: len(k)] == k for y in nodes),
            sum(map(leaf, under)), sum((len(nodes[x]) - 1) * size.get(x, 0) for x in under), hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


def digest(x):
    return hashlib.md5(str(x).encode()).hexdigest()


@pytest.mark.parametrize("shards", [1, 4, 13])
def test_trie_equals_a_plain_trie(spark, shards, monkeypatch):
    rng = random.Random(shards)
    convs = {c: [(digest(x), x) for x in (rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(7)))] for c in rng.sample(range(-50, 5000), 150)}
    hot = [(digest(x), x) for x in (1, 1, 2, 1, 3)]
    convs |= {c: hot for c in range(6000, 6100)}
    convs |= {c: [(digest(1), 1)] * 40 + [(digest(c), c)] for c in range(7000, 7010)}
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "SAMPLED", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        df = spark.createDataFrame([(c, [d for d, _ in t], [z for _, z in t]) for c, t in convs.items()], "conv_id bigint, digests array<string>, sizes array<bigint>")
        got = prefix_trie.trie(df)
        assert got.columns == COLUMNS
        assert Counter(tuple(r) for r in got.collect()) == by_hand(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_splitters_are_cut_where_they_differ():
    a, b, c = (digest(x) for x in "abc")
    a, b, c = sorted((a, b, c))
    sample = [a + a, a + b + a + a, a + b + b + c, a + b + b + c, c + a + b]
    cuts = prefix_trie.splitters(sample, 5)
    assert cuts == [a, a + b, a + b + b, c][: len(cuts)] and cuts == sorted(set(cuts))
    nodes = prefix_trie.skeleton_of(cuts)
    assert nodes[0][0] is None and all(parent is not None and parent < i for i, (parent, _) in enumerate(nodes) if i)


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", None, ""]), rng.choice(["a", "ü", None, "", "long " * 5000])) for c in range(60) for _ in range(rng.randrange(14)) if c % 7 != 5]
    rows += [(None, 1, "user", "no id"), (None, None, None, None), (3, 1, "user", "a"), (3, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("x") for c in ("path", "sizes", "shard", "skeleton", "of", "h")})
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(prefix_trie.OP13_SQL)
    at = [want.columns.index(c) for c in COLUMNS]
    found = Counter(tuple(r) for r in got.collect())
    assert found == Counter(tuple(r[i] for i in at) for r in want.fetchall()) and len(found) > 100
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(df.limit(0)))).count() == 0
