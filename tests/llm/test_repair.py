"""Conversation repair against all edit sequences, in segments and whole, and on odd rows."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scanloom.llm import repair


def every_way(rows, start, ends):
    """All edits of the rows, with up to three insertions in each gap, by plain enumeration: the least (cost, audit)."""
    ways = {(0, "", start)}

    def inserted(found):
        out = set(found)
        for _ in range(3):
            out |= {(c + 2, a + "I", repair.NEXT[s][x]) for c, a, s in out for x in repair.NEXT[s] if x in "ua"}
        return out

    for initial, gone, cut in rows:
        new = set()
        for c, a, s in inserted(ways):
            new.add((c + 3, a + "D", s))
            if not gone:
                for x, to in repair.NEXT[s].items():
                    if x == initial:
                        new.add((c + cut, a + "K", to))
                    if x in "ua":
                        new.add((c + 2 + cut, a + "R", to))
        ways = new
    found = [(c, a) for c, a, s in inserted(ways) if s in ends]
    return min(found) if found else None


def test_both_searches_meet_at_the_cheapest_edits():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suua -"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        for start, ends in itertools.product(range(4), ((0, 3), (2,), (1,))):
            assert repair.cheapest(rows, start, ends) == every_way(rows, start, ends), (rows, start, ends)


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "user", None, "", "tool"]), rng.choice(["A b.", "c", " ", None, "Yes!", "\n. \n", "Long " * 300])) for c in range(40) for _ in range(rng.randrange(9))]
    rows += [(None, i, "user" if i % 3 else "assistant", f"Turn {i}.") for i in range(30)]
    return rows


@pytest.mark.parametrize("segment", [256, 2, 5])
def test_segments_give_the_same_repair(spark, many, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    reports, out = repair.repaired(turns_of(spark, many))
    got = {r["conv_id"]: r for r in reports.collect()}
    lines = {}
    for r in out.orderBy("conv_id", "seg", "nr").collect():
        lines.setdefault(r["conv_id"], []).append(r)
    rows = {}
    for r in repair.checked(turns_of(spark, many)).orderBy("place").collect():
        rows.setdefault(r["conv_id"], []).append(r)
    assert got.keys() == rows.keys() and len(got) > 30
    for conv, parts in rows.items():
        cost, audit = repair.cheapest([(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in parts], 0, (0, 3))
        assert (got[conv]["cost"], got[conv]["audit"]) == (cost, audit)
        assert got[conv]["illegal"] == sum((a["initial"] + b["initial"]) not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
        kept = lines.get(conv, [])
        assert "".join(r["edit"] for r in kept) == audit.replace("D", "")
        said = "".join(r["role"][0] for r in kept)
        assert not said or (said.removeprefix("s") and said.removeprefix("s") == "ua" * (len(said.removeprefix("s")) // 2))


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be kind."), (1, 1, "assistant", "x" * 100_000), (2, 5, None, None), (3, 1, "assistant", "No!"), (3, 9, "assistant", "No!"), (4, None, "user", "Only?")]
    df = turns_of(spark, rows).withColumns({c: F.lit("x") for c in ("place", "seg", "of", "digest", "fault", "_one")})
    reports, out = repair.repaired(df)
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) for r in reports.collect()}
    assert got == {1: (0, 0, 1, 1, 1, 4, "KKDK"), 2: (0, 1, 0, 0, 0, 3, "D"), 3: (7, 0, 1, 0, 1, 5, "IKD"), 4: (0, 0, 0, 0, 0, 2, "KI")}
    texts = {(r["conv_id"], r["nr"]): (r["turn"], r["role"], r["text"], r["edit"]) for r in out.collect()}
    assert texts[3, 0] == (None, "user", "", "I") and texts[1, 0][1] == "system" and len(texts[1, 2][2]) == 100_000 and (2, 0) not in texts
    empty_reports, empty_out = repair.repaired(df.limit(0))
    assert empty_reports.count() == 0 and empty_out.count() == 0


def test_repair_query_equals_sql_on_odd_rows(spark, many, tmp_path):
    turns_of(spark, many + [(77, 3, "user", "again."), (77, 3, "user", "again.")]).write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op11_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(repair.OP11_SQL)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))
