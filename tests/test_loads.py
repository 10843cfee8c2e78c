"""Resumable loads, passes driven by time, stable places of lines."""

import datetime as dt

from pyspark.sql import functions as F

from scanloom.operators.state import Versioned
from scanloom.sources import scans as src
from scanloom.streaming import loads
from scanloom.streaming import scans as st

NOW = dt.datetime(2024, 2, 1)


def ledger_of(table):
    return {r["source"]: tuple(r)[1:] for r in table.read().collect()}


def test_a_load_goes_on_where_it_broke_off(spark, tmp_path):
    ddl = loads.PAGE + ", records array<struct<k:bigint,v:string,at:bigint>>"
    page = lambda i, size=2, total=7, v="a": ("s", i, min(size, total - i), total, [(k, v, 1) for k in range(i, min(i + size, total))])
    table, ledger = Versioned(spark, str(tmp_path / "table"), "k bigint, v string, at bigint"), Versioned(spark, str(tmp_path / "ledger"), loads.LEDGER)
    sources = spark.createDataFrame([("s",), ("other",)], "source string")
    begin = lambda now: ledger.write(spark.createDataFrame(loads.begun(sources, ledger.read(), F.lit(now)).collect(), loads.LEDGER))

    def land(*pages):
        spark.createDataFrame(pages, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        loads.load_stream(stream, table, ["k"], "at", ledger, str(tmp_path / "cp")).awaitTermination()

    begin(NOW)
    # the page from 4 on has not come, so that the one from 6 on does not count
    land(page(2), page(0), page(0), page(6))
    assert ledger_of(ledger)["s"] == (None, True, None, NOW - dt.timedelta(hours=4), 4)
    assert sorted(r["k"] for r in table.read().collect()) == [0, 1, 2, 3]
    begin(NOW + dt.timedelta(days=1))
    assert ledger_of(ledger)["s"][4] == 4
    land(page(4), page(6))
    stamp = NOW + dt.timedelta(hours=20)
    assert ledger_of(ledger)["s"] == (stamp, None, None, None, None) and ledger_of(ledger)["other"][4] == 0
    assert sorted(r["k"] for r in table.read().collect()) == list(range(7))
    # the next load is the window since the stamp; a repeated batch changes nothing
    begin(NOW + dt.timedelta(days=3))
    assert ledger_of(ledger)["s"] == (stamp, False, stamp, NOW + dt.timedelta(hours=68), 0)
    land(page(0, 2, 3, "b"))
    begin(NOW + dt.timedelta(days=4))
    assert ledger_of(ledger)["s"][0] == stamp and ledger_of(ledger)["s"][4] == 0
    land(page(0, 2, 3, "c"), page(2, 2, 3, "c"))
    before = sorted(map(tuple, table.read().collect()))
    assert [v for k, v, _ in before] == ["c"] * 3 + ["a"] * 4 and ledger_of(ledger)["s"][0] == NOW + dt.timedelta(hours=92)
    last = max((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda x: int(x.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()
    versions = (table.version(), ledger.version())
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    loads.load_stream(stream, table, ["k"], "at", ledger, str(tmp_path / "cp")).awaitTermination()
    assert (table.version(), ledger.version()) == versions


def test_passes_over_31_days_with_a_timeout(spark, tmp_path):
    ddl = "path string, mtime double, size bigint, inode bigint"
    listing = ddl + ", listed_at timestamp"
    manifest, feed = Versioned(spark, str(tmp_path / "manifest"), ddl), Versioned(spark, str(tmp_path / "feed"), st.FEED)
    seen = []

    def day(n, files, timeout=False):
        spark.createDataFrame([(p, m, 1, 1, NOW + dt.timedelta(days=n)) for p, m in files.items()], listing).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(listing).parquet(str(tmp_path / "in"))

        def sink(changed, epoch, full):
            seen.append((n, full, sorted(r["path"] for r in changed.select("path").collect())))
            return timeout

        st.timed_change_feed(stream, manifest, feed, str(tmp_path / "cp"), sink).awaitTermination()

    day(0, {"a": 1.0, "b": 1.0}, timeout=True)
    day(1, {"a": 1.0, "b": 1.0})
    day(2, {"a": 2.0, "b": 1.0, "c": 1.0}, timeout=True)
    day(3, {"a": 2.0, "b": 1.0, "c": 1.0})
    day(4, {"a": 2.0, "b": 1.0, "c": 1.0})
    day(30, {"a": 2.0})
    day(31, {"a": 2.0, "b": 1.0, "c": 1.0})
    # a full pass that timed out stays due; an incremental one that did leaves its files changed
    assert seen == [(0, True, ["a", "b"]), (1, True, ["a", "b"]), (2, False, ["a", "c"]), (3, False, ["a", "c"]), (4, False, []), (30, False, []), (31, True, ["a", "b", "c"])]
    assert tuple(feed.read().first()) == (NOW + dt.timedelta(days=31), NOW + dt.timedelta(days=31), True, False)


def test_places_of_lines_do_not_depend_on_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 700), ("b.jsonl", 3)):
        lines = [f'{{"template-id": "t{i}", "host": "h", "info": {{"name": "n{i}", "severity": "low"}}}}' if i % 5 else ("" if i % 2 else "{broken") for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "1k" else "4m")
            hits = src.web_hits(spark, str(tmp_path))
            got.append(sorted((r["file"][-7:], r["pos"], r["template_id"]) for r in hits.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got[0] == got[1] == sorted((f"{x}.jsonl", i, f"t{i}") for x, n in (("a", 700), ("b", 3)) for i in range(n) if i % 5)
