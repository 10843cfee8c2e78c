"""Repair of conversation structure: the cheapest edits that make a conversation an optional system turn and then user and assistant in turn.

A conversation's edit lattice has a node for each number of rows read and each state of the grammar `(s?(ua)+)?`; its edges keep,
rerole or delete a row, or insert an empty turn. Bidirectional Dijkstra searches it: a heap from the start and one from the accepting
states meet, go on until no crossing of equal cost is left, and of all cheapest ways the one with the least concatenated audit is taken.

No task holds a whole large conversation. Rows get their place by running sums over range partitions and are cut into segments of
SEGMENT rows. A segment is searched for each pair of states at its ends (one pair where it is the whole conversation); a conversation's
segments are then chained in order, by audits and not texts. Chaining keeps the least audit: of two cheapest ways over the same rows into the
same state neither audit begins the other, as the longer one would hold more insertions and cost more.

Rows are ordered by turn (null first), role and a digest of the text; repeated rows stay and count as duplicates. A null role or text is
one space, which makes a blank row or a role that can only be changed. Rows without an id are one conversation with a null id. A text of any
length stays whole. An empty table has no conversations. Columns beside the four are left out, clashing names among them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from scanloom.operators.shared import with_running_sum

from .common import table, written

#: States of the grammar: nothing yet, after the system turn, after a user, after an assistant.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
BACK = {t: [(s, x) for s, out in NEXT.items() for x, to in out.items() if to == t] for t in range(4)}
ACCEPTS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
SEGMENT = 256
WHITE = " \t\n\x0b\x0c\r"
LONG, TEXT = pa.int64(), pa.string()
WAY = pa.struct({"enters": LONG, "leaves": LONG, "cost": LONG, "audit": TEXT})
SOLVED = pa.schema({"conv_id": LONG, "seg": LONG, "first": TEXT, "last": TEXT, "illegal": LONG, "ways": pa.list_(WAY)})
CHOSEN = pa.schema({"conv_id": LONG, "seg": LONG, "enters": LONG, "audit": TEXT, "cost": LONG, "illegal": LONG})
REPAIRED = pa.schema({"conv_id": LONG, "seg": LONG, "nr": LONG, "turn": LONG, "role": TEXT, "text": TEXT, "edit": TEXT})
DIGESTS = pa.schema({"conv_id": LONG, "repaired_sha256": TEXT})


# the lattice: a row is (role's initial, must it go, is it truncated)

Row = tuple[str, bool, bool]
Node = tuple[int, int]


def ahead_of(rows: list[Row], node: Node) -> Iterator[tuple[int, str, Node]]:
    """cost, audit letter and target of the edges that leave a node."""
    i, state = node
    for to in (NEXT[state][x] for x in NEXT[state] if x in NAMES):
        yield INSERT, "I", (i, to)
    if i < len(rows):
        initial, gone, cut = rows[i]
        yield DELETE, "D", (i + 1, state)
        if not gone:
            for x, to in NEXT[state].items():
                if x == initial:
                    yield KEEP + TRUNCATED * cut, "K", (i + 1, to)
                elif x in NAMES:
                    yield REROLE + TRUNCATED * cut, "R", (i + 1, to)


def behind(rows: list[Row], node: Node) -> Iterator[tuple[int, str, Node]]:
    """cost, audit letter and origin of the edges that reach a node."""
    i, state = node
    for origin, x in BACK[state]:
        if x in NAMES:
            yield INSERT, "I", (i, origin)
    if i:
        initial, gone, cut = rows[i - 1]
        yield DELETE, "D", (i - 1, state)
        if not gone:
            for origin, x in BACK[state]:
                if x == initial:
                    yield KEEP + TRUNCATED * cut, "K", (i - 1, origin)
                elif x in NAMES:
                    yield REROLE + TRUNCATED * cut, "R", (i - 1, origin)


def cheapest(rows: list[Row], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost from a state before the rows to one of the states after them, and its least audit; None if there is no way.

    Edges without cost lead to the next row, so nodes of equal cost are taken in the order of rows, backward ones in reverse: a node's audit is
    final when it is taken.
    """
    sources = ({(0, start)}, {(len(rows), t) for t in ends})
    labels: tuple[dict[Node, tuple[int, str]], ...] = tuple({x: (0, "") for x in s} for s in sources)
    heaps = [[(0, x[0] if side == 0 else -x[0], x[1]) for x in s] for side, s in enumerate(sources)]
    done: tuple[set[Node], set[Node]] = (set(), set())
    least = 0 if sources[0] & sources[1] else float("inf")
    while any(heaps) and sum(h[0][0] if h else 0 for h in heaps) <= least:
        side = 0 if heaps[0] and (not heaps[1] or heaps[0][0][0] <= heaps[1][0][0]) else 1
        cost, i, state = heapq.heappop(heaps[side])
        node = (abs(i), state)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = labels[side][node][1]
        for step, letter, to in (ahead_of if side == 0 else behind)(rows, node):
            label = (cost + step, audit + letter if side == 0 else letter + audit)
            known = labels[side].get(to)
            if known is None or label < known:
                labels[side][to] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(heaps[side], (label[0], to[0] if side == 0 else -to[0], to[1]))
            if to in labels[1 - side]:
                least = min(least, label[0] + labels[1 - side][to][0])
    if least == float("inf"):
        return None
    ahead, after = labels
    met = done[1] | sources[1]
    audits = [ahead[x][1] + after[x][1] for x in done[0] & met if ahead[x][0] + after[x][0] == least]
    for x in done[0]:
        for step, letter, to in ahead_of(rows, x):
            if to in met and ahead[x][0] + step + after[to][0] == least:
                audits.append(ahead[x][1] + letter + after[to][1])
    return int(least), min(audits)


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _solve(group: pa.Table) -> pa.Table:
    rows = group.sort_by("place").to_pylist()
    one = rows[0]
    lattice = [(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in rows]
    enters = (0,) if one["seg"] == 0 else range(4)
    leaves = ACCEPTS if rows[-1]["place"] + 1 == one["place_total"] else range(4)
    ways = [{"enters": s, "leaves": t, "cost": x[0], "audit": x[1]} for s in enters for t in leaves if (x := cheapest(lattice, s, (t,)))]
    wrong = sum(not legal(a["initial"], b["initial"]) for a, b in zip(rows, rows[1:]))
    return pa.table([[one["conv_id"]], [one["seg"]], [one["initial"]], [rows[-1]["initial"]], [wrong], [ways]], schema=SOLVED)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in the order of conversations and places to the way taken through each; what is held is one conversation's audits."""
    held, conv = [], object()
    for batch in batches:
        for seg in batch.to_pylist():
            if held and seg["conv_id"] != conv:
                yield pa.RecordBatch.from_pylist(_taken(held), CHOSEN)
                held = []
            conv = seg["conv_id"]
            held.append(seg)
    if held:
        yield pa.RecordBatch.from_pylist(_taken(held), CHOSEN)


def _taken(segs: list[dict]) -> list[dict]:
    best: dict[int, tuple[int, str]] = {0: (0, "")}
    came: list[dict[int, dict]] = []
    for seg in segs:
        new: dict[int, tuple[int, str]] = {}
        by: dict[int, dict] = {}
        for way in seg["ways"]:
            if way["enters"] in best:
                cost, audit = best[way["enters"]]
                label = (cost + way["cost"], audit + way["audit"])
                if way["leaves"] not in new or label < new[way["leaves"]]:
                    new[way["leaves"]], by[way["leaves"]] = label, way
        best = new
        came.append(by)
    state = min((t for t in ACCEPTS if t in best), key=lambda t: best[t])
    out = []
    for at in range(len(segs) - 1, -1, -1):
        way = came[at][state]
        wrong = segs[at]["illegal"] + (at > 0 and not legal(segs[at - 1]["last"], segs[at]["first"]))
        out.append({"conv_id": segs[at]["conv_id"], "seg": segs[at]["seg"], "enters": way["enters"], "audit": way["audit"], "cost": way["cost"], "illegal": wrong})
        state = way["enters"]
    return out[::-1]


def _rewrite(rows: pa.Table, chosen: pa.Table) -> pa.Table:
    rows, way, out = rows.sort_by("place").to_pylist(), chosen.to_pylist()[0], []
    state, at = way["enters"], 0
    for letter in way["audit"]:
        row = None if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        symbol = row["initial"] if letter == "K" else next(x for x in NEXT[state] if x in NAMES)
        state = NEXT[state][symbol]
        out.append({
            "conv_id": way["conv_id"], "seg": way["seg"], "nr": len(out), "turn": row and row["turn"],
            "role": row["role"] if letter == "K" else NAMES[symbol], "text": row["text"] if row else "", "edit": letter,
        })
    return pa.Table.from_pylist(out, REPAIRED)


# the operator


def checked(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, place (from 0) and place_total, seg, initial and fault: blank, duplicate, truncated or null, the first that holds."""
    rows = turns.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "_one": F.lit(1)})
    placed = with_running_sum(rows, ["conv_id"], ["turn", "role", "digest"], "_one", "place").drop("_one")
    first = placed.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest")).agg(F.min("place").alias("first_place"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    met = placed.join(first, same).drop("of", "of_role", "of_digest", "digest")
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(F.col("place") > F.col("first_place"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return met.withColumns({"seg": F.floor(F.col("place") / SEGMENT), "initial": F.left("role", F.lit(1)), "fault": fault}).drop("first_place")


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The reports and the repaired turns.

    Reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: conv_id, seg, nr (their order), turn (null if inserted), role, text, edit (K, R or I).
    """
    rows = written(checked(turns, id_col, turn_col, role_col, text_col), "repair-rows")
    solved = rows.select("conv_id", "seg", "place", "place_total", "initial", "fault").groupBy("conv_id", "seg").applyInArrow(_solve, from_arrow_schema(SOLVED))
    chosen = written(solved.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_chain, from_arrow_schema(CHOSEN)), "repair-ways")
    out = rows.groupBy("conv_id", "seg").cogroup(chosen.groupBy("conv_id", "seg")).applyInArrow(_rewrite, from_arrow_schema(REPAIRED))
    count = lambda x: F.count_if(F.col("fault") == x).alias(x)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    faults = rows.groupBy("conv_id").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    # a conversation's pieces of audit in their order: one letter an edit
    audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit")
    ways = chosen.groupBy(F.col("conv_id").alias("of")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audits)
    return faults.join(ways, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"), out


# the query


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with drops, empty texts, lost sentence ends, repeats and wrong roles, as the CRC-32 of `conv_id:turn` says; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    k = F.col("kind")
    rows = rows.withColumns({
        "role": F.when(k == 4, "user").otherwise(F.col("role")),
        "text": F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "copy": F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.select("conv_id", "turn", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's `role:text` lines, over turns in order; what is held is one turn."""
    conv, sha = object(), None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if sha is None or row["conv_id"] != conv:
                if sha is not None:
                    out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                conv, sha = row["conv_id"], hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{row['role']}:{row['text']}".encode())
        yield pa.RecordBatch.from_pylist(out, DIGESTS)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], DIGESTS)


def op11_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    reports, out = repaired(damaged(turns))
    shas = out.select("conv_id", "seg", "nr", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "nr").mapInArrow(_digests, from_arrow_schema(DIGESTS))
    known = turns.select(F.col("conv_id").alias("id")).distinct()
    both = known.join(reports, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    both = both.join(shas, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: CRC-32 by its table of 256 remainders; {0} is an ASCII text.
CRC_TABLE = "crc as (select list(v order by i) as tab from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) r(i)))"
CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda x: cast(ascii(x) as bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _sql() -> str:
    """The lattice as a fold over a conversation's rows: the least (cost, audit, repaired lines) for each state of the grammar."""
    add = lambda x, cost, letter, line="": f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': " + (f"list_append({x}.o, {line})" if line else f"{x}.o") + "}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    s = [f"s[{i}]" for i in (1, 2, 3, 4)]
    users = f"list_transform([s], lambda s: [s[1], s[2], {least(s[2], *(add(x, 2, 'I', chr(39) + 'user:' + chr(39)) for x in (s[0], s[1], s[3])))}, s[4]])[1]"
    closed = f"list_transform([{users}], lambda s: [s[1], s[2], s[3], {least(s[3], add(s[2], 2, 'I', chr(39) + 'assistant:' + chr(39)))}])[1]"
    keep = lambda x, i: add(x, f"case when r.i = '{i}' and not r.f then r.t else 1000000 end", "K", "r.r || ':' || r.x")
    rerole = lambda x, name: add(x, "case when not r.f then 2 + r.t else 1000000 end", "R", f"'{name}:' || r.x")
    drop = lambda x: add(x, 3, "D")
    to_user = [f(x, y) for x in (s[0], s[1], s[3]) for f, y in ((keep, "u"), (rerole, "user"))]
    step = f"[{drop(s[0])}, {least(drop(s[1]), keep(s[0], 's'))}, {least(drop(s[2]), *to_user)}, {least(drop(s[3]), keep(s[2], 'a'), rerole(s[2], 'assistant'))}]"
    start = "[{'c': 0, 'a': '', 'o': cast([] as varchar[])}" + ", {'c': 1000000, 'a': '', 'o': cast([] as varchar[])}" * 3 + "]"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
with {CRC_TABLE},
t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             {CRC.format("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k
      from conversations, crc),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
             case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
             unnest(case when k = 3 then [0, 1] else [0] end) as copy
      from t where k <> 0),
n as (select *, rtrim(text, {white}) as bare, row_number() over (partition by conv_id order by turn nulls first, role, unhex(sha256(text))) as p from d),
m as (select *, row_number() over (partition by conv_id, role, text order by p) as nth,
             lag(substr(role, 1, 1)) over (partition by conv_id order by p) || substr(role, 1, 1) as two from n),
f as (select *, case when bare = '' then 'blank' when nth > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from m),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
             count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
             count(*) filter (two is not null and two not in ('su', 'ua', 'au')) as illegal,
             list({{'i': substr(role, 1, 1), 'f': fault in ('blank', 'duplicate'), 't': case when fault = 'truncated' then 1 else 0 end, 'r': role, 'x': text}} order by p) as rows
      from f group by conv_id),
h as (select *, list_reduce(rows, lambda z, r: list_transform([list_transform([z], lambda s: {closed})[1]], lambda s: {step})[1], {start}) as z from g),
e as (select *, list_transform([list_transform([z], lambda s: {closed})[1]], lambda s: {least(s[0], s[3])})[1] as best from h)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join e on c.conv_id is not distinct from e.conv_id
"""


OP11_SQL = _sql()
