"""The trie of conversation prefixes: splitter-skeleton over sorted shards.

A conversation is the path of its turns' digests. Equal paths meet first, in blocks of BLOCK neighbouring ids, so that a path that a third of
all conversations share is a row for each block. A bounded sample of paths (about SAMPLED for each shard) gives the splitters of a range partitioning,
each cut after the first turn in which it differs from the one before. The trie of the splitters, the skeleton, is broadcast: only its nodes can have members in
more than one shard. Each shard reads its paths in order with a stack and finishes all other nodes; for skeleton nodes it gives partial
aggregates, which are added up by node and then along the skeleton, which has at most (shards x longest shared prefix) nodes.

Rows without an id are left out. A null role or text is empty. Turns are ordered by number (null first) and digest; repeated rows are turns of their own. Texts
of any length stay whole; from their digests on, 48 bytes a turn are moved. A conversation's path is one row. A conversation without turns
is a member of the root. An empty table has no nodes. Other columns are left out, clashing names among them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import table, written
from .repair import CRC, CRC_TABLE

#: Hexadecimal digits of a turn's digest.
WIDTH = 32
BLOCK = 1024
SAMPLED = 50
LONG, TEXT = pa.int64(), pa.string()
NODES = pa.schema({
    "skeleton": LONG, "parent_skeleton": LONG, "conv_id": LONG, "depth": LONG, "parent_conv_id": LONG, "n_convs": LONG, "n_children": LONG,
    "n_leaves": LONG, "saved_tokens": LONG, "ends_sha256": TEXT, "size": LONG,
})
NO_ENDS = hashlib.sha256().hexdigest()


def paths(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, digests (hexadecimal) and sizes (UTF-8 bytes of the texts) of its turns in order."""
    rows = turns.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("size"))
    own = rows.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return own.select("conv_id", F.transform("x", lambda x: x["digest"]).alias("digests"), F.transform("x", lambda x: x["size"]).alias("sizes"))


def splitters(sorted_sample: list[str], shards: int) -> list[str]:
    """At most shards - 1 paths that cut the sample evenly, each cut after its first turn that the one before has not."""
    out: list[str] = []
    for i in range(1, shards):
        path, last = sorted_sample[len(sorted_sample) * i // shards], out[-1] if out else ""
        if path <= last:
            continue
        same = 0
        while path[same : same + WIDTH] == last[same : same + WIDTH] and same < len(last):
            same += WIDTH
        out.append(path[: same + WIDTH])
    return out


def skeleton_of(cuts: list[str]) -> list[tuple[int | None, dict[str, int]]]:
    """The trie of the splitters: for each node its parent's number and its children by digest; 0 is the root."""
    nodes: list[tuple[int | None, dict[str, int]]] = [(None, {})]
    for path in cuts:
        at = 0
        for i in range(0, len(path), WIDTH):
            turn = path[i : i + WIDTH]
            if turn not in nodes[at][1]:
                nodes[at][1][turn] = len(nodes)
                nodes.append((at, {}))
            at = nodes[at][1][turn]
    return nodes


class _Node:
    """A node whose paths are being read."""

    __slots__ = ("turn", "skeleton", "depth", "size", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, turn: str, skeleton: int | None, depth: int, size: int):
        self.turn, self.skeleton, self.depth, self.size = turn, skeleton, depth, size
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.waiting = None, 0, 0, 0, 0, None, []

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def row(self) -> dict:
        return {"skeleton": self.skeleton, "conv_id": self.conv, "depth": self.depth, "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved, "ends_sha256": self.ends.hexdigest() if self.ends else None, "size": self.size}


def _closed(stack: list[_Node]) -> Iterator[dict]:
    """Takes the last node off the stack. Its children's rows were waiting for its smallest member."""
    node = stack.pop()
    if node.skeleton is not None:
        yield node.row()
        return
    parent = stack[-1]
    node.leaves = node.leaves or 1
    node.saved += (node.n - 1) * node.size
    parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + node.leaves, parent.saved + node.saved
    parent.add(node.conv, node.n)
    yield from ({**x, "parent_conv_id": node.conv} for x in node.waiting)
    if parent.skeleton is None:
        parent.waiting.append(node.row())
    else:
        yield {**node.row(), "parent_skeleton": parent.skeleton}


def _shard(batches: Iterator[pa.RecordBatch], skeleton: list[tuple[int | None, dict[str, int]]]) -> Iterator[pa.RecordBatch]:
    """A shard's paths in order to its nodes, finished or, for skeleton nodes, the shard's part of them."""
    stack, out = [_Node("", 0, 0, 0)], []
    for batch in batches:
        for path, sizes, conv, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "conv_id", "n", "ids"))):
            turns = [path[i : i + WIDTH] for i in range(0, len(path), WIDTH)]
            same = 0
            while same < min(len(turns), len(stack) - 1) and stack[same + 1].turn == turns[same]:
                same += 1
            while len(stack) > same + 1:
                out.extend(_closed(stack))
            for depth in range(same, len(turns)):
                above = stack[-1].skeleton
                stack.append(_Node(turns[depth], None if above is None else skeleton[above][1].get(turns[depth]), depth + 1, sizes[depth]))
            top = stack[-1]
            top.add(conv, n)
            if top.ends is None:
                top.ends = hashlib.sha256()
            else:
                top.ends.update(b",")
            top.ends.update(ids.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, NODES)
            out = []
    read = stack[0].n or len(stack) > 1 or stack[0].children
    while read and stack:
        out.extend(_closed(stack))
    yield pa.RecordBatch.from_pylist(out, NODES)


def _rolled_up(parts: list[dict], skeleton: list[tuple[int | None, dict[str, int]]]) -> list[dict]:
    """Skeleton nodes with their subtrees, from what the shards have added up for each: children have greater numbers than their parents."""
    known = {x["skeleton"]: {**x} for x in parts}
    for at in range(len(skeleton) - 1, -1, -1):
        node = known.get(at)
        if node is None:
            continue
        node["n_children"] += sum(x in known for x in skeleton[at][1].values())
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
        node["ends_sha256"] = node["ends_sha256"] or NO_ENDS
        parent = skeleton[at][0]
        if parent is not None:
            above = known.setdefault(parent, {"skeleton": parent, "conv_id": node["conv_id"], "depth": node["depth"] - 1, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": None, "size": 0})
            above["conv_id"] = node["conv_id"] if above["conv_id"] is None else min(above["conv_id"], node["conv_id"])
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                above[c] += node[c]
    for at, node in known.items():
        node["parent_conv_id"] = known[skeleton[at][0]]["conv_id"] if at else None
    return list(known.values())


def trie(convs: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    convs: conv_id, digests, sizes, one row a conversation.
    """
    spark = convs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = convs.select("conv_id", F.array_join("digests", "").alias("path"), "sizes", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    equal = rows.groupBy("path", "block").agg(F.any_value("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
    held = written(equal.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")), "trie-paths")
    one_in = max(1, held.count() // (SAMPLED * shards))
    # about SAMPLED paths for each shard come to the driver
    sample = held.where(F.pmod(F.xxhash64("path"), F.lit(one_in)) == 0).select("path").distinct().collect()
    cuts = splitters(sorted(x["path"] for x in sample), shards) if sample else []
    skeleton = skeleton_of(cuts)
    shared = spark.sparkContext.broadcast((cuts, skeleton))

    @F.arrow_udf("int")
    def shard_of(path: pa.Array) -> pa.Array:
        return pa.array([bisect_right(shared.value[0], x) for x in path.to_pylist()], pa.int32())

    dealt = held.withColumn("shard", shard_of("path")).repartitionById(shards, F.col("shard")).sortWithinPartitions("path", "block")
    nodes = written(dealt.drop("shard").mapInArrow(lambda it: _shard(it, shared.value[1]), from_arrow_schema(NODES)), "trie-nodes")
    sums = nodes.where("skeleton is not null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"), F.max("size").alias("size"),
    )
    found = _rolled_up([x.asDict() for x in sums.collect()], skeleton)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = spark.createDataFrame([tuple(x[c] for c in (*columns, "skeleton")) for x in found], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, of_skeleton bigint")
    above = F.broadcast(top.select("of_skeleton", F.col("conv_id").alias("of_conv")))  # as many rows as the skeleton has nodes
    rest = nodes.where("skeleton is null").join(above, F.col("parent_skeleton") == F.col("of_skeleton"), "left")
    rest = rest.withColumns({"parent_conv_id": F.coalesce("of_conv", "parent_conv_id"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))})
    return rest.select(columns).unionByName(top.select(columns))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that begin as another: conv_id c has the first h turns of c - c % 5 and then its own after the first h; h: CRC-32 of c modulo 9."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = own.select(F.col("conv_id").alias("of"), F.slice("digests", 1, 8).alias("head"), F.slice("sizes", 1, 8).alias("head_sizes"))
    rows = own.join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("of"), "left").withColumn("h", h)
    begun = lambda head, own, kind: F.concat(F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0))))
    return rows.select("conv_id", begun("head", "digests", "array<string>").alias("digests"), begun("head_sizes", "sizes", "array<bigint>").alias("sizes"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(paths(table(spark, sf_dir, "conversations"))))


OP13_SQL = f"""
with {CRC_TABLE},
t as (select conv_id, turn, md5(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as d, strlen(coalesce(text, '')) as z
      from conversations where conv_id is not null),
o as (select conv_id, list(d order by turn nulls first, d, z) as ds, list(z order by turn nulls first, d, z) as zs from t group by conv_id),
h as (select o.*, {CRC.format("cast(conv_id as varchar)")} % 9 as h from o, crc),
r as (select h.conv_id, list_concat(coalesce(b.ds[1:h], []), h.ds[h + 1:]) as ds, list_concat(coalesce(b.zs[1:h], []), h.zs[h + 1:]) as zs
      from h left join o b on b.conv_id = h.conv_id - h.conv_id % 5),
p as (select *, unnest(range(len(ds) + 1)) as depth from r),
n as (select array_to_string(ds[1:depth], '') as k, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(zs[depth]), 0) as z,
             sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(ds) = depth), '')) as ends_sha256
      from p group by all),
c as (select substr(k, 1, 32 * (depth - 1)) as k, count(*) as n_children from n where depth > 0 group by 1),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (k)),
u as (select substr(k, 1, 32 * e) as k, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * z) as saved_tokens
      from (select *, unnest(range(depth + 1)) as e from m) group by 1)
select m.conv_id, m.depth, a.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, m.ends_sha256
from m join u using (k) left join n a on m.depth > 0 and a.k = substr(m.k, 1, 32 * (m.depth - 1))
"""
