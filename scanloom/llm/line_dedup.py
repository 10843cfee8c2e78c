"""Line dedup across documents: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at
least min_chars code points that at least min_docs documents hold lose their lines everywhere but in
the largest id that holds them. Lines are cut and hashed once, into a table of ids and 128-bit hashes; texts move
once, to meet their lists of hashes to drop. A hash with more than 1 / (4 x shuffle partitions) of all lines is hot:
there are fewer such hashes than 4 x partitions, so they are broadcast, and the join of the others has no large key.

A null or empty text is one empty line. Rows that repeat an id count as one document. A row without an
id is no document: it adds nothing to the counts and loses nothing. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, table, written

#: The contract's white space; a fixed value.
WHITE = " \t\n\x0b\x0c\r"


def line_hash(line: str, min_chars: int) -> bytes | None:
    key = line.strip(WHITE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most_rows=2000):
            found = [{h for line in (text or "").split("\n") if (h := line_hash(line, min_chars))} for text in part.column(1).to_pylist()]
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([h for x in found for h in x], pa.binary())], ["doc_id", "line_hash"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """A row per document that loses lines: doc_id, drops (the hashes of the lines that it loses)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    lines = written(texts.mapInArrow(lambda it: _hashes(it, min_chars), "doc_id bigint, line_hash binary"), "line-hashes")
    counted = lines.groupBy("line_hash").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common = written(counted, "common-lines")
    hot = F.col("n") * 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) > lines.count()
    some = F.broadcast(common.where(hot).select("line_hash", "keeper"))
    rest = lines.join(some.select("line_hash"), "line_hash", "left_anti").join(common.where(~hot).select("line_hash", "keeper"), "line_hash")
    met = lines.join(some, "line_hash").unionByName(rest)
    return met.where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("line_hash").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the lines dropped from the text, and the columns n_lines (before) and n_dropped (a suffix _ if those names are taken)."""

    @F.arrow_udf("n_lines bigint, n_dropped bigint, kept string")
    def rebuild(texts: pa.Array, drops: pa.Array) -> pa.Array:
        n, dropped, kept = [], [], []
        for text, gone in zip(texts.to_pylist(), drops.to_pylist()):
            lines = (text or "").split("\n")
            n.append(len(lines))
            if gone:
                away = set(gone)
                lines = [x for x in lines if line_hash(x, min_chars) not in away]
                kept.append("\n".join(lines))
            else:
                kept.append(text or "")
            dropped.append(n[-1] - len(lines))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "kept"])

    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    names = docs.columns
    key, gone, made = free_name(names, "drop_id"), free_name(names, "drops"), free_name(names, "made")
    joined = docs.join(drops.select(F.col("doc_id").alias(key), F.col("drops").alias(gone)).hint("shuffle_hash"), docs[id_col] == F.col(key), "left")
    out = joined.withColumn(made, rebuild(F.col(text_col).cast("string"), F.col(gone)))
    return out.select(
        *[F.col(f"{made}.kept").alias(c) if c == text_col else F.col(c) for c in names],
        F.col(f"{made}.n_lines").alias(free_name(names, "n_lines")),
        F.col(f"{made}.n_dropped").alias(free_name(names, "n_dropped")),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
common as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
marked as (
  select doc_id, line, pos, c.k is not null and doc_id <> keeper as gone
  from keyed left join common c on keyed.k = c.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
