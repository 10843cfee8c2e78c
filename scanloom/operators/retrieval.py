"""Retrieval corpus: page ingest, vector top-k behind filters, review-gated export."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanloom.functions.scalars import checksum, chunks_checksum, cosine
from scanloom.functions.text import page_chunks, page_text, page_text_native, rule_chunks

from .matching import small
from .state import replaced_chunks, source_changes

#: Query vectors that are scored together, and bytes of them that are broadcast or that meet a part of the rows, at most.
QUERY_BLOCK, QUERY_BYTES = 512, 32 << 20


def page_sources(pages: DataFrame, native: bool = False, bare_entities: bool = True) -> DataFrame:
    """pages (url, html) with text and checksum."""
    return pages.withColumn("text", page_text_native("html") if native else page_text("html", bare_entities)).withColumn("checksum", checksum("text"))


def chunks(sources: DataFrame, keep: list[str]) -> DataFrame:
    """A row a chunk: section_ref paragraph_i in order."""
    return sources.select(*keep, F.posexplode(page_chunks("text")).alias("chunk_no", "chunk")).withColumn("section_ref", F.concat(F.lit("paragraph_"), F.col("chunk_no").cast("string")))


def rule_sources(documents: DataFrame, groups: DataFrame, allowed: DataFrame) -> DataFrame:
    """One source for each group of allowed rules, with the checksum of its chunks in order. documents: rule_id, text; groups: rule_id, group_dir."""
    rows = documents.join(allowed.select("rule_id").distinct(), "rule_id", "left_semi").join(groups, "rule_id").select("group_dir", "rule_id", F.posexplode(rule_chunks("text")).alias("n", "chunk"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "n", "chunk"))), lambda x: x["chunk"])
    return rows.groupBy("group_dir").agg(F.count_distinct("rule_id").alias("rules"), ordered.alias("chunks")).withColumn("checksum", chunks_checksum("chunks"))


def ingested(stored: DataFrame, chunk_rows: DataFrame, sources: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sources with what changed, and the chunks after the ingest: unchanged sources are skipped, changed ones' chunks replaced.

    stored: corpus, title, platform, source_id, checksum. sources: the same with text, from page_sources or rule_sources. chunk_rows: source_id and `keep`, chunk_no, chunk, section_ref.
    """
    changes = source_changes(stored, sources)
    fresh = chunks(changes.where("change <> 'same'"), ["source_id", *keep])
    return changes, replaced_chunks(chunk_rows, changes, fresh)


def ingested_rules(stored: DataFrame, chunk_rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule sources with what changed (change), and the chunks after the ingest: groups with an equal checksum are skipped, changed ones' chunks replaced, new ones added.

    stored: group_dir, checksum. sources: rule_sources. chunk_rows: source_id (the group), chunk, section_ref. Groups that no longer come keep their chunks.
    """
    old = stored.select("group_dir", F.col("checksum").alias("_old"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("checksum"), "same").otherwise("changed")
    changes = sources.join(old, "group_dir", "left").withColumn("change", change).drop("_old")
    fresh = changes.where("change <> 'same'").select(F.col("group_dir").alias("source_id"), F.posexplode("chunks").alias("_n", "chunk"))
    fresh = fresh.select("source_id", "chunk", F.concat(F.col("source_id"), F.lit("#"), (F.col("_n") + 1).cast("string")).alias("section_ref"))
    return changes, replaced_chunks(chunk_rows, changes.withColumn("source_id", F.col("group_dir")), fresh)


def selection_manifest(found: DataFrame, none: DataFrame, contributors: DataFrame) -> DataFrame:
    """One JSON line of what a rule ingest selected: products with the tier used, products without a profile, and how many rules each (product, tier) selects.

    found: product, tier; none: product; contributors: rule_id, contributors. Products are a list that a person keeps, so it is short.
    """
    used = found.agg(F.array_sort(F.collect_list(F.struct("product", "tier"))).alias("used"))
    skipped = none.agg(F.array_sort(F.collect_list("product")).alias("skipped"))
    counts = contributors.select(F.explode("contributors").alias("c")).groupBy("c.product", "c.tier").agg(F.count(F.lit(1)).alias("rules"))
    counts = counts.agg(F.array_sort(F.collect_list(F.struct("product", "tier", "rules"))).alias("contributors"))
    return used.join(skipped, F.lit(True)).join(counts, F.lit(True)).select(F.to_json(F.struct("used", "skipped", "contributors")).alias("value"))


def ignored_groups(choices: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups that choices name and that aren't known, with how often. choices: group_id; groups: group_id."""
    return choices.join(groups.select("group_id").distinct(), "group_id", "left_anti").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


def blob_of_floats(vector: Column) -> Column:
    """An array of floats as little-endian 32-bit binary; the inverse of floats_of_blob. Null stays null."""
    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)


def candidates(chunk_rows: DataFrame, hint: Column | None = None, platform: str | None = None) -> DataFrame:
    """Chunks that may be retrieved: with a vector, of the hint if there is one, and of the platform or of none."""
    rows = chunk_rows.where("embedding is not null")
    if hint is not None:
        rows = rows.where(F.col("finding_class_hint") == hint)
    if platform is not None:
        rows = rows.where((F.col("platform") == platform) | F.col("platform").isNull())
    return rows


def top_k(rows: DataFrame, vector: list[float], k: int = 8, id_col: str = "chunk_id") -> DataFrame:
    """The k rows nearest to one vector, scores rounded to 4; equal scores go by id. Each task keeps k rows."""
    scored = rows.withColumn("score", cosine("embedding", F.array(*[F.lit(float(x)) for x in vector])))
    return scored.orderBy(F.desc("score"), id_col).limit(k).withColumn("score", F.round("score", 4))


def top_k_for_each(rows: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "chunk_id", most_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k rows nearest to each of a set of query vectors (query_id, query_vector), in one scan of the rows for any number of queries.

    Vectors of at most most_bytes together are broadcast. More queries are dealt into groups of that size and the rows, as they are scanned, into parts; each part meets each
    group in a task of its own. A task keeps k rows a query, which are ranked after a shuffle of k rows for each task and query. Rows are taken in blocks
    around pivots: by the distance of a block's rows from their centroid no row of it can come nearer to a query than a bound, and blocks below a query's k-th score are passed over.
    Scores are cosines (0 for a vector without length, shorter vectors end in zeros); equal ones, to 12 digits, go by id. Rows without a vector are left out.
    """
    said = queries.agg(F.count(F.lit(1)), F.max(F.size("query_vector"))).first()
    groups = max(1, -(-said[0] * max(1, said[1] or 1) * 8 // most_bytes))
    spark, out = rows.sparkSession, f"query_id bigint, {id_col} bigint, score double"
    held = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query_vector").cast("array<double>").alias("q"))
    if groups == 1:
        sent = spark.sparkContext.broadcast([tuple(x) for x in asked.collect()])  # at most most_bytes of vectors
        found = held.mapInArrow(lambda it: _nearest(it, sent.value, k), out)
    else:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // most_bytes)
        left = held.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)), "grp": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
        right = asked.withColumns({"grp": F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"), "part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))})

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            asked = list(zip(b["query_id"].to_pylist(), b["q"].to_pylist()))
            return pa.Table.from_batches(list(_nearest(a.select(["id", "v"]).to_batches(), asked, k)), _HITS)

        found = left.groupBy("part", "grp").cogroup(right.groupBy("part", "grp")).applyInArrow(meet, out.replace(id_col, "id"))
        found = found.toDF("query_id", id_col, "score")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", 4))


_HITS = pa.schema({"query_id": pa.int64(), "id": pa.int64(), "score": pa.float64()})


def _units(vectors: list, size: int) -> np.ndarray:
    """Vectors of length 1 in rows, ended by zeros; those without length stay zero."""
    out = np.zeros((len(vectors), size))
    for x, v in zip(out, vectors):
        x[: len(v or ())] = v or ()
    norms = np.sqrt((out * out).sum(1))[:, None]
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _blocks(batches, most: int = 8192, pivots: int = 8):
    """ids and vectors of neighbouring rows: chunks of a task's rows, cut by the nearest of their first rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            ids, vectors = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
            x = _units(vectors, max(map(len, vectors), default=0))
            near = np.argmax(x @ x[:pivots].T, axis=1) if len(x) > pivots else np.zeros(len(x), int)
            for p in np.unique(near):
                yield ids[near == p], x[near == p]


def _nearest(batches, asked: list, k: int):
    """The k nearest rows of a task to each query."""
    size = max((len(q or ()) for _, q in asked), default=0)
    qids, qs = np.array([i for i, _ in asked], np.int64), _units([q for _, q in asked], size)
    least = np.full(len(qids), -np.inf)
    best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # places of queries, ids, scores
    for ids, x in _blocks(batches):
        n = min(x.shape[1], size)
        x = x[:, :n]
        middle = x.mean(0)
        reach = np.sqrt(((x - middle) ** 2).sum(1)).max()
        lo = np.flatnonzero(qs[:, :n] @ middle + reach + 1e-9 >= least)
        for at in range(0, len(lo), QUERY_BLOCK):
            q = lo[at : at + QUERY_BLOCK]
            scores = np.round(x @ qs[q, :n].T, 12) + 0.0
            cut = np.maximum(least[q], np.partition(scores, -k, axis=0)[-k]) if len(x) >= k else least[q]
            row, col = np.nonzero(scores >= cut)
            best = [np.concatenate(y) for y in zip(best, (q[col], ids[row], scores[row, col]))]
        order = np.lexsort((best[1], -best[2], best[0]))
        of = best[0][order]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, int)
        place = np.arange(len(of)) - np.repeat(starts, np.diff([*starts, len(of)]))
        best = [y[order][place < k] for y in best]
        full = np.flatnonzero(place[place < k] == k - 1)
        least[best[0][full]] = best[2][full]
    yield pa.RecordBatch.from_arrays([pa.array(qids[best[0]]), pa.array(best[1].astype(np.int64)), pa.array(best[2])], schema=_HITS)


def with_sources(hits: DataFrame, sources: DataFrame) -> DataFrame:
    return hits.join(small(sources), "source_id")


def pending(chunk_rows: DataFrame, force: bool = False) -> DataFrame:
    return chunk_rows if force else chunk_rows.where("embedding is null")


def embedded(chunk_rows: DataFrame, vectors: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with the vectors given for them, and the run's record. The first vector's size is the norm; vectors of another size fail and aren't written."""
    first = vectors.agg(F.min_by(F.size("embedding"), "chunk_id").alias("dimension"))
    sized = vectors.join(F.broadcast(first), F.lit(True))
    good = sized.where(F.size("embedding") == F.col("dimension")).select("chunk_id", F.col("embedding").alias("_e"))
    out = chunk_rows.join(good, "chunk_id", "left").withColumn("embedding", F.coalesce("_e", "embedding")).drop("_e")
    record = sized.agg(F.lit(model).alias("model"), F.max("dimension").alias("dimension"), F.count_if(F.size("embedding") == F.col("dimension")).alias("embedded"), F.count_if(F.size("embedding") != F.col("dimension")).alias("failed"))
    return out, record


def floats_of_blob(blob: Column) -> Column:
    """Little-endian 32-bit floats of a binary as an array."""
    @F.pandas_udf("array<float>")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decode(blob)


def citations(cites: DataFrame, chunk_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """entry_id, urls: a citation's own address, else that of its chunk's source; distinct in order."""
    rows = cites.join(chunk_rows.select("chunk_id", "source_id"), "chunk_id", "left").join(sources.select("source_id", F.col("url").alias("_u")), "source_id", "left")
    rows = rows.withColumn("u", F.coalesce(F.nullif("url", F.lit("")), "_u")).where("u is not null")
    return rows.groupBy("entry_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", "u"))), lambda x: x["u"])).alias("urls"))


def nested_steps(steps: DataFrame, commands: DataFrame) -> DataFrame:
    """entry_id, steps: text and its commands by platform, in order."""
    c = commands.groupBy("step_id").agg(F.map_from_entries(F.collect_list(F.struct("platform_key", "command_template"))).alias("commands"))
    rows = steps.join(c, "step_id", "left")
    return rows.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_order", F.struct("text", F.to_json("commands").alias("commands")).alias("s")))), lambda x: x["s"]).alias("steps"))


#: A class that stands for three checks; fixed names.
FAN_OUT = ("FIREWALL-PROFILE", ["FIREWALL-DOMAIN", "FIREWALL-PRIVATE", "FIREWALL-PUBLIC"])


def export_gate(entries: DataFrame, reviews: DataFrame, steps: DataFrame, commands: DataFrame, windows_keys: DataFrame, catalog_keys: DataFrame, cited: DataFrame) -> DataFrame:
    """Every entry with what becomes of it: route (windows, catalog or skipped), reason, key (one row for each), provenance.

    An entry passes if its latest review approves and none of its commands is unchecked or bad. entries: entry_id, finding_class; windows_keys, catalog_keys: key.
    """
    last = reviews.groupBy("entry_id").agg(F.max_by("decision", "review_id").alias("decision"))
    bad = commands.where("not (ast_validated <=> 1)").join(steps.select("step_id", "entry_id"), "step_id").select("entry_id").distinct().withColumn("bad", F.lit(True))
    rows = entries.join(last, "entry_id", "left").join(bad, "entry_id", "left").join(cited.select("entry_id", F.lit(True).alias("cited")), "entry_id", "left")
    key = F.when(F.col("finding_class") == FAN_OUT[0], F.array(*map(F.lit, FAN_OUT[1]))).otherwise(F.array("finding_class"))
    rows = rows.withColumn("key", F.explode(key))
    rows = rows.join(small(windows_keys.select("key", F.lit(True).alias("in_windows"))), "key", "left").join(small(catalog_keys.select("key", F.lit(True).alias("in_catalog"))), "key", "left")
    reason = (
        F.when(~F.col("decision").eqNullSafe(F.lit("approved")), "no approved review").when(F.col("bad"), "not all commands are validated")
        .when((F.col("finding_class") != FAN_OUT[0]) & F.col("in_windows").isNull() & F.col("in_catalog").isNull(), "in neither catalog")
    )
    route = F.when(F.col("reason").isNotNull(), "skipped").when((F.col("finding_class") == FAN_OUT[0]) | F.col("in_windows").isNotNull(), "windows").otherwise("catalog")
    rows = rows.withColumn("reason", reason).withColumn("route", route)
    proof = F.when(F.col("route") == "catalog", F.when(F.col("cited"), "verified:citation").otherwise("authored"))
    return rows.select("entry_id", "finding_class", "key", "route", "reason", proof.alias("provenance")).distinct()


def profile_contributors(selected: DataFrame) -> DataFrame:
    """rule_id with the (product, tier) pairs that select it."""
    return selected.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct("product", "tier"))).alias("contributors"))


def selected_rules(choices: DataFrame) -> DataFrame:
    """Included and not excluded rules by product. choices: product, rule_id, excluded."""
    return choices.where("not excluded").select("product", "rule_id").distinct().join(choices.where("excluded").select("product", "rule_id"), ["product", "rule_id"], "left_anti")
