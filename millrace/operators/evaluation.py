"""Measures of retrieval against reference passages: flags by matching texts, hit, mrr, ndcg and recall at k, and the best chunk for a line."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from millrace.functions import metrics as M
from millrace.functions.records import contexts_match, match_normal, normals_match
from millrace.functions.text import strip
from millrace.work import written


def matched(refs: DataFrame, hits: DataFrame, overlap: int = 20) -> DataFrame:
    """query_id, ref_no, rank of the reference passages refs(query_id, ref_no, text) and results hits(query_id, rank, text) that are the same
    passage. Both are few for each query; blank ones do not count."""
    r = refs.where(strip(F.coalesce("text", F.lit(""))) != "").select("query_id", "ref_no", F.col("text").alias("ref"))
    h = hits.where(strip(F.coalesce("text", F.lit(""))) != "").select("query_id", "rank", F.col("text").alias("got"))
    return r.join(h, "query_id").where(contexts_match(F.col("ref"), F.col("got"), overlap)).select("query_id", "ref_no", "rank")


def ir_scores(refs: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5), overlap: int = 20) -> DataFrame:
    """For each query of refs hit, mrr, ndcg and recall at each k (columns hit_1, mrr_1, ...). Ranks are places among the results that are not
    blank; recall is the share of the references that one of the first k results matches; without references all are 0."""
    full = strip(F.coalesce("text", F.lit(""))) != ""
    placed = hits.where(full).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    found = matched(refs, placed, overlap)
    flags = placed.select("query_id", "rank").join(found.select("query_id", "rank").distinct().withColumn("rel", F.lit(1)), ["query_id", "rank"], "left")
    lists = flags.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("rel", F.lit(0)).alias("rel")))), lambda x: x["rel"]).alias("rels"))
    first = found.groupBy("query_id", "ref_no").agg(F.min("rank").alias("first")).groupBy("query_id").agg(F.collect_list("first").alias("firsts"))
    asked = refs.groupBy("query_id").agg(F.count_if(full).alias("n_refs"))
    none = F.array().cast("array<int>")
    rows = asked.join(lists, "query_id", "left").join(first, "query_id", "left").withColumns({"rels": F.coalesce("rels", none), "firsts": F.coalesce("firsts", none)})

    def recall(k: int) -> Column:
        return F.when(F.col("n_refs") > 0, F.size(F.filter("firsts", lambda x: x <= k)) / F.col("n_refs")).otherwise(0.0)

    measures = {}
    for k in ks:
        measures |= {f"hit_{k}": M.hit_at_k(F.col("rels"), k), f"mrr_{k}": M.mrr_at_k(F.col("rels"), k), f"ndcg_{k}": M.ndcg_at_k(F.col("rels"), k), f"recall_{k}": recall(k)}
    return rows.select("query_id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in measures.items()])


def mean_scores(scores: DataFrame) -> DataFrame:
    """One row of the means, 4 digits."""
    return scores.agg(*[F.round(F.avg(c), 4).alias(c) for c in scores.columns if c != "query_id"])


def gram_codes(text: str, lengths: list[int]) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of these lengths in a text."""
    a = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    out = [np.zeros(0, np.uint64)]
    for k in (k for k in lengths if k <= len(a)):
        h = np.full(len(a) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h + a[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.unique(np.concatenate(out))


def head_keys(low: str, size: int) -> list[str]:
    """The first `size` characters of a normalised text, with and without its leading number; all of them, if there are fewer."""
    return [k for k in dict.fromkeys((low[:size], re.sub("^[0-9]{1,3}", "", low)[:size])) if k]


def best_chunks(lines: DataFrame, chunks: DataFrame, overlap: int = 16) -> DataFrame:
    """line_id, chunk_id of lines(line_id, number, text) and chunks(chunk_id, ord, number, text): the first chunk in order that is the same passage as
    the line, one that bears the line's number before any other. Passages match only if the beginning of one, with or
    without its leading number, stands in the other, so a chunk is a candidate if its normalised text holds the first characters of the
    line's, as many as must be common (all of them, if there are fewer), or the line's those of the chunk's. Hashes of these keys are joined
    beside ids; a text is normalised once and meets its candidates only."""
    size = min(overlap, 16)

    def normal(df: DataFrame, *columns: Column) -> DataFrame:
        return written(df.select(*columns, match_normal(F.col("text")).alias("low")).where("low <> ''"), "normal")

    def coded(df: DataFrame, name: str, lengths: list[int] | None) -> DataFrame:
        """name, key: hashes of a text's keys, or of its runs of the given lengths."""
        schema = StructType().add(df.schema[name]).add("keys", ArrayType(LongType()))

        def codes(low: str) -> np.ndarray:
            found = gram_codes(low, lengths) if lengths is not None else np.concatenate([gram_codes(k, [len(k)]) for k in head_keys(low, size)] or [np.zeros(0, np.uint64)])
            return found.view(np.int64)

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    c = b.slice(at, 100)
                    yield pa.RecordBatch.from_arrays([c.column(0), pa.array([codes(x) for x in c.column(1).to_pylist()], pa.list_(pa.int64()))], [name, "keys"])

        return df.select(name, "low").mapInArrow(run, schema).select(name, F.explode("keys").alias("key"))

    def sizes(df: DataFrame) -> list[int]:
        """Lengths of the keys: one to size."""
        heads = F.array(F.col("low"), F.regexp_replace(F.col("low"), "^[0-9]{1,3}", ""))
        return [r[0] for r in df.select(F.explode(heads).alias("k")).select(F.least(F.length("k"), F.lit(size)).alias("n")).where("n > 0").distinct().collect()]

    li = normal(lines, F.col("line_id"), F.col("number").alias("n")).withColumnRenamed("low", "line")
    ch = normal(chunks, F.col("chunk_id"), F.col("ord"), F.col("number").alias("m")).withColumnRenamed("low", "chunk")
    line, chunk = li.withColumnRenamed("line", "low"), ch.withColumnRenamed("chunk", "low")
    forth = coded(chunk, "chunk_id", sizes(line)).join(written(coded(line, "line_id", None), "keys"), "key")
    back = coded(chunk, "chunk_id", None).join(written(coded(line, "line_id", sizes(chunk)), "keys"), "key")
    pairs = written(forth.select("line_id", "chunk_id").union(back.select("line_id", "chunk_id")).distinct(), "pairs")
    pairs = pairs.select(F.col("line_id").alias("l"), F.col("chunk_id").alias("c"))
    found = pairs.join(ch, F.col("c").eqNullSafe(F.col("chunk_id"))).join(li, F.col("l").eqNullSafe(F.col("line_id")))
    good = found.where(normals_match(F.col("line"), F.col("chunk"), overlap))
    own = F.when(F.col("n").eqNullSafe(F.col("m")) & F.col("n").isNotNull(), 0).otherwise(1)
    return good.groupBy("line_id").agg(F.min(F.struct(own.alias("own"), "ord", "chunk_id")).alias("best")).select("line_id", F.col("best.chunk_id").alias("chunk_id"))


__all__ = ["best_chunks", "ir_scores", "matched", "mean_scores"]
