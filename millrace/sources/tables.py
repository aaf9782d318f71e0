"""Keyed tables as DataFrames: selection, upserts, deletes, manifests, caches, and a versioned folder that holds a table's state.

Every change is a new DataFrame; Store.save() writes it beside the old one and readers see it when it is whole, so a lost executor
or driver leaves the last version as it was."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def where(df: DataFrame, equal: dict | None) -> DataFrame:
    """Rows that have all these values; null means null."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), (equal or {}).items(), df)


def select(df: DataFrame, equal: dict | None = None, columns: list[str] | None = None, order_by: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = where(df, equal)
    rows = rows.orderBy(*order_by) if order_by else rows
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(limit) if limit is not None else rows
    return rows.select(*columns) if columns else rows


def upserted(df: DataFrame, rows: DataFrame, keys: list[str], on_conflict: str = "update") -> DataFrame:
    """df with rows: on_conflict update replaces the row of a key, skip keeps it. rows must hold a key once."""
    if on_conflict == "skip":
        return df.unionByName(rows.join(df.select(*keys), keys, "left_anti").select(df.columns))
    return df.join(rows.select(*keys), keys, "left_anti").select(df.columns).unionByName(rows.select(df.columns))


def updated(df: DataFrame, values: dict, equal: dict) -> DataFrame:
    """Columns set in the rows that have all these values."""
    hit = reduce(lambda a, kv: a & F.col(kv[0]).eqNullSafe(F.lit(kv[1])), equal.items(), F.lit(True))
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, equal: dict) -> DataFrame:
    hit = reduce(lambda a, kv: a & F.col(kv[0]).eqNullSafe(F.lit(kv[1])), equal.items(), F.lit(True))
    return df.where(~hit)


def replaced(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """df after all rows of the keys that occur in rows are replaced by them (a document's chunks, an index's postings)."""
    return df.join(rows.select(*keys).distinct(), keys, "left_anti").select(df.columns).unionByName(rows.select(df.columns))


def counted(df: DataFrame, equal: dict | None = None) -> DataFrame:
    return where(df, equal).agg(F.count(F.lit(1)).alias("n"))


def to_index(files: DataFrame, manifest: DataFrame, model_version: str, config_hash: str) -> DataFrame:
    """Files (tenant_id, md5, ...) that the manifest (tenant_id, md5, model_version, config_hash) does not have in this version."""
    done = manifest.where((F.col("model_version") == model_version) & (F.col("config_hash") == config_hash)).select("tenant_id", "md5")
    return files.join(done, ["tenant_id", "md5"], "left_anti")


def with_cached(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks (fingerprint, ...) with the vector that the cache (fingerprint, vector) has for them, null where it must be made."""
    return chunks.join(cache.select("fingerprint", F.col("vector").alias("cached")), "fingerprint", "left")


def aggregated(df: DataFrame, pipeline: list[dict]) -> DataFrame:
    """A document pipeline of $match, $project, $unwind, $group ($sum, $avg, $min, $max, $first), $sort, $skip and $limit as one plan."""
    ops = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(v)}

    def value(x):
        return F.col(x[1:]) if isinstance(x, str) and x.startswith("$") else F.lit(x)

    def stage(d: DataFrame, s: dict) -> DataFrame:
        (name, spec), = s.items()
        if name == "$match":
            for field, cond in spec.items():
                for op, v in (cond.items() if isinstance(cond, dict) else [("$eq", cond)]):
                    d = d.where(ops[op](F.col(field), v))
            return d
        if name == "$project":
            return d.select(*[F.col(k) if v in (1, True) else value(v).alias(k) for k, v in spec.items() if v not in (0, False)])
        if name == "$unwind":
            field = spec.lstrip("$")
            return d.withColumn(field, F.explode(field))
        if name == "$group":
            fs = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first}
            made = [fs[op](value(v)).alias(k) for k, x in spec.items() if k != "_id" for op, v in x.items()]
            key = spec["_id"]
            keys = [value(v).alias(k) for k, v in key.items()] if isinstance(key, dict) else [] if key is None else [value(key).alias("_id")]
            return d.groupBy(*keys).agg(*made)
        if name == "$sort":
            return d.orderBy(*[F.col(k).asc() if v > 0 else F.col(k).desc() for k, v in spec.items()])
        if name == "$skip":
            return d.offset(spec)
        if name == "$limit":
            return d.limit(spec)
        raise ValueError(f"unknown stage {name}")

    return reduce(stage, pipeline, df)


class Store:
    """The versions of one table under a folder of any store that Spark can write."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Numbers of the whole versions (Spark leaves _SUCCESS in them)."""
        top = self._Path(self.path)
        if not self._fs.exists(top):
            return []
        found = [s.getPath() for s in self._fs.listStatus(top) if s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if self._fs.exists(self._Path(p, "_SUCCESS")))

    def load(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def save(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """df as the next version; older ones but the last `keep` go."""
        old = self.versions()
        n = (old[-1] if old else 0) + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v{n}")
        for v in old[: -self.keep + 1] if self.keep > 1 else old:
            self._fs.delete(self._Path(f"{self.path}/v{v}"), True)
        return self.spark.read.parquet(f"{self.path}/v{n}")

    def upsert(self, rows: DataFrame, keys: list[str], on_conflict: str = "update") -> DataFrame:
        now = self.load()
        return self.save(rows if now is None else upserted(now, rows, keys, on_conflict))

    def delete(self, equal: dict) -> DataFrame:
        return self.save(deleted(self.load(), equal))

    def drop(self) -> None:
        self._fs.delete(self._Path(self.path), True)
