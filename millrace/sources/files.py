"""Files in and out: texts, JSON lines, JSON sections, object listings, JDBC options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.records import format_of
from millrace.functions.text import strip


def objects(spark: SparkSession, path: str, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """path, size, modified, content of the files under a path, of names that match a glob if one is given; the first `limit` by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return rows if limit is None else rows.orderBy("path").limit(limit)


def texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, format, text, status of text files: bytes that are no UTF-8 become U+FFFD, blanks at the ends go; a file without text is
    `partial`."""
    text = strip(F.make_valid_utf8(F.col("content").cast("string")))
    rows = objects(spark, path, pattern).select("path", format_of(F.col("path")).alias("format"), text.alias("text"))
    return rows.withColumn("status", F.when(F.col("text") == "", F.lit("partial")).otherwise(F.lit("ok")))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """One JSON object a line; bad lines are left out, or an error if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Rows at the end of a folder of JSON lines (audit logs, dead letters, reports)."""
    df.write.mode("append").json(path)


def sections(spark: SparkSession, path: str, title: str | None = None) -> DataFrame:
    """path, place, title, body of the `sections` of JSON files (a file holds one object over several lines); of one title if given."""
    schema = "sections array<struct<title:string,content:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode("sections").alias("place", "s"))
    rows = rows.select("path", "place", F.col("s.title").alias("title"), F.col("s.content").alias("body"))
    return rows if title is None else rows.where(F.col("title") == title)


def jdbc_options(url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **more: str) -> dict[str, str]:
    """Options of spark.read.format("jdbc"): with a numeric key and its bounds the table is read in so many parts side by side."""
    out = {"url": url, "dbtable": table, "fetchsize": "10000", **more}
    if key and bounds:
        out |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def profile(spark: SparkSession, tenant: str, user: str, raw: dict) -> tuple[DataFrame, DataFrame]:
    """(facts: tenant_id, user_id, key, value, source; entities: alias, canonical_id, display_name) of one user's external profile."""
    facts = [(tenant, user, str(f["key"]), str(f.get("value", "")), f.get("source")) for f in raw.get("facts") or [] if f.get("key")]
    entities = [(a, e.get("canonical_id"), e.get("display_name")) for a, e in (raw.get("entities") or {}).items()]
    return spark.createDataFrame(facts, "tenant_id string, user_id string, key string, value string, source string"), spark.createDataFrame(entities, "alias string, canonical_id string, display_name string")
