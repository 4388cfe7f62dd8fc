"""The page cache: JSON or Parquet records by kind and address; the table of pages that runs read offline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
PAGE = "status int, text string, final_url string, content_type string, kind string, error string, blocked boolean, truncated boolean, transient boolean, retry_after double, extra map<string,string>"
SCHEMA = "cache_format int, kind string, url string, stored_at string, data struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in PAGE.split(", ")) + ",date:string,snapshot_url:string>"


def cache_key(kind: Column, url: Column) -> Column:
    """SHA-256 of kind, line feed and address, in hexadecimal."""
    return F.sha2(F.concat(kind, F.lit("\n"), url), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Valid records of a folder of JSON files: of this format, and each under its own key's name."""
    df = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("_file", F.col("_metadata.file_name"))
    named = F.regexp_extract("_file", "^([0-9a-f]{64})", 1)
    return df.where((F.col("cache_format") == FORMAT) & F.col("url").isNotNull() & (named == cache_key(F.col("kind"), F.col("url")))).drop("_file")


def cacheable(pages: DataFrame) -> DataFrame:
    """Results that may be kept: neither refused by policy nor passing failures."""
    return pages.where(~F.coalesce("blocked", F.lit(False)) & ~F.coalesce("transient", F.lit(False)))


def write_cache(records: DataFrame, path: str) -> None:
    """Appends records as Parquet, clustered by key so that reads by address touch few files."""
    records.withColumn("cache_key", cache_key(F.col("kind"), F.col("url"))).repartitionByRange("cache_key").write.mode("append").parquet(path)
