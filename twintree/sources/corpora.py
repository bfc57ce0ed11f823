"""Tables as path-shaped entries: path, content, file_size, ctime, phys, n_extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import depth_of, name_of, parent_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without a zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def as_entries(rows: DataFrame) -> DataFrame:
    """rows: path, content and, if known, ctime, phys, n_extents."""
    have = set(rows.columns)
    path, content = F.col("path"), F.col("content").cast("string")
    return rows.select(
        "path",
        parent_path(path).alias("parent_path"),
        name_of(path).alias("name"),
        depth_of(path).alias("depth"),
        F.lit(True).alias("is_file"),
        F.lit(False).alias("is_dir"),
        F.octet_length(content).cast("long").alias("file_size"),
        (F.col("ctime") if "ctime" in have else F.lit(0)).cast("long").alias("ctime"),
        (F.col("phys") if "phys" in have else F.lit(None)).cast("long").alias("phys"),
        (F.col("n_extents") if "n_extents" in have else F.lit(None)).cast("int").alias("n_extents"),
        content.alias("content"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return as_entries(table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("/docs"), "source", "lang", "doc_id").alias("path"),
        F.col("text").alias("content"), F.lit(0).alias("ctime"), (F.col("doc_id") + 1).alias("phys"), (F.floor(size / 4096) + 1).alias("n_extents")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").withColumn("ordinal", F.row_number().over(order))
    return as_entries(rows.select(F.concat_ws("/", F.lit("/orders"), "l_orderkey", "ordinal").alias("path"),
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("content"), epoch_seconds(F.col("l_shipdate")).alias("ctime"),
        F.col("l_partkey").alias("phys"), F.col("l_suppkey").alias("n_extents")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "events").withColumn("day", day)
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")))
    return as_entries(rows.select(F.concat_ws("/", F.lit("/events"), "user_id", "day", "ordinal").alias("path"), F.col("event_type").alias("content"),
        epoch_seconds(F.col("ts")).alias("ctime"), (F.col("event_id") + 1).alias("phys"), F.lit(1).alias("n_extents")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_entries(table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("/conv"), "conv_id", "turn").alias("path"),
        F.col("text").alias("content")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of the URL, without what follows ? or # and without trailing slashes."""
    whole = F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+$", "")
    return as_entries(table(spark, sf_dir, "pages").select(F.concat(F.lit("/pages/"), whole).alias("path"), F.col("html").alias("content")))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree for each return flag; equal order and line numbers align."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("content"))
    return as_entries(rows.select(F.concat_ws("/", F.lit("/flags"), "l_returnflag", "l_orderkey", "l_linenumber").alias("path"), "content"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return as_entries(rows.select(F.concat_ws("/", F.lit("/cust"), "r_name", "n_name", "c_custkey").alias("path"), F.col("c_mktsegment").alias("content")))
