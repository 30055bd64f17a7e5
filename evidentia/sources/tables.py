"""Readers of tables and document folders, and keyed writes over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_documents(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A namespace kept as one JSON document per file; the schema is declared, never inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(folder)


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files below a folder with path, size, modification time and text; tool folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    hidden = F.col("path").rlike(r"/(node_modules|\.git|\.data)/")
    return files.where(~hidden).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("text"))


def snapshot(df: DataFrame, folder: str, version: int, partition_by: list[str] | None = None) -> None:
    """Write a published snapshot: its Parquet data, then one pointer row that readers follow."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{folder}/v={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder}/_published_versions")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The latest published snapshot of a folder."""
    version = spark.read.schema("version long").json(f"{folder}/_published_versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/v={version}")


def get(df: DataFrame, key: str, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == F.lit(key))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new put in by key."""
    return old.join(new, key, "left_anti").unionByName(new)


def import_missing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old and those rows of new whose key it lacks."""
    return old.unionByName(new.join(old, key, "left_anti"))


def import_latest(old: DataFrame, new: DataFrame, key: str = "id", updated: str = "updated_at") -> DataFrame:
    """Per key the row updated last; a missing time is the oldest, and of equal times the incoming row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.coalesce(F.col(updated).cast("string"), F.lit("")).desc(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_new")


def compare_and_swap(old: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """changes (key, expected, version, ...) with applied: whether the key's version is the expected one, null meaning absent."""
    now = old.select(F.col(key), F.col("version").alias("_now"))
    return changes.join(now, key, "left").withColumn("applied", F.col("_now").eqNullSafe(F.col("expected"))).drop("_now")


def delete(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def delete_expected(old: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """old without the rows that keys (key, expected) names with their version, and keys with deleted. A null expectation
    names any version; a row whose version differs, or that is not there, is not deleted."""
    now = old.select(F.col(key), F.col("version").alias("_now"), F.lit(True).alias("_there"))
    met = keys.join(now, key, "left")
    deleted = F.coalesce(F.col("_there") & (F.col("expected").isNull() | (F.col("expected") == F.col("_now"))), F.lit(False))
    told = met.select(*keys.columns, deleted.alias("deleted"))
    return old.join(told.where("deleted").select(key).distinct(), key, "left_anti"), told
