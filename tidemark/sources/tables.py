"""Reading and writing managed tables and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).saveAsTable(name)


def write_partitioned(df: DataFrame, name: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """Append matches columns by name, whatever their order in df."""
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(name):
        df.select(*spark.table(name).columns).write.insertInto(name)
    else:
        df.write.partitionBy(*columns).mode(mode).saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, columns: Sequence[str], buckets: int) -> None:
    """A table whose rows lie in files by a hash of the columns, each sorted by them.

    Tables with as many buckets on their common columns are joined and grouped by them without a shuffle. Rows are dealt
    by the same hash before the write, so a bucket is one file.
    """
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).mode("overwrite").saveAsTable(name)


def overwrite_partition(df: DataFrame, path: str, column: str, value: str) -> None:
    """Replaces one partition of a folder of Parquet files; the others stay."""
    df.withColumn(column, F.lit(value)).write.option("partitionOverwriteMode", "dynamic").partitionBy(column).mode("overwrite").parquet(path)


def replace_table(df: DataFrame, name: str) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.saveAsTable(name)


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def swap_table(df: DataFrame, name: str) -> None:
    """Written beside the old table, which then gives way: a failed write leaves the old one."""
    spark, made = df.sparkSession, f"{name}_new"
    replace_table(df, made)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {made} RENAME TO {name}")


def import_csv(spark: SparkSession, path: str, schema: str, header_column: str) -> DataFrame:
    """Header rows may stand anywhere, as files are joined: rows whose header_column holds its own name go."""
    return spark.read.schema(schema).csv(path).where(F.coalesce(F.col(header_column) != header_column, F.lit(True)))


def keyword_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of two fields separated by any white space -> spread_app_id, keyword."""
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path).select(fields.alias("f")).where(F.size("f") == 2).select(F.col("f")[0].alias("spread_app_id"), F.col("f")[1].alias("keyword"))


def export_training_set(df: DataFrame, path: str) -> int:
    """Rows as Parquet and their number beside them, in one pass over df's files."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    n = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(n,)], "rows long").coalesce(1).write.mode("overwrite").json(f"{path}/count")
    return n


def documents(df: DataFrame, id_column: str, fields: Sequence[str]) -> DataFrame:
    """(doc_id, body): the body is JSON and holds the id too."""
    return df.select(F.col(id_column).cast("string").alias("doc_id"), F.to_json(F.struct(id_column, *fields)).alias("body"))


def parsed(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    return df.select(F.from_json(body, schema).alias("d")).select("d.*")


def only_row(df: DataFrame) -> DataFrame:
    """df, which must hold exactly one row."""
    if (n := df.limit(2).count()) != 1:
        raise ValueError(f"one row is expected, not {n or 'none'}")
    return df
