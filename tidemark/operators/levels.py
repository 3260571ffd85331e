"""Steps that change shared resources in a given order, in as few rounds as that order allows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import new_folder, written


def placed_by_level(rows: DataFrame, resource: Sequence[str], step: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """rows with `level` and `next_level`, and the number of levels.

    rows: one for each resource that a step changes. Steps of one resource follow each other in `order`, which has no
    ties between steps; steps that share no resource don't wait for each other. A step's level is the number of steps on
    the longest chain that ends with it. next_level is that of the resource's next step, 0 if it is the last one.

    The edges between a resource's consecutive steps that are left after k rounds are those that begin k levels up, so
    each round reads fewer; there are as many rounds as levels.
    """
    spark = rows.sparkSession
    chain = Window.partitionBy(*resource).orderBy(*order)  # one row a step of the resource
    chained = written(rows.withColumn("step", F.struct(*step)).withColumn("next", F.lead("step").over(chain)), "steps")
    edges = chained.where("next is not null").select(F.col("step").alias("u"), F.col("next").alias("v")).distinct()
    folder, top = new_folder(spark, "edges"), 1
    while True:
        edges.write.parquet(f"{folder}/begins={top}")
        edges = spark.read.schema(edges.schema).parquet(f"{folder}/begins={top}")
        if not edges.limit(1).count():
            break
        edges = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        top += 1
    levels = written(spark.read.parquet(folder).groupBy("v").agg((F.max("begins") + 1).alias("level")), "levels")
    placed = chained.join(levels.withColumnRenamed("v", "step"), "step", "left").withColumn("level", F.coalesce("level", F.lit(1)))
    after = levels.select(F.col("v").alias("next"), F.col("level").alias("next_level"))
    placed = placed.join(after, "next", "left").withColumn("next_level", F.coalesce("next_level", F.when(F.col("next").isNull(), 0).otherwise(1)))
    path = new_folder(spark, "placed")
    placed.drop("step", "next").write.partitionBy("level").parquet(path)
    return spark.read.parquet(path), top


def served_by_level(placed: DataFrame, levels: int, resource: Sequence[str], amount: str, serve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows with what `serve` has added (`taken`), level by level.

    serve gets a level's rows with `left`, what the steps before have left of the resource's amount, and adds `taken`.
    A row is read in its own round alone; what it leaves is filed under the next level that wants it.
    """
    spark, out = placed.sparkSession, new_folder(placed.sparkSession, "served")
    for k in range(1, levels + 1):
        now = placed.where(F.col("level") == k).drop("level")
        if k == 1:
            now = now.withColumn("left", F.col(amount))
        else:
            given = spark.read.parquet(f"{out}/round=*/to={k}").select(*resource, F.col("rest").alias("left"))
            now = now.join(given, [*resource], "left").withColumn("left", F.coalesce("left", F.col(amount)))
        served = serve(now).withColumn("rest", F.col("left") - F.col("taken")).withColumnRenamed("next_level", "to")
        served.write.partitionBy("to").parquet(f"{out}/round={k}")
    return spark.read.parquet(out).drop("round", "to", "left", "rest")
