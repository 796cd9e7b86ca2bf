"""Connected components of a table of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable; nodes without links don't appear.

    In each round a node first asks its label for its own (pointer jumping), then takes the
    least label among its neighbours and hands it on to the root of its tree, so rounds grow
    with the logarithm of a component's width.  Every round is a written table in the shared
    folder; the one before it is deleted.

    The joins on a label and on a neighbour have a component or a hub as their key.  Their sides
    come straight from written tables, so Spark splits a hot key's rows over tasks.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = stored(pairs.union(pairs.select("v", "u")).distinct(), "links")
    path = new_path(spark, "labels")
    now = stored(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels", path)
    while True:
        upper = now.select(F.col("u").alias("label"), F.col("label").alias("upper"))
        jumped = now.join(upper, "label").select("u", F.col("label").alias("old"), F.col("upper").alias("label"))
        near = pairs.join(jumped.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        best = jumped.join(near, "u").select("u", "old", "label", F.least("label", "near").alias("new"))
        # A root takes the least label that its tree has met.
        roots = best.groupBy("label").agg(F.min("new").alias("root_new")).where("root_new < label").select(F.col("label").alias("u"), "root_new")
        next_path = new_path(spark, "labels")
        after = stored(best.join(roots, "u", "left").select("u", "old", F.least("new", F.coalesce("root_new", "new")).alias("label")), "labels", next_path)
        changed = not after.where("label <> old").isEmpty()
        drop_path(spark, path)
        path, now = next_path, after.select("u", "label")
        if not changed:
            return now.withColumnRenamed("u", "node")
