from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS
from tillpath.operators import classifiers


def test_forest_keeps_the_place_of_each_row_in_its_trees(spark):
    """Rows are not led through every tree again for each level, and the trees are the same ones."""
    made = spark.range(300, numPartitions=2).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("b"),
        (F.col("id") % 7 + F.pmod(F.xxhash64("id"), F.lit(50)) / 10 > 5).cast("double").alias("label"),
    )
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(made).localCheckpoint()
    forest = classifiers._classifier("random_forest", 300, DEFAULTS, 5)
    assert forest.getCacheNodeIds()
    again = forest.copy().setCacheNodeIds(False)
    assert forest.fit(rows).toDebugString.split("\n")[1:] == again.fit(rows).toDebugString.split("\n")[1:]
