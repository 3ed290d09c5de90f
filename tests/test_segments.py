from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tillpath.operators import segments


@pytest.fixture(scope="module")
def spread(spark):
    """400 customers without clear groups, so that fits take many steps."""
    key = F.col("customer_id")

    def draw(name: str, most: int):
        return F.pmod(F.xxhash64(key, F.lit(name)), F.lit(most))

    return spark.range(400, numPartitions=3).withColumnRenamed("id", "customer_id").select(
        "customer_id", draw("r", 900).cast("int").alias("recency_days"), (draw("f", 30) + 1).alias("frequency"),
        draw("m", 90000).cast("decimal(22,2)").alias("monetary"),
    ).localCheckpoint()


def test_fits_in_common_passes_are_those_of_mllib(spread):
    scaled = segments.rfm_features(spread)
    vectors = segments._vectors(scaled).select("features").persist()
    found = segments._best_fits(scaled, vectors, range(2, 6), 42, 3)
    for k, (centres, cost) in found.items():
        fits = [KMeans(k=k, seed=42 + i, maxIter=300).fit(vectors) for i in range(3)]
        best = min(fits, key=lambda model: model.summary.trainingCost)
        assert cost == pytest.approx(best.summary.trainingCost)
        assert np.allclose(centres, best.clusterCenters())
    vectors.unpersist()


def test_passes_do_not_add_up_over_fits(spark, spread):
    """A job per step of the longest fit, however many fits there are."""
    scaled = segments.rfm_features(spread)
    packed = scaled.select(*segments._SCALED).mapInArrow(segments._packed, "rows binary").rdd.map(
        lambda row: row["rows"]
    ).persist()
    first = [list(r) for r in scaled.select(*segments._SCALED).take(12)]
    starts = [np.array(first[i:i + k]) for k in range(2, 6) for i in range(6)]

    def jobs(group: str, own: list[np.ndarray]) -> int:
        spark.sparkContext.setJobGroup(group, group)
        try:
            segments._descend(packed, own)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    alone = [jobs(f"alone-{i}", [s]) for i, s in enumerate(starts)]
    assert jobs("together", starts) == max(alone) < sum(alone)
    packed.unpersist()


def test_a_row_between_equal_centres_counts_once():
    rows = np.array([[0.0, 0.0, 0.0], [4.0, 0.0, 0.0], [2.0, 0.0, 0.0]])
    fits = [np.array([[0.0, 0.0, 0.0], [4.0, 0.0, 0.0]]), np.array([[1.0, 0.0, 0.0]] * 2)]
    (sums, costs), = segments._nearest_sums([rows.tobytes()], fits)
    assert sums[:, -1].tolist() == [2.0, 1.0, 3.0, 0.0]
    assert sums[:, 0].tolist() == [2.0, 4.0, 6.0, 0.0]
    assert costs.tolist() == [4.0, 11.0]
