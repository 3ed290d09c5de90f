"""Customer segmentation: K-Means on log-scaled R/F/M, profiles and names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tillpath.config import DEFAULTS, Settings
from tillpath.fixed_values import SEGMENT_NAMES
from tillpath.functions.numeric import half_up, ratio
from tillpath.operators.ranking import exact_quantiles

RFM = ["recency_days", "frequency", "monetary"]
_SCALED = [f"{c}_z" for c in RFM]


@dataclass(frozen=True)
class RfmScaler:
    """Mean and population deviation of log1p(R, F, M), learnt once and kept for scoring."""

    mean: dict[str, float]
    deviation: dict[str, float]

    @staticmethod
    def fit(scores: DataFrame) -> RfmScaler:
        # One row of six numbers.
        row = scores.agg(
            *[F.avg(F.log1p(F.col(c).cast("double"))).alias(f"mean_{c}") for c in RFM],
            *[F.stddev_pop(F.log1p(F.col(c).cast("double"))).alias(f"dev_{c}") for c in RFM],
        ).first()
        return RfmScaler(
            {c: row[f"mean_{c}"] or 0.0 for c in RFM}, {c: row[f"dev_{c}"] or 1.0 for c in RFM}
        )

    def transform(self, scores: DataFrame) -> DataFrame:
        return scores.withColumns({
            f"{c}_z": (F.log1p(F.col(c).cast("double")) - self.mean[c]) / F.lit(self.deviation[c])
            for c in RFM
        })


def rfm_features(scores: DataFrame, scaler: RfmScaler | None = None) -> DataFrame:
    """z-scores of log1p(R, F, M) in `recency_days_z`, `frequency_z`, `monetary_z`."""
    return (scaler or RfmScaler.fit(scores)).transform(scores)


def _vectors(scaled: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=_SCALED, outputCol="features").transform(scaled)


# Lloyd's steps end when no centre moves further, or after so many.
_TOLERANCE = 1e-4
_MOST_STEPS = 300
# Rows whose distances to all centres are held at once.
_SLICE = 2048


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of z-scores as one value each."""
    for batch in batches:
        rows = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["rows"])


def _nearest_sums(
    packed: Iterable[bytes], fits: list[np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One partition: per centre of every fit the sum and the count of its rows, and the cost of every fit.

    Fits with equally many centres are worked on together. A row belongs to the first of equally near centres.
    """
    width = fits[0].shape[1]
    starts = np.cumsum([0, *map(len, fits)])
    sums, costs = np.zeros((starts[-1], width + 1)), np.zeros(len(fits))
    groups = []
    for k in sorted({len(f) for f in fits}):
        members = [i for i, f in enumerate(fits) if len(f) == k]
        places = np.concatenate([np.arange(starts[i], starts[i] + k) for i in members])
        centres = np.concatenate([fits[i] for i in members])
        # Times (row, 1): the squared distance less the square of the row.
        groups.append((k, members, places, np.column_stack([-2 * centres, (centres * centres).sum(axis=1)])))
    for block in packed:
        rows = np.frombuffer(block).reshape(-1, width)
        for at in range(0, len(rows), _SLICE):
            part = rows[at:at + _SLICE]
            with_one = np.column_stack([part, np.ones(len(part))])
            squares = (part * part).sum(axis=1)
            for k, members, places, weights in groups:
                distances = (weights @ with_one.T).reshape(len(members), k, len(part))
                least = distances.min(axis=1)
                nearest = distances == least[:, None]
                if np.count_nonzero(nearest) > least.size:
                    nearest &= nearest.cumsum(axis=1) == 1
                sums[places] += nearest.reshape(len(places), len(part)).astype(float) @ with_one
                costs[members] += np.maximum(least + squares, 0).sum(axis=1)
    yield sums, costs


def _descend(packed: RDD, centres: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of every fit, from its starting centres by Lloyd's steps.

    All fits take each step in one pass; a fit that stands still leaves. Steps, end and cost (that of the centres
    before the last step) are those of MLlib, which makes a chain of passes for each fit.
    """
    centres, costs = list(centres), [0.0] * len(centres)
    moving = list(range(len(centres)))
    for _ in range(_MOST_STEPS):
        if not moving:
            break
        sent = packed.context.broadcast([centres[i] for i in moving])
        sums, found = packed.mapPartitions(lambda blocks: _nearest_sums(blocks, sent.value)).reduce(
            lambda one, other: (one[0] + other[0], one[1] + other[1])
        )
        sent.destroy()
        still, at = [], 0
        for i, cost in zip(moving, found):
            own = sums[at:at + len(centres[i])]
            at += len(own)
            # A centre without rows stays.
            moved = np.where(own[:, -1:] > 0, own[:, :-1] / np.maximum(own[:, -1:], 1), centres[i])
            costs[i] = float(cost)
            if (((moved - centres[i]) ** 2).sum(axis=1) > _TOLERANCE**2).any():
                still.append(i)
            centres[i] = moved
        moving = still
    return list(zip(centres, costs))


def _nearest(place: list[Column], centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first of equally near ones."""
    squares = [sum((p - float(c)) * (p - float(c)) for p, c in zip(place, centre)) for centre in centres]
    return F.array_min(F.array(*[F.struct(d, F.lit(i)) for i, d in enumerate(squares)]))["col2"]


def _best_fits(
    scaled: DataFrame, vectors: DataFrame, ks: Iterable[int], seed: int, restarts: int
) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the centres and cost of the cheapest fit over several seeds; ties keep the first.

    MLlib draws the starting centres of every fit, a few passes each and a few fits side by side. All fits of
    all k then descend together, so the passes do not add up over the fits.
    """
    tasks = [(k, seed + i) for k in ks for i in range(restarts)]

    def start(task: tuple[int, int]) -> np.ndarray:
        k, own_seed = task
        return np.array(KMeans(k=k, seed=own_seed, maxIter=0, solver="row").fit(vectors).clusterCenters())

    with ThreadPoolExecutor(max_workers=4) as pool:
        starts = list(pool.map(start, tasks))
    packed = scaled.select(*_SCALED).mapInArrow(_packed, "rows binary").rdd.map(lambda row: row["rows"])
    # One wave of tasks per pass.
    packed = packed.coalesce(packed.context.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = _descend(packed, starts)
    finally:
        packed.unpersist()
    best: dict[int, tuple[np.ndarray, float]] = {}
    for (k, _), fit in zip(tasks, fits):
        if k not in best or fit[1] < best[k][1]:
            best[k] = fit
    return best


@dataclass(frozen=True)
class Segmenter:
    """A fitted segmentation: scaler and centres of the clusters."""

    scaler: RfmScaler
    centers: list[list[float]]

    def predict(self, scores: DataFrame) -> DataFrame:
        """Add `cluster_id`, one map-side pass."""
        scaled = self.scaler.transform(scores)
        nearest = _nearest([F.col(c) for c in _SCALED], np.array(self.centers))
        return scaled.withColumn("cluster_id", nearest).drop(*_SCALED)


def kmeans_fit(
    scores: DataFrame,
    k: int | None = None,
    settings: Settings = DEFAULTS,
    *,
    restarts: int = 10,
) -> Segmenter:
    scaler = RfmScaler.fit(scores)
    scaled = scaler.transform(scores)
    vectors = _vectors(scaled).select("features")
    vectors.persist(StorageLevel.MEMORY_AND_DISK)
    k = k or settings.segments
    try:
        centres, _ = _best_fits(scaled, vectors, [k], settings.seed, restarts)[k]
    finally:
        vectors.unpersist()
    return Segmenter(scaler, centres.tolist())


def kmeans_sweep(
    scores: DataFrame,
    ks: range = range(2, 11),
    settings: Settings = DEFAULTS,
    *,
    restarts: int = 10,
) -> DataFrame:
    """(k, inertia, silhouette) per number of clusters.

    All fits of all k take their steps in common passes over the cached rows, each evaluation is a
    distributed job. The silhouette uses squared distances, which needs one pass instead of all pairs.
    """
    scaled = rfm_features(scores)
    vectors = _vectors(scaled).select("features")
    vectors.persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    place = [vector_to_array("features")[i] for i in range(len(_SCALED))]
    rows = []
    try:
        for k, (centres, cost) in _best_fits(scaled, vectors, ks, settings.seed, restarts).items():
            silhouette = evaluator.evaluate(vectors.withColumn("prediction", _nearest(place, centres)))
            rows.append((k, cost, float(silhouette)))
    finally:
        vectors.unpersist()
    return scores.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double").select(
        "k", "inertia", half_up(F.col("silhouette"), 4).alias("silhouette")
    )


def best_k(sweep: DataFrame) -> DataFrame:
    """The number of clusters with the highest silhouette; the smaller one among equals."""
    return sweep.agg(
        F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("best_k"),
        F.max("silhouette").alias("silhouette"),
    )


def segment_profiles(clustered: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Per cluster: size, mean R/F/M, median M, mean RFM total."""
    n = F.count(F.lit(1))
    profiles = clustered.groupBy("cluster_id").agg(
        n.alias("customer_count"),
        ratio(F.sum("recency_days"), n).alias("avg_recency"),
        ratio(F.sum("frequency"), n).alias("avg_frequency"),
        ratio(F.sum("monetary"), n).alias("avg_monetary"),
        ratio(F.sum("rfm_total"), n).alias("avg_rfm_total"),
    )
    medians = exact_quantiles(
        clustered, "monetary", {"median": 0.5}, group=["cluster_id"], partitions=partitions
    )
    return profiles.join(medians, "cluster_id").select(
        "cluster_id",
        "customer_count",
        "avg_recency",
        "avg_frequency",
        "avg_monetary",
        half_up(F.col("median")).alias("median_monetary"),
        "avg_rfm_total",
    )


def _name() -> Column:
    recent = F.col("avg_recency") < F.col("mid_recency")
    frequent = F.col("avg_frequency") > F.col("mid_frequency")
    spending = F.col("avg_monetary") > F.col("mid_monetary")
    label = None
    for (r, f, m), name in SEGMENT_NAMES.items():
        test = (recent == r) & (frequent == f) & (spending == m)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label


def segment_names(profiles: DataFrame) -> DataFrame:
    """Name each cluster by its means against the medians of all cluster means.

    Clusters are taken by falling RFM total; one whose name is taken gets its id appended. The
    frame has one row per cluster.
    """
    mids = profiles.agg(
        F.median("avg_recency").alias("mid_recency"),
        F.median("avg_frequency").alias("mid_frequency"),
        F.median("avg_monetary").alias("mid_monetary"),
    )
    by_name = Window.partitionBy("_name").orderBy(F.col("avg_rfm_total").desc(), "cluster_id")
    repeated = F.row_number().over(by_name) > 1
    with_id = F.format_string("%s (%d)", "_name", "cluster_id")
    return (
        profiles.crossJoin(F.broadcast(mids))
        .withColumn("_name", _name())
        .withColumn("segment_name", F.when(repeated, with_id).otherwise(F.col("_name")))
        .select(*profiles.columns, "segment_name")
    )


def assign_segments(clustered: DataFrame, names: DataFrame) -> DataFrame:
    """Customers with cluster id and name; a cluster without a name is `Segment <id>`.

    The broadcast side has one row per cluster.
    """
    lookup = names.select("cluster_id", "segment_name")
    return clustered.join(F.broadcast(lookup), "cluster_id", "left").withColumn(
        "segment_name",
        F.coalesce("segment_name", F.format_string("Segment %d", "cluster_id")),
    )
