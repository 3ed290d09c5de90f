from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpath import schemas
from tillpath.functions.numeric import risk_tier
from tillpath.operators import classifiers, features, merging, metrics, segments, serving


@pytest.fixture(scope="module")
def three_groups(spark):
    """Three well separated groups in R/F/M, 40 customers each."""
    centers = [(5, 60, 90000), (120, 12, 4000), (600, 1, 60)]
    data = [
        (g * 100 + i, r + i % 3, f + i % 2, Decimal(m + i), 15 - 5 * g)
        for g, (r, f, m) in enumerate(centers) for i in range(40)
    ]
    return spark.createDataFrame(
        data, "customer_id long, recency_days int, frequency long, monetary decimal(22,2), rfm_total int"
    )


def test_sweep_prefers_three_clusters(three_groups):
    sweep = segments.kmeans_sweep(three_groups, range(2, 6))
    assert segments.best_k(sweep).first()["best_k"] == 3
    costs = [r["inertia"] for r in sweep.orderBy("k").collect()]
    assert costs[0] > costs[1]


def test_clusters_match_the_planted_groups(three_groups):
    fitted = segments.kmeans_fit(three_groups, 3, restarts=3)
    assert len(fitted.centers) == 3
    clustered = fitted.predict(three_groups)
    pairs = clustered.select((F.col("customer_id") / 100).cast("int").alias("g"), "cluster_id").distinct()
    assert pairs.count() == 3
    named = segments.segment_names(segments.segment_profiles(clustered))
    names = {r["segment_name"] for r in named.collect()}
    assert "Champions" in names and len(names) == 3


def test_scaled_features_have_mean_zero_and_unit_deviation(three_groups):
    row = segments.rfm_features(three_groups).agg(
        F.avg("monetary_z").alias("m"), F.stddev_pop("monetary_z").alias("s")
    ).first()
    assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1)


def test_repeated_names_get_the_cluster_id(spark):
    profiles = spark.createDataFrame(
        [(0, 10.0, 9.0, 90.0, 14.0), (1, 11.0, 8.0, 80.0, 12.0), (2, 300.0, 1.0, 5.0, 4.0),
         (3, 310.0, 1.5, 6.0, 5.0)],
        "cluster_id int, avg_recency double, avg_frequency double, avg_monetary double, avg_rfm_total double",
    )
    got = {r["cluster_id"]: r["segment_name"] for r in segments.segment_names(profiles).collect()}
    assert got == {0: "Champions", 1: "Champions (1)", 3: "Lost Low-Value", 2: "Lost Low-Value (2)"}
    clustered = spark.createDataFrame([(7, 0), (8, 9)], "customer_id long, cluster_id int")
    named = segments.assign_segments(clustered, segments.segment_names(profiles))
    assert rows(named.select("customer_id", "segment_name")) == [(7, "Champions"), (8, "Segment 9")]


@pytest.fixture(scope="module")
def planted(spark):
    """600 customers; churn depends on order rate, with some noise."""
    key = F.col("customer_id")
    noise = (F.pmod(F.xxhash64(key), F.lit(100)) / 100.0)
    label = key % 2 == 0
    return spark.range(600).withColumnRenamed("id", "customer_id").select(
        "customer_id",
        F.when(label, 2 + noise * 4).otherwise(5 + noise * 6).alias("frequency"),
        (noise * 1000).alias("monetary"),
        (noise * 20 + 3).alias("avg_order_value"),
        F.when(key % 50 != 0, noise / 5).alias("return_rate"),
        (100 + key).cast("int").alias("tenure_days"),
        (noise * 3).alias("avg_items_per_order"),
        F.when(label, -1).otherwise(1).cast("long").alias("purchase_trend"),
        F.when(key % 3 == 0, "Europe").when(key % 3 == 1, "UK").alias("region"),
        F.lit("Direct").alias("acquisition_channel"),
        F.lit("25-34").alias("age_group"),
        label.alias("churn_label"),
    )


def test_split_is_exact_and_repeatable(planted):
    one = features.stratified_split(planted.repartition(1), partitions=1)
    many = features.stratified_split(planted.repartition(7), partitions=5)
    sizes = rows(one.groupBy("churn_label", "is_test").count())
    assert sizes == [(False, False, 240), (False, True, 60), (True, False, 240), (True, True, 60)]
    assert one.exceptAll(many).count() == 0


def test_features_are_computed_once_for_training(spark, planted, tmp_path):
    """Encoder, bounds of the split and its rows read the staged features."""
    computed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        computed.add(1)
        return value

    watched = planted.withColumn("frequency", counted(F.col("frequency").cast("double")))
    data = classifiers.prepare(watched)
    assert data.rows.count() == planted.count() == computed.value


def test_imputing_and_encoding(planted):
    done = features.encode_categories(features.impute(planted))
    assert done.where("return_rate IS NULL OR region IS NULL").count() == 0
    assert rows(done.select("region", "region_enc").distinct()) == [
        ("Europe", 0.0), ("UK", 1.0), ("Unknown", 2.0),
    ]


def test_scaling_ignores_test_rows_and_constant_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, False), (3.0, 5.0, False), (100.0, 5.0, True)], "a double, b double, is_test boolean"
    )
    assert rows(features.scale_features(df, ["a", "b"])) == [
        (-1.0, 0.0, False), (1.0, 0.0, False), (98.0, 0.0, True),
    ]


@pytest.mark.parametrize("name", classifiers.MODELS)
def test_models_find_the_planted_signal(spark, planted, name, tmp_path):
    from tillpath.sources.tables import full_refresh

    full_refresh(spark.range(3), str(tmp_path / "t"))  # a metric observed before must not matter
    data = classifiers.prepare(planted)
    model = classifiers.fit_model(name, data, rounds=10)
    scored = classifiers.predict(name, model, data.test)
    assert scored.count() == 120
    assert metrics.auc(scored).first()["auc_roc"] > 0.95
    importance = classifiers.feature_importance(model, spark).collect()
    assert importance[0]["feature"] in ("frequency", "purchase_trend")
    assert [r["importance"] for r in importance] == sorted((r["importance"] for r in importance), reverse=True)
    everyone = classifiers.score_all(planted, model, data.encoder)
    assert everyone.count() == 600
    assert everyone.where("churn_probability NOT BETWEEN 0 AND 1").count() == 0


def test_metrics_by_hand(spark):
    scored = spark.createDataFrame(
        [("m", 1, 0.9), ("m", 1, 0.5), ("m", 0, 0.5), ("m", 0, 0.1), ("m", 1, 0.2), ("n", 0, 0.3), ("n", 1, 0.3)],
        "model string, label int, score double",
    )
    got = {r["model"]: r for r in metrics.evaluate_models(scored, partitions=3).collect()}
    m = got["m"]
    # Pairs: .9 beats both; .5 ties one and beats one; .2 beats one: (2 + 1.5 + 1) / 6.
    assert m["auc_roc"] == 0.75
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.6667, 0.6667, 0.6667, 0.6)
    assert got["n"]["auc_roc"] == 0.5 and got["n"]["precision"] == 0.0
    assert metrics.best_model(metrics.evaluate_models(scored)).first()["model"] == "m"
    points = rows(metrics.roc_points(scored).where("model = 'm'").select("threshold", "fpr", "tpr"))
    assert points == [(0.1, 1.0, 1.0), (0.2, 0.5, 1.0), (0.5, 0.5, pytest.approx(2 / 3)), (0.9, 0.0, pytest.approx(1 / 3))]
    assert rows(metrics.confusion_matrix(scored)) == [("m", 0, 1, 1), ("m", 1, 1, 2), ("n", 0, 1, 0), ("n", 1, 1, 0)]
    best = metrics.threshold_sweep(scored).where("model = 'm'").first()
    # At 0.11 .. 0.20 nothing is missed and one customer is called in vain; the first wins.
    assert (best["threshold"], best["cost"], best["fp"], best["fn"]) == (0.11, 10.0, 1, 0)


def test_scores_on_a_threshold_pass_it(spark):
    scored = spark.createDataFrame([("m", 1, 0.29), ("m", 0, 0.28)], "model string, label int, score double")
    costs = {r["threshold"]: (r["fp"], r["fn"]) for r in metrics.threshold_costs(scored).collect()}
    assert costs[0.29] == (0, 0) and costs[0.3] == (0, 1) and costs[0.28] == (1, 0)
    assert len(costs) == 80


def test_risk_tiers(spark):
    df = spark.createDataFrame([(0.39,), (0.4,), (0.7,), (0.71,), (None,)], "p double")
    got = df.select(risk_tier(F.col("p")), risk_tier(F.col("p"), right_closed=True)).collect()
    assert [tuple(r) for r in got] == [
        ("low", "low"), ("medium", "low"), ("high", "medium"), ("high", "high"), (None, None),
    ]


def _table(spark, data):
    base = {f.name: None for f in schemas.CUSTOMER_FEATURES.fields}
    return spark.createDataFrame([tuple({**base, **d}.values()) for d in data], schemas.CUSTOMER_FEATURES)


def test_merges(spark):
    old = _table(spark, [
        {"customer_id": 1, "recency_days": 5, "frequency": 2, "monetary": Decimal("9.00"),
         "segment_name": "Old", "churn_label": True, "churn_probability": Decimal("0.9000")},
        {"customer_id": 2, "recency_days": 6, "frequency": 1, "monetary": Decimal("1.00"), "churn_label": True},
    ])
    new = spark.createDataFrame(
        [(1, 50, 3, Decimal("10.00"), "1-1-1", 0, "New"), (3, 7, 1, Decimal("2.00"), "5-5-5", 1, "Fresh")],
        "customer_id long, recency_days int, frequency long, monetary decimal(22,2), rfm_segment string, "
        "cluster_id int, segment_name string",
    )
    got = {r["customer_id"]: r for r in merging.merge_segments(old, new).collect()}
    assert (got[1]["recency_days"], got[1]["segment_name"], got[1]["churn_label"]) == (50, "New", True)
    assert float(got[1]["churn_probability"]) == 0.9
    assert got[2]["recency_days"] == 6 and got[2]["churn_label"] is True
    assert got[3]["churn_label"] is False and got[3]["churn_probability"] is None

    scores = spark.createDataFrame([(1, 0.49996), (9, 0.7)], "customer_id long, churn_probability double")
    got = {r["customer_id"]: r for r in merging.merge_scores(old, scores).collect()}
    assert set(got) == {1, 2}
    assert float(got[1]["churn_probability"]) == 0.5 and got[1]["churn_label"] is False
    assert got[2]["churn_label"] is True


def test_serving(spark):
    table = _table(spark, [
        {"customer_id": i, "recency_days": i, "frequency": 1, "monetary": Decimal(i), "cluster_id": 0 if i < 8 else 1,
         "segment_name": None if i == 0 else ("A" if i < 8 else "B"), "churn_label": i < 3,
         "churn_probability": None if i == 9 else Decimal(i) / 10}
        for i in range(10)
    ])
    page = serving.churn_risk_page(table, page=2, limit=3)
    assert [r["customer_id"] for r in page.rows.collect()] == [5, 4, 3]
    assert page.total.first()["total"] == 9
    high = serving.churn_risk_page(table, tier="high", segment="A")
    assert [r["customer_id"] for r in high.rows.collect()] == [7]
    for wrong in ({"page": 0}, {"limit": 201}, {"tier": "odd"}):
        with pytest.raises(ValueError):
            serving.churn_risk_page(table, **wrong)
    segments_found = serving.segment_summary(table)
    assert rows(segments_found.select("segment_name", "customer_count", "churn_rate")) == [
        ("A", 7, 28.57), ("B", 2, 0.0),
    ]
    assert rows(serving.segment_share(segments_found).select("segment_name", "share_pct")) == [("A", 77.8), ("B", 22.2)]
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
