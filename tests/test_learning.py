import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trafficlens.operators import metrics as M
from trafficlens.operators import mlprep as P
from trafficlens.operators import models as MD
from trafficlens.sources import views as V
from trafficlens.operators import features as FE


def test_scalers_guard_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert [tuple(r) for r in P.standardise(df, ["x", "c"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in P.min_max_scale(df, ["x", "c"]).collect()] == [(0.0, 0.0), (1.0, 0.0)]
    other = spark.createDataFrame([(5.0, 6.0)], "x double, c double")
    assert tuple(P.min_max_scale(other, ["x", "c"], fit_on=df).first()) == (2.0, 1.0)


def test_clean(spark, rows):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (float("inf"), "b"), (3.0, None)], "x double, t string")
    assert rows(P.clean(df)) == sorted([(1.0, "a"), (2.0, "b"), (3.0, None)], key=repr)


def test_preparation_survives_saving(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a", 0), (None, "b", 1), (5.0, "a", 1)], "x double, t string, label int")
    path = str(tmp_path / "prep")
    P.save_preparation(P.fit_preparation(df, "label"), path)
    new = spark.createDataFrame([(3.0, "a", 0), (None, "zzz", 0), (5.0, "b", 0)], "x double, t string, label int")
    out = [r[0] for r in P.prepare(new, P.load_preparation(path)).select(vector_to_array("features")).collect()]
    # Mean 3; with the missing value imputed the deviation is sqrt(8 / 3).
    assert out[0] == [0.0, 1.0, 0.0] and out[1] == [0.0, 0.0, 0.0]
    assert out[2][0] == pytest.approx(2 / math.sqrt(8 / 3)) and out[2][1:] == [0.0, 1.0]


def test_split_ratios(spark):
    df = spark.createDataFrame([(i, "m" if i < 20 else "b") for i in range(120)], "id bigint, label string")
    with pytest.raises(ValueError):
        P.stratified_split(df, "id", "label", 0.5, 0.1, 0.1)
    split = P.stratified_split(df, "id", "label", 0.8, 0.1, 0.1)
    got = {(r["label"], r["split"]): r["n"] for r in split.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("m", "test"): 2, ("m", "val"): 2, ("m", "train"): 16, ("b", "test"): 10, ("b", "val"): 10, ("b", "train"): 80}
    assert split.select("id").distinct().count() == 120


def test_small_class_spreads_over_folds(spark):
    df = spark.createDataFrame([(i, "few" if i < 3 else "many") for i in range(53)], "id bigint, label string")
    folds = P.stratified_folds(df, "id", "label")
    assert folds.filter("label = 'few'").select("fold").distinct().count() == 3
    sizes = [r["count"] for r in folds.filter("label = 'many'").groupBy("fold").count().collect()]
    assert sizes == [10] * 5


def test_many_categories(spark):
    """Codes are dense and in order for more values than a row could list; missing values have none."""
    df = spark.range(30_000).select("id", F.when(F.col("id") > 0, F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"))
    coded = P.label_encode(df, "c", "code")
    assert coded.filter("code <> id - 1 or (id = 0) <> (code is null)").count() == 0 and coded.count() == 30_000
    vector = P.one_hot_vector(df, "c", "v").filter("id in (0, 7)").orderBy("id").collect()
    assert [(r["v"]["size"], r["v"]["indices"]) for r in vector] == [(29_999, []), (29_999, [6])]


def test_rows_without_an_id_stay(spark, rows):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (None, "a"), (2, "a"), (None, None)], "id bigint, label string")
    split = P.stratified_split(df, "id", "label", 0.5, 0.25, 0.25)
    assert sorted(r["split"] for r in split.filter("label = 'a'").collect()) == ["test", "train", "train", "val"] and split.count() == 5
    assert P.stratified_folds(df, "id", "label").count() == 5


def test_a_split_ranks_no_rows(spark, folder):
    """Distinct ids are decided by keys found beforehand: the plan has no window, no union and one scan."""
    df = V.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    text = P.stratified_split(df, "o_orderkey", "o_orderstatus")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Union" not in text and text.count("Relation [") == 1


def test_perceptron_learns_by_weight(spark):
    df = spark.createDataFrame([([float(i % 2), 1.0], i % 2, 0.0 if i % 2 == 0 else 1.0) for i in range(200)], "features array<double>, label int, weight double")
    model = MD.train(df, "perceptron", weight="weight")
    # Only rows of label 1 have weight, so everything is taken for it.
    assert MD.score(df, model).filter("not is_predicted_malicious").count() == 0


def test_training_job_learns_distinct_rows(spark):
    df = spark.createDataFrame([(i, i % 3 * 10, "Attack" if i % 3 == 0 else "Benign") for i in range(300)], "id bigint, x int, label string")
    assert MD.distinct_rows(df, "id").orderBy("x").collect() == [(0, "Attack", 0), (10, "Benign", 1), (20, "Benign", 2)]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    r = M.binary_metrics(df).first()
    assert (r["tn"], r["accuracy"], r["precision"], r["recall"], r["f1"], r["false_positive_rate"]) == (2, 1.0, 0.0, 0.0, 0.0, 0.0)


def test_confusion_matrix_form(spark, rows):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, prediction string")
    assert rows(M.confusion_matrix(df, ["a", "b"])) == [("a", 1, 1), ("b", 0, 1)]


@pytest.fixture(scope="module")
def training_rows(spark, folder):
    packets = V.packets(spark, folder).withColumn("label", F.col("is_malicious").cast("int"))
    return FE.feature_vectors(packets, keep=("label",))


@pytest.mark.parametrize("kind", ["random_forest", "logistic_regression", "perceptron"])
def test_models_learn_and_survive_saving(spark, training_rows, tmp_path, kind):
    model = MD.train(training_rows, kind)
    MD.save_model(model, str(tmp_path / kind))
    again = MD.load_model(kind, str(tmp_path / kind))
    result = MD.evaluate(training_rows, again).first()
    assert result["n"] == 1000 and result["accuracy"] > 0.9
    scored = MD.score(training_rows, again).filter("is_predicted_malicious <> (confidence > 0.5)")
    assert scored.count() == 0


def test_training_needs_rows(spark, training_rows):
    with pytest.raises(ValueError):
        MD.train(training_rows.limit(0))


def test_retraining_needs_five_alerts(spark):
    base = spark.createDataFrame([([float(i)], i % 2) for i in range(20)], "features array<double>, label int")
    feedback = "id bigint, timestamp timestamp, feature_data array<double>, label int, alert_id string"
    rows = [(i, None, [float(i)], i % 2, f"a{i % 4}") for i in range(8)]
    assert MD.retrain(base, spark.createDataFrame(rows, feedback), "logistic_regression") is None
    rows = [(i, None, [float(i)], i % 2, None) for i in range(8)]
    _model, row = MD.retrain(base, spark.createDataFrame(rows, feedback), "logistic_regression")
    r = row.first()
    assert (r["training_type"], r["dataset_size"]) == ("retraining", 8)


def test_training_job(spark, folder):
    rows = V.packets(spark, folder).select("packet_id", "dport", "proto", "len", F.when(F.col("is_malicious"), "Attack").otherwise("Benign").alias("label"))
    model, preparation, row = MD.training_job(rows, "packet_id", "logistic_regression")
    r = row.first()
    assert r["training_type"] == "initial" and r["dataset_size"] > 700 and 0 <= r["accuracy"] <= 1
    assert MD.score(P.prepare(rows, preparation), model).count() == 1000


def test_training_job_on_all_columns_learns_most_packets(spark, folder):
    import __spark_entry__ as E

    r = E.queries()["m13_training_job_all_columns"](spark, folder).first()
    assert r["dataset_size"] > 700 and (r["precision"], r["f1_score"], r["false_positive_rate"]) == (1.0, 1.0, 0.0)


def test_too_many_categories_for_columns(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_COLUMNS", 3)
    few = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "c string")
    assert P.categories(few, "c") == ["a", "b", "c"]
    with pytest.raises(ValueError, match="one_hot_vector"):
        P.one_hot(few.union(spark.createDataFrame([("d",)], "c string")), "c")
