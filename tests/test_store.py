import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficlens import schema
from trafficlens.session import new_folder, shared_folder
from trafficlens.sources import files
from trafficlens.sources import views as V
from trafficlens.sources.store import Store


def test_create_tables_twice_and_append(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    prefix = "t" + tmp_path.name.replace("-", "_") + "_"
    store.create_tables(prefix=prefix)
    store.create_tables(prefix=prefix)
    for name, columns in schema.TABLES.items():
        have = [c for c in spark.table(prefix + name).columns if c != "dt"]
        assert have == list(columns)
    store.append("detections", V.detections(spark, folder))
    assert store.read("detections").count() == 1000
    one_day = store.read("detections").filter("dt = date '2024-01-03'")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and one_day.count() > 0
    for name in schema.TABLES:
        spark.sql(f"drop table {prefix}{name}")


def test_missing_metrics_are_zero(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append_training(spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "rf", 0.5)], "id bigint, timestamp timestamp, model_type string, accuracy double"))
    r = store.read("training_history").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["training_time"]) == (0.5, 0.0, 0.0, 0.0)


def test_text_survives_csv_and_json(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'say "hi", é'), (2, None), (3, "' OR 1=1 --")], "id int, t string")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_json(df, str(tmp_path / "j"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "id int, t string")) == rows(df)
    assert rows(files.read_csv(spark, str(tmp_path / "c"))) == rows(df)
    assert rows(files.read_json(spark, str(tmp_path / "j"), "id int, t string")) == rows(df)
    one = tmp_path / "one.json"
    one.write_text('[{"id": 1,\n "t": "x"}]')
    assert rows(files.read_json(spark, str(one), multi_line=True)) == [(1, "x")]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        pytest.skip("no shared folder configured")
    assert shared_folder(spark) == configured and new_folder(spark, "x").startswith(configured)


def test_views_repeat(spark, folder, rows):
    a, b = (V.decisions(spark, folder).filter(F.col("status") == "confirmed") for _ in range(2))
    assert rows(a) == rows(b)
