"""Shape of the physical plans."""

import pytest

import __spark_entry__ as E
from trafficlens.operators import features as FE
from trafficlens.operators import signatures as SG
from trafficlens.operators import traffic as T
from trafficlens.plans import registry
from trafficlens.sources import views as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that train, write files or run streams while they are built.
SLOW_TO_BUILD = ("t6", "t8", "r1_stream", "r2_stream", "r3_stream", "r4_stream", "r5_stream", "r6_stream", "t1", "t2", "t3", "t4", "t5", "t7", "m10", "m11", "m13", "m14", "m16", "m17", "m9", "s1", "s2", "s5", "s6_append", "s7", "s8")


@pytest.mark.parametrize("name", [n for n in sorted(registry.QUERIES) if not n.startswith(SLOW_TO_BUILD)])
def test_no_python_and_no_cartesian_product(spark, folder, name):
    text = plan(E.queries()[name](spark, folder))
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_features_and_matching_do_not_shuffle(spark, folder):
    packets = V.packets(spark, folder)
    for df in (FE.feature_vectors(packets), FE.payload_analysis(packets), SG.matches(packets), FE.analyze_packets(packets)):
        assert "Exchange hashpartitioning" not in plan(df)


def test_services_are_broadcast(spark, folder):
    assert plan(T.with_services(V.packets(spark, folder))).count("BroadcastHashJoin") == 2


def test_top_lists_do_not_sort_everything(spark, folder):
    for name in ("l1_newest_detections", "l5_top_sources", "l6_top_destinations", "l7_top_ports_dashboard"):
        assert "TakeOrderedAndProject" in plan(E.queries()[name](spark, folder)), name


def test_only_needed_columns_are_read(spark, folder):
    text = plan(T.packets_per(V.packets(spark, folder), "src"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_filters_reach_the_scan(spark, folder):
    text = plan(V.detections(spark, folder).filter("id = 17"))
    assert "EqualTo(event_id,17)" in text
