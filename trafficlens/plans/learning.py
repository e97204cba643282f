"""Preparation, training and evaluation."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trafficlens.operators import features as FE
from trafficlens.operators import metrics as M
from trafficlens.operators import mlprep as P
from trafficlens.operators import models as MD
from trafficlens.operators import normalize as N
from trafficlens.plans.oracle import CELLS, metric_columns, over
from trafficlens.plans.registry import query
from trafficlens.session import new_folder
from trafficlens.sources import views as V


def r6(*columns, digits=6):
    return {c: F.round(F.col(c), digits) + 0.0 for c in columns}


def _lines(spark, sf):
    return V.table(spark, sf, "lineitem")


# --- statistics, imputation, scaling ---

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "a28_column_statistics",
    " union all ".join(
        f"select '{c}' as \"column\", round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std, min({c}) as min, max({c}) as max, count({c}) as n, count(*) as rows from lineitem" for c in NUMBERS
    ),
)
def _(spark, sf):
    return P.column_statistics(_lines(spark, sf), list(NUMBERS)).withColumns(r6("mean", "std", digits=4))


@query("a29_classes", "select l_returnflag, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from lineitem group by 1")
def _(spark, sf):
    return M.class_share(_lines(spark, sf), "l_returnflag").withColumns(r6("share"))


@query("a29_class_count", "select count(distinct attack) as classes from (select event_type as attack from events) q")
def _(spark, sf):
    return M.class_count(V.table(spark, sf, "events").withColumnRenamed("event_type", "attack"), "attack")


MISSING = "select l_orderkey, l_linenumber, nullif(l_discount, 0) as discount, case when l_tax = 0 then null else l_tax end as tax from lineitem"


def _missing(spark, sf):
    discount, tax = F.col("l_discount"), F.col("l_tax")
    return _lines(spark, sf).select(
        "l_orderkey", "l_linenumber", F.when(discount != 0, discount).alias("discount"),
        F.when(tax == 0, float("inf")).otherwise(tax).alias("tax"),
    )


IMPUTED = "round(coalesce(discount, avg(discount) over ()), 6) as discount, round(coalesce(tax, avg(tax) over ()), 6) as tax"


@query("m1_mean_imputation", f"select l_orderkey, l_linenumber, {IMPUTED} from ({MISSING}) q")
def _(spark, sf):
    df = N.infinite_to_null(_missing(spark, sf))
    return P.impute_means(df, ["discount", "tax"]).withColumns(r6("discount", "tax"))


@query("m2_clean", f"select l_linenumber, l_returnflag, {IMPUTED} from (select distinct l_linenumber, l_returnflag, nullif(l_discount, 0) as discount, case when l_tax = 0 then null else l_tax end as tax from lineitem) q")
def _(spark, sf):
    rows = _lines(spark, sf).select(
        "l_linenumber", "l_returnflag", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") == 0, float("-inf")).otherwise(F.col("l_tax")).alias("tax"),
    )
    return P.clean(rows, target="l_linenumber").withColumns(r6("discount", "tax"))


@query("m3_standardise", "select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 6) as l_quantity, 0.0e0 as constant from lineitem")
def _(spark, sf):
    df = _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", F.lit(7.0).alias("constant"))
    return P.standardise(df, ["l_quantity", "constant"]).withColumns(r6("l_quantity", "constant"))


@query("m4_min_max_scale", "select o_orderkey, round((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 6) as o_totalprice, 0.0e0 as constant from orders")
def _(spark, sf):
    df = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(7.0).alias("constant"))
    return P.min_max_scale(df, ["o_totalprice", "constant"]).withColumns(r6("o_totalprice", "constant"))


@query("m5_one_hot", 'select o_orderkey, cast(o_orderstatus = \'F\' as double) as "o_orderstatus_F", cast(o_orderstatus = \'O\' as double) as "o_orderstatus_O", cast(o_orderstatus = \'P\' as double) as "o_orderstatus_P" from orders')
def _(spark, sf):
    return P.one_hot(V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("m5_one_hot_unknown", 'select o_orderkey, cast(o_orderstatus = \'F\' as double) as "o_orderstatus_F", 0.0e0 as "o_orderstatus_X" from orders')
def _(spark, sf):
    return P.one_hot(V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "X"])


@query("m6_label_encoding", "select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as integer) as code from orders")
def _(spark, sf):
    return P.label_encode(V.table(spark, sf, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


RANKED = "select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by md5('42:' || cast(o_orderkey as varchar)), o_orderkey) as r, count(*) over (partition by o_orderstatus) as n from orders"


@query("m7_stratified_split", f"select o_orderkey, o_orderstatus, case when r <= floor(n * 0.15e0 + 1e-9) then 'test' when r <= 2 * floor(n * 0.15e0 + 1e-9) then 'val' else 'train' end as split from ({RANKED}) q")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return P.stratified_split(rows, "o_orderkey", "o_orderstatus")


@query("m8_stratified_folds", f"select o_orderkey, o_orderstatus, cast((r - 1) % 5 as integer) as fold from ({RANKED}) q")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return P.stratified_folds(rows, "o_orderkey", "o_orderstatus")


@query(
    "m9_apply_saved_preparation",
    over("""select packet_id, round((len - avg(len) over ()) / stddev_pop(len) over (), 6) as len, round((ttl - avg(ttl) over ()) / stddev_pop(ttl) over (), 6) as ttl,
 cast(proto = 'icmp' as double) as icmp, cast(proto = 'tcp' as double) as tcp, cast(proto = 'udp' as double) as udp from packets""", "packets"),
)
def _(spark, sf):
    rows = V.packets(spark, sf).select("len", "ttl", "proto", F.col("is_malicious").cast("int").alias("label"), "packet_id")
    path = new_folder(spark, "preparation")
    P.save_preparation(P.fit_preparation(rows.drop("packet_id"), "label"), path)
    prepared = P.prepare(rows, P.load_preparation(path))
    v = vector_to_array("features")
    names = ("len", "ttl", "icmp", "tcp", "udp")
    return prepared.select("packet_id", *[(F.round(v[i], 6) + 0.0).alias(n) for i, n in enumerate(names)])


@query("m15_reward_weights", over("select packet_id, case when is_malicious then 1.0e0 else 0.1e0 end as weight from packets", "packets"))
def _(spark, sf):
    return V.packets(spark, sf).select("packet_id", P.reward_weight(F.col("is_malicious").cast("int")).alias("weight"))


# --- evaluation of given predictions ---


def _predictions(spark, sf, threshold=0.5):
    d = V.detections(spark, sf)
    return d.select("id", F.col("is_malicious").cast("int").alias("label"), (F.col("confidence") > threshold).cast("int").alias("prediction"))


METRICS = ("accuracy", "precision", "recall", "f1", "false_positive_rate")


def rounded(names) -> str:
    return ", ".join(f"round({m}, 6) as {m}" for m in names)


@query("a21_confusion", over(f"select {CELLS} from predictions", "predictions"))
def _(spark, sf):
    return M.confusion(_predictions(spark, sf))


@query("a22_binary_metrics", over(f"select tn, fp, fn, tp, tn+fp+fn+tp as n, {rounded(METRICS)} from (select *, {metric_columns()} from (select {CELLS} from predictions) c) m", "predictions"))
def _(spark, sf):
    return M.binary_metrics(_predictions(spark, sf)).withColumns(r6(*METRICS))


GUESS = "case when event_id % 3 = 0 then 'view' when event_id % 3 = 1 then event_type else 'click' end"


def _multiclass(spark, sf):
    i = F.col("event_id") % 3
    guess = F.when(i == 0, "view").when(i == 1, F.col("event_type")).otherwise("click")
    return V.table(spark, sf, "events").select(F.col("event_type").alias("label"), guess.alias("prediction"))


@query("a23_multiclass_confusion", f"select event_type as label, {GUESS} as prediction, count(*) as n from events group by 1, 2")
def _(spark, sf):
    return M.multiclass_confusion(_multiclass(spark, sf))


@query("a23_multiclass_accuracy", f"select count(*) filter (event_type = {GUESS}) as correct, count(*) as n, round(count(*) filter (event_type = {GUESS}) / cast(count(*) as double), 6) as accuracy from events")
def _(spark, sf):
    return M.multiclass_accuracy(_multiclass(spark, sf)).withColumns(r6("accuracy"))


FOLD_SCORES = ("accuracy", "precision", "recall", "f1")


@query(
    "a24_fold_scores",
    over(f"select fold, {rounded(FOLD_SCORES)} from scores union all select null, " + ", ".join(f"round(avg({m}), 6)" for m in FOLD_SCORES) + " from scores", "predictions",
         scores=f"select fold, {metric_columns()}  from (select id % 5 as fold, {CELLS} from predictions group by 1) c"),
)
def _(spark, sf):
    p = _predictions(spark, sf).withColumn("fold", F.col("id") % 5)
    return M.fold_scores(p).withColumns(r6(*FOLD_SCORES))


@query(
    "m18_compare_models",
    over("select metric, round(max(value) filter (model = 'strict'), 6) as strict, round(max(value) filter (model = 'loose'), 6) as loose from ("
         + " union all ".join(f"select model, '{m}' as metric, {m} as value from scores" for m in FOLD_SCORES) + ") q group by 1", "detections",
         scores=f"""select model, {metric_columns()} from (select model, {CELLS} from
 (select 'strict' as model, cast(is_malicious as int) as label, case when confidence > 0.8 then 1 else 0 end as prediction from detections
 union all select 'loose', cast(is_malicious as int), case when confidence > 0.3 then 1 else 0 end from detections) p group by 1) c"""),
)
def _(spark, sf):
    both = [_predictions(spark, sf, t).withColumn("model", F.lit(n)) for n, t in (("strict", 0.8), ("loose", 0.3))]
    table = M.compare_models(both[0].unionByName(both[1]), models=["strict", "loose"])
    return table.withColumns(r6("strict", "loose"))


# --- models: trained on targets that the features separate, so SQL can state what they decide ---

SPLIT = """select packet_id, proto, is_udp, row_number() over (partition by is_udp order by md5('42:' || cast(packet_id as varchar)), packet_id) as r, count(*) over (partition by is_udp) as n
 from (select *, proto = 'udp' as is_udp from packets) p"""


def _training_rows(spark, sf):
    packets = V.spread(V.packets(spark, sf)).withColumn("label", (F.col("proto") == "udp").cast("int"))
    return FE.feature_vectors(packets, keep=("label",))


@query(
    "m10_m12_train_and_evaluate",
    over(f"""select count(*) filter (not is_udp) as tn, cast(0 as bigint) as fp, cast(0 as bigint) as fn, count(*) filter (is_udp) as tp, count(*) as n,
 1.0e0 as accuracy, 1.0e0 as precision, 1.0e0 as recall, 1.0e0 as f1, 0.0e0 as false_positive_rate from ({SPLIT}) q where r <= floor(n * 0.1e0 + 1e-9)""", "packets"),
)
def _(spark, sf):
    rows = P.stratified_split(_training_rows(spark, sf), "packet_id", "label", 0.8, 0.1, 0.1)
    learn = rows.filter("split = 'train'").withColumn("weight", P.reward_weight(F.col("label")))
    model = MD.train(learn, weight="weight")
    return MD.evaluate(rows.filter("split = 'test'"), model)


@query("m11_s12_score_with_saved_model", over("select packet_id, proto = 'udp' as is_predicted_malicious, true as by_confidence, true as same_as_unsaved from packets", "packets"))
def _(spark, sf):
    rows = _training_rows(spark, sf)
    path = new_folder(spark, "model")
    model = MD.train(rows, "logistic_regression")
    MD.save_model(model, path)
    decided, sure = F.col("is_predicted_malicious"), F.col("confidence")
    scored = MD.score(rows, MD.load_model("logistic_regression", path)).select("packet_id", decided, sure)
    direct = MD.score(rows, model).select(F.col("packet_id").alias("_id"), sure.alias("_sure"))
    return scored.join(direct, F.col("packet_id") == F.col("_id")).select("packet_id", decided, ((sure > 0.5) == decided).alias("by_confidence"), (sure == F.col("_sure")).alias("same_as_unsaved"))


@query("p18_predicted_as_class", "select o_orderkey, 1 as prediction from orders where o_totalprice > 250000")
def _(spark, sf):
    prediction = (F.col("o_totalprice") > 250000).cast("int").alias("prediction")
    return MD.predicted_as(V.table(spark, sf, "orders").select("o_orderkey", prediction), 1)


@query(
    "m13_training_job",
    over("""select 'random_forest' as model_type, 'initial' as training_type, cast(sum(n - 2 * floor(n * 0.1e0 + 1e-9)) as bigint) as dataset_size, 1.0e0 as accuracy, 1.0e0 as recall
 from (select count(*) as n from (select distinct dport, proto, len // 100 as size from packets) d group by proto = 'udp') q""", "packets"),
)
def _(spark, sf):
    """Rows repeat in everything but the id; only distinct ones are split and learnt."""
    size = F.floor(F.col("len") / 100).cast("int").alias("size")
    rows = V.packets(spark, sf).select("packet_id", "dport", "proto", size, F.when(F.col("proto") == "udp", "Attack").otherwise("Benign").alias("label"))
    _model, _preparation, row = MD.training_job(rows, "packet_id")
    return row.select("model_type", "training_type", "dataset_size", "accuracy", "recall")


@query(
    "m13_training_job_all_columns",
    over("""select 'random_forest' as model_type, 'initial' as training_type, cast(sum(n - 2 * floor(n * 0.1e0 + 1e-9)) as bigint) as dataset_size,
 1.0e0 as accuracy, 1.0e0 as precision, 1.0e0 as recall, 1.0e0 as f1_score, 0.0e0 as false_positive_rate
 from (select count(*) as n from (select distinct sport, dport, proto, len, ttl, flags from packets) d group by proto = 'udp') q""", "packets"),
)
def _(spark, sf):
    """All header columns, so nearly every packet is a row of its own and the training set grows with the input."""
    label = F.when(F.col("proto") == "udp", "Attack").otherwise("Benign").alias("label")
    _model, _preparation, row = MD.training_job(V.packets(spark, sf).select("packet_id", "sport", "dport", "proto", "len", "ttl", "flags", label), "packet_id")
    return row.select("model_type", "training_type", "dataset_size", "accuracy", "precision", "recall", "f1_score", "false_positive_rate")


@query("m14_retrain_from_feedback", over("select 'logistic_regression' as model_type, 'retraining' as training_type, count(distinct alert_id) as dataset_size, 35 as width from feedback", "feedback"))
def _(spark, sf):
    d = V.detections(spark, sf, vectors=True)
    base = d.select(F.col("feature_data").alias("features"), F.col("is_malicious").cast("int").alias("label"))
    result = MD.retrain(base, V.feedback(spark, sf, vectors=True), "logistic_regression")
    if result is None:
        return V.training_history(spark, sf).limit(0)
    model, row = result
    return row.select("model_type", "training_type", "dataset_size", F.lit(model.numFeatures).alias("width"))


@query("m16_cross_validation", over(f"select fold, count(*) as n, count(*) filter (is_udp) as positives, cast(0 as bigint) as wrong from (select *, cast((r - 1) % 5 as integer) as fold from ({SPLIT}) q) f group by fold", "packets"))
def _(spark, sf):
    packets = V.packets(spark, sf).select("packet_id", (F.col("proto") == "udp").cast("int").alias("label"), F.coalesce("dport", F.lit(0)).alias("dport"), "len", "ttl", F.coalesce("flags", F.lit(0)).alias("flags"))
    pooled = MD.cross_validate(packets, "packet_id", features=["dport", "len", "ttl", "flags"])
    return pooled.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.count_if(F.col("label") != F.col("prediction")).alias("wrong"))


@query("m17_multiclass", over("select cast(dense_rank() over (order by proto) - 1 as integer) as label, cast(dense_rank() over (order by proto) - 1 as integer) as prediction, n from (select proto, count(*) as n from packets group by 1) q", "packets"))
def _(spark, sf):
    rows = FE.feature_vectors(V.spread(V.packets(spark, sf)).withColumn("service", F.coalesce(F.col("proto"), F.lit("other"))), keep=("service",))
    coded = P.label_encode(rows, "service", "label")
    model = MD.train(coded, classes=3)
    return M.multiclass_confusion(MD.classify(coded, model))
