"""Registered queries on flow records, labels, splits, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scalar as S
from tidewire.functions.packets import flow_id
from tidewire.operators import features as FE
from tidewire.operators import flows as FL
from tidewire.operators import labels as LA
from tidewire.operators import metrics as M
from tidewire.operators import prepare as PR
from tidewire.operators import report as R
from tidewire.operators import split as SP
from tidewire.plans import fixtures as X
from tidewire.plans import oracle_parts as O
from tidewire.plans.registry import f32, fx, query
from tidewire.schemas import FEATURE_NAMES
from tidewire.session import scratch_dir
from tidewire.sources import tables as T

B, BC, C, SC = O.BINETFLOW, O.BINETFLOW_CLEAN, O.CIC, O.SCORED
RAW_COLUMNS = T.BINETFLOW_COLUMNS


def binetflow(spark, sf_dir):
    return X.binetflow_records(spark, sf_dir)


def binetflow_table(spark, sf_dir):
    return PR.prepare_binetflow(binetflow(spark, sf_dir), keep=["row_id"])


def cic(spark, sf_dir):
    return X.cic_records(spark, sf_dir)


def show(table, keep):
    return table.select(*keep, *[f32(F.col(n)).alias(n) for n in FEATURE_NAMES])


def _table_sql(prefix, values, source, keep):
    shown = ", ".join(f"{O.f32(values.get(n, '0'))} AS {n}" for n in FEATURE_NAMES)
    return f"WITH {prefix} SELECT {keep}, {shown} FROM {source}"


# --- sources ------------------------------------------------------------------

@query("binetflow_scan", f"WITH {B} SELECT {', '.join(c for c in RAW_COLUMNS if c != 'Dur')}, nullif(Dur, '') AS Dur, 7 AS scenario FROM (SELECT * REPLACE (nullif(Dport, '') AS Dport) FROM raw)")
def binetflow_scan(spark, sf_dir):
    """Written as CSV text by Spark, then read back: headers trimmed, scenario from the path."""
    path = scratch_dir(spark, "binetflow") + "/7/capture.binetflow"
    raw = binetflow(spark, sf_dir).select(*[F.col(c).alias(f" {c} ") for c in RAW_COLUMNS])
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return T.binetflow_scan(spark, path)


@query("scenario_from_path", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE CAST(l_suppkey % 100 AS INTEGER) END AS scenario
  FROM lineitem""")
def scenario_from_path(spark, sf_dir):
    number = (F.col("l_suppkey") % 100).cast("string")
    path = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("/data/x"), number, F.lit("/capture.binetflow"))).otherwise(
        F.concat(F.lit("/data/"), number, F.lit("/capture.binetflow")))
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.scenario_of(path).alias("scenario"))


@query("cic_scan", f"""WITH {C}, f AS (SELECT row_id, "Label", CAST(price AS VARCHAR) AS bytes, CAST(l_partkey % 65536 AS VARCHAR) AS port,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(qty AS VARCHAR) END AS packets FROM raw) SELECT * FROM f""")
def cic_scan(spark, sf_dir):
    """Two kinds of files whose headers differ and carry stray blanks."""
    path = scratch_dir(spark, "cic")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "header": True}
    raw = cic(spark, sf_dir).withColumn("odd", F.element_at(F.split("row_id", ":"), 4).cast("int") % 2)
    names = ["Label", "Total Length of Fwd Packets", "Destination Port", "row_id"]
    odd = raw.filter("odd = 1").select(*[F.col(c).alias(f" {c}") for c in ["Total Fwd Packets"] + names])
    even = raw.filter("odd = 0").select(*[F.col(c).alias(c.replace(" ", "  ")) for c in names])
    odd.write.options(**keep).csv(f"{path}/MachineLearningCVE/odd")
    even.write.options(**keep).csv(f"{path}/MachineLearningCVE/even")
    got = T.cic_scan(spark, f"{path}/MachineLearningCSV/*")      # the other folder name: falls back
    return got.select("row_id", "Label", F.col("Total Length of Fwd Packets").alias("bytes"),
                      F.col("Destination Port").alias("port"), F.col("Total Fwd Packets").alias("packets"))


@query("cic_path_fallback", """SELECT count(*) AS n_rows, true AS same FROM lineitem""")
def cic_path_fallback(spark, sf_dir):
    path = scratch_dir(spark, "cic-path")
    cic(spark, sf_dir).select("Label").write.option("header", True).csv(f"{path}/MachineLearningCSV/day")
    found = T.resolve_inputs(spark, f"{path}/MachineLearningCVE/day")
    same = found == T.resolve_inputs(spark, f"{path}/MachineLearningCSV/day")
    return T.scan_text(spark, found).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(same).alias("same"))


@query("union_files", f"""WITH {B} SELECT Proto, CASE WHEN scenario <= 6 THEN Sport END AS Sport, CASE WHEN scenario > 6 THEN Label END AS Label,
  count(*) AS n FROM raw GROUP BY ALL""")
def union_files(spark, sf_dir):
    raw = binetflow(spark, sf_dir)
    low = raw.filter("scenario <= 6").select("Proto", "Sport")
    high = raw.filter("scenario > 6").select("Label", "Proto")
    return T.union_files([low, high]).groupBy("Proto", "Sport", "Label").agg(F.count(F.lit(1)).alias("n"))


@query("missing_columns", """SELECT name AS column_name, (SELECT count(*) FROM lineitem) AS n_rows FROM (VALUES ('Dir'), ('State')) t(name)""")
def missing_columns(spark, sf_dir):
    raw = binetflow(spark, sf_dir).drop("Dir", "State")
    lacking = T.missing_columns(raw, RAW_COLUMNS)
    return raw.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.lit(c) for c in lacking])).alias("column_name"), "n_rows")


@query("header_normalise", """SELECT 'Flow Bytes/s,Label,Label_1,Total Fwd Packets' AS headers, count(*) AS n_rows FROM lineitem""")
def header_normalise(spark, sf_dir):
    raw = cic(spark, sf_dir).select(
        F.col("`Flow Bytes/s`").alias(" Flow   Bytes/s "), F.col("Label").alias(" Label"), F.col("Label").alias("Label  "),
        F.col("Total Fwd Packets").alias("Total  Fwd Packets"))
    names = T.normalise_headers(raw.columns)
    return raw.toDF(*names).agg(F.lit(",".join(names)).alias("headers"), F.count(F.lit(1)).alias("n_rows"))


FEATURE_SQL = _table_sql(BC, O.BINETFLOW_FEATURES, "labelled", "row_id, lab AS label, start_time")


@query("feature_table_sink", FEATURE_SQL)
def feature_table_sink(spark, sf_dir):
    path = scratch_dir(spark, "features")
    T.write_features(binetflow_table(spark, sf_dir), path)
    return show(spark.read.parquet(path), ["row_id", "label", "start_time"])


@query("feature_table_scan", f"""{FEATURE_SQL} WHERE l_null = 0""".replace("FROM labelled", "FROM (SELECT *, CASE WHEN scenario = 13 THEN 1 ELSE 0 END AS l_null FROM labelled)"))
def feature_table_scan(spark, sf_dir):
    """CSV with label words and some non-finite rows, read back as a training table."""
    path = scratch_dir(spark, "feature-csv")
    dirty = binetflow_table(spark, sf_dir).withColumns({
        "label": F.when(F.col("label") == 1, " C2").otherwise("Benign"),
        "pkt_len_mean": F.when(F.col("scenario") == 13, F.lit(float("inf"))).otherwise(F.col("pkt_len_mean")).cast("float"),
    })
    T.write_features(dirty, path, "csv")
    table = T.feature_table_scan(spark, path)
    return show(table, ["row_id", "label", "start_time"])


@query("label_table_scan", f"""WITH {O.packets()}, sided AS (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS from_lo FROM packets),
keyed AS (SELECT *, CASE WHEN from_lo THEN src_ip ELSE dst_ip END AS lo_ip,
  CASE WHEN from_lo THEN src_port ELSE dst_port END AS lo_port, CASE WHEN from_lo THEN dst_ip ELSE src_ip END AS hi_ip,
  CASE WHEN from_lo THEN dst_port ELSE src_port END AS hi_port FROM sided), {O.FLOW_LABELS}
  SELECT flow_id, CAST(CASE WHEN lower(trim(label)) IN ('c2', 'malicious') THEN 1 ELSE 0 END AS BIGINT) AS label FROM labels_raw""")
def label_table_scan(spark, sf_dir):
    path = scratch_dir(spark, "labels")
    X.flow_labels(spark, sf_dir).select("flow_id", "label").write.option("header", True).csv(path)
    return T.label_table_scan(spark, path).select("flow_id", "label")


# --- cleaning and labels ------------------------------------------------------

@query("filter_finite_cic", f"""WITH {C} SELECT row_id, CAST(qty AS DOUBLE) AS fwd, rate_p, rate_b FROM clean""")
def filter_finite_cic(spark, sf_dir):
    return PR.filter_finite_cic(cic(spark, sf_dir)).select(
        "row_id", F.col("Total Fwd Packets").alias("fwd"), F.col("`Flow Packets/s`").alias("rate_p"),
        F.col("`Flow Bytes/s`").alias("rate_b"))


@query("filter_finite_binetflow", f"WITH {BC} SELECT row_id, d AS Dur, pk AS TotPkts, tb AS TotBytes, sb AS SrcBytes FROM clean")
def filter_finite_binetflow(spark, sf_dir):
    return PR.filter_finite_binetflow(binetflow(spark, sf_dir)).select("row_id", *PR.BINETFLOW_NUMBERS)


@query("filter_finite_features", f"WITH {BC} SELECT row_id FROM labelled WHERE d <> 0")
def filter_finite_features(spark, sf_dir):
    """Rates of zero-length flows made infinite again, then dropped."""
    t = binetflow_table(spark, sf_dir)
    broken = t.withColumn("pkts_per_second", F.when(F.col("flow_duration") == 0, float("nan")).otherwise(F.col("pkts_per_second")))
    return T.finite_features(broken).select("row_id")


@query("filter_botnet_only", f"""WITH {C} SELECT row_id, "Label" AS label_text FROM raw WHERE upper(trim("Label")) IN ('BENIGN', 'BOT')""")
def filter_botnet_only(spark, sf_dir):
    return PR.filter_botnet_only(cic(spark, sf_dir)).select("row_id", F.col("Label").alias("label_text"))


@query("binetflow_label_filter", f"WITH {BC} SELECT row_id, lab AS label FROM numbers WHERE lab IS NOT NULL")
def binetflow_label_filter(spark, sf_dir):
    return PR.binetflow_label_filter(binetflow(spark, sf_dir)).select("row_id", "label")


@query("binetflow_label_background", f"""WITH {BC} SELECT row_id, CAST(CASE WHEN Label LIKE '%Background%' THEN 0 ELSE lab END AS BIGINT) AS label
  FROM numbers WHERE lab IS NOT NULL OR Label LIKE '%Background%'""")
def binetflow_label_background(spark, sf_dir):
    return PR.binetflow_label_filter(binetflow(spark, sf_dir), include_background=True).select("row_id", "label")


@query("clean_drop_stats", f"""WITH {BC}, c AS (SELECT count(*) AS n_rows, count(CASE WHEN d IS NULL OR NOT isfinite(d) THEN 1 END) AS dropped_clean,
  count(CASE WHEN isfinite(d) AND lab IS NULL THEN 1 END) AS dropped_label FROM numbers) SELECT *,
  {O.fx('100.0 * dropped_clean / CAST(n_rows AS DOUBLE)')} AS pct_clean, {O.fx('100.0 * dropped_label / CAST(n_rows - dropped_clean AS DOUBLE)')} AS pct_label FROM c""")
def clean_drop_stats(spark, sf_dir):
    s = PR.clean_drop_stats(binetflow(spark, sf_dir), PR.BINETFLOW_NUMBERS, S.binetflow_label(F.col("Label")).isNotNull())
    return s.withColumns({c: fx(F.col(c)) for c in ("pct_clean", "pct_label")})


@query("unknown_labels", f"WITH {B} SELECT DISTINCT lower(trim(Proto)) AS label FROM raw")
def unknown_labels(spark, sf_dir):
    words = binetflow(spark, sf_dir).select(F.explode(F.array("Proto", F.lit("c2"), F.lit(" Benign"))).alias("label"))
    return T.unknown_labels(words)


@query("norm_label", """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS BIGINT) AS label FROM events""")
def norm_label(spark, sf_dir):
    word = X._pick(F.col("event_id") % 5, ["Normal ", "ATTACK", "1", "background", "huh"])
    return X.table(spark, sf_dir, "events").select("event_id", S.norm_label(word).alias("label"))


@query("cic_label", f"""WITH {C} SELECT row_id, CAST(CASE WHEN upper(trim("Label")) = 'BENIGN' AND line <> 3 THEN 0 ELSE 1 END AS BIGINT) AS label FROM raw""")
def cic_label(spark, sf_dir):
    raw = cic(spark, sf_dir).withColumn("line", F.element_at(F.split("row_id", ":"), 4))
    return raw.select("row_id", S.cic_label(F.when(F.col("line") != "3", F.col("Label"))).alias("label"))


@query("proto_number", f"WITH {BC} SELECT row_id, proto_no AS protocol FROM clean")
def proto_number(spark, sf_dir):
    return PR.filter_finite_binetflow(binetflow(spark, sf_dir)).select("row_id", S.proto_number(F.col("Proto")).alias("protocol"))


@query("parse_port", f"""WITH {BC} SELECT row_id, CAST(Sport AS DOUBLE) AS sport, CAST(dst_no AS DOUBLE) AS dport FROM clean""")
def parse_port(spark, sf_dir):
    return PR.filter_finite_binetflow(binetflow(spark, sf_dir)).select(
        "row_id", S.parse_port(F.col("Sport")).alias("sport"), S.parse_port(F.col("Dport")).alias("dport"))


@query("us_to_s", f"WITH {C} SELECT row_id, {O.fx('(tax * 1000003 + line) / 1e6')} AS seconds FROM raw")
def us_to_s(spark, sf_dir):
    return cic(spark, sf_dir).select("row_id", fx(S.us_to_s(F.col("Flow Duration").cast("double"))).alias("seconds"))


@query("count_to_flag", f"""WITH {C} SELECT row_id, CAST({O.CIC_FEATURES['fwd_syn_flag']} AS DOUBLE) AS syn, CAST({O.CIC_FEATURES['rst_flag']} AS DOUBLE) AS rst FROM raw""")
def count_to_flag(spark, sf_dir):
    return cic(spark, sf_dir).select(
        "row_id", S.count_to_flag(F.col("SYN Flag Count")).alias("syn"), S.count_to_flag(F.col("RST Flag Count")).alias("rst"))


@query("parse_start_time", f"""WITH {C} SELECT row_id, CASE WHEN line = 2 THEN 0 ELSE
  epoch_us(date_trunc('day', l_shipdate)) / 1e6 + (line + 5) * 3600 + 900 END AS start_time FROM raw""")
def parse_start_time(spark, sf_dir):
    line = F.element_at(F.split("row_id", ":"), 4)
    text = F.when(line == "2", "soon").otherwise(F.col("Timestamp"))
    return cic(spark, sf_dir).select("row_id", S.parse_start_time(text, *PR.CIC_TIMES).alias("start_time"))


@query("split_packet_counts", f"""WITH {BC} SELECT row_id, round_even(pk * share, 0) AS fwd, greatest(pk - round_even(pk * share, 0), 0) AS bwd FROM clean""")
def split_packet_counts(spark, sf_dir):
    t = PR.filter_finite_binetflow(binetflow(spark, sf_dir))
    fwd, bwd = PR.split_packet_counts(F.col("TotPkts"), S.ratio_or(F.col("SrcBytes"), F.col("TotBytes"), 0.5))
    return t.select("row_id", fwd.alias("fwd"), bwd.alias("bwd"))


@query("clip_low", "SELECT event_id, greatest(value - 20, 0) AS clipped FROM events")
def clip_low(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", S.clip_low(F.col("value") - 20).alias("clipped"))


@query("cic_transform", _table_sql(C, O.CIC_FEATURES, "clean", "row_id, CAST(lab AS BIGINT) AS label, start_time"))
def cic_transform(spark, sf_dir):
    return show(PR.prepare_cic(cic(spark, sf_dir), keep=["row_id"]), ["row_id", "label", "start_time"])


@query("binetflow_transform", _table_sql(BC, O.BINETFLOW_FEATURES, "labelled", "row_id, lab AS label, start_time, scenario"))
def binetflow_transform(spark, sf_dir):
    return show(binetflow_table(spark, sf_dir), ["row_id", "label", "start_time", "scenario"])


@query("feature_projection", _table_sql(BC, {k: v for k, v in O.BINETFLOW_FEATURES.items() if k in ("total_packets", "dst_port")}, "labelled", "row_id"))
def feature_projection(spark, sf_dir):
    some = binetflow_table(spark, sf_dir).select("row_id", "dst_port", "total_packets")
    return show(FE.feature_projection(some, ["row_id"]), ["row_id"])


@query("zero_features", _table_sql(BC, {k: v for k, v in O.BINETFLOW_FEATURES.items() if k not in ("protocol", "dst_port")}, "labelled", "row_id, lab AS label"))
def zero_features(spark, sf_dir):
    return show(FE.zero_features(binetflow_table(spark, sf_dir), ["dst_port", "protocol"]), ["row_id", "label"])


@query("validate_features", f"""WITH {BC} SELECT count(CASE WHEN d = 0 THEN 1 END) AS bad_rate, CAST(0 AS BIGINT) AS bad_port,
  count(CASE WHEN d = 0 THEN 1 END) AS bad_rows FROM labelled""")
def validate_features(spark, sf_dir):
    t = FE.validate_features(binetflow_table(spark, sf_dir))
    broken = t.withColumn("pkts_per_second", F.when(F.col("flow_duration") == 0, float("inf")).otherwise(F.col("pkts_per_second")))
    return FE.non_finite_counts(broken).select(
        F.col("pkts_per_second").alias("bad_rate"), F.col("dst_port").alias("bad_port"), "bad_rows")


# --- sampling and splits ------------------------------------------------------

def _ordered(seed, key="row_id"):
    return f"substr(md5('{seed}|' || {key}), 1, 15)"


SAMPLE_SQL = f"""WITH {BC}, r AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY {_ordered(42)}) AS rn FROM labelled)
  SELECT row_id, lab AS label, start_time FROM r WHERE lab = 1 OR rn <= 5000"""


@query("benign_sample", SAMPLE_SQL)
def benign_sample(spark, sf_dir):
    return PR.benign_sample(binetflow_table(spark, sf_dir), 5000, row_key=["row_id"]).select("row_id", "label", "start_time")


@query("union_sample", SAMPLE_SQL.replace("SELECT row_id, lab AS label, start_time FROM r", "SELECT lab AS label, count(*) AS n, count(DISTINCT row_id) AS n_ids FROM r") + " GROUP BY ALL")
def union_sample(spark, sf_dir):
    t = PR.prepare_binetflow(binetflow(spark, sf_dir), benign=5000, keep=["row_id"], row_key=["row_id"])
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_ids"))


TIME_SPLIT = f"""WITH {BC}, r AS (SELECT row_id, lab AS label, start_time, row_number() OVER (ORDER BY start_time, substr(md5(row_id), 1, 15)) >
  CAST(floor((SELECT count(*) FROM labelled) * 0.75) AS BIGINT) AS is_test FROM labelled)"""


@query("time_split", f"{TIME_SPLIT} SELECT * FROM r")
def time_split(spark, sf_dir):
    t = binetflow_table(spark, sf_dir).select("row_id", "label", "start_time")
    return SP.time_split(t, 0.25, ["row_id"])


@query("time_split_ranges", f"""{TIME_SPLIT} SELECT is_test, count(*) AS n_rows, count(CASE WHEN label = 0 THEN 1 END) AS n_benign,
  count(CASE WHEN label = 1 THEN 1 END) AS n_c2, min(start_time) AS t_first, max(start_time) AS t_last FROM r GROUP BY is_test""")
def time_split_ranges(spark, sf_dir):
    return SP.split_ranges(time_split(spark, sf_dir))


@query("random_split", f"""WITH {BC}, k AS (SELECT count(*) AS n, count(CASE WHEN lab = 0 THEN 1 END) AS n0 FROM labelled),
  q AS (SELECT *, n - CAST(ceil(n * 0.25) AS BIGINT) AS tr FROM k),
  f AS (SELECT *, n0 * tr / CAST(n AS DOUBLE) AS s0, (n - n0) * tr / CAST(n AS DOUBLE) AS s1 FROM q),
  z AS (SELECT *, floor(s0) + CASE WHEN floor(s0) + floor(s1) < tr AND s0 - floor(s0) >= s1 - floor(s1) THEN 1 ELSE 0 END AS q0 FROM f),
  r AS (SELECT row_id, lab AS label, row_number() OVER (PARTITION BY lab ORDER BY {_ordered(42)}) AS rn FROM labelled)
  SELECT row_id, label, rn > CASE WHEN label = 0 THEN q0 ELSE tr - q0 END AS is_test FROM r, z""")
def random_split(spark, sf_dir):
    t = binetflow_table(spark, sf_dir).select("row_id", "label")
    return SP.random_split(t, 0.25, 42, ["row_id"])


@query("single_class_check", f"{TIME_SPLIT} SELECT is_test, min(label) <> max(label) AS both_classes FROM r GROUP BY is_test")
def single_class_check(spark, sf_dir):
    return SP.single_class_check(time_split(spark, sf_dir))


@query("class_counts", f"WITH {BC} SELECT lab AS label, count(*) AS n_rows FROM labelled GROUP BY lab")
def class_counts(spark, sf_dir):
    return LA.class_counts(binetflow_table(spark, sf_dir))


@query("class_balance", f"""WITH {BC}, c AS (SELECT count(CASE WHEN lab = 0 THEN 1 END) AS benign, count(CASE WHEN lab = 1 THEN 1 END) AS c2 FROM labelled)
  SELECT *, {O.fx('benign / CAST(greatest(c2, 1) AS DOUBLE)')} AS imbalance FROM c""")
def class_balance(spark, sf_dir):
    return LA.class_balance(binetflow_table(spark, sf_dir)).withColumn("imbalance", fx(F.col("imbalance")))


@query("scenario_counts", f"WITH {BC} SELECT scenario, count(*) AS n_rows, CAST(sum(lab) AS BIGINT) AS n_c2 FROM labelled GROUP BY scenario")
def scenario_counts(spark, sf_dir):
    return LA.scenario_counts(binetflow_table(spark, sf_dir))


@query("class_weights", f"""WITH {BC}, c AS (SELECT count(*) AS n, count(CASE WHEN lab = 0 THEN 1 END) / CAST(count(CASE WHEN lab = 1 THEN 1 END) AS DOUBLE) AS pw FROM labelled)
  SELECT lab AS label, count(*) AS n_rows, {O.fx('any_value(n) / CAST(2 * count(*) AS DOUBLE)')} AS weight, {O.fx('any_value(pw)')} AS pos_weight FROM labelled, c GROUP BY lab""")
def class_weights(spark, sf_dir):
    w = LA.class_weights(binetflow_table(spark, sf_dir))
    return w.withColumns({"weight": fx(F.col("weight")), "pos_weight": fx(F.col("pos_weight"))})


# --- label join ---------------------------------------------------------------

FLOWS_AND_LABELS = f"WITH RECURSIVE {O.packets()}, {O.assigned()}, {O.FLOWS}, {O.FLOW_LABELS}"


def _flows_and_labels(spark, sf_dir):
    flows = FL.long_enough(FL.summarise_flows(FL.assign_flows(X.event_packets(spark, sf_dir), X.EVENT_RULES)))
    labels = X.flow_labels(spark, sf_dir).withColumn("label", S.norm_label(F.col("label")))
    return flows.select("flow_id", "flow_seq", "total_packets"), labels


@query("label_join", f"""{FLOWS_AND_LABELS} SELECT flow_id, flow_seq, total_packets, CAST(label AS BIGINT) AS label FROM flows JOIN last_labels USING (flow_id)
  WHERE total_packets >= 2""")
def label_join(spark, sf_dir):
    return LA.label_join(*_flows_and_labels(spark, sf_dir))


@query("unmatched_flows", f"""{FLOWS_AND_LABELS} SELECT flow_id, flow_seq, total_packets FROM flows WHERE total_packets >= 2
  AND flow_id NOT IN (SELECT flow_id FROM last_labels)""")
def unmatched_flows(spark, sf_dir):
    return LA.unmatched_flows(*_flows_and_labels(spark, sf_dir))


# --- metrics ------------------------------------------------------------------

CONFUSION = f"""WITH {SC}, c AS (SELECT count(CASE WHEN label = 0 AND proba_c2 < 0.5 THEN 1 END) AS tn,
  count(CASE WHEN label = 0 AND proba_c2 >= 0.5 THEN 1 END) AS fp, count(CASE WHEN label = 1 AND proba_c2 < 0.5 THEN 1 END) AS fn,
  count(CASE WHEN label = 1 AND proba_c2 >= 0.5 THEN 1 END) AS tp FROM scored),
d AS (SELECT CAST(tn AS DOUBLE) AS a, CAST(fp AS DOUBLE) AS b, CAST(fn AS DOUBLE) AS e, CAST(tp AS DOUBLE) AS g FROM c)"""
RATES = {
    "precision": "g / (g + b)", "recall": "g / (g + e)", "f1": "2 * g / (2 * g + b + e)", "fpr": "b / (b + a)", "fnr": "e / (e + g)",
    "balanced_accuracy": "(g / (g + e) + a / (a + b)) / 2", "mcc": "(g * a - b * e) / sqrt((g + b) * (g + e) * (a + b) * (a + e))",
}
CURVE = f"""WITH {SC}, g AS (SELECT proba_c2, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg FROM scored GROUP BY proba_c2),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
  WINDOW w AS (ORDER BY proba_c2 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("confusion", f"{CONFUSION} SELECT * FROM c")
def confusion(spark, sf_dir):
    return M.confusion(X.scored_lines(spark, sf_dir))


@query("classification_metrics", f"{CONFUSION} SELECT c.*, {', '.join(f'{O.fx(v)} AS {k}' for k, v in RATES.items())} FROM c, d")
def classification_metrics(spark, sf_dir):
    m = M.classification_metrics(X.scored_lines(spark, sf_dir))
    return m.withColumns({k: fx(F.col(k)) for k in RATES})


@query("pr_auc", f"{CURVE} SELECT {O.fx('sum(pos / p * tp / (tp + fp))')} AS pr_auc FROM u")
def pr_auc(spark, sf_dir):
    return M.ranking_metrics(X.scored_lines(spark, sf_dir)).select(fx(F.col("pr_auc")).alias("pr_auc"))


@query("roc_auc", f"""WITH {SC}, r AS (SELECT label, rank() OVER (ORDER BY proba_c2) + (count(*) OVER (PARTITION BY proba_c2) - 1) / 2.0 AS rk FROM scored),
  s AS (SELECT CAST(sum(CASE WHEN label = 1 THEN rk END) AS DOUBLE) AS rs, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM r)
  SELECT {O.fx('(rs - p * (p + 1) / 2) / (p * (n - p))')} AS roc_auc FROM s""")
def roc_auc(spark, sf_dir):
    return M.ranking_metrics(X.scored_lines(spark, sf_dir)).select(fx(F.col("roc_auc")).alias("roc_auc"))


@query("per_class_report", f"""{CONFUSION}, k AS (SELECT 'benign' AS class, a / (a + e) AS p, a / (a + b) AS r, 2 * a / (2 * a + b + e) AS f, a + b AS s FROM d
  UNION ALL SELECT 'c2', g / (g + b), g / (g + e), 2 * g / (2 * g + b + e), g + e FROM d),
  w AS (SELECT * FROM k UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(s) FROM k
  UNION ALL SELECT 'weighted', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM k)
  SELECT class, {O.fx('p')} AS precision, {O.fx('r')} AS recall, {O.fx('f')} AS f1, CAST(s AS BIGINT) AS support FROM w""")
def per_class_report(spark, sf_dir):
    r = M.per_class_report(X.scored_lines(spark, sf_dir))
    return r.withColumns({c: fx(F.col(c)) for c in ("precision", "recall", "f1")})


@query("evaluate", CONFUSION + CURVE.replace(f"WITH {SC}", "") + f""", x AS (SELECT sum(pos / p * tp / (tp + fp)) AS pr, sum(neg * (tp - pos / 2) / (p * n)) AS ro FROM u)
  SELECT c.*, {', '.join(f'{O.fx(v)} AS {k}' for k, v in RATES.items())}, {O.fx('pr')} AS pr_auc, {O.fx('ro')} AS roc_auc FROM c, d, x""")
def evaluate(spark, sf_dir):
    m = M.evaluate(X.scored_lines(spark, sf_dir))
    return m.withColumns({k: fx(F.col(k)) for k in M.METRICS})


@query("cross_dataset_eval", f"""WITH {SC} SELECT count(*) AS total_flows, count(CASE WHEN proba_c2 >= 0.5 THEN 1 END) AS flagged_flows,
  max(proba_c2) AS max_proba, {O.fx('count(CASE WHEN proba_c2 >= 0.5 THEN 1 END) / CAST(count(*) AS DOUBLE)')} AS flagged_rate FROM scored""")
def cross_dataset_eval(spark, sf_dir):
    return M.cross_dataset_eval(X.scored_lines(spark, sf_dir)).withColumn("flagged_rate", fx(F.col("flagged_rate")))


@query("fail_gate", f"WITH {SC}, m AS (SELECT max(proba_c2) AS p FROM scored) SELECT 'low' AS gate, p >= 0.95 AS failed FROM m UNION ALL SELECT 'high', p >= 1.1 FROM m")
def fail_gate(spark, sf_dir):
    scored = X.scored_lines(spark, sf_dir)
    low, high = (M.fail_gate(scored, limit).select(F.lit(name).alias("gate"), "failed") for name, limit in (("low", 0.95), ("high", 1.1)))
    return low.unionByName(high)


@query("predict_label", f"""WITH {SC} SELECT row_id, CASE WHEN proba_c2 >= 0.5 THEN 'c2' ELSE 'benign' END AS label,
  {O.fx('CASE WHEN proba_c2 >= 0.5 THEN proba_c2 ELSE 1 - proba_c2 END')} AS confidence FROM scored""")
def predict_label(spark, sf_dir):
    p = F.col("proba_c2")
    return X.scored_lines(spark, sf_dir).select("row_id", S.predict_label(p).alias("label"), fx(S.confidence(p)).alias("confidence"))


# --- reports ------------------------------------------------------------------

REPORTED = ["flow_duration", "total_packets", "total_bytes", "beacon_score", "payload_entropy", "pkts_per_second", "iat_mean"]


def scored_flows(spark, sf_dir):
    """Flows with a stand-in probability that falls with the beacon score."""
    flows = FE.flow_features(X.event_packets(spark, sf_dir), X.EVENT_RULES)
    return flows.withColumn("proba_c2", 1 / (1 + F.col("features.beacon_score").cast("double")))


def _d(name):
    return f"CAST(CAST(f_{name} AS FLOAT) AS DOUBLE)"


FOUND = f"""{O.features(O.packets(), REPORTED, True)}, p AS (SELECT *, 1 / (1 + {_d('beacon_score')}) AS pr FROM feats),
found AS (SELECT flow_id, flow_seq, CASE WHEN pr >= 0.5 THEN 'c2' ELSE 'benign' END AS label,
  round_even(CASE WHEN pr >= 0.5 THEN pr ELSE 1 - pr END, 6) AS confidence, round_even(pr, 6) AS proba_c2, src_ip, src_port, dst_ip, dst_port,
  CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(protocol AS VARCHAR) END AS protocol,
  round_even({_d('flow_duration')}, 3) AS duration_s, CAST(f_total_packets AS BIGINT) AS total_packets, CAST(f_total_bytes AS BIGINT) AS total_bytes,
  round_even({_d('beacon_score')}, 6) AS beacon_score, round_even({_d('payload_entropy')}, 4) AS payload_entropy,
  round_even({_d('pkts_per_second')}, 4) AS pkts_per_second, round_even({_d('iat_mean')}, 6) AS iat_mean FROM p)"""
NUMBERS = ["confidence", "proba_c2", "duration_s", "beacon_score", "payload_entropy", "pkts_per_second", "iat_mean"]
FLAT = ", ".join(O.fx(c, 6) + f" AS {c}" if c in NUMBERS else c for c in R.FLAT_COLUMNS)


def found(spark, sf_dir):
    return R.detections(scored_flows(spark, sf_dir))


def flat(df, more=[]):
    return df.select(*[fx(F.col(c), 6).alias(c) if c in NUMBERS else F.col(c) for c in R.FLAT_COLUMNS], *more)


@query("report_round", f"{FOUND} SELECT {FLAT}, flow_seq FROM found")
def report_round(spark, sf_dir):
    return flat(found(spark, sf_dir), ["flow_seq"])


@query("report_rank", f"{FOUND} SELECT {FLAT}, flow_seq FROM found ORDER BY proba_c2 DESC, flow_id, flow_seq")
def report_rank(spark, sf_dir):
    return flat(R.report_rank(found(spark, sf_dir)), ["flow_seq"])


@query("flag_filter", f"{FOUND} SELECT flow_id, flow_seq, label, {O.fx('proba_c2', 5)} AS proba_c2 FROM found WHERE proba_c2 >= 0.5")
def flag_filter(spark, sf_dir):
    return R.flagged(found(spark, sf_dir)).select("flow_id", "flow_seq", "label", fx(F.col("proba_c2"), 5).alias("proba_c2"))


@query("top_flows", f"""{FOUND} SELECT substr(flow_id, 1, 47) AS flow_id, flow_seq, label, {O.fx('round(proba_c2, 3)')} AS proba_c2,
  {O.fx('round(beacon_score, 4)')} AS beacon_score, {O.fx('round(payload_entropy, 3)')} AS payload_entropy, {O.fx('round(duration_s, 2)')} AS duration_s
  FROM (SELECT * FROM found ORDER BY proba_c2 DESC, flow_id, flow_seq LIMIT 10)""")
def top_flows(spark, sf_dir):
    top = R.top_flows(found(spark, sf_dir), 10)
    return top.withColumns({c: fx(F.col(c)) for c in ("proba_c2", "beacon_score", "payload_entropy", "duration_s")})


@query("report_header", f"""{FOUND} SELECT 1 AS schema_version, 'events' AS source, count(*) AS total_flows,
  count(CASE WHEN proba_c2 >= 0.5 THEN 1 END) AS flagged_flows, CAST(0.5 AS DOUBLE) AS flag_threshold FROM found""")
def report_header(spark, sf_dir):
    return R.report_header(found(spark, sf_dir), "events").drop("analyzed_at", "model")


@query("report_json", f"""{FOUND} SELECT {FLAT}, 1 AS schema_version, 'events' AS source, count(*) OVER () AS total_flows,
  count(CASE WHEN proba_c2 >= 0.5 THEN 1 END) OVER () AS flagged_flows, CAST(0.5 AS DOUBLE) AS flag_threshold FROM found""")
def report_json(spark, sf_dir):
    """Written as JSON lines with an envelope; both read back."""
    path = scratch_dir(spark, "report-json")
    rows = found(spark, sf_dir)
    R.write_json(rows, R.report_header(rows, "events"), path)
    top = spark.read.json(f"{path}/header").first()         # one line
    envelope = [F.lit(top["schema_version"]).cast("int").alias("schema_version"), F.lit(top["source"]).alias("source"),
                F.lit(top["total_flows"]).cast("bigint").alias("total_flows"), F.lit(top["flagged_flows"]).cast("bigint").alias("flagged_flows"),
                F.lit(top["flag_threshold"]).cast("double").alias("flag_threshold")]
    return flat(spark.read.schema(rows.select(*R.FLAT_COLUMNS).schema).json(f"{path}/flows"), envelope)


SHAP_SQL = f"""s AS (SELECT row_id, i, n, ((k * (i + 1)) % 1009 - 504) / 1000.0::DOUBLE AS v FROM
  (SELECT {O.LINE_KEY} AS row_id, l_partkey + l_linenumber AS k, unnest([{', '.join(f"'{n}'" for n in FEATURE_NAMES)}]) AS n,
  unnest(range(34)) AS i FROM (SELECT DISTINCT * FROM lineitem))),
top AS (SELECT row_id, string_agg(n || '=' || CAST(v AS VARCHAR), ';' ORDER BY rk) AS shap_top FROM
  (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, i) AS rk FROM s) WHERE rk <= 8 GROUP BY row_id)"""


def explained_lines(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem").distinct()
    k = F.col("l_partkey") + F.col("l_linenumber")
    values = [((k * (i + 1)) % 1009 - 504) / F.lit(1000.0) for i in range(len(FEATURE_NAMES))]
    shap = F.map_from_arrays(F.array(*[F.lit(n) for n in FEATURE_NAMES]), F.array(*values))
    return li.select(X._line_key().alias("row_id"), shap.alias("shap"))


@query("shap_top_k", f"WITH {SHAP_SQL} SELECT row_id, shap_top FROM top")
def shap_top_k(spark, sf_dir):
    rows = explained_lines(spark, sf_dir)
    return rows.select("row_id", R.shap_text(R.shap_top_k(F.col("shap"))).alias("shap_top"))


@query("report_csv", f"""{FOUND}, a AS (SELECT flow_id, flow_seq, i, n, ((total_packets * 7 + total_bytes) * (i + 1) % 1009 - 504) / 1000.0::DOUBLE AS v FROM
  (SELECT *, unnest([{', '.join(f"'{n}'" for n in FEATURE_NAMES)}]) AS n, unnest(range(34)) AS i FROM found)),
  t AS (SELECT flow_id, flow_seq, string_agg(n || '=' || CAST(v AS VARCHAR), ';' ORDER BY rk) AS shap_top FROM
  (SELECT *, row_number() OVER (PARTITION BY flow_id, flow_seq ORDER BY abs(v) DESC, i) AS rk FROM a) WHERE rk <= 8 GROUP BY ALL)
  SELECT {FLAT}, shap_top FROM found JOIN t USING (flow_id, flow_seq)""")
def report_csv(spark, sf_dir):
    """Written as CSV with flattened attributions and read back."""
    k = (F.col("features.total_packets") * 7 + F.col("features.total_bytes")).cast("bigint")
    values = [((k * (i + 1)) % 1009 - 504) / F.lit(1000.0) for i in range(len(FEATURE_NAMES))]
    shap = F.map_from_arrays(F.array(*[F.lit(n) for n in FEATURE_NAMES]), F.array(*values))
    rows = R.detections(scored_flows(spark, sf_dir).withColumn("shap", shap))
    path = scratch_dir(spark, "report-csv")
    R.write_csv(rows, path)
    schema = R.csv_rows(rows).schema
    return flat(spark.read.schema(schema).option("header", True).csv(path), ["shap_top"])
