import pytest
from pyspark.sql import functions as F

from tidewire.functions import packets as P
from tidewire.functions import scalar as S
from tidewire.operators import prepare as PR
from tidewire.operators import report as R
from tidewire.schemas import FEATURE_NAMES
from tidewire.sources import tables as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,want", [("80", 80), ("0x303f", 12351), ("0X1f ", 31), ("", 0), ("abc", 0), (None, 0), ("80.0", 80), ("0xzz", 0)])
def test_parse_port(spark, text, want):
    assert one(spark, S.parse_port, text) == want


@pytest.mark.parametrize("text,want,background", [
    ("flow=Background-Established", None, 0), ("flow=From-Botnet-V42-1-TCP", 1, 1), ("flow=From-Normal-V42-Stribrek", 0, 0),
    ("flow=From-Normal-V42-To-Botnet", 1, 1), ("Background-Botnet", None, 0), ("other", None, None), (None, None, None)])
def test_binetflow_label(spark, text, want, background):
    assert one(spark, S.binetflow_label, text) == want
    assert one(spark, lambda c: S.binetflow_label(c, True), text) == background


@pytest.mark.parametrize("text,want", [(" benign ", 0), ("Normal", 0), ("0", 0), ("Bot", 1), (None, 1), ("", 1)])
def test_cic_label(spark, text, want):
    assert one(spark, S.cic_label, text) == want


def test_small_functions(spark):
    assert one(spark, lambda c: S.safe_div(c, F.lit(0.0)), 3.0, "double") == 0
    assert one(spark, lambda c: S.safe_div(c, F.lit(2.0)), float("inf"), "double") == 0
    assert one(spark, S.proto_number, " TCP ") == 6 and one(spark, S.proto_number, "nope") == 0
    assert one(spark, S.proto_name, 47, "int") == "47" and one(spark, S.proto_name, 17, "int") == "UDP"
    assert one(spark, lambda c: S.parse_start_time(c, *PR.CIC_TIMES), "6/7/2017 9:15") == 1496826900
    assert one(spark, lambda c: S.parse_start_time(c, *PR.BINETFLOW_TIMES), "2011/08/10 09:46:53.047277") == 1312969613.047277
    assert one(spark, lambda c: S.parse_start_time(c, *PR.CIC_TIMES), "soon") == 0
    assert one(spark, S.count_to_flag, "") == 0 and one(spark, S.count_to_flag, "3") == 1
    for bad in (float("nan"), float("inf"), -float("inf"), None):
        assert one(spark, S.is_finite, bad, "double") is False
    fwd, bwd = spark.range(1).select(*PR.split_packet_counts(F.lit(5.0), F.lit(0.5))).first()
    assert (fwd, bwd) == (2, 3)         # half to even


def test_predicates(spark):
    rows = [("10.0.0.1", "192.168.1.77", 40000, 443, 6), ("10.0.3.1", "8.8.8.8", 5353, 53, 17)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int")

    def n(test):
        return [r.protocol for r in df.filter(test).collect()]

    assert n(P.proto("udp")) == [17] and n(P.port(443)) == [6] and n(P.host("8.8.8.8")) == [17]
    assert n(P.net("192.168.1.64/26")) == [6] and n(P.net("10.0.0.0/8")) == [6, 17] and n(P.net("10.0.0.0/23")) == [6]
    assert n(P.src_host("10.0.0.1") & P.dst_port(443)) == [6] and n(P.dst_host("10.0.0.1") | P.src_port(1)) == []


def test_headers_and_scenario(spark, tmp_path):
    assert T.normalise_headers([" Flow   Bytes/s", "a ", "a"]) == ["Flow Bytes/s", "a", "a_1"]
    for path, want in (("/d/9/x.binetflow", 9), ("/d/42/x.binetflow", 42), ("/d/x9/x.binetflow", 0), ("/d/123/x.binetflow", 0)):
        assert one(spark, T.scenario_of, path) == want
    with pytest.raises(FileNotFoundError):
        T.resolve_inputs(spark, str(tmp_path / "*.csv"))
    (tmp_path / "3").mkdir()
    (tmp_path / "3" / "a.binetflow").write_bytes(b"Dur , Label\n1,caf\xe9\n2,x\n")
    got = T.binetflow_scan(spark, str(tmp_path / "*" / "*.binetflow"))
    assert got.columns == ["Dur", "Label", "scenario"] and [r.scenario for r in got.collect()] == [3, 3]


def test_feature_table_checks(spark):
    good = spark.range(1).select(*[F.lit(1.0).cast("float").alias(n) for n in FEATURE_NAMES], F.lit(" C2 ").alias("label"))
    assert T.load_features(good).first().label == 1
    with pytest.raises(ValueError, match="label"):
        T.load_features(good.drop("label"))
    with pytest.raises(ValueError, match="feature columns"):
        T.load_features(good.drop("dst_port"))
    with pytest.raises(ValueError, match="outside the vocabulary"):
        T.load_features(good.withColumn("label", F.lit("huh")))


def test_cic_without_optional_columns(spark):
    rows = [("5000000", "3", "BENIGN"), ("Infinity", "1", "Bot"), ("1", None, "Bot")]
    raw = spark.createDataFrame(rows, "`Flow Duration` string, `Total Fwd Packets` string, Label string")
    out = PR.cic_transform(PR.filter_finite_cic(raw)).collect()
    assert len(out) == 1 and out[0].flow_duration == 5 and out[0].total_packets == 3 and out[0].start_time == 0 and out[0].label == 0
    with pytest.raises(ValueError, match="no attack rows"):
        PR.prepare_cic(raw)


def test_report(spark, tmp_path):
    import json
    names = ["beacon_score", "iat_std", "payload_entropy", "dst_port"]
    shap = {"beacon_score": 0.2, "iat_std": -0.3, "payload_entropy": 0.1, "dst_port": -0.2}
    feats = "struct<flow_duration double, total_packets double, total_bytes double, beacon_score double, payload_entropy double, pkts_per_second double, iat_mean double>"
    rows = [(f"f{i}", i, p, "a", 1, "b", 2, 6, (1.23456, 5.0, 700.0, 0.1234567, 7.12345, 1.0, 0.5), shap)
            for i, p in enumerate([0.12, 0.91, 0.4999996])]
    scored = spark.createDataFrame(rows, f"flow_id string, flow_seq bigint, proba_c2 double, src_ip string, src_port int, "
                                         f"dst_ip string, dst_port int, protocol int, features {feats}, shap map<string,double>")
    found = R.detections(scored)
    ranked = R.report_rank(found).collect()
    assert [r.proba_c2 for r in ranked] == [0.91, 0.5, 0.12]
    assert [r.label for r in ranked] == ["c2", "benign", "benign"]          # the label uses the unrounded value
    assert R.flagged(found).count() == 2                                     # the flag the rounded one
    assert [e["name"] for e in ranked[0].shap] == ["iat_std", "beacon_score", "dst_port", "payload_entropy"]
    assert R.csv_rows(found).first().shap_top == "iat_std=-0.3;beacon_score=0.2;dst_port=-0.2;payload_entropy=0.1"
    header = R.report_header(found, "x.pcap", metadata={"dataset": "made", "metrics": {"f1": 1.0}})
    R.write_json(found, header, str(tmp_path / "r"))
    top = json.loads(spark.read.text(str(tmp_path / "r" / "header")).first()[0])
    assert list(top) == ["schema_version", "source", "analyzed_at", "total_flows", "flagged_flows", "flag_threshold", "model"]
    assert top["flagged_flows"] == 2 and json.loads(top["model"])["metrics"] == {"f1": 1.0}
    parts = sorted((tmp_path / "r" / "flows").glob("part-*"))
    lines = [json.loads(line) for part in parts for line in part.read_text().splitlines()]
    assert [f["proba_c2"] for f in lines] == [0.91, 0.5, 0.12] and lines[0]["shap"]["iat_std"] == -0.3
    assert len(names) == len(shap)
