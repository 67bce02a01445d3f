"""The 34 features of a flow, each by its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalar import has_flag, header_entropy, is_finite, safe_div
from tidewire.operators.entropy import payload_entropies, tallied
from tidewire.operators.flows import Chunks, FlowRules, assign_flows, find_chunks, summarise_flows
from tidewire.schemas import (
    ENTROPY_FEATURES, FEATURE_NAMES, FIN, FLOW_ID, FLOW_KEY, MIN_PACKETS, PROTO_FEATURES, RST, SMALL_PAYLOAD,
    STATS_FEATURES, SYN, TIMING_FEATURES,
)

IDENTITY = FLOW_ID + ["flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "start_us", "end_us"]


def moment(value: Column, n: Column, at_least: int) -> Column:
    """A standardised moment, 0 for too few values or no spread."""
    return F.when((n >= at_least) & is_finite(value), value).otherwise(0.0)


def with_active(assigned: DataFrame) -> DataFrame:
    """Adds `active_us`: the packet's gap where it is no longer than the flow's mean gap.

    For integers gap <= sum / n is gap <= floor(sum / n), which needs no fractions.
    """
    flow = Window.partitionBy(*FLOW_ID, "chunk")
    total = F.coalesce(F.col("span_gap_sum"), F.sum("iat_us").over(flow))
    n = F.coalesce(F.col("span_gap_n"), F.count("iat_us").over(flow))
    return (
        assigned.withColumns({"_sum": total, "_n": n})
        .withColumn("active_us", F.when((F.col("_n") > 0) & (F.col("iat_us") <= F.expr("_sum div _n")), F.col("iat_us")))
        .drop("_sum", "_n")
    )


def _without_lone_packets(assigned: DataFrame) -> DataFrame:
    """Packets of flows of at least two; in the order of the assignment, so that nothing is moved or sorted for it."""
    order = Window.partitionBy(*FLOW_KEY).orderBy("ts_us", "packet_seq")
    next_starts = F.coalesce(F.lead("starts").over(order), F.lit(True))
    return assigned.withColumn("_lone", F.col("starts") & next_starts).filter(~F.col("_lone")).drop("_lone")


def _flow_sums(assigned: DataFrame) -> DataFrame:
    gap = F.col("iat_us").cast("double")
    return summarise_flows(assigned, [
        F.avg("length").alias("len_mean"), F.stddev_pop("length").alias("len_std"),
        F.min("length").alias("len_min"), F.max("length").alias("len_max"),
        F.count(F.when(F.col("payload_len") < SMALL_PAYLOAD, 1)).alias("n_small"),
        F.count("iat_us").alias("n_gaps"), F.avg(gap).alias("gap_mean"), F.stddev_pop(gap).alias("gap_std"),
        F.min("iat_us").alias("gap_min"), F.max("iat_us").alias("gap_max"),
        F.skewness(gap).alias("gap_skew"), F.kurtosis(gap).alias("gap_kurt"),
        F.coalesce(F.sum("active_us"), F.lit(0)).alias("active_us"),
    ])


def _definitions() -> dict[str, Column]:
    c = F.col

    def seconds(name):
        return F.coalesce(c(name).cast("double"), F.lit(0.0)) / F.lit(1e6)

    def number(name):
        return c(name).cast("double")

    def flag(flags, bit):
        return F.when(has_flag(flags, bit), 1.0).otherwise(0.0)

    either = c("fwd_tcp_flags").bitwiseOR(c("bwd_tcp_flags"))
    return {
        "flow_duration": c("duration_s"),
        "total_packets": number("total_packets"), "total_bytes": number("total_bytes"),
        "fwd_packet_count": number("fwd_packets"), "bwd_packet_count": number("bwd_packets"),
        "fwd_total_bytes": number("fwd_bytes"), "bwd_total_bytes": number("bwd_bytes"),
        "fwd_bwd_byte_ratio": safe_div(c("fwd_bytes"), c("total_bytes")),
        "pkt_len_mean": c("len_mean"), "pkt_len_std": c("len_std"),
        "pkt_len_min": number("len_min"), "pkt_len_max": number("len_max"),
        "small_pkt_ratio": safe_div(c("n_small"), c("total_packets")),
        "fwd_payload_bytes": number("fwd_payload_bytes"),
        "iat_mean": seconds("gap_mean"), "iat_std": seconds("gap_std"),
        "iat_min": seconds("gap_min"), "iat_max": seconds("gap_max"),
        "iat_skew": moment(c("gap_skew"), c("n_gaps"), 3),
        "iat_kurtosis": moment(c("gap_kurt"), c("n_gaps"), 4),
        "beacon_score": safe_div(c("gap_std"), c("gap_mean")),
        "pkts_per_second": safe_div(c("total_packets"), c("duration_s")),
        "bytes_per_second": safe_div(c("total_bytes"), c("duration_s")),
        "active_time": seconds("active_us"),
        "payload_entropy": F.coalesce(c("payload_entropy"), F.lit(0.0)),
        "header_entropy": header_entropy(c("src_port"), c("dst_port"), c("protocol")),
        "dns_query_entropy": F.coalesce(c("dns_query_entropy"), F.lit(0.0)),
        "avg_payload_size": safe_div(c("fwd_payload_bytes"), c("fwd_packets")),
        "protocol": number("protocol"), "dst_port": number("dst_port"),
        "direction_dominance": safe_div(F.greatest(c("fwd_bytes"), c("bwd_bytes")), c("total_bytes")),
        "fwd_syn_flag": flag(c("fwd_tcp_flags"), SYN), "fwd_fin_flag": flag(c("fwd_tcp_flags"), FIN),
        "rst_flag": flag(either, RST),
    }


GROUPS = {
    "stats": STATS_FEATURES, "timing": TIMING_FEATURES, "entropy": ENTROPY_FEATURES, "proto": PROTO_FEATURES,
}


def flow_features(
    packets: DataFrame, rules: FlowRules = FlowRules(), min_packets: int = MIN_PACKETS,
    groups: tuple[str, ...] = ("stats", "timing", "entropy", "proto"), chunks: Chunks | str | None = "auto",
    long_payloads: bool = True,
) -> DataFrame:
    """One row per flow: its identity columns, then a struct `features` with the asked-for features.

    Only what the asked-for groups need is read and moved: payloads travel, `tallied`, for the entropy group alone,
    in a branch of their own, next to the narrow branch that makes everything else. With `long_payloads` off they travel
    as they are, and no packet passes through Python before it moves: faster, with the same results, where they hold some ten bytes.
    """
    if chunks == "auto":
        chunks = find_chunks(packets, rules)
    if "entropy" in groups and long_payloads:
        packets = tallied(packets)
    assigned = assign_flows(packets, rules, chunks)
    return features_of_assigned(assigned, min_packets, groups, chunks is not None)


def features_of_assigned(
    assigned: DataFrame, min_packets: int = MIN_PACKETS,
    groups: tuple[str, ...] = ("stats", "timing", "entropy", "proto"), in_chunks: bool = False,
) -> DataFrame:
    """As `flow_features`, from packets that already carry their flow."""
    wanted = [name for group in ("stats", "timing", "entropy", "proto") if group in groups for name in GROUPS[group]]
    narrow = with_active(assigned) if "timing" in groups else assigned.withColumn("active_us", F.lit(0))
    flows = _flow_sums(narrow).filter(F.col("total_packets") >= min_packets)
    if "entropy" in groups:
        counted = assigned if in_chunks or min_packets < 2 else _without_lone_packets(assigned)
        flows = flows.join(payload_entropies(counted, in_chunks), FLOW_ID, "left")
    return features_of_sums(flows, wanted)


def features_of_sums(flows: DataFrame, wanted: list[str] = FEATURE_NAMES) -> DataFrame:
    """Identity columns and `features` from one row of sums per flow."""
    definitions = _definitions()
    return flows.select(
        *IDENTITY, F.struct(*[definitions[n].cast("float").alias(n) for n in wanted]).alias("features"))


def feature_columns(features: DataFrame, keep: list[str] = ["flow_id", "flow_seq", "start_us"]) -> DataFrame:
    """The training layout: 34 FLOAT columns in order, `start_time`, and the columns to keep."""
    names = features.schema["features"].dataType.names
    return features.select(
        *[F.col(k) for k in keep], *[F.col("features")[n].alias(n) for n in names],
        (F.col("start_us") / F.lit(1e6)).alias("start_time"),
    )


def feature_projection(table: DataFrame, keep: list[str] = []) -> DataFrame:
    """34 FLOAT columns in canonical order; a missing column or value is 0."""
    def pick(name):
        value = F.col(name) if name in table.columns else F.lit(0.0)
        return F.coalesce(value.cast("float"), F.lit(0.0).cast("float")).alias(name)

    return table.select(*keep, *[pick(n) for n in FEATURE_NAMES])


def zero_features(table: DataFrame, names: list[str]) -> DataFrame:
    unknown = sorted(set(names) - set(FEATURE_NAMES))
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    return table.withColumns({n: F.lit(0.0).cast("float") for n in names})


def non_finite_counts(table: DataFrame) -> DataFrame:
    """One row: per feature the number of rows that are null, NaN or infinite, and `bad_rows` overall."""
    return table.agg(
        *[F.count_if(~is_finite(F.col(n))).alias(n) for n in FEATURE_NAMES],
        F.count_if(~all_finite()).alias("bad_rows"),
    )


def all_finite() -> Column:
    test = F.lit(True)
    for name in FEATURE_NAMES:
        test = test & is_finite(F.col(name))
    return test


def validate_features(table: DataFrame) -> DataFrame:
    """The table itself, after a check that all 34 features are there and finite."""
    missing = [n for n in FEATURE_NAMES if n not in table.columns]
    if missing:
        raise ValueError(f"missing {len(missing)} feature columns: {missing[:5]}")
    bad = non_finite_counts(table).select("bad_rows").first()[0]
    if bad:
        raise ValueError(f"{bad} rows hold non-finite features; clean them first")
    return table
