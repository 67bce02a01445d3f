"""Table layouts and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: result-defining constants ---------------------------------
TCP_IDLE_SECONDS = 120.0
UDP_IDLE_SECONDS = 60.0
MIN_PACKETS = 2
FIN, SYN, RST, ACK = 1, 2, 4, 16
ICMP, TCP, UDP = 1, 6, 17
SHAP_TOP_N = 8
FLAG_THRESHOLD = 0.5
REPORT_SCHEMA_VERSION = 1
BUNDLE_VERSION = 1
SMALL_PAYLOAD = 64
DNS_PORT = 53
DNS_HEADER_BYTES = 12

# --- fixed values: the 34 features in their append-only order ----------------
FEATURE_NAMES = [
    "flow_duration", "total_packets", "total_bytes", "fwd_packet_count", "bwd_packet_count",
    "fwd_total_bytes", "bwd_total_bytes", "fwd_bwd_byte_ratio", "pkt_len_mean", "pkt_len_std",
    "pkt_len_min", "pkt_len_max", "small_pkt_ratio", "fwd_payload_bytes",
    "iat_mean", "iat_std", "iat_min", "iat_max", "iat_skew", "iat_kurtosis",
    "beacon_score", "pkts_per_second", "bytes_per_second", "active_time",
    "payload_entropy", "header_entropy", "dns_query_entropy", "avg_payload_size",
    "protocol", "dst_port", "direction_dominance", "fwd_syn_flag", "fwd_fin_flag", "rst_flag",
]
STATS_FEATURES = FEATURE_NAMES[:14]
TIMING_FEATURES = FEATURE_NAMES[14:24]
ENTROPY_FEATURES = FEATURE_NAMES[24:28]
PROTO_FEATURES = FEATURE_NAMES[28:]

# --- columns that identify a conversation ------------------------------------
FLOW_KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
FLOW_ID = FLOW_KEY + ["flow_seq"]

PACKETS = T.StructType([
    T.StructField("packet_seq", T.LongType()),      # unique in the table; breaks timestamp ties
    T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("payload_len", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
])

FRAMES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("frame_no", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("linktype", T.IntegerType()),
    T.StructField("orig_len", T.IntegerType()),
    T.StructField("frame", T.BinaryType()),
])

FLOW_LABELS = T.StructType([
    T.StructField("flow_id", T.StringType()),
    T.StructField("label", T.StringType()),
])

FEATURE_TABLE = T.StructType(
    [T.StructField(name, T.FloatType()) for name in FEATURE_NAMES]
    + [T.StructField("label", T.LongType()), T.StructField("start_time", T.DoubleType())]
)


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<bigint>": T.ArrayType(T.LongType()),
}


def fields(text: str) -> list[T.StructField]:
    """`name type, name type` to fields, without a session."""
    return [T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))]
