"""Public labelled flow datasets into the training layout.

Each preparation is one narrow plan (scan, project, filter); only sampling adds a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalar import (
    CIC_BENIGN_RAW, CIC_BOTNET_RAW, bind, binetflow_label, cic_label, clip_low, count_to_flag, finite_or_null,
    parse_port, parse_start_time, proto_number, ratio_or, us_to_s,
)
from tidewire.operators import skew
from tidewire.schemas import FEATURE_NAMES

# --- fixed values: where CIC columns go --------------------------------------
CIC_COLUMNS = {
    "flow_duration": "Flow Duration", "fwd_packet_count": "Total Fwd Packets",
    "bwd_packet_count": "Total Backward Packets", "fwd_total_bytes": "Total Length of Fwd Packets",
    "bwd_total_bytes": "Total Length of Bwd Packets", "pkt_len_mean": "Packet Length Mean",
    "pkt_len_std": "Packet Length Std", "pkt_len_min": "Min Packet Length", "pkt_len_max": "Max Packet Length",
    "iat_mean": "Flow IAT Mean", "iat_std": "Flow IAT Std", "iat_min": "Flow IAT Min", "iat_max": "Flow IAT Max",
    "pkts_per_second": "Flow Packets/s", "bytes_per_second": "Flow Bytes/s",
    "avg_payload_size": "Average Packet Size", "dst_port": "Destination Port", "active_time": "Active Mean",
}
CIC_MICROSECONDS = ["flow_duration", "iat_mean", "iat_std", "iat_min", "iat_max", "active_time"]
CIC_FLAGS = {"fwd_syn_flag": "SYN Flag Count", "fwd_fin_flag": "FIN Flag Count", "rst_flag": "RST Flag Count"}
CIC_ZERO = [
    "iat_skew", "iat_kurtosis", "payload_entropy", "header_entropy", "dns_query_entropy", "small_pkt_ratio",
    "active_time", "fwd_payload_bytes", "protocol",
]
CIC_TIMES = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a")
BINETFLOW_NUMBERS = ["Dur", "TotPkts", "TotBytes", "SrcBytes"]
BINETFLOW_TIMES = ("yyyy/MM/dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")


def with_numbers(raw: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns, where present, as finite doubles or null; each text is read once."""
    present = [c for c in columns if c in raw.columns]
    parsed = bind(raw, {f"_n{i}": F.trim(F.col(f"`{c}`")).try_cast("double") for i, c in enumerate(present)})
    values = {c: finite_or_null(F.col(f"_n{i}")).alias(c) for i, c in enumerate(present)}
    return parsed.select(*[values.get(c, F.col(f"`{c}`")) for c in raw.columns])


def filter_finite(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Only rows whose listed columns, where present, are all finite numbers."""
    return with_numbers(raw, columns).dropna(subset=[c for c in columns if c in raw.columns])


def filter_finite_cic(raw: DataFrame) -> DataFrame:
    return filter_finite(raw, list(CIC_COLUMNS.values()))


def filter_finite_binetflow(raw: DataFrame) -> DataFrame:
    return filter_finite(raw, BINETFLOW_NUMBERS)


def filter_botnet_only(raw: DataFrame) -> DataFrame:
    return raw.filter(F.upper(F.trim("Label")).isin(CIC_BENIGN_RAW + CIC_BOTNET_RAW))


def _as_table(df: DataFrame, values: dict[str, Column], keep: list[str], tail: list[Column]) -> DataFrame:
    return df.select(*keep, *[values[n].cast("float").alias(n) for n in FEATURE_NAMES], *tail)


def cic_transform(clean: DataFrame, keep: list[str] = [], formats: tuple[str, ...] = CIC_TIMES) -> DataFrame:
    """34 features, label, start_time from cleaned CIC rows. Byte sums, ratios and rates derive from columns."""
    if "Label" not in clean.columns:
        raise ValueError("CIC input lacks the 'Label' column")
    direct = {}
    for name, source in CIC_COLUMNS.items():
        value = F.col(f"`{source}`").cast("double") if source in clean.columns else F.lit(0.0)
        direct[name] = us_to_s(value) if name in CIC_MICROSECONDS else value
    v = direct
    fwd, bwd = v["fwd_total_bytes"], v["bwd_total_bytes"]
    v["total_packets"] = v["fwd_packet_count"] + v["bwd_packet_count"]
    v["total_bytes"] = fwd + bwd
    v["fwd_bwd_byte_ratio"] = ratio_or(fwd, fwd + bwd, 0.0)
    v["direction_dominance"] = ratio_or(F.greatest(fwd, bwd), fwd + bwd, 0.0)
    v["beacon_score"] = ratio_or(v["iat_std"], v["iat_mean"], 0.0)
    for name, source in CIC_FLAGS.items():
        v[name] = count_to_flag(F.col(f"`{source}`")) if source in clean.columns else F.lit(0.0)
    v.update({n: F.lit(0.0) for n in CIC_ZERO})
    start = parse_start_time(F.col("Timestamp"), *formats) if "Timestamp" in clean.columns else F.lit(0.0)
    return _as_table(clean, v, keep, [cic_label(F.col("Label")).alias("label"), start.alias("start_time")])


def binetflow_label_filter(raw: DataFrame, include_background: bool = False) -> DataFrame:
    return raw.withColumn("label", binetflow_label(F.col("Label"), include_background)).filter("label is not null")


def split_packet_counts(packets: Column, share: Column) -> tuple[Column, Column]:
    """Forward and backward packets by byte share, rounded half to even, the rest never below 0."""
    fwd = F.rint(packets * share)
    return fwd, clip_low(packets - fwd)


def binetflow_transform(labelled: DataFrame, keep: list[str] = []) -> DataFrame:
    """34 features, label, start_time, scenario from cleaned and labelled binetflow rows."""
    packets, total, fwd = (F.col(c).cast("double") for c in ("TotPkts", "TotBytes", "SrcBytes"))
    duration = F.col("Dur").cast("double")
    bwd = clip_low(total - fwd)
    fwd_packets, bwd_packets = split_packet_counts(packets, ratio_or(fwd, total, 0.5))
    v = {n: F.lit(0.0) for n in FEATURE_NAMES}
    v.update({
        "flow_duration": duration, "total_packets": packets, "total_bytes": total,
        "fwd_packet_count": fwd_packets, "bwd_packet_count": bwd_packets,
        "fwd_total_bytes": fwd, "bwd_total_bytes": bwd,
        "fwd_bwd_byte_ratio": ratio_or(fwd, total, 0.0),
        "direction_dominance": ratio_or(F.greatest(fwd, bwd), total, 0.0),
        "pkts_per_second": ratio_or(packets, duration, 0.0), "bytes_per_second": ratio_or(total, duration, 0.0),
        "avg_payload_size": ratio_or(total, packets, 0.0),
        "protocol": proto_number(F.col("Proto")),
        "dst_port": parse_port(F.col("Dport")) if "Dport" in labelled.columns else F.lit(0.0),
    })
    start = parse_start_time(F.col("StartTime"), *BINETFLOW_TIMES) if "StartTime" in labelled.columns else F.lit(0.0)
    tail = [F.col("label").cast("bigint").alias("label"), start.alias("start_time")]
    if "scenario" in labelled.columns:
        tail.append(F.col("scenario").cast("int").alias("scenario"))
    return _as_table(labelled, v, keep, tail)


def require_attacks(table: DataFrame) -> DataFrame:
    """The table itself; refused where no row is an attack, as nothing can be learned from it."""
    if table.filter("label = 1").isEmpty():
        raise ValueError("no attack rows are left after preparation")
    return table


def prepare_cic(
    raw: DataFrame, only_botnet: bool = False, benign: int | None = None, seed: int = 42, keep: list[str] = [], row_key: list[str] | None = None,
) -> DataFrame:
    rows = filter_botnet_only(raw) if only_botnet else raw
    table = cic_transform(filter_finite_cic(rows), keep)
    return require_attacks(table if benign is None else benign_sample(table, benign, seed, row_key))


def prepare_binetflow(
    raw: DataFrame, include_background: bool = False, benign: int | None = None, seed: int = 42, keep: list[str] = [], row_key: list[str] | None = None,
) -> DataFrame:
    rows = binetflow_label_filter(filter_finite_binetflow(raw), include_background)
    table = binetflow_transform(rows, keep)
    return require_attacks(table if benign is None else benign_sample(table, benign, seed, row_key))


def clean_drop_stats(raw: DataFrame, columns: list[str], usable: Column | None = None) -> DataFrame:
    """One pass, one row: rows seen, dropped while cleaning, dropped for their label, with percentages."""
    finite = F.lit(True)
    numbers = with_numbers(raw, columns)
    for c in columns:
        if c in raw.columns:
            finite = finite & F.col(f"`{c}`").isNotNull()
    usable = F.lit(True) if usable is None else usable
    flags = numbers.select(finite.alias("ok"), F.coalesce(usable, F.lit(False)).alias("use"))

    def percent(part, whole):
        return F.lit(100.0) * part / F.greatest(whole, F.lit(1))

    counts = flags.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("ok")).alias("dropped_clean"),
        F.count_if(F.col("ok") & ~F.col("use")).alias("dropped_label"),
    )
    return counts.withColumns({
        "pct_clean": percent(F.col("dropped_clean"), F.col("n_rows")),
        "pct_label": percent(F.col("dropped_label"), F.col("n_rows") - F.col("dropped_clean")),
    })


def benign_sample(table: DataFrame, n: int, seed: int = 42, row_key: list[str] | None = None) -> DataFrame:
    """Exactly n benign rows and every attack row; all rows when n benign rows or fewer exist.

    Which rows: the n smallest by md5 of seed and row key. The n-th smallest is found from histograms, so no
    task sorts or holds the sample.
    """
    columns = table.columns
    hashed = table.withColumn("_h", skew.hash60(F.lit(str(seed)), *[F.col(c).cast("string") for c in row_key or columns]))
    benign = F.col("label") == 0
    test, cut = skew.first_k(hashed.filter(benign), ["_h"], n, {"_h": skew.HASH_RANGE})
    kept = skew.mark(hashed, [(benign, test, cut), (~benign, F.lit(True), None)], ["_h"], "_keep")
    return kept.filter("_keep").select(*columns)
