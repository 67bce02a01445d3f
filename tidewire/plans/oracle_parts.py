"""SQL building blocks: the derived tables of `fixtures`, and flow building as a recursive query."""

KEY = "lo_ip, lo_port, hi_ip, hi_port, protocol"


def fx(expr: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def f32(expr: str, digits: int = 3) -> str:
    """A value as FLOAT, shown with few digits."""
    return fx(f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)", digits)


def packets(payload: str = "encode(props)", source: str = "events") -> str:
    return f"""
ev AS (
  SELECT event_id, epoch_us(ts) AS ts_us, event_type, CAST(floor(value) AS INTEGER) AS size,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client, '10.1.0.' || (user_id % 5) AS server,
    CASE WHEN user_id % 10 < 7 THEN 6 WHEN user_id % 10 < 9 THEN 17 ELSE 1 END AS protocol,
    CAST(40000 + user_id % 25000 AS INTEGER) AS cport,
    CASE user_id % 4 WHEN 0 THEN 53 WHEN 1 THEN 443 WHEN 2 THEN 80 ELSE 8080 END AS sport,
    event_id % 3 = 2 AS back, {payload} AS payload
  FROM {source}),
packets AS (
  SELECT event_id AS packet_seq, ts_us, CASE WHEN back THEN server ELSE client END AS src_ip,
    CASE WHEN back THEN client ELSE server END AS dst_ip,
    CASE WHEN protocol = 1 THEN 0 WHEN back THEN sport ELSE cport END AS src_port,
    CASE WHEN protocol = 1 THEN 0 WHEN back THEN cport ELSE sport END AS dst_port,
    protocol, size + 40 AS length, size AS payload_len,
    CASE WHEN protocol <> 6 THEN 0 ELSE CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 16
      WHEN 'view' THEN 24 WHEN 'purchase' THEN 17 WHEN 'error' THEN 4 ELSE 0 END END AS tcp_flags, payload
  FROM ev)"""


DOCUMENT_PACKETS = packets(
    "encode(text)", "events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)")

CONVERSATION_PACKETS = """
packets AS (
  SELECT conv_id * 1000 + turn AS packet_seq, 1700000000000000 + turn * 1500000 + conv_id AS ts_us,
    CASE WHEN role <> 'user' THEN '10.9.0.53' ELSE '10.2.0.' || (conv_id % 256) END AS src_ip,
    CASE WHEN role <> 'user' THEN '10.2.0.' || (conv_id % 256) ELSE '10.9.0.53' END AS dst_ip,
    CASE WHEN role <> 'user' THEN 53 ELSE CAST(20000 + conv_id % 40000 AS INTEGER) END AS src_port,
    CASE WHEN role <> 'user' THEN CAST(20000 + conv_id % 40000 AS INTEGER) ELSE 53 END AS dst_port,
    17 AS protocol, octet_length(encode(text)) + 28 AS length, octet_length(encode(text)) AS payload_len,
    0 AS tcp_flags, encode(text) AS payload
  FROM conversations)"""


def assigned(tcp_us: int = 43_200_000_000, udp_us: int = 21_600_000_000, teardown: bool = True) -> str:
    """CTEs from `packets` to `assigned`: a flow that starts at position m ends at the nearer of the next RST
    and the first ACK without SYN after the next FIN; the next flow starts right behind."""
    same = " AND ".join(f"w.{c} = e.{c}" for c in KEY.split(", "))
    none = 1 << 40
    close = f"""CASE WHEN protocol = 6 THEN least(coalesce(next_rst, {none}),
      coalesce(min(CASE WHEN (tcp_flags & 1) <> 0 THEN next_ack END) OVER f, {none})) ELSE {none} END"""
    following = f"(PARTITION BY {KEY}, run ORDER BY m ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""
sided AS (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS from_lo FROM packets),
keyed AS (SELECT *, CASE WHEN from_lo THEN src_ip ELSE dst_ip END AS lo_ip,
  CASE WHEN from_lo THEN src_port ELSE dst_port END AS lo_port, CASE WHEN from_lo THEN dst_ip ELSE src_ip END AS hi_ip,
  CASE WHEN from_lo THEN dst_port ELSE src_port END AS hi_port FROM sided),
gaps AS (SELECT *, row_number() OVER k AS n, ts_us - lag(ts_us) OVER k AS gap FROM keyed
  WINDOW k AS (PARTITION BY {KEY} ORDER BY ts_us, packet_seq)),
runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > CASE WHEN protocol = 6 THEN {tcp_us} ELSE {udp_us} END
  THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY n) AS run FROM gaps),
pos AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, run ORDER BY n) AS m FROM runs),
ptr AS (SELECT *, min(CASE WHEN (tcp_flags & 4) <> 0 THEN m END) OVER f AS next_rst,
  min(CASE WHEN (tcp_flags & 16) <> 0 AND (tcp_flags & 2) = 0 THEN m END) OVER f AS next_ack
  FROM pos WINDOW f AS {following}),
ends AS (SELECT *, {close if teardown else none} AS close_m FROM ptr WINDOW f AS {following}),
walk AS (SELECT {KEY}, run, m, close_m FROM ends WHERE m = 1
  UNION ALL SELECT {', '.join('e.' + c for c in KEY.split(', '))}, e.run, e.m, e.close_m
  FROM walk w JOIN ends e ON {same} AND w.run = e.run AND e.m = w.close_m + 1),
numbered AS (SELECT e.*, w.m IS NOT NULL AS starts,
  CAST(sum(CASE WHEN w.m IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY {', '.join('e.' + c for c in KEY.split(', '))}
    ORDER BY e.n) AS BIGINT) AS flow_seq
  FROM ends e LEFT JOIN walk w ON {same} AND w.run = e.run AND w.m = e.m),
assigned AS (SELECT *, CASE WHEN starts THEN NULL ELSE gap END AS iat_us,
  from_lo = first_value(from_lo) OVER (PARTITION BY {KEY}, flow_seq ORDER BY n) AS is_fwd,
  lo_ip || ':' || lo_port || '-' || hi_ip || ':' || hi_port || '-' || protocol AS flow_id FROM numbered)"""


FLOWS = f"""
flows AS (SELECT {KEY}, flow_seq, any_value(flow_id) AS flow_id,
  bool_or(CASE WHEN is_fwd THEN from_lo END) AS fwd_lo, min(ts_us) AS start_us, max(ts_us) AS end_us,
  count(*) AS total_packets, count(CASE WHEN is_fwd THEN 1 END) AS fwd_packets,
  count(CASE WHEN NOT is_fwd THEN 1 END) AS bwd_packets, CAST(sum(length) AS BIGINT) AS total_bytes,
  CAST(coalesce(sum(CASE WHEN is_fwd THEN length END), 0) AS BIGINT) AS fwd_bytes,
  CAST(coalesce(sum(CASE WHEN NOT is_fwd THEN length END), 0) AS BIGINT) AS bwd_bytes,
  CAST(coalesce(sum(CASE WHEN is_fwd THEN payload_len END), 0) AS BIGINT) AS fwd_payload_bytes,
  CAST(coalesce(sum(CASE WHEN NOT is_fwd THEN payload_len END), 0) AS BIGINT) AS bwd_payload_bytes,
  coalesce(bit_or(CASE WHEN is_fwd THEN tcp_flags END), 0) AS fwd_tcp_flags,
  coalesce(bit_or(CASE WHEN NOT is_fwd THEN tcp_flags END), 0) AS bwd_tcp_flags,
  (max(ts_us) - min(ts_us)) / 1e6 AS duration_s,
  avg(length) AS len_mean, stddev_pop(length) AS len_std, min(length) AS len_min, max(length) AS len_max,
  count(CASE WHEN payload_len < 64 THEN 1 END) AS n_small
  FROM assigned GROUP BY {KEY}, flow_seq)"""

ENDS = """CASE WHEN fwd_lo THEN lo_ip ELSE hi_ip END AS src_ip, CASE WHEN fwd_lo THEN lo_port ELSE hi_port END AS src_port,
  CASE WHEN fwd_lo THEN hi_ip ELSE lo_ip END AS dst_ip, CASE WHEN fwd_lo THEN hi_port ELSE lo_port END AS dst_port"""

TIMING = f"""
centred AS (SELECT *, avg(iat_us) OVER fl AS gm, sum(iat_us) OVER fl AS gs, count(iat_us) OVER fl AS gn
  FROM assigned WINDOW fl AS (PARTITION BY {KEY}, flow_seq)),
timing AS (SELECT {KEY}, flow_seq, max(gn) AS n_gaps, max(gm) AS gap_mean, avg(power(iat_us - gm, 2)) AS v2,
  avg(power(iat_us - gm, 3)) AS v3, avg(power(iat_us - gm, 4)) AS v4, min(iat_us) AS gap_min, max(iat_us) AS gap_max,
  coalesce(sum(CASE WHEN iat_us * gn <= gs THEN iat_us END), 0) AS active_us
  FROM centred GROUP BY {KEY}, flow_seq)"""

ENTROPY = f"""
fwd AS (SELECT {KEY}, flow_seq, n, regexp_extract_all(hex(payload), '..') AS l,
  coalesce(sum(octet_length(payload)) OVER (PARTITION BY {KEY}, flow_seq ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM assigned WHERE is_fwd),
sized AS (SELECT {KEY}, flow_seq, sum(len(l)) AS total FROM fwd GROUP BY ALL),
bytes AS (SELECT {KEY}, flow_seq, off + generate_subscripts(l, 1) - 1 AS place, unnest(l) AS b FROM fwd),
hist AS (SELECT {KEY}, flow_seq, b, count(*) AS c,
  count(CASE WHEN total <= 12 OR place >= 12 THEN 1 END) AS d FROM bytes JOIN sized USING ({KEY}, flow_seq) GROUP BY ALL),
entropies AS (SELECT {KEY}, flow_seq, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS payload_entropy,
  CASE WHEN lo_port = 53 OR hi_port = 53 THEN
    log2(sum(d)) - sum(CASE WHEN d > 0 THEN d * log2(d) ELSE 0 END) / sum(d) ELSE 0 END AS dns_query_entropy
  FROM hist GROUP BY {KEY}, flow_seq)"""

HEADER_BYTES = """[src_port & 255, (src_port >> 8) & 255, dst_port & 255, (dst_port >> 8) & 255, protocol & 255]"""


def header_entropy(src: str, dst: str, proto: str) -> str:
    items = [f"({src} & 255)", f"(({src} >> 8) & 255)", f"({dst} & 255)", f"(({dst} >> 8) & 255)", f"({proto} & 255)"]
    count = ["(" + " + ".join(f"CASE WHEN {a} = {b} THEN 1 ELSE 0 END" for b in items) + ")" for a in items]
    # each of the 5 bytes adds log2(5 / count) / 5
    return "(" + " + ".join(f"log2(5.0 / {c}) / 5" for c in count) + ")"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / CAST({b} AS DOUBLE) END"


FEATURES = {
    "flow_duration": "duration_s", "total_packets": "total_packets", "total_bytes": "total_bytes",
    "fwd_packet_count": "fwd_packets", "bwd_packet_count": "bwd_packets", "fwd_total_bytes": "fwd_bytes",
    "bwd_total_bytes": "bwd_bytes", "fwd_bwd_byte_ratio": div("fwd_bytes", "total_bytes"),
    "pkt_len_mean": "len_mean", "pkt_len_std": "len_std", "pkt_len_min": "len_min", "pkt_len_max": "len_max",
    "small_pkt_ratio": div("n_small", "total_packets"), "fwd_payload_bytes": "fwd_payload_bytes",
    "iat_mean": "coalesce(gap_mean, 0) / 1e6", "iat_std": "coalesce(sqrt(v2), 0) / 1e6",
    "iat_min": "coalesce(gap_min, 0) / 1e6", "iat_max": "coalesce(gap_max, 0) / 1e6",
    "iat_skew": "CASE WHEN n_gaps >= 3 AND v2 > 0 THEN v3 / power(v2, 1.5) ELSE 0 END",
    "iat_kurtosis": "CASE WHEN n_gaps >= 4 AND v2 > 0 THEN v4 / (v2 * v2) - 3 ELSE 0 END",
    "beacon_score": div("coalesce(sqrt(v2), 0)", "coalesce(gap_mean, 0)"),
    "pkts_per_second": div("total_packets", "duration_s"), "bytes_per_second": div("total_bytes", "duration_s"),
    "active_time": "active_us / 1e6", "payload_entropy": "coalesce(payload_entropy, 0)",
    "header_entropy": header_entropy("src_port", "dst_port", "protocol"),
    "dns_query_entropy": "coalesce(dns_query_entropy, 0)",
    "avg_payload_size": div("fwd_payload_bytes", "fwd_packets"), "protocol": "protocol", "dst_port": "dst_port",
    "direction_dominance": div("greatest(fwd_bytes, bwd_bytes)", "total_bytes"),
    "fwd_syn_flag": "CASE WHEN (fwd_tcp_flags & 2) <> 0 THEN 1 ELSE 0 END",
    "fwd_fin_flag": "CASE WHEN (fwd_tcp_flags & 1) <> 0 THEN 1 ELSE 0 END",
    "rst_flag": "CASE WHEN ((fwd_tcp_flags | bwd_tcp_flags) & 4) <> 0 THEN 1 ELSE 0 END",
}


def features(source: str, wanted: list[str], entropy: bool = True, min_packets: int = 2) -> str:
    """Up to `feats`: flow_id, flow_seq, ends, times, and the wanted features as doubles."""
    join_entropy = f"LEFT JOIN entropies USING ({KEY}, flow_seq)" if entropy else ""
    columns = ", ".join(f"CAST({FEATURES[n]} AS DOUBLE) AS f_{n}" for n in wanted)
    return f"""WITH RECURSIVE {source}, {assigned()}, {FLOWS}, {TIMING}{', ' + ENTROPY if entropy else ''},
ended AS (SELECT *, {ENDS} FROM flows WHERE total_packets >= {min_packets}),
feats AS (SELECT {KEY}, flow_seq, flow_id, src_ip, src_port, dst_ip, dst_port, start_us, end_us, {columns}
  FROM ended JOIN timing USING ({KEY}, flow_seq) {join_entropy})"""


LINE_KEY = """(l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':' || CAST(l_quantity AS BIGINT)
  || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) || ':' || CAST(round(l_discount * 100) AS BIGINT) || ':' ||
  CAST(round(l_tax * 100) AS BIGINT) || ':' || l_returnflag || ':' || l_linestatus || ':' || strftime(l_shipdate, '%Y%m%d'))"""

BINETFLOW = f"""
raw AS (SELECT strftime(l_shipdate, '%Y/%m/%d') || ' 00:00:00.000000' AS StartTime,
  CASE WHEN l_orderkey % 997 = 0 THEN 'inf' WHEN l_orderkey % 997 = 1 THEN ''
    ELSE CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) END AS Dur,
  CASE l_linenumber % 6 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' WHEN 3 THEN 'arp' WHEN 4 THEN 'TCP ' ELSE 'xyz' END AS Proto,
  '147.32.' || (l_suppkey % 256) || '.1' AS SrcAddr, CAST(1024 + l_partkey % 60000 AS VARCHAR) AS Sport, '->' AS Dir,
  '10.0.' || (l_partkey % 256) || '.9' AS DstAddr,
  CASE l_suppkey % 5 WHEN 0 THEN '53' WHEN 1 THEN '443' WHEN 2 THEN '0x303f' WHEN 3 THEN '' ELSE 'abc' END AS Dport,
  'CON' AS State, '0' AS sTos, '0' AS dTos, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS TotPkts,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS TotBytes,
  CAST(CAST(floor(l_extendedprice * (1 - 5 * l_discount)) AS BIGINT) AS VARCHAR) AS SrcBytes,
  CASE WHEN l_orderkey % 50 = 0 THEN 'other' ELSE CASE l_suppkey % 4 WHEN 0 THEN 'flow=Background-Established'
    WHEN 1 THEN 'flow=From-Normal-V42-Stribrek' WHEN 2 THEN 'flow=From-Botnet-V42-1-TCP'
    ELSE 'flow=From-Normal-V42-To-Botnet' END END AS Label,
  CAST(1 + l_suppkey % 13 AS INTEGER) AS scenario, {LINE_KEY} AS row_id FROM lineitem)"""

BINETFLOW_LABEL = """CASE WHEN Label LIKE '%Background%' THEN NULL WHEN Label LIKE '%Botnet%' THEN 1
  WHEN Label LIKE '%Normal%' THEN 0 END"""

# pieces of the cleaned, labelled binetflow table as numbers
BINETFLOW_CLEAN = f"""{BINETFLOW},
numbers AS (SELECT *, TRY_CAST(Dur AS DOUBLE) AS d, CAST(TotPkts AS DOUBLE) AS pk, CAST(TotBytes AS DOUBLE) AS tb,
  CAST(SrcBytes AS DOUBLE) AS sb, CAST({BINETFLOW_LABEL} AS BIGINT) AS lab FROM raw),
clean AS (SELECT *, CASE WHEN tb = 0 THEN 0.5 ELSE sb / tb END AS share, greatest(tb - sb, 0) AS bb,
  epoch_us(strptime(StartTime, '%Y/%m/%d %H:%M:%S.%f')) / 1e6 AS start_time,
  CASE lower(trim(Proto)) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END AS proto_no,
  CASE Dport WHEN '53' THEN 53 WHEN '443' THEN 443 WHEN '0x303f' THEN 12351 ELSE 0 END AS dst_no
  FROM numbers WHERE isfinite(d)),
labelled AS (SELECT * FROM clean WHERE lab IS NOT NULL)"""

BINETFLOW_FEATURES = {
    "flow_duration": "d", "total_packets": "pk", "total_bytes": "tb", "fwd_packet_count": "round_even(pk * share, 0)",
    "bwd_packet_count": "greatest(pk - round_even(pk * share, 0), 0)", "fwd_total_bytes": "sb", "bwd_total_bytes": "bb",
    "fwd_bwd_byte_ratio": div("sb", "tb"), "avg_payload_size": div("tb", "pk"), "protocol": "proto_no",
    "dst_port": "dst_no", "direction_dominance": div("greatest(sb, bb)", "tb"),
    "pkts_per_second": div("pk", "d"), "bytes_per_second": div("tb", "d"),
}

CIC = f"""
base AS (SELECT *, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(round(l_discount * 100) AS BIGINT) AS disc,
  CAST(l_quantity AS BIGINT) AS qty, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  {LINE_KEY} AS row_id FROM lineitem),
raw AS (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'Bot' WHEN 2 THEN 'DoS Hulk' ELSE ' benign ' END AS "Label"
  FROM base),
clean AS (SELECT *, CASE WHEN upper(trim("Label")) = 'BENIGN' THEN 0 ELSE 1 END AS lab,
  CAST(qty * 3 AS DOUBLE) AS rate_p, CAST(price * 2 AS DOUBLE) AS rate_b,
  epoch_us(date_trunc('day', l_shipdate)) / 1e6 + (line + 5) * 3600 + 900 AS start_time FROM raw WHERE tax <> 1 AND tax <> 0)"""

CIC_FEATURES = {
    "flow_duration": "(tax * 1000003 + line) / 1e6", "total_packets": "qty + line", "total_bytes": "price + disc * 1000",
    "fwd_packet_count": "qty", "bwd_packet_count": "line", "fwd_total_bytes": "price", "bwd_total_bytes": "disc * 1000",
    "fwd_bwd_byte_ratio": div("price", "price + disc * 1000"), "pkt_len_mean": "price % 1500", "pkt_len_std": "price % 700",
    "pkt_len_min": "line * 4", "pkt_len_max": "price % 1500 + 60", "iat_mean": "disc * 50021 / 1e6",
    "iat_std": "tax * 10007 / 1e6", "iat_min": "line / 1e6", "iat_max": "(disc * 90001 + tax) / 1e6",
    "beacon_score": div("(tax * 10007) / 1e6", "(disc * 50021) / 1e6"), "pkts_per_second": "rate_p",
    "bytes_per_second": "rate_b", "avg_payload_size": "price % 1400", "dst_port": "l_partkey % 65536",
    "direction_dominance": div("greatest(price, disc * 1000)", "price + disc * 1000"),
    "fwd_syn_flag": "CASE WHEN line % 3 > 0 THEN 1 ELSE 0 END", "fwd_fin_flag": "qty % 2",
    "rst_flag": "CASE WHEN line = 5 THEN 0 ELSE line % 2 END",
}

SCORED = f"""
scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  round((l_quantity % 25) / 30 + 0.2 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, 3) AS proba_c2, {LINE_KEY} AS row_id
  FROM lineitem)"""

FLOW_LABELS = f"""
ids AS (SELECT DISTINCT lo_ip || ':' || lo_port || '-' || hi_ip || ':' || hi_port || '-' || protocol AS flow_id,
  CAST(string_split(CASE WHEN src_ip LIKE '10.0.%' THEN src_ip ELSE dst_ip END, '.')[4] AS BIGINT) AS u FROM keyed),
labels_raw AS (
  SELECT flow_id, CASE WHEN u % 3 = 0 THEN 'c2' ELSE 'benign' END AS label, 0 AS row_no FROM ids WHERE u % 7 <> 0
  UNION ALL SELECT flow_id, CASE WHEN u % 2 = 0 THEN ' Malicious ' ELSE 'normal' END, 1 FROM ids WHERE u % 7 <> 0 AND u % 5 = 0),
last_labels AS (SELECT flow_id, CASE WHEN lower(trim(label)) IN ('c2', 'malicious') THEN 1 ELSE 0 END AS label
  FROM labels_raw QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY row_no DESC) = 1)"""
