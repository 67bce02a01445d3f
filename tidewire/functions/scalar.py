"""Row-level expressions. Every function takes and returns Columns, so Catalyst sees through them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import DNS_PORT, ICMP, TCP, UDP

# --- fixed values: vocabularies ----------------------------------------------
PROTO_NUMBERS = {
    "tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "ipv6": 41, "ipv6-icmp": 58, "rtp": 0, "arp": 0,
    "pim": 103, "esp": 50, "ah": 51, "gre": 47, "ospf": 89, "ipnip": 4, "unas": 0, "udt": 0, "rtcp": 0,
}
LABEL_WORDS = {
    "benign": 0, "0": 0, "normal": 0, "background": 0,
    "c2": 1, "1": 1, "malicious": 1, "botnet": 1, "attack": 1,
}
CIC_BENIGN = ["BENIGN", "NORMAL", "BACKGROUND", "0"]
CIC_BENIGN_RAW = ["BENIGN", "NORMAL", "BACKGROUND"]
CIC_BOTNET_RAW = ["BOT", "BOTNET", "BOTNET ARES"]


LARGEST = 1.7976931348623157e308


def bind(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds columns that are worked out once per row, whatever refers to them later.

    Plain projections may be merged into later ones and filters copied below them, which repeats costly text
    work; a one-row `inline` keeps the expression in one place.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite (NaN compares as larger than any number)."""
    return F.coalesce(x.cast("double").between(-LARGEST, LARGEST), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(x.cast("double").between(-LARGEST, LARGEST), x.cast("double"))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or the quotient is not finite."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(is_finite(q), q).otherwise(F.lit(0.0))


def ratio_or(a: Column, b: Column, fallback: float) -> Column:
    """a / b, and `fallback` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(fallback))


def clip_low(x: Column, floor: float = 0.0) -> Column:
    return F.greatest(x, F.lit(floor))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def proto_name(protocol: Column) -> Column:
    p = protocol.cast("int")
    return (
        F.when(p == ICMP, "ICMP").when(p == TCP, "TCP").when(p == UDP, "UDP")
        .otherwise(p.cast("string"))
    )


def _lookup(words: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for pair in words.items() for v in pair])


def proto_number(name: Column) -> Column:
    """IANA number of a protocol name, 0 when unknown."""
    return F.coalesce(F.try_element_at(_lookup(PROTO_NUMBERS), F.lower(F.trim(name))), F.lit(0))


def norm_label(label: Column) -> Column:
    """0 or 1 from the label vocabulary; null when the word is unknown (see `unknown_labels`)."""
    return F.try_element_at(_lookup(LABEL_WORDS), F.lower(F.trim(label.cast("string")))).cast("bigint")


def cic_label(label: Column) -> Column:
    """0 for the benign words, 1 for anything else, also for a missing label."""
    known = F.upper(F.trim(label)).isin(CIC_BENIGN)
    return F.when(known, 0).otherwise(1).cast("bigint")


def binetflow_label(label: Column, include_background: bool = False) -> Column:
    """Class of a binetflow label; null means the row is not used."""
    background = F.lit(0) if include_background else F.lit(None).cast("int")
    return (
        F.when(label.contains("Background"), background)
        .when(label.contains("Botnet"), 1)
        .when(label.contains("Normal"), 0)
        .cast("bigint")
    )


def parse_port(text: Column) -> Column:
    """Port number from decimal or 0x-hex text; 0 when missing or unreadable."""
    t = F.trim(text)
    digits = F.regexp_replace(F.substring(t, 3, 1 << 30), "^0+(?=.)", "")
    long = F.aggregate(F.split(digits, ""), F.lit(0.0), lambda a, c: a * 16 + F.coalesce(F.conv(c, 16, 10).cast("double"), F.lit(0.0)))
    hexadecimal = F.when(F.length(digits) <= 15, F.conv(digits, 16, 10).cast("double")).otherwise(long)
    value = F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexadecimal).otherwise(t.try_cast("double"))
    return F.coalesce(finite_or_null(value), F.lit(0.0))


def us_to_s(x: Column) -> Column:
    return x / F.lit(1e6)


def count_to_flag(count: Column) -> Column:
    return F.when(F.coalesce(count.try_cast("double"), F.lit(0.0)) > 0, 1.0).otherwise(0.0)


def parse_start_time(text: Column, *formats: str) -> Column:
    """Epoch seconds of a UTC text timestamp under the first fitting format; 0 when none fits."""
    tries = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats]
    return F.coalesce(F.unix_micros(F.coalesce(*tries)) / F.lit(1e6), F.lit(0.0))


def entropy_of_counts(counts: Column) -> Column:
    """Bits per symbol of an array of symbol counts; 0 when empty. H = log2 n - sum(c log2 c) / n."""
    n = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c)
    weighted = F.aggregate(
        counts, F.lit(0.0), lambda acc, c: acc + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    )
    return F.when(n > 0, F.greatest(F.log2(n) - weighted / n, F.lit(0.0))).otherwise(0.0)


def _entropies_by_pairs(most: int) -> list[list[float]]:
    """[n][equal pairs]: bits per symbol of n values. For n up to 5 the number of equal pairs tells how the values group."""
    def groups(n, largest):
        return [[]] if n == 0 else [[c, *rest] for c in range(min(n, largest), 0, -1) for rest in groups(n - c, c)]

    table = [[0.0] * (most * (most - 1) // 2 + 1) for _ in range(most + 1)]
    for n in range(1, most + 1):
        for sizes in groups(n, n):
            table[n][sum(c * (c - 1) // 2 for c in sizes)] = max(math.log2(n) - sum(c * math.log2(c) for c in sizes) / n, 0.0)
    return table


def header_entropy(src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """Entropy of five bytes: both ports low and high, and the protocol; null ones do not count."""
    def low(p):
        return p.bitwiseAND(F.lit(255))

    def high(p):
        return F.shiftright(p, 8).bitwiseAND(F.lit(255))

    values = [low(src_port), high(src_port), low(dst_port), high(dst_port), low(protocol)]
    table = _entropies_by_pairs(len(values))
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    pairs = sum((F.when(a == b, 1).otherwise(0) for a, b in itertools.combinations(values, 2)), F.lit(0))
    return F.get(F.array(*[F.lit(h) for row in table for h in row]), n * len(table[0]) + pairs)


def is_dns(src_port: Column, dst_port: Column) -> Column:
    return (src_port == DNS_PORT) | (dst_port == DNS_PORT)


def predict_label(p: Column) -> Column:
    return F.when(p >= 0.5, "c2").otherwise("benign")


def confidence(p: Column) -> Column:
    return F.when(p >= 0.5, p).otherwise(F.lit(1.0) - p)
