"""Packet predicates and the conversation key."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalar import PROTO_NUMBERS


def proto(name_or_number) -> Column:
    n = PROTO_NUMBERS[name_or_number.lower()] if isinstance(name_or_number, str) else int(name_or_number)
    return F.col("protocol") == n


def host(ip: str) -> Column:
    return (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)


def src_host(ip: str) -> Column:
    return F.col("src_ip") == ip


def dst_host(ip: str) -> Column:
    return F.col("dst_ip") == ip


def port(number: int) -> Column:
    return (F.col("src_port") == number) | (F.col("dst_port") == number)


def src_port(number: int) -> Column:
    return F.col("src_port") == number


def dst_port(number: int) -> Column:
    return F.col("dst_port") == number


def _ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, "\\.")
    octets = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    return F.when(
        F.size(parts) == 4,
        octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3],
    )


def _ipv6_digits(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address in text, null for other text."""
    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    halves = F.split(F.lower(ip), "::")
    left, right = groups(F.get(halves, 0)), groups(F.coalesce(F.get(halves, 1), F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.when(ip.contains(":"), F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ""))


def _net6(cidr: str) -> Column:
    found = ipaddress.IPv6Network(cidr, strict=False)
    low, high = (f"{int(a):032x}" for a in (found.network_address, found.broadcast_address))

    def inside(ip: Column) -> Column:
        return F.coalesce(_ipv6_digits(ip).between(low, high), F.lit(False))

    return inside(F.col("src_ip")) | inside(F.col("dst_ip"))


def net(cidr: str) -> Column:
    """Either end lies in an IPv4 or IPv6 network. Byte-aligned IPv4 masks become prefix tests a scan can push down."""
    if ":" in cidr:
        return _net6(cidr)
    base, bits = cidr.split("/")
    bits = int(bits)
    if bits == 0:
        return F.col("src_ip").contains(".") | F.col("dst_ip").contains(".")
    if bits in (8, 16, 24):
        prefix = ".".join(base.split(".")[: bits // 8]) + "."
        return F.col("src_ip").startswith(prefix) | F.col("dst_ip").startswith(prefix)
    number = 0
    for octet in base.split("."):
        number = number * 256 + int(octet)
    size = 1 << (32 - bits)
    first = number // size * size

    def inside(ip):
        value = _ipv4_number(ip)
        return F.coalesce((value >= first) & (value < first + size), F.lit(False))

    return inside(F.col("src_ip")) | inside(F.col("dst_ip"))


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Adds the direction-free 5-tuple and `from_lo`: was the packet sent by the smaller end?

    Ends compare by address text, then port. When both ends are the same, every packet is `from_lo`.
    """
    from_lo = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port"))
    )

    def pick(a, b):
        return F.when(from_lo, F.col(a)).otherwise(F.col(b))

    return packets.withColumns({
        "lo_ip": pick("src_ip", "dst_ip"), "lo_port": pick("src_port", "dst_port"),
        "hi_ip": pick("dst_ip", "src_ip"), "hi_port": pick("dst_port", "src_port"),
        "from_lo": from_lo,
    })


def flow_id() -> Column:
    """`lo_ip:lo_port-hi_ip:hi_port-protocol`"""
    return F.concat(
        F.concat_ws(":", "lo_ip", F.col("lo_port").cast("string")), F.lit("-"),
        F.concat_ws(":", "hi_ip", F.col("hi_port").cast("string")), F.lit("-"),
        F.col("protocol").cast("string"),
    )
