"""IPv4 arithmetic and flow-packet headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaylight.fixed import FLOW_VERSIONS


def ip_number(c: Column) -> Column:
    """Dotted IPv4 text as BIGINT; null when malformed."""
    parts = F.split(c, r"\.")
    total = F.lit(0).cast("bigint")
    for i, shift in enumerate((24, 16, 8, 0)):
        total = total + F.shiftleft(F.get(parts, F.lit(i)).try_cast("bigint"), shift)
    return F.when(F.size(parts) >= 4, total)


def network_of(number: Column, prefix: int) -> Column:
    """The network address of ``number`` at a prefix length."""
    mask = (0xFFFFFFFF << (32 - prefix)) & 0xFFFFFFFF
    return number.bitwiseAND(F.lit(mask).cast("bigint"))


def parse_ip(text: str) -> int:
    a, b, c, d = (int(p) for p in text.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def in_subnet(c: Column, cidr: str) -> Column:
    """True when the IPv4 text lies in ``cidr``; malformed text is outside."""
    if "/" not in cidr:
        return F.coalesce(c == F.lit(cidr), F.lit(False))
    net, prefix = cidr.split("/")
    want = parse_ip(net) & (0xFFFFFFFF << (32 - int(prefix))) & 0xFFFFFFFF
    return F.coalesce(
        network_of(ip_number(c), int(prefix)) == F.lit(want).cast("bigint"), F.lit(False)
    )


def big_endian(data: Column, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, 1, n)), 16, 10).cast("bigint")


def flow_version(data: Column) -> Column:
    """Export version of a flow datagram: 16-bit header, else a 32-bit header equal to 5."""
    two, four = big_endian(data, 2), big_endian(data, 4)
    size = F.length(data)
    return (
        F.when(size < 2, F.lit(None))
        .when(two.isin(*FLOW_VERSIONS), two)
        .when((size >= 4) & (four == 5), F.lit(5))
        .cast("int")
    )
