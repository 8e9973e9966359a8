"""IPv4 addresses and CIDR blocks as integer ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
ADDRESS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
BLOCK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}/(?:3[0-2]|[12]?[0-9])$"


def address_number(address: Column) -> Column:
    """Dotted IPv4 address as a bigint; NULL when it is not one."""
    octets = F.split(address, r"\.")
    return F.when(
        address.rlike(ADDRESS),
        F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.cast("bigint")),
    )


def block_range(block: Column) -> Column:
    """CIDR block as ``struct<lo, hi>``, network and broadcast addresses included; NULL if invalid."""
    sides = F.split(block, "/")
    width = F.when(block.rlike(BLOCK), F.lit(32) - F.try_element_at(sides, F.lit(2)).cast("int"))
    size = F.pow(F.lit(2.0), width).cast("bigint")
    number = address_number(sides[0])
    low = number - F.pmod(number, size)
    return F.when(block.rlike(BLOCK), F.struct(low.alias("lo"), (low + size - 1).alias("hi")))


def client_address(forwarded_for: Column, remote: Column) -> Column:
    """The address a request is judged by: the forwarded one, else the peer's."""
    return F.coalesce(forwarded_for, remote)
