"""Hosts as a URL parser reads them: every spelling of an IP address as one number of 128 bits, in 32 hexadecimal digits.

IPv4 addresses take the place of IPv4-mapped ones, so one order and one table of
ranges holds for both kinds.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAPPED = "0" * 20 + "ffff"
# Address ranges that are never public.
PRIVATE_RANGES = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once: a lambda binds it, where a repeated column would repeat its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4_part(part: Column) -> Column:
    """The value of a part of an IPv4 address: hexadecimal, octal or decimal; null where it is none or has more than 32 bits."""
    base = F.when(part.rlike("^0x[0-9a-f]*$"), 16).when(part.rlike("^0[0-7]+$"), 8).when(part.rlike("^(0|[1-9][0-9]*)$"), 10)
    digits = F.regexp_replace(part, "^(0x)?0*", "")
    value = let(digits, lambda x: F.when(F.length(x) <= 11, F.when(x == "", F.lit(0).cast("long")).when(base == 16, F.conv(x, 16, 10).cast("long")).when(base == 8, F.conv(x, 8, 10).cast("long")).when(base == 10, x.try_cast("long"))))
    return let(value, lambda v: F.when(v < 2**32, v))


def ipv4_hex(host: Column) -> Column:
    """An IPv4 address of one to four parts, in any base, the last part filling what is left; null for anything else."""

    def whole(values: Column) -> Column:
        n = F.size(values)
        last, front = F.element_at(values, -1), F.slice(values, 1, n - 1)
        number = F.aggregate(front, F.lit(0).cast("long"), lambda acc, v: acc * 256 + v)
        room = F.pow(F.lit(2.0), (5 - n) * 8).cast("long")
        fits = n.between(1, 4) & F.forall(front, lambda v: v < 256) & (last < room)
        return F.when(fits, F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(number * room + last)), 8, "0")))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _v4_part), whole)


def ipv6_hex(text: Column) -> Column:
    """An IPv6 address in any spelling (shortened, full, with an IPv4 tail), without brackets and zone; null for anything else."""
    strict = r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"
    listed = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":", -1))
    tail = F.regexp_extract(text, r":([0-9]+\.[0-9.]+)$", 1)

    def plain(t: Column) -> Column:
        four = let(ipv4_hex(t), lambda x: F.concat(F.substr(x, F.lit(25), F.lit(4)), F.lit(":"), F.substr(x, F.lit(29), F.lit(4))))
        return F.when(t == "", text).when(t.rlike(strict), F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(t)), four))

    def groups(halves: Column) -> Column:
        head, rest = listed(F.get(halves, F.lit(0))), listed(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        both = F.struct(F.size(halves).alias("n"), head.alias("head"), rest.alias("rest"))
        filled = lambda x: F.when((x["n"] == 1) & (F.size(x["head"]) == 8), x["head"]).when((x["n"] == 2) & (F.size(x["head"]) + F.size(x["rest"]) <= 7), F.concat(x["head"], F.array_repeat(F.lit("0"), 8 - F.size(x["head"]) - F.size(x["rest"])), x["rest"]))
        return let(both, filled)

    def hexed(parts: Column) -> Column:
        right = F.forall(parts, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(right, F.array_join(F.transform(parts, lambda g: F.lpad(F.lower(g), 4, "0")), ""))

    return let(let(F.split(let(tail, plain), "::", -1), groups), hexed)


def host_of(url: Column) -> Column:
    """struct(scheme, userinfo, host, address, valid) of a URL.

    address is 128 bits in hexadecimal digits for a host that is an IP address in any
    spelling, else null. A host whose last label is a number must be an address, one
    in brackets an IPv6 address, and a port at most 65535: valid is false otherwise,
    and where there is no host. Percent signs in a host are not decoded; it then is
    not valid.
    """
    clean = F.regexp_replace(F.regexp_replace(url, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")

    def parts(c: Column) -> Column:
        scheme = F.lower(F.regexp_extract(c, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
        authority = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\]*([^/\\?#]*)", 1)
        user = F.regexp_replace(F.regexp_extract(authority, r"^(.*)@", 1), ":", "") != ""
        place = F.lower(F.regexp_replace(authority, r"^.*@", ""))
        return F.struct(scheme.alias("scheme"), user.alias("userinfo"), F.regexp_replace(place, r":[0-9]*$", "").alias("host"), F.regexp_extract(place, r":([0-9]*)$", 1).alias("port"))

    def judged(x: Column) -> Column:
        host, bracket = x["host"], F.startswith(x["host"], F.lit("["))
        numeric = host.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        address = F.when(bracket, ipv6_hex(F.regexp_extract(host, r"^\[(.*)\]$", 1))).when(numeric, ipv4_hex(host))
        return F.struct(*[x[c].alias(c) for c in ("scheme", "userinfo", "host", "port")], (bracket | numeric).alias("literal"), address.alias("address"))

    def checked(x: Column) -> Column:
        port = (x["port"] == "") | F.coalesce(F.regexp_replace(x["port"], "^0+(?=.)", "").try_cast("long") <= 65535, F.lit(False))
        named = ~x["host"].rlike(r"[\x00-\x20%<>^|`{}\[\]:@\"]")
        valid = (x["host"] != "") & port & F.when(x["literal"], x["address"].isNotNull()).otherwise(named)
        return F.struct(x["scheme"].alias("scheme"), x["userinfo"].alias("userinfo"), x["host"].alias("host"), x["address"].alias("address"), F.coalesce(valid, F.lit(False)).alias("valid"))

    return let(let(let(clean, parts), judged), checked)


def range_hex(cidr: str) -> tuple[str, str]:
    """First and last address of a range, as 32 digits; IPv4 ranges lie among the mapped addresses."""
    net = ipaddress.ip_network(cidr)
    shift = 0xFFFF << 32 if net.version == 4 else 0
    return f"{int(net.network_address) + shift:032x}", f"{int(net.broadcast_address) + shift:032x}"


def in_ranges(address: Column, ranges: tuple[str, ...] = PRIVATE_RANGES) -> Column:
    """Whether an address of 32 digits lies in one of a few ranges."""
    return reduce(lambda a, b: a | b, [address.between(*range_hex(r)) for r in ranges])


def ipv4_number(ip: Column) -> Column:
    """Four decimal parts as a number, whatever their size."""
    parts = F.split(ip, r"\.")
    return reduce(lambda a, b: a * 256 + b, [F.get(parts, F.lit(i)).cast("long") for i in range(4)])


def range_bounds(cidr: str) -> tuple[int, int]:
    """First and last number of an IPv4 range."""
    net = ipaddress.IPv4Network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def bits_of(address: Column) -> Column:
    """An address of 32 digits as 128 binary digits."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.lpad(F.conv(F.substr(address, i * 8 + 1, F.lit(8)), 16, 2), 32, "0")), "")


def range_prefixes(ranges: DataFrame, column: str = "cidr") -> DataFrame:
    """(cidr, prefix): the leading bits that all addresses of a range share and no other has; ranges(cidr) in any table. Ranges that are none are left out."""
    base, size = F.substring_index(column, "/", 1), F.regexp_extract(column, r"/([0-9]{1,3})$", 1)
    v6 = F.contains(column, F.lit(":"))
    address = F.when(v6, ipv6_hex(base)).otherwise(ipv4_hex(base))
    length = F.when(v6, size.try_cast("int")).otherwise(size.try_cast("int") + 96)
    own = ranges.select(F.col(column).alias("cidr"), F.substr(bits_of(address), F.lit(1), length).alias("prefix"), length.alias("bits"))
    return own.where("prefix is not null and bits between 0 and 128 and (bits >= 96 or cidr like '%:%')").select("cidr", "prefix")


def join_ranges(addresses: DataFrame, ranges: DataFrame, key: str, address: str) -> DataFrame:
    """(key, cidr) of addresses(key, address) and ranges(cidr, prefix) that hold them, as an equi-join.

    Addresses meet a range by its leading bits; only the lengths that occur in ranges
    are tried (at most 129), so the join is one of equal keys however many ranges
    there are.
    """
    lengths = sorted(r[0] for r in ranges.select(F.length("prefix")).distinct().collect())
    bits = addresses.where(F.col(address).isNotNull()).select(key, bits_of(F.col(address)).alias("b"))
    tried = bits.select(key, F.explode(F.array(*[F.substr(F.col("b"), F.lit(1), F.lit(n)) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("prefix"))
    return tried.hint("merge").join(ranges.select("prefix", "cidr"), "prefix").select(key, "cidr")
