"""IP address predicates as expressions: no join, no Python on the executors."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: registered special-purpose ranges counted as private, and the holes in them ---
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
              "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
              "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
PUBLIC_HOLES_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = ["::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
              "2002::/16", "fc00::/7", "fe80::/10"]
PUBLIC_HOLES_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
                   "2001:20::/28", "2001:30::/28"]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(\.{_OCTET}){{3}}"


def is_strict_ipv4(text: Column) -> Column:
    """Dotted quad with octets 0..255 and no leading zeros."""
    return text.rlike(rf"^{_QUAD}$")


def is_ipv4(text: Column) -> Column:
    """Form check only: four groups of one to three digits, each 0..255."""
    shape = text.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))
    return F.coalesce(shape & F.forall(parts, lambda p: p.between(0, 255)), F.lit(False))


def _let(value: Column, body) -> Column:
    """Bind an intermediate value once, so that expression trees stay linear in size."""
    return F.transform(F.array(value), body)[0]


def _v4_private(text: Column) -> Column:
    """The ranges of ``PRIVATE_V4`` as one pattern over a strict quad; two addresses are public."""
    ranges = (r"^(0|10|127|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.0\.[02]\."
              r"|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.")
    return text.rlike(ranges) & is_strict_ipv4(text) & ~text.isin(*[h.split("/")[0] for h in PUBLIC_HOLES_V4])


def ipv6_hex(text: Column) -> Column:
    """IPv6 text to 32 lower-case hex digits; null when malformed."""
    def octets_to_groups(address: Column) -> Column:
        # A dotted IPv4 tail becomes two hex groups.
        octets = F.split(F.regexp_extract(address, r"([0-9.]+)$", 1), r"\.")
        digits = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o.try_cast("int"))), 2, "0")), "")
        return _let(digits, lambda d: F.concat(F.regexp_replace(address, r"[0-9.]+$", ""), F.substring(d, 1, 4),
                                               F.lit(":"), F.substring(d, 5, 4)))

    def expand(address: Column) -> Column:
        halves = F.split(address, "::")
        left = F.filter(F.split(halves[0], ":"), lambda g: g != "")
        right = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
        short = F.contains(address, F.lit("::"))
        known = F.size(left) + F.size(right)
        zeros = F.when(short, F.array_repeat(F.lit("0000"), F.greatest(8 - known, F.lit(0)))).otherwise(
            F.array_repeat(F.lit("0000"), 0))
        full = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")
        sound = (address.rlike(r"^[0-9a-f:]+$") & ~address.rlike(r"[0-9a-f]{5}|:::|^:[^:]|[^:]:$|::.*::")
                 & F.when(short, known <= 7).otherwise(known == 8))
        return F.when(sound, full)

    lowered = F.lower(F.regexp_replace(text, r"%[^%]+$", ""))
    plain = _let(lowered, lambda a: F.when(a.rlike(rf":{_QUAD}$"), octets_to_groups(a)).otherwise(a))
    return _let(plain, expand)


def _v6_hit(digits: Column, ranges: list[str]) -> Column:
    nets = [ipaddress.ip_network(r) for r in ranges]
    table = ", ".join(f"struct('{int(n.network_address):032x}' AS lo, '{int(n.broadcast_address):032x}' AS hi)" for n in nets)
    return F.exists(F.expr(f"array({table})"), lambda r: digits.between(r["lo"], r["hi"]))


def _v6_private(digits: Column) -> Column:
    mapped = F.array_join(F.transform(F.sequence(F.lit(25), F.lit(31), F.lit(2)), lambda i: F.conv(
        F.substr(digits, i, F.lit(2)), 16, 10)), ".")
    return F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), _let(mapped, _v4_private)).otherwise(
        _v6_hit(digits, PRIVATE_V6) & ~_v6_hit(digits, PUBLIC_HOLES_V6))


def is_private(text: Column) -> Column:
    """True for every registered private range of either family; false for anything unparsable."""
    return F.coalesce(F.when(text.contains(":"), _let(ipv6_hex(text), _v6_private)).otherwise(_v4_private(text)), F.lit(False))


def is_rfc1918_text(text: Column) -> Column:
    """Prefix test on the text, as the internal/external user tag defines it."""
    return text.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def attributed_user(src_ip: Column, dst_ip: Column) -> Column:
    """First private side, else a known source, else the destination."""
    return (F.when(is_private(src_ip), src_ip)
            .when(is_private(dst_ip), dst_ip)
            .when((src_ip != "") & (src_ip != "unknown"), src_ip)
            .otherwise(dst_ip))
