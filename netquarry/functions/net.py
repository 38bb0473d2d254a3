"""IP, subnet and MAC expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 1918 ranges as string prefixes.
PRIVATE_PREFIX = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
# One octet, a whole address, and the ranges not routed outside.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = "^" + r"\.".join([OCTET] * 4) + "$"
NOT_ROUTED = r"^(10\.|127\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.)"
# Fixed value: what counts as an IPv4 literal in a DNS answer.
IPV4_LITERAL = r"^[0-9]+(\.[0-9]+)+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_internal(ip) -> Column:
    """RFC 1918 membership by prefix; null and '' are not internal."""
    return F.coalesce(_c(ip).rlike(PRIVATE_PREFIX), F.lit(False))


def is_ipv4(ip) -> Column:
    """Four dot-separated numbers from 0 to 255; false for null."""
    return F.coalesce(_c(ip).rlike(IPV4), F.lit(False))


def ip_number(ip) -> Column:
    """IPv4 as bigint, null when malformed."""
    parts = F.split(_c(ip), r"\.")
    a, b, c, d = (F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4))
    return F.when(is_ipv4(ip), a * 16777216 + b * 65536 + c * 256 + d)


def is_enrichable(ip) -> Column:
    """True for addresses worth an outside lookup: well formed and not
    private, loopback or link-local."""
    return is_ipv4(ip) & ~F.coalesce(_c(ip).rlike(NOT_ROUTED), F.lit(False))


def cidr_pattern(cidr: str) -> str:
    """A literal network as one regular expression. IPv4: whole octets as they
    are, the split octet as its range, the rest as any octet. IPv6: the same
    by hex digit, over the 32 digits of ``ipv6_digits``."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 6:
        whole, rest = divmod(net.prefixlen, 4)
        digits = net.network_address.exploded.replace(":", "")
        low = int(digits[whole], 16) if rest else 0
        split = "[" + "".join(f"{n:x}" for n in range(low, low + 2 ** (4 - rest))) + "]" if rest else ""
        return "^" + digits[:whole] + split
    whole, rest = divmod(net.prefixlen, 8)
    first = str(net.network_address).split(".")
    parts = first[:whole]
    if rest:
        low = int(first[whole])
        parts.append("(?:" + "|".join(str(n) for n in range(low, low + 2 ** (8 - rest))) + ")")
    parts += [OCTET] * (4 - len(parts))
    return "^" + r"\.".join(parts) + "$"


def ipv6_digits(ip) -> Column:
    """The 32 hex digits of an IPv6 address in any of its hex spellings, else null."""
    text = F.lower(_c(ip))

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    halves = F.split(text, "::")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)).cast("int")), right)
    shaped = text.rlike("^[0-9a-f:]+$") & F.when(F.contains(text, F.lit("::")), (F.size(halves) == 2) & (missing > 0)).otherwise(
        (missing == 0) & text.rlike("^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$")
    ) & ~F.exists(whole, lambda g: F.length(g) > 4)
    return F.when(shaped, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def in_cidr(ip, cidr: str) -> Column:
    """Membership in a literal network: one compiled pattern per rule, so it
    costs the same inside and outside generated code. Addresses of the other
    version are outside."""
    text = ipv6_digits(ip) if ipaddress.ip_network(cidr, strict=False).version == 6 else _c(ip)
    return F.coalesce(text.rlike(cidr_pattern(cidr)), F.lit(False))


def subnet24(ip) -> Column:
    """``a.b.c.0/24`` for four-part addresses, else null."""
    parts = F.split(_c(ip), r"\.")
    return F.when(
        F.size(parts) == 4,
        F.concat(F.substring_index(_c(ip), ".", 3), F.lit(".0/24")),
    )


def is_ipv4_literal(text) -> Column:
    return F.coalesce(_c(text).rlike(IPV4_LITERAL), F.lit(False))


def normalize_mac(mac) -> Column:
    return F.upper(F.replace(F.trim(_c(mac)), F.lit("-"), F.lit(":")))


def mac_prefix(mac) -> Column:
    """OUI part of a normalised MAC, null when too short."""
    m = _c(mac)
    return F.when(F.length(m) >= 8, F.upper(F.substring(m, 1, 8)))


def node_id(sensor, vlan, ip) -> Column:
    return F.concat_ws(":", _c(sensor), _c(vlan), _c(ip))
