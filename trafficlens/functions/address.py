"""Address expressions: private ranges, zones, direction."""

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens import dims

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def _network_prefix(network: str) -> str:
    """Pattern of the leading octets of a network: ``172.16.0.0/12`` gives ``172\\.(?:16|...|31)\\.``."""
    net = ipaddress.ip_network(network)
    whole, bits = divmod(net.prefixlen, 8)
    octets = str(net.network_address).split(".")
    parts = octets[:whole]
    if bits:
        first = int(octets[whole])
        parts.append("(?:" + "|".join(str(v) for v in range(first, first + (1 << (8 - bits)))) + ")")
    return "".join(p + r"\." for p in parts)


def _private_pattern() -> str:
    exceptions = "|".join(a.replace(".", r"\.") for a in dims.GLOBAL_EXCEPTIONS)
    return rf"\A(?!(?:{exceptions})\z)(?:" + "|".join(_network_prefix(n) for n in dims.PRIVATE_NETWORKS) + ")"


_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})"
_IPV6 = rf"\A(?:{_GROUPS}{{7}}|(?:{_GROUPS}{{0,6}})?::(?:{_GROUPS}{{0,6}})?)\z"


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(_IPV4)


def _digit_prefix(network: str) -> str:
    """Pattern of the leading hexadecimal digits of a network of either version."""
    net = ipaddress.ip_network(network)
    digits = f"{int(net.network_address):0{net.max_prefixlen // 4}x}"
    whole, bits = divmod(net.prefixlen, 4)
    if not bits:
        return digits[:whole]
    first = int(digits[whole], 16)
    return digits[:whole] + "[" + "".join(f"{d:x}" for d in range(first, first + (1 << (4 - bits)))) + "]"


def _private_digits_pattern() -> str:
    """Private addresses in 32 digits; an embedded IPv4 address decides for itself."""

    def any_of(networks) -> str:
        return "(?:" + "|".join(_digit_prefix(n) for n in networks) + ")"

    v4 = f"(?!{any_of(dims.GLOBAL_EXCEPTIONS)}){any_of(dims.PRIVATE_NETWORKS)}"
    v6 = f"(?!{any_of(dims.GLOBAL_NETWORKS_V6)}){any_of(dims.PRIVATE_NETWORKS_V6)}"
    return rf"\A(?:0{{20}}ffff{v4}|{v6})"


def _without_dots(ip: Column) -> Column:
    """An IPv4 address at the end as two hexadecimal groups."""
    tail = F.substring_index(ip, ":", -1)
    octets = [F.split_part(tail, F.lit("."), F.lit(i)).try_cast("int") for i in range(1, 5)]
    groups = [F.lower(F.hex(octets[i] * 256 + octets[i + 1])) for i in (0, 2)]
    head = F.left(ip, F.length(ip) - F.length(tail))
    return F.when(is_ipv4(tail), F.concat(head, groups[0], F.lit(":"), groups[1])).otherwise(ip)


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; NULL when it is malformed."""
    ip = _without_dots(F.lower(ip))
    missing = 8 - F.size(F.array_remove(F.split(ip, ":"), ""))
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), missing))
    full = F.btrim(F.replace(ip, F.lit("::"), zeros), F.lit(":"))
    padded = F.regexp_replace(full, "([0-9a-f]+)", "000$1")
    digits = F.regexp_replace(padded, r"[0-9a-f]*([0-9a-f]{4})(?::|\z)", "$1")
    # "::" stands for at least one group.
    fits = F.when(ip.contains("::"), missing >= 1).otherwise(missing == 0)
    return F.when(ip.rlike(_IPV6) & fits, digits)


def _private_ipv6(ip: Column) -> Column:
    """True, False, or NULL for malformed text.

    The lambda keeps this long and rarely needed expression out of the code generated for every address,
    which would otherwise grow beyond what the JVM compiles.
    """
    found = F.transform(F.array(ip), lambda x: ipv6_digits(x).rlike(_private_digits_pattern()))
    return F.get(found, F.lit(0))


def is_private(ip: Column) -> Column:
    """Whether an address lies in a network that is not globally reachable; False for malformed text.

    The networks are fixed, so the range test becomes one literal pattern: no join, nothing parsed twice.
    """
    v4 = is_ipv4(ip) & ip.rlike(_private_pattern())
    return F.when(ip.contains(":"), F.coalesce(_private_ipv6(ip), F.lit(False))).otherwise(v4)


def is_public(ip: Column) -> Column:
    """True for public addresses; a missing or malformed address is not public."""
    v4 = is_ipv4(ip) & ~ip.rlike(_private_pattern())
    return F.coalesce(F.when(ip.contains(":"), ~_private_ipv6(ip)).otherwise(v4), F.lit(False))


def is_internal(ip: Column) -> Column:
    """Prefix rule used by the dashboards; a different rule from :func:`is_private`."""
    hit = reduce(lambda a, b: a | b, [ip.startswith(p) for p in dims.INTERNAL_PREFIXES])
    return F.coalesce(hit, F.lit(False))


def host_side(ip: Column, inside: str = "internal", outside: str = "external") -> Column:
    return F.when(is_internal(ip), inside).otherwise(outside)


def host_zone(ip: Column) -> Column:
    return (
        F.when(ip.startswith("192.168."), "internal").when(ip.startswith("172.16."), "dmz").otherwise("external")
    )


def direction(src: Column, dst: Column) -> Column:
    return F.concat(host_side(src), F.lit("_to_"), host_side(dst))
