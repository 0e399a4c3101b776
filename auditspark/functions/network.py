"""Addresses and networks as fixed-width hex keys.

An address is 8 (IPv4) or 32 (IPv6) hex digits, so the length names the family.
Containment becomes equality of masked keys, which joins can hash.  Everything
is built from SQL functions; only the canonical spelling of the (small) network
list uses Python.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
# hex digit AND mask of the leading 1, 2 or 3 bits, indexed by the digit
_NIBBLE = {bits: "".join(f"{d & (0xF << (4 - bits) & 0xF):x}" for d in range(16)) for bits in (1, 2, 3)}


def _hex2(octet: Column) -> Column:
    return F.lpad(F.lower(F.hex(octet.cast("int"))), 2, "0")


def _v4_hex(text: Column) -> Column:
    return F.concat(*[_hex2(F.split_part(text, F.lit("."), F.lit(i))) for i in (1, 2, 3, 4)])


# doubled gaps, overlong groups, single colons at an end
_BAD_GROUPS = r"::.*::|:::|[0-9a-fA-F]{5}|(?<!:):\z|\A:(?!:)"


def _v6_groups_hex(text: Column) -> Column:
    """Hex of colon groups: fill the '::' gap, left-pad every group, keep exactly eight."""
    one_if = lambda test: F.when(test, 1).otherwise(0)
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    missing = 8 - colons + one_if(text.startswith("::")) + one_if(text.endswith("::"))
    gap = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.nullif(F.greatest(missing, F.lit(0)), F.lit(0))))
    filled = F.regexp_replace(F.replace(text, F.lit("::"), gap), r"\A:|:\z", "")
    padded = F.regexp_replace(F.lower(F.when(text.contains("::"), filled).otherwise(text)), "([0-9a-f]+)", "000$1")
    packed = F.regexp_replace(padded, r"[0-9a-f]{0,3}([0-9a-f]{4})(?::|\z)", "$1")
    return F.when(~text.rlike(_BAD_GROUPS), F.nullif(F.regexp_extract(packed, r"\A([0-9a-f]{32})\z", 1), F.lit("")))


def _v6_hex(text: Column) -> Column:
    # A dotted tail stands for two groups: '0:0' holds its place, its digits follow after.
    packed = _v6_groups_hex(F.regexp_replace(text, r"[0-9]+\.[0-9.]*\z", "0:0"))
    dotted = F.regexp_extract(text, r"[0-9]+\.[0-9.]*\z", 0)
    plain = ~text.contains(".")
    return F.concat(F.left(packed, F.when(plain, 32).otherwise(24)), F.when(plain, "").when(dotted.rlike(_V4), _v4_hex(dotted)))


def _v4_key(text: Column) -> Column:
    return F.when(text.rlike(_V4), _v4_hex(text))


def _v6_key(text: Column) -> Column:
    return F.when(text.contains(":"), _v6_hex(text))


def ip_hex(text: Column) -> Column:
    """Hex key of an address; NULL for names, zones and malformed text."""
    return F.coalesce(_v4_key(text), _v6_key(text))


def with_ip_hex(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the hex key as a generated column: later filters read it instead of repeating the expression."""
    return df.select("*", F.explode_outer(F.array(ip_hex(F.col(column)))).alias(name))


def mask_hex(key: Column, bits: Column) -> Column:
    """Leading ``bits`` of a hex key (``bits`` may be a column)."""
    whole = F.floor(bits / 4).cast("int")
    digit = F.substr(key, whole + 1, F.lit(1))
    partial = F.lit("")
    for n, table in _NIBBLE.items():
        partial = F.when(bits % 4 == n, F.translate(digit, "0123456789abcdef", table)).otherwise(partial)
    return F.concat(F.left(key, whole), partial)


def last_hex(key: Column, bits: Column) -> Column:
    """Greatest address of the network of ``bits`` leading bits that holds a hex key."""
    whole = F.floor(bits / 4).cast("int")
    digit = F.substr(key, whole + 1, F.lit(1))
    partial = F.lit("")
    for n in _NIBBLE:
        filled = "".join(f"{d | (0xF >> n):x}" for d in range(16))
        partial = F.when(bits % 4 == n, F.translate(digit, "0123456789abcdef", filled)).otherwise(partial)
    return F.rpad(F.concat(F.left(key, whole), partial), F.length(key), F.lit("f"))


def network_key(key: Column, bits: Column) -> Column:
    """Equality key of one network of one family."""
    return F.concat_ws("/", F.length(key).cast("string"), bits.cast("string"), mask_hex(key, bits))


def parse_network(text: str):
    """Driver-side check of one address or CIDR network (no zone)."""
    if "%" in text:
        raise ValueError(f"zones are not supported: {text!r}")
    address, slash, bits = text.partition("/")
    if slash and (not bits.isdigit() or str(int(bits)) != bits):
        raise ValueError(f"invalid network {text!r}")
    return ipaddress.ip_network(f"{ipaddress.ip_address(address)}{slash}{bits}", strict=False)


def _v4_pattern(net: ipaddress.IPv4Network) -> str:
    """Pattern of the addresses of a network: its whole octets, the values of the one that is cut, any others."""
    whole, rest = divmod(net.prefixlen, 8)
    octets = net.network_address.packed
    cut = ["(?:" + "|".join(str(octets[whole] + k) for k in range(1 << (8 - rest))) + ")"] if rest else []
    fixed = [*map(str, octets[:whole]), *cut]
    return r"\A" + r"\.".join([*fixed, *[_OCTET] * (4 - len(fixed))]) + r"\z"


def in_network(text: Column, network: str) -> Column:
    """Containment in one constant network; text that is no address never matches."""
    net = parse_network(network)
    if net.version == 4:
        return F.coalesce(text.rlike(_v4_pattern(net)), F.lit(False))
    key = f"{int(net.network_address):032x}"
    probe = _v6_key(text)
    whole, rest = divmod(net.prefixlen, 4)
    hit = probe.startswith(key[:whole]) if whole else probe.isNotNull()
    if rest:
        digit = F.translate(F.substr(probe, F.lit(whole + 1), F.lit(1)), "0123456789abcdef", _NIBBLE[rest])
        hit = hit & (digit == f"{int(key[whole], 16) & (0xF << (4 - rest) & 0xF):x}")
    return F.coalesce(hit, F.lit(False))


_CANONICAL = T.StructType([T.StructField("value", T.StringType()), T.StructField("hex", T.StringType()),
                           T.StructField("bits", T.IntegerType())])


@F.pandas_udf(_CANONICAL)
def canonical_network(text: pd.Series) -> pd.DataFrame:
    """Canonical spelling, hex key and prefix length; NULLs when invalid."""
    rows = []
    for item in text:
        try:
            net = parse_network(item)
            value = str(net) if "/" in item else str(net.network_address)
            rows.append((value, f"{int(net.network_address):0{8 if net.version == 4 else 32}x}", net.prefixlen))
        except (ValueError, TypeError, AttributeError):
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["value", "hex", "bits"]).astype({"bits": "Int32"})
