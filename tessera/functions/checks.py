"""Small predicates on columns: card numbers, reserved addresses, globs, address kinds."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Domains that are reserved for documentation and tests.
RESERVED_DOMAIN = r"(?i)(@|\.)example\.(com|net|org)$|\.(test|example|invalid|localhost)$"


def is_card_number(candidate: Column) -> Column:
    """13 to 19 digits, separators aside, with a right check digit."""
    digits = F.regexp_replace(candidate, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def is_reserved_address(address: Column) -> Column:
    return address.rlike(RESERVED_DOMAIN)


_GLOB = re.compile(r"\*|\?|\[(!?)(\]?[^\]]*)\]|.", re.S)


def glob_pattern(glob: str) -> str:
    """A shell glob (*, ?, [a-z], [!abc]) as an anchored pattern that ignores case; a bracket left open stands for itself."""

    def part(m: re.Match) -> str:
        if m[2]:
            return "[" + ("^" if m[1] else "") + re.sub(r"[\[\]\\^&]", r"\\\g<0>", m[2]) + "]"
        return {"*": ".*", "?": "."}.get(m[0]) or re.escape(m[0])

    return rf"(?is)\A{_GLOB.sub(part, glob)}\z"


def matches_any_glob(value: Column, globs: list[str]) -> Column:
    """A null value matches nothing."""
    out = F.lit(False)
    for g in globs:
        out = out | value.rlike(glob_pattern(g))
    return F.coalesce(out, F.lit(False))


def dotted_quad(host: Column) -> Column:
    """A plain dotted IPv4 address as a number, else null."""
    parts = F.split(host, r"\.")
    number = sum((F.element_at(parts, i + 1).cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), number)


# IPv4 blocks by kind, first match counts (kind, first address, size).
_BLOCKS = [("link_local", "169.254.0.0", 16), ("loopback", "127.0.0.0", 8), ("private", "10.0.0.0", 8), ("private", "172.16.0.0", 12), ("private", "192.168.0.0", 16), ("private", "0.0.0.0", 8), ("private", "100.64.0.0", 10)]


def _as_number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return a << 24 | b << 16 | c << 8 | d


def address_kind(number: Column) -> Column:
    """link_local, loopback, private or public, of an IPv4 number; null of null."""
    out = F.when(number.isNull(), F.lit(None).cast("string"))
    for kind, first, bits in _BLOCKS:
        start = _as_number(first)
        out = out.when(number.between(start, start + (1 << (32 - bits)) - 1), kind)
    return out.otherwise("public")


@F.pandas_udf(LongType())
def odd_address(hosts: pd.Series) -> pd.Series:
    """IPv4 numbers of hosts in hexadecimal, octal, decimal, short or IPv6-mapped spelling, else null."""
    import ipaddress

    def number(host: str | None) -> int | None:
        if not host:
            return None
        host = host.strip("[]").lower()
        if ":" in host:
            try:
                v6 = ipaddress.IPv6Address(host)
            except ValueError:
                return None
            mapped = v6.ipv4_mapped
            return int(mapped) if mapped else 0x7F000001 if v6.is_loopback else 0xA9FE0000 if v6.is_link_local else 0x0A000000 if v6.is_private else None
        parts = host.split(".")
        if not 1 <= len(parts) <= 4:
            return None
        try:
            values = [int(p, 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
        except ValueError:
            return None
        *front, last = values
        if any(not 0 <= v <= 255 for v in front) or not 0 <= last < 256 ** (5 - len(parts)):
            return None
        return sum(v << (24 - 8 * i) for i, v in enumerate(front)) + last

    return hosts.map(number, na_action="ignore").astype("Int64")
