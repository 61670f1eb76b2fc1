"""Internet addresses by value: IPv6 text to 128 bits, blocks of addresses, host names as a URL parser reads them.

A 128-bit value is 32 hexadecimal digits: equal values are equal strings whatever their spelling, and a block (CIDR) is a
prefix of digits with at most one digit compared bit by bit. Columns only; one pass over a host.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.stage import let

DIGITS = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED_RE = rf"^{DIGITS}(\.{DIGITS}){{3}}$"
EMBEDDED_RE = r"^(?s)(.*:)([0-9.]+)$"
GROUP_RE = "^[0-9a-f]{1,4}$"


def _hex4(high: Column, low: Column) -> Column:
    return F.lower(F.hex(high.cast("int") * 256 + low.cast("int")))


def ipv6_hex(text: Column) -> Column:
    """The value of an IPv6 address (without brackets) as 32 lower-case hexadecimal digits; NULL where a URL parser fails: groups of one to
    four digits, at most one ``::`` (for one group of zeros at least), a dotted IPv4 address in place of the last two groups, no zone."""
    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def plain(low: Column) -> Column:
        """With the dotted part, if any, as two groups."""
        at = lambda p, k: F.try_element_at(p, F.lit(k))
        two = lambda p: F.concat(F.regexp_extract(low, EMBEDDED_RE, 1), _hex4(at(p, 1), at(p, 2)), F.lit(":"), _hex4(at(p, 3), at(p, 4)))
        return let(F.regexp_extract(low, EMBEDDED_RE, 2), lambda dotted: F.when(~dotted.contains("."), low).when(
            dotted.rlike(DOTTED_RE), let(F.split(dotted, r"\."), two)))

    def filled(halves: Column) -> Column:
        left = groups(F.element_at(halves, 1))
        right = F.when(F.size(halves) == 2, groups(F.try_element_at(halves, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return let(F.struct(left.alias("l"), right.alias("r")), lambda x: let(8 - F.size(x["l"]) - F.size(x["r"]), lambda room: F.when(
            F.when(F.size(halves) == 2, room >= 1).otherwise((F.size(halves) == 1) & (room == 0)),
            F.concat(x["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), room)), x["r"]))))

    whole = let(F.lower(text), lambda low: let(plain(low), lambda pairs: F.when(pairs.contains(":"), let(F.split(pairs, "::", -1), filled))))
    return let(whole, lambda w: F.when(F.forall(w, lambda g: g.rlike(GROUP_RE)), F.array_join(F.transform(w, lambda g: F.lpad(g, 4, "0")), "")))


def in_block(value: Column, block: str) -> Column:
    """Is a 32-digit value in the IPv6 block ``block`` (CIDR)?"""
    net = ipaddress.IPv6Network(block)
    digits, bits = divmod(net.prefixlen, 4)
    text = f"{int(net.network_address):032x}"
    inside = value.startswith(text[:digits])
    if bits:
        step = 1 << 4 - bits
        first = int(text[digits], 16)
        inside = inside & F.substring(value, digits + 1, 1).isin([f"{d:x}" for d in range(first, first + step)])
    return inside


def mapped_ipv4(value: Column) -> Column:
    """The IPv4 address inside an IPv4-mapped value as a number, else NULL."""
    return F.when(in_block(value, "::ffff:0:0/96"), F.conv(F.substring(value, 25, 8), 16, 10).cast("bigint"))


# Full-width forms of printable ASCII, and the three other full stops, as host names are mapped before they are read.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "。｡"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."


def read_host(raw: Column) -> Column:
    """A host as a URL parser reads it: bracketed ones as they are, others percent-decoded once as UTF-8 and mapped to lower-case ASCII forms.
    NULL where an escape is malformed."""
    decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    return F.lower(F.when(raw.startswith("["), raw).otherwise(F.translate(decoded, _WIDE, _NARROW)))
