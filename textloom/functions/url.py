"""URL screening as Column expressions.

The reference parses with the WHATWG URL parser and rejects private, local and
metadata hosts. Here the parts that decide the verdict are rebuilt with
built-ins: scheme, authority and host by one anchored regex, and the WHATWG
IPv4 number rules (1 to 4 parts; 0x hex, leading-0 octal, decimal; the last
part fills the remaining bytes) with ``transform``/``aggregate`` over the
host's labels. No Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.address import in_block, ipv6_hex, mapped_ipv4, read_host
from textloom.functions.stage import let, pin

# Fixed values (reject messages and host lists, as in the reference).
REASON_INVALID = "Invalid URL"
REASON_SCHEME = "Only HTTP and HTTPS URLs are supported"
REASON_PRIVATE = "URL points to a private, local, or metadata address"
LOCAL_HOSTS = ["localhost", "localhost.localdomain"]
METADATA_HOSTS = ["metadata", "metadata.google.internal"]
METADATA_SUFFIX = ".metadata.google.internal"

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# scheme ':' slashes [userinfo '@'] host [':' port] [path/query/fragment]
AUTHORITY_RE = (r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/\\?#]*@)?"
                r"(\[[^\]/\\?#]*\]|[^:/\\?#]*)(?::([0-9]*))?(?:[/\\?#].*)?$")
FORBIDDEN_HOST_RE = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
HEX_RE = r"^0[xX][0-9a-fA-F]*$"
OCT_RE = r"^0[0-7]+$"
DEC_RE = r"^(0|[1-9][0-9]*)$"
TOO_BIG = 1 << 40


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_url(col) -> Column:
    """WHATWG pre-processing: strip C0 controls and spaces at the ends, drop tab/CR/LF."""
    u = F.regexp_replace(_c(col), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.regexp_replace(u, r"[\t\n\r]", "")


def _ipv4_number(x: Column) -> Column:
    """WHATWG IPv4 number parser for one label; NULL on failure, TOO_BIG if huge."""
    hex_digits = F.ltrim(F.substr(x, F.lit(3)), F.lit("0"))
    oct_digits = F.ltrim(x, F.lit("0"))
    dec_digits = F.ltrim(x, F.lit("0"))
    return (F.when(x.rlike(HEX_RE),
                   F.when(F.length(hex_digits) == 0, F.lit(0).cast("bigint"))
                   .when(F.length(hex_digits) > 9, F.lit(TOO_BIG))
                   .otherwise(F.conv(hex_digits, 16, 10).try_cast("bigint")))
            .when(x.rlike(OCT_RE),
                  F.when(F.length(oct_digits) == 0, F.lit(0).cast("bigint"))
                  .when(F.length(oct_digits) > 12, F.lit(TOO_BIG))
                  .otherwise(F.conv(oct_digits, 8, 10).try_cast("bigint")))
            .when(x.rlike(DEC_RE),
                  F.when(F.length(dec_digits) > 11, F.lit(TOO_BIG)).otherwise(x.try_cast("bigint"))))


def ipv4_address(host) -> Column:
    """For a host that ends in a number: the 32-bit address, or -1 when the
    WHATWG parser fails (the URL is then invalid). NULL for ordinary names."""
    h = _c(host)
    raw = F.split(h, r"\.", -1)
    labels = F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""),
                    F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    last = F.element_at(labels, -1)
    ends_in_number = (last != "") & (last.rlike(r"^[0-9]+$") | last.rlike(HEX_RE))
    nums = F.transform(labels, _ipv4_number)
    n = F.size(labels)
    failed = (F.exists(nums, lambda v: v.isNull())
              | (n > 4)
              | F.exists(F.slice(nums, 1, F.greatest(n - 1, F.lit(0))), lambda v: v > 255)
              | (F.element_at(nums, -1) >= F.pow(F.lit(256), F.lit(5) - n).cast("bigint")))
    # Leading parts fill the high bytes: fold h = h*256 + p, then shift by the
    # bytes the last part covers.
    head = F.aggregate(F.slice(nums, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("bigint"),
                       lambda acc, v: acc * 256 + v)
    head_sum = head * F.pow(F.lit(256), F.lit(5) - n).cast("bigint")
    addr = head_sum + F.element_at(nums, -1)
    return F.when(~ends_in_number, F.lit(None).cast("bigint")).when(failed, F.lit(-1)).otherwise(addr)


def _private_ipv4(addr: Column) -> Column:
    a = F.floor(addr / (1 << 24))
    b = F.floor(addr / (1 << 16)) % 256
    return (a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254))
            | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
            | ((a == 100) & b.between(64, 127)))


# Blocks whose addresses a fetch must not reach.
PRIVATE_BLOCKS = ["::1/128", "fc00::/7", "fe80::/16", "ff00::/8"]


def _private_ipv6(value: Column) -> Column:
    """By value, however the address is spelled; IPv4-mapped addresses as the IPv4 address."""
    inside = in_block(value, PRIVATE_BLOCKS[0])
    for block in PRIVATE_BLOCKS[1:]:
        inside = inside | in_block(value, block)
    return F.coalesce(inside | F.coalesce(let(mapped_ipv4(value), _private_ipv4), F.lit(False)), F.lit(False))


def with_url_screen(df: DataFrame, url: str, prefix: str = "u_") -> DataFrame:
    """Add ``<prefix>scheme, host, ok, reason`` for the URL column ``url``. The verdict is pinned, so that a filter on it does
    not repeat the parse."""
    keep, got = df.columns, f"__{prefix}parts"
    out = pin(df.withColumn(got, url_parts(url)), [got])
    return out.select(*keep, *(F.col(got)[c].alias(f"{prefix}{c}") for c in ("scheme", "host", "reason", "ok")))


def url_parts(col) -> Column:
    """The parse and its verdict as struct<scheme, host, ok, reason>. Each intermediate value (cleaned URL, host, address) is
    bound once (``let``)."""
    def verdict(u: Column, host: Column) -> Column:
        bracketed = host.startswith("[")
        six = F.when(bracketed, ipv6_hex(F.regexp_replace(host, r"^\[|\]$", "")))
        four = F.when(~bracketed, ipv4_address(host))
        return let(F.struct(F.lower(F.regexp_extract(u, SCHEME_RE, 1)).alias("scheme"), F.regexp_extract(u, AUTHORITY_RE, 2).alias("port"),
                            six.alias("six"), four.alias("addr")), lambda x: judged(u, host, bracketed, x))

    def judged(u: Column, host: Column, bracketed: Column, x: Column) -> Column:
        scheme, port, addr = x["scheme"], x["port"], x["addr"]
        special = scheme.isin("http", "https")
        host_ok = F.coalesce(F.when(bracketed, x["six"].isNotNull()).otherwise((host != "") & ~host.rlike(FORBIDDEN_HOST_RE)), F.lit(False))
        port_ok = (port == "") | ((F.length(port) <= 5) & F.coalesce(port.try_cast("int") <= 65535, F.lit(False)))
        invalid = (scheme == "") | (special & ~(u.rlike(AUTHORITY_RE) & host_ok & port_ok)) | F.coalesce(addr == -1, F.lit(False))
        private = F.coalesce(host.isin(*LOCAL_HOSTS) | host.isin(*METADATA_HOSTS) | host.endswith(METADATA_SUFFIX)
                             | F.coalesce((addr >= 0) & _private_ipv4(addr), F.lit(False)) | (bracketed & _private_ipv6(x["six"])), F.lit(False))
        reason = (F.when(invalid, F.lit(REASON_INVALID)).when(~special, F.lit(REASON_SCHEME)).when(private, F.lit(REASON_PRIVATE)))
        return F.struct(scheme.alias("scheme"), F.when(~invalid, host).alias("host"), reason.isNull().alias("ok"), reason.alias("reason"))

    return let(clean_url(col), lambda u: let(read_host(F.regexp_extract(u, AUTHORITY_RE, 1)), lambda host: verdict(u, host)))


def looks_like_url(col) -> Column:
    """True when the value parses as an http or https URL (any host)."""
    p = url_parts(col)
    return F.coalesce(p["reason"].isNull() | (p["reason"] == REASON_PRIVATE), F.lit(False))
