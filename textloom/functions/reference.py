"""URL references resolved against a base, as a URL parser does it for web addresses.

RFC 3986, section 5, with the web's additions for http and https: back slashes count as slashes before the query, a scheme equal to the base's
without slashes is relative, hosts are lower-case, default ports go, an empty path is ``/``, and characters that may not stand in a URL are
percent-encoded. Dot segments are removed by a fold over the array of segments. Columns only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.stage import let
from textloom.functions.url import clean_url

# RFC 3986, appendix B: scheme, authority, path, query, fragment.
SPLIT_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?:(//)([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
AUTHORITY_RE = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
SINGLE_DOT, DOUBLE_DOT = "(?i)^([.]|%2e)$", "(?i)^([.]|%2e){2}$"
PATH_UNSAFE = r"[\x00-\x20\"#<>?`{}^\x7F-\x{10FFFF}]"
QUERY_UNSAFE = r"[\x00-\x20\"#<>'\x7F-\x{10FFFF}]"
FRAGMENT_UNSAFE = r"[\x00-\x20\"<>`\x7F-\x{10FFFF}]"
SPECIAL = ["http", "https"]


def remove_dots(path: Column) -> Column:
    """A path without dot segments (RFC 3986, 5.2.4): a fold that drops ``.`` and lets ``..`` take the segment before it away. A path that ends in a
    dot segment ends in a slash."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    last = F.size(segments) - 1
    marked = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == last).alias("end")))

    def step(done: Column, x: Column) -> Column:
        up, here = x["s"].rlike(DOUBLE_DOT), x["s"].rlike(SINGLE_DOT)
        kept = F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(here, done).otherwise(F.array_append(done, x["s"]))
        return F.when((up | here) & x["end"], F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))


def percent_encode(text: Column, unsafe: str) -> Column:
    """Unsafe characters as the escapes of their UTF-8 bytes."""
    coded = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(unsafe), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)), "")
    return F.when(text.rlike(unsafe), coded).otherwise(text)


def _slashes(text: Column) -> Column:
    """Back slashes before the query or fragment as slashes."""
    def change(head: Column) -> Column:
        return F.concat(F.translate(head, "\\", "/"), F.substring(text, F.length(head) + 1, F.length(text)))
    return F.when(text.contains("\\"), let(F.regexp_extract(text, "(?s)^([^?#]*)", 1), change)).otherwise(text)


def _part(text: Column, k: int) -> Column:
    return F.regexp_extract(text, SPLIT_RE, k)


def _authority(text: Column, scheme: Column) -> Column:
    user, host, port = (F.regexp_extract(text, AUTHORITY_RE, k) for k in (1, 2, 3))
    default = lambda p: ((scheme == "http") & p.rlike("^0*80$")) | ((scheme == "https") & p.rlike("^0*443$"))
    number = lambda p: F.when((p == "") | default(p), F.lit("")).otherwise(F.concat(F.lit(":"), F.regexp_replace(p, "^0+(?=[0-9])", "")))
    whole = F.concat(let(user, lambda x: F.when(x != "", F.concat(x, F.lit("@"))).otherwise(F.lit(""))), F.lower(host), let(port, number))
    return F.when(~text.rlike(AUTHORITY_RE), text).otherwise(whole)


def resolve_reference(base: Column, location: Column) -> Column:
    """The absolute URL that ``location`` means on the page at ``base`` (an http or https URL). Locations with another scheme come back cleaned
    but otherwise as they are. NULL if either is NULL."""
    base_parts = let(_slashes(clean_url(base)), lambda b: F.struct(
        F.lower(_part(b, 1)).alias("scheme"), _part(b, 3).alias("authority"),
        let(_part(b, 4), lambda p: F.when(p == "", F.lit("/")).otherwise(p)).alias("path"), _part(b, 5).alias("query")))
    given = let(clean_url(location), lambda r: F.struct(
        r.alias("text"), _slashes(r).alias("web"), F.lower(F.regexp_extract(r, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("own")))

    def split(b: Column, r: Column) -> Column:
        """Scheme and the rest, which starts with // where it brings an authority of its own."""
        own = r["own"]
        rest = F.when(own == "", r["web"]).otherwise(F.substring(r["web"], F.length(own) + 2, F.length(r["web"])))
        return let(rest, lambda x: let(
            # "http:x" on an http page is relative; any other web scheme starts an authority, however many slashes follow it.
            (own != "") & ((own != b["scheme"]) | x.startswith("/")),
            lambda absolute: F.struct(
                F.when(absolute, own).otherwise(b["scheme"]).alias("scheme"),
                F.when(absolute | x.startswith("//"), F.concat(F.lit("//"), F.regexp_replace(x, "^/*", ""))).otherwise(x).alias("rest"))))

    def parts(x: Column) -> Column:
        after = F.regexp_replace(x["rest"], "^//[^/?#]*", "")
        return let(after, lambda t: F.struct(
            x["scheme"].alias("scheme"), x["rest"].startswith("//").alias("has_authority"), F.regexp_extract(x["rest"], "^//([^/?#]*)", 1).alias("authority"),
            F.regexp_extract(t, "(?s)^([^?#]*)", 1).alias("path"), F.regexp_extract(t, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"),
            F.regexp_extract(t, "(?s)^[^#]*(#.*)$", 1).alias("fragment")))

    def joined(b: Column, x: Column) -> Column:
        merged = F.concat(F.regexp_extract(b["path"], "(?s)^(.*/)", 1), x["path"])
        full = F.when(x["has_authority"] | x["path"].startswith("/"), x["path"]).when(x["path"] == "", b["path"]).otherwise(merged)
        search = F.when((x["path"] == "") & (x["query"] == "") & ~x["has_authority"], b["query"]).otherwise(x["query"])
        authority = F.when(x["has_authority"], x["authority"]).otherwise(b["authority"])
        encoded = lambda c, unsafe: let(c, lambda v: percent_encode(v, unsafe))
        return F.concat(x["scheme"], F.lit("://"), let(authority, lambda a: _authority(a, x["scheme"])), encoded(remove_dots(full), PATH_UNSAFE),
                        encoded(search, QUERY_UNSAFE), encoded(x["fragment"], FRAGMENT_UNSAFE))

    def resolved(b: Column, r: Column) -> Column:
        web = let(split(b, r), lambda x: let(parts(x), lambda y: joined(b, y)))
        return F.when((r["own"] != "") & ~r["own"].isin(*SPECIAL), r["text"]).otherwise(web)

    return F.when(base.isNotNull() & location.isNotNull(), let(base_parts, lambda b: let(given, lambda r: resolved(b, r))))


def page_key(url: Column) -> Column:
    """The spelling under which a URL is looked up: resolved against itself, without its fragment."""
    return F.regexp_replace(resolve_reference(url, url), r"(?s)#.*$", "")
