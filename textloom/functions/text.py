"""Column functions for text: whitespace, length in UTF-16 units, bounding,
HTML-to-text and content category.

All are built-in expressions (regexp_replace, replace, rlike, substring), so
they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference for equal results).
# Item text limit, in UTF-16 code units.
MAX_CONTENT_LENGTH = 12_000
# Page and file body limit, in bytes.
MAX_DOWNLOAD_SIZE = 1_000_000

# JavaScript's whitespace class (WhiteSpace + LineTerminator). Java's \s lacks
# NBSP and the Unicode spaces, so the class is spelled out. The \x{..} form is
# understood by both Java regex and RE2.
JS_WS = (r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The same set as characters, for the built-in trim functions: they scan the
# two ends only, where a regex would scan the whole text.
JS_WS_CHARS = ("\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(col) -> Column:
    """String.prototype.trim."""
    return F.trim(_c(col), F.lit(JS_WS_CHARS))


def js_trim_end(col) -> Column:
    return F.rtrim(_c(col), F.lit(JS_WS_CHARS))


def js_trim_start(col) -> Column:
    return F.ltrim(_c(col), F.lit(JS_WS_CHARS))


def collapse_ws(col) -> Column:
    """Replace every run of JavaScript whitespace by one space."""
    return F.regexp_replace(_c(col), rf"{JS_WS}+", " ")


def utf16_length(col) -> Column:
    """JavaScript ``.length``: code points plus one per supplementary character."""
    c = _c(col)
    return F.length(c) + F.regexp_count(c, F.lit(ASTRAL))


def _utf16_prefix(col, units: int) -> Column:
    """``s.slice(0, units)`` in UTF-16 units; a surrogate pair split at the end is dropped."""
    c = _c(col)
    enc = F.encode(c, "UTF-16BE")
    nbytes = units * 2
    last_unit = F.hex(F.substring(enc, nbytes - 1, 1))
    split_pair = last_unit.isin("D8", "D9", "DA", "DB")
    cut = F.when(split_pair, F.substring(enc, 1, nbytes - 2)).otherwise(F.substring(enc, 1, nbytes))
    return F.decode(cut, "UTF-16BE")


def bound_text(col, limit: int = MAX_CONTENT_LENGTH) -> Column:
    """Over ``limit`` UTF-16 units: cut and trim the end only; otherwise unchanged."""
    c = _c(col)
    n = F.length(c)
    # Cheap path: without supplementary characters code points equal UTF-16 units.
    plain_cut = js_trim_end(F.substring(c, 1, limit))
    exact_cut = js_trim_end(_utf16_prefix(c, limit))
    has_astral = F.regexp_count(c, F.lit(ASTRAL)) > 0
    return (F.when(n * 2 <= limit, c)
            .when(~has_astral, F.when(n > limit, plain_cut).otherwise(c))
            .when(utf16_length(c) > limit, exact_cut)
            .otherwise(c))


def was_cut(col, limit: int = MAX_CONTENT_LENGTH) -> Column:
    c = _c(col)
    return F.when(F.length(c) * 2 <= limit, F.lit(False)).otherwise(utf16_length(c) > limit)


def is_html(body, content_type=None) -> Column:
    """HTML if the content type mentions html, the trimmed body starts with a
    doctype, or the body holds ``<html`` anywhere (all lower-cased)."""
    b = F.lower(_c(body))
    by_body = F.startswith(js_trim(b), F.lit("<!doctype html")) | F.contains(b, F.lit("<html"))
    if content_type is None:
        return by_body
    return F.coalesce(F.contains(F.lower(_c(content_type)), F.lit("html")), F.lit(False)) | by_body


# The entity decoding order (ampersand is decoded before &lt;,
# so "&amp;lt;" becomes "<", as in the reference).
HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
                 ("&quot;", '"'), ("&#39;", "'")]


def html_to_text(html) -> Column:
    """Drop script and style blocks, tags to spaces, decode six entities,
    collapse whitespace, trim (not yet bounded)."""
    t = F.regexp_replace(_c(html), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for ent, ch in HTML_ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return js_trim(collapse_ws(t))


def page_text(html) -> Column:
    return bound_text(html_to_text(html))


# Email headers (at a line start, any case) and newsletter
# patterns (any case) that decide the content category.
EMAIL_HEADERS = ["from", "to", "subject", "date", "reply-to", "cc", "bcc"]
NEWSLETTER_PATTERNS = ["unsubscribe", "newsletter", "weekly update", "daily digest",
                       "what you missed", r"issue\s+#?\d+", r"\bsubscribe\b",
                       "read this email online"]

# JavaScript line terminators for a multi-line ^ (Java's (?m) also breaks at U+0085).
_LINE_START = r"(?:\A|[\n\r\x{2028}\x{2029}])"
EMAIL_RE = "(?i)" + _LINE_START + "(?:" + "|".join(EMAIL_HEADERS) + "):"
# JavaScript's \b is ASCII-word based; Java 17's \b is Unicode-aware, so it is
# spelled out as ASCII lookarounds.
ASCII_WORD_BOUNDARY_BEFORE = r"(?<![A-Za-z0-9_])"
ASCII_WORD_BOUNDARY_AFTER = r"(?![A-Za-z0-9_])"


def _java_pattern(p: str) -> str:
    p = p.replace(r"\s", JS_WS)
    p = p.replace(r"\bsubscribe\b", ASCII_WORD_BOUNDARY_BEFORE + "subscribe" + ASCII_WORD_BOUNDARY_AFTER)
    return p


NEWSLETTER_RE = "(?i)(?:" + "|".join(_java_pattern(p) for p in NEWSLETTER_PATTERNS) + ")"


def content_category(col) -> Column:
    """email / newsletter / unknown (the reference never returns article)."""
    c = _c(col)
    return (F.when(c.rlike(EMAIL_RE), F.lit("email"))
            .when(c.rlike(NEWSLETTER_RE), F.lit("newsletter"))
            .when(F.contains(F.lower(c), F.lit("dear ")), F.lit("email"))
            .otherwise(F.lit("unknown")))
