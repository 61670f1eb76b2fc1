"""Crawled page snapshots: screen, gate by size, extract text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import MAX_DOWNLOAD_SIZE, bound_text, html_to_text, is_html, js_trim, was_cut
from textloom.functions.url import with_url_screen

# Reject messages of the page fetch.
EMPTY_BODY = "Fetched URL returned empty content"
EMPTY_AFTER = "Fetched URL returned empty content after extraction"


def too_large(limit: int) -> str:
    return f"URL content exceeds {limit} bytes"


def page_snapshots(pages: DataFrame, url: str = "url", body: str = "html", status: str | None = None,
                   status_text: str | None = None, content_type: str | None = None,
                   declared_length: str | None = None, limit: int = MAX_DOWNLOAD_SIZE) -> DataFrame:
    """Accept or reject each fetched body, in the reference's order of checks.

    Adds ``ok``, ``reason``, ``is_html``, ``content`` (bounded text, NULL when
    rejected), ``was_cut`` and ``source`` (the URL asked for). Every check is a
    ``when`` branch, so the costly HTML clean-up runs only for rows that pass
    the URL and size gates.
    """
    b = F.col(body)
    ct = F.col(content_type) if content_type else None
    st = F.col(status) if status else F.lit(200)
    st_text = F.coalesce(F.col(status_text), F.lit("")) if status_text else F.lit("")
    declared = F.col(declared_length) if declared_length else F.lit(None).cast("bigint")
    # Checks that need no text work come first; the regex clean-up is computed
    # once, in its own projection, and only for rows that pass them.
    pre = (F.when(~F.col("_u_ok"), F.col("_u_reason"))
           .when(~st.between(200, 299), F.format_string("URL returned %d: %s", st, st_text))
           .when(F.coalesce(declared > limit, F.lit(False)), F.lit(too_large(limit)))
           .when(F.octet_length(b) > limit, F.lit(too_large(limit)))
           .when(b.isNull() | (F.length(b) == 0), F.lit(EMPTY_BODY)))
    out = (pages
           .transform(lambda d: with_url_screen(d, url, prefix="_u_"))
           .withColumn("_pre", pre)
           .withColumn("is_html", F.when(F.col("_pre").isNull(), is_html(b, ct)))
           .withColumn("_raw", F.when(F.col("is_html"), html_to_text(b))
                       .when(F.col("_pre").isNull(), b))
           .withColumn("_bounded", bound_text(F.col("_raw")))
           .withColumn("reason", F.coalesce(F.col("_pre"),
                                            F.when(F.length(js_trim(F.col("_bounded"))) == 0, F.lit(EMPTY_AFTER))))
           .withColumn("ok", F.col("reason").isNull())
           .withColumn("content", F.when(F.col("ok"), F.col("_bounded")))
           .withColumn("was_cut", F.when(F.col("ok"), was_cut(F.col("_raw"))))
           .withColumn("is_html", F.when(F.col("ok"), F.col("is_html")))
           .withColumn("source", F.col(url)))
    return out.drop("_u_scheme", "_u_host", "_u_ok", "_u_reason", "_pre", "_raw", "_bounded")
