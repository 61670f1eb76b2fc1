"""Audits over command, argument, ref and path logs (C6-C11), template
expansion into argv (P7, P8, C14, C15), and redirect chains of crawled pages
(J8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import screens as S
from textloom.functions.reference import page_key, resolve_reference
from textloom.functions.stage import pin
from textloom.functions.url import REASON_PRIVATE, url_parts, with_url_screen

# Messages of the reference.
INVALID_COMMAND = "Invalid command format"
INVALID_ARGUMENTS = "Invalid argument format"
NEEDS_INPUT = "This template requires input."
MANY_PLACEHOLDERS = ("Template command should contain at most one $@ placeholder. Multiple placeholders are not "
                     "supported.")
EMPTY_COMMAND = "Empty command"
TOO_MANY_REDIRECTS = "Too many redirects"
NO_LOCATION = "Redirect response without Location header"
MAX_REDIRECTS = 5


def audit_log(df: DataFrame, rules: Column) -> DataFrame:
    """Verdict per row from a rule-set column (array of broken rule names)."""
    return df.withColumn("broken", rules).withColumn("ok", F.size("broken") == 0)


def rule_counts(audited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rejects per broken rule (and optional grouping columns)."""
    cols = by or []
    # Pinned: the filter that Spark infers from the explode would check every row a second time.
    return (pin(audited.select(*cols, "broken"), ["broken"]).select(*cols, F.explode("broken").alias("rule"))
            .groupBy(*cols, "rule").agg(F.count(F.lit(1)).alias("n")))


def expand_templates(df: DataFrame, command: str = "command", args: str = "args", piped: str = "piped") -> DataFrame:
    """P7 + P8: screen the command and arguments, pick the input (arguments
    win over piped text), and build argv without a shell. With one ``$@`` the
    input replaces it inside its token (it stays one argument, literally);
    with none it is appended. Adds ok, reason, cmd, argv."""
    c, a = F.col(command), F.coalesce(F.col(args), F.array().cast("array<string>"))
    p = F.col(piped)
    has_args = F.size(a) > 0
    has_stdin = F.coalesce(F.length(p) > 0, F.lit(False))
    n = S.placeholder_count(c)
    reason = (F.when(~S.is_safe_command(c), F.lit(INVALID_COMMAND))
              .when(F.size(S.argument_rules(a)) > 0, F.lit(INVALID_ARGUMENTS))
              .when(c.contains("$@") & ~has_args & ~has_stdin, F.lit(NEEDS_INPUT))
              .when(n > 1, F.lit(MANY_PLACEHOLDERS))
              .when(F.size("_tok") == 0, F.lit(EMPTY_COMMAND)))
    # Tokens and verdict are pinned: what follows mentions them many times.
    out = pin(df.withColumn("_tok", S.command_tokens(c)), ["_tok"])
    out = pin(out.withColumn("reason", reason), ["reason"]).withColumn("ok", F.col("reason").isNull())
    out = out.withColumn("_input", F.when(has_args, F.array_join(a, " ")).when(has_stdin, p).otherwise(F.lit("")))
    inp, tok = F.col("_input"), F.col("_tok")
    head, rest = F.element_at(tok, 1), F.slice(tok, 2, F.greatest(F.size(tok) - 1, F.lit(0)))

    def fill(t):
        return F.when(t.contains("$@"), S.strip_outer_quotes(F.replace(t, F.lit("$@"), inp))).otherwise(
            S.strip_outer_quotes(t))
    one = n == 1
    cmd = F.when(one & head.contains("$@"), S.strip_outer_quotes(F.replace(head, F.lit("$@"), inp))).otherwise(head)
    argv = F.when(one, F.transform(rest, fill)).otherwise(
        F.concat(F.transform(rest, S.strip_outer_quotes),
                 F.when(F.length(inp) > 0, F.array(inp)).otherwise(F.array().cast("array<string>"))))
    return (out.withColumn("cmd", F.when(F.col("ok"), cmd)).withColumn("argv", F.when(F.col("ok"), argv))
            .drop("_input", "_tok"))


def redirect_chains(starts: DataFrame, hops: DataFrame) -> DataFrame:
    """Follow each start URL through the crawl log ``hops`` (url, status,
    location): at most five redirects, each target screened, relative
    targets resolved as a URL parser does (``resolve_reference``); the original URL stays the source.

    URLs are looked up by ``page_key``, so spelling and fragment don't matter. Of several rows of one URL in the log, the one with the
    smallest status, then the smallest location, counts: a page fetched again neither multiplies rows nor turns a success into a failure.

    Six bounded steps, each an equi join of the frontier to the crawl log on
    URL; finished rows leave the frontier. The crawl log is joined by key,
    never broadcast by assumption (AQE broadcasts it only when small). Each
    step is checkpointed to the shared checkpoint folder: the next URL is an
    expression of the previous one, and without a cut Catalyst would inline
    it step after step (the plan would grow geometrically); the cut also lets
    a lost executor be recovered from the last step instead of the start."""
    from textloom.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(starts.sparkSession)
    one = F.min(F.struct(F.col("status").alias("s"), F.coalesce("location", F.lit("")).alias("l")))
    keyed = pin(hops.select("status", "location", page_key(F.col("url")).alias("_hurl")), ["_hurl"])
    h = keyed.groupBy("_hurl").agg(one.alias("_m")).select(
        "_hurl", F.col("_m.s").alias("_status"), F.col("_m.l").alias("_location"))
    h = h.checkpoint(eager=True)
    cur = starts.select("start_id", F.col("url").alias("source"), F.col("url").alias("cur"),
                        F.lit(0).alias("redirects"))
    cur = with_url_screen(cur, "cur", prefix="_s_").withColumn("reason", F.col("_s_reason")) \
        .withColumn("done", F.col("reason").isNotNull()).drop("_s_scheme", "_s_host", "_s_ok", "_s_reason")
    cur = cur.withColumn("_key", page_key(F.col("cur"))).checkpoint(eager=True)
    finished = [cur.where("done").select("start_id", "source", F.col("cur").alias("final_url"), "redirects", "reason")]
    live = cur.where(~F.col("done")).select("start_id", "source", "cur", "redirects", "_key")
    # The expressions are large, and the same in each step: they are built once.
    redirect = F.col("_status").between(300, 399)
    screened = url_parts("_next")["reason"]
    nxt = F.when(redirect & (F.length("_location") > 0), resolve_reference(F.col("cur"), F.col("_location")))
    for step in range(MAX_REDIRECTS + 1):
        j = live.join(h, F.col("_key") == F.col("_hurl"), "left").drop("_key")
        j = pin(pin(j.withColumn("_next", nxt), ["_next"]).withColumn("_n_reason", screened), ["_n_reason"])
        reason = (F.when(F.col("_hurl").isNull(), F.lit("Failed to fetch URL: no snapshot"))
                  .when(redirect & F.coalesce(F.length("_location") == 0, F.lit(True)), F.lit(NO_LOCATION))
                  .when(redirect & F.col("_n_reason").isNotNull(), F.col("_n_reason"))
                  .when(redirect & (F.lit(step) == MAX_REDIRECTS), F.lit(TOO_MANY_REDIRECTS))
                  .when(~redirect & ~F.col("_status").between(200, 299),
                        F.format_string("URL returned %d: ", F.col("_status"))))
        j = j.withColumn("reason", reason).select("start_id", "source", "cur", "redirects", "_next", "reason",
                                                  F.col("_status").between(300, 399).alias("_redirect"))
        j = j.checkpoint(eager=True)
        stop = F.col("reason").isNotNull() | ~F.col("_redirect")
        finished.append(j.where(stop).select("start_id", "source", F.col("cur").alias("final_url"), "redirects",
                                             "reason"))
        # A resolved URL is its own key but for the fragment.
        live = j.where(~stop).select("start_id", "source", F.col("_next").alias("cur"), (F.col("redirects") + 1).alias("redirects"),
                                     F.regexp_replace("_next", "(?s)#.*$", "").alias("_key"))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.withColumn("ok", F.col("reason").isNull())


__all__ = ["audit_log", "rule_counts", "expand_templates", "redirect_chains", "REASON_PRIVATE"]
