"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole generated tables (or rows Spark derives from them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import (bound_text, content_category, html_to_text, is_html, js_trim, utf16_length,
                                     was_cut)
from textloom.functions.url import with_url_screen
from textloom.plans import derive
from textloom.streaming.assemble import (assemble_stream, progress_chunks, reframe_stream, replay_chunks, replay_wire_lines,
                                         run_to_table)
from textloom.session import read_table
from textloom.functions import screens as S
from textloom.operators.audit import audit_log, expand_templates, redirect_chains, rule_counts
from textloom.operators.answers import (meeting_report, recover_json, summary_markdown, typed_classes,
                                       typed_meetings, typed_summaries)
from textloom.operators.catalogue import (catalogue_merge, detect_tools, known_tools_table, lint_configs, lint_report,
                                         profile_rows, selectable_items, status_rows, template_defaults)
from textloom.operators.lookup import lookup_cascade, search_topk
from textloom.operators.prompts import CLASSIFY, EXTRACT_MEETING, SUMMARIZE, diff_prompt, modes_table
from textloom.operators.responses import assemble, json_conf, reframe, wire_deltas
from textloom.operators.routing import meeting_route, mock_responses, providers_table, request_body, route_requests
from textloom.sources.inputs import patches, resolve_inputs, transcripts
from textloom.sources.pages import page_snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- Step 2: pages, bounds, URL screen, categories, input resolution --------

@query("page_text")
def q_page_text(spark, sf):
    """C2 -> C1 -> C3 on every page: sniff HTML, extract text, bound it."""
    p = read_table(spark, sf, "pages")
    raw = (p.withColumn("is_html", is_html(F.col("html")))
           .withColumn("_raw", F.when(F.col("is_html"), html_to_text("html")).otherwise(F.col("html"))))
    return raw.select("page_id", "is_html", was_cut("_raw").alias("was_cut"), bound_text("_raw").alias("text"))


@query("page_gate")
def q_page_gate(spark, sf):
    p = read_table(spark, sf, "pages")
    return page_snapshots(p).select("page_id", "source", "ok", "reason", "is_html", "was_cut", "content")


@query("bound_text")
def q_bound_text(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text").withColumn("_t", js_trim("text"))
    return d.select("doc_id", utf16_length("_t").alias("n_units"), was_cut("_t").alias("was_cut"),
                    bound_text("_t").alias("content"))


@query("url_screen")
def q_url_screen(spark, sf):
    u = with_url_screen(derive.hostile_urls(spark, sf), "url", prefix="")
    return u.select("page_id", "url", "scheme", "host", "ok", "reason")


@query("url_reject_counts")
def q_url_reject_counts(spark, sf):
    return (q_url_screen(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query("content_category")
def q_content_category(spark, sf):
    d = derive.mixed_documents(spark, sf).withColumn("_t", js_trim("text")).withColumn("_c", bound_text("_t"))
    return d.select("doc_id", "lang", "source", content_category("_c").alias("category"))


@query("category_counts")
def q_category_counts(spark, sf):
    return (q_content_category(spark, sf).groupBy("lang", "source", "category")
            .agg(F.count(F.lit(1)).alias("n")))


def _resolved(spark, sf) -> DataFrame:
    snaps = page_snapshots(read_table(spark, sf, "pages"))
    return resolve_inputs(derive.input_requests(spark, sf), snapshots=snaps)


@query("resolve_inputs")
def q_resolve_inputs(spark, sf):
    return _resolved(spark, sf).select("request_id", "kind", "source", "ok", "reason", "content")


@query("outcome_report")
def q_outcome_report(spark, sf):
    r = _resolved(spark, sf)
    return (r.rollup("kind", "reason").agg(F.count(F.lit(1)).alias("n")))


# --- Step 3: prompts -------------------------------------------------------

def _summary_render(df: DataFrame) -> DataFrame:
    return SUMMARIZE.render(df, content="content", mode="mode", maxLength="max_length", audience="audience",
                            category="category", source="source_label")


@query("summary_prompts")
def q_summary_prompts(spark, sf):
    v = derive.summary_variables(spark, sf)
    return _summary_render(v).select("doc_id", "prompt_id", "prompt_version", "mode", "ok", "system", "user")


@query("prompt_rejects")
def q_prompt_rejects(spark, sf):
    v = derive.bad_summary_variables(spark, sf)
    return _summary_render(v).where(~F.col("ok")).select("doc_id", "prompt_id", "reason")


@query("classify_prompts")
def q_classify_prompts(spark, sf):
    d = derive.doc_content(spark, sf)
    return CLASSIFY.render(d, content="content").select("doc_id", "prompt_id", "ok", "reason", "system", "user")


@query("transcripts")
def q_transcripts(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return transcripts(c).select("conv_id", "transcript", "ok", "reason")


@query("meeting_prompts")
def q_meeting_prompts(spark, sf):
    t = q_transcripts(spark, sf)
    return EXTRACT_MEETING.render(t, transcript="transcript").select("conv_id", "prompt_id", "ok", "reason",
                                                                     "system", "user")


@query("diff_prompts")
def q_diff_prompts(spark, sf):
    p = patches(derive.patch_table(spark, sf))
    ref = F.when(F.col("kind") == "commit", F.col("ref"))
    return p.select("patch_id", "kind", "status", "reason",
                    F.when(F.col("reason").isNull(), diff_prompt(F.col("patch"), ref, F.col("custom_prompt")))
                    .alias("prompt"))


@query("mode_prompts")
def q_mode_prompts(spark, sf):
    """Each document's mode joined to the 4-row mode table (broadcast:
    the dimension is fixed at 4 rows)."""
    v = derive.summary_modes(spark, sf)
    return v.join(F.broadcast(modes_table(spark)), "mode", "left").select("doc_id", "mode", "instruction")


# --- Step 4: routing, request bodies, mock responder ------------------------

def _routed(spark, sf) -> DataFrame:
    return route_requests(derive.provider_requests(spark, sf), providers_table(spark))


@query("route_requests")
def q_route_requests(spark, sf):
    return _routed(spark, sf).select("request_id", F.col("route").alias("provider"), "ok", "reason",
                                     F.col("resolved_model").alias("model"),
                                     F.col("resolved_base_url").alias("base_url"), "endpoint")


@query("request_payloads")
def q_request_payloads(spark, sf):
    """Every valid summary prompt, sent to a provider chosen by doc_id % 5."""
    v = _summary_render(derive.summary_variables(spark, sf)).where(F.col("ok"))
    names = F.array(*[F.lit(x) for x in ["openai", "anthropic", "ollama", "openrouter", "opencode"]])
    v = v.withColumn("provider", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")))
    p = F.broadcast(providers_table(spark).select(F.col("provider").alias("_p"), "default_model"))
    v = v.join(p, F.col("provider") == F.col("_p"), "left")
    return v.select("doc_id", "provider", request_body(F.col("provider"), F.col("default_model"), F.col("system"),
                                                       F.col("user")).alias("body"))


@query("meeting_route")
def q_meeting_route(spark, sf):
    r = meeting_route(derive.meeting_requests(spark, sf))
    return r.select("request_id", "ok", "reason", "use_openrouter", F.col("resolved_base_url").alias("base_url"),
                    F.col("resolved_model").alias("model"), F.col("resolved_temperature").alias("temperature"))


@query("mock_responses")
def q_mock_responses(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("response_id"))
    return mock_responses(d, "response_id")


# --- Step 5: stream formats, re-framing, assembly ---------------------------

def _provider_text(spark, sf, provider: str) -> DataFrame:
    json_conf(spark)
    lines = derive.wire_lines(spark, sf).where(F.col("provider") == provider)
    return assemble(wire_deltas(lines), ["conv_id", "turn"])


@query("openai_text")
def q_openai_text(spark, sf):
    return _provider_text(spark, sf, "openai")


@query("anthropic_text")
def q_anthropic_text(spark, sf):
    return _provider_text(spark, sf, "anthropic")


@query("ollama_text")
def q_ollama_text(spark, sf):
    return _provider_text(spark, sf, "ollama")


@query("reframed_text")
def q_reframed_text(spark, sf):
    """T1 -> T2..T4 -> A1 from 17-byte chunks back to each turn's text."""
    json_conf(spark)
    lines = reframe(derive.byte_chunks(spark, sf), ["conv_id", "turn", "provider"])
    return assemble(wire_deltas(lines), ["conv_id", "turn"])


# --- Step 6: JSON recovery and typed answers ---------------------------------

@query("recover_json")
def q_recover_json(spark, sf):
    return recover_json(derive.summary_answers(spark, sf)).select("doc_id", "json", "route", "reason")


@query("recover_rates")
def q_recover_rates(spark, sf):
    """Success rate by route (no oracle: depends on X1)."""
    r = recover_json(derive.summary_answers(spark, sf))
    return r.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def _typed_summaries(spark, sf) -> DataFrame:
    json_conf(spark)
    return typed_summaries(recover_json(derive.summary_answers(spark, sf)))


@query("typed_summaries")
def q_typed_summaries(spark, sf):
    return _typed_summaries(spark, sf).select("doc_id", "ok", "reason", "title", "summary",
                                              F.to_json("key_points").alias("key_points"),
                                              F.to_json("action_items").alias("action_items"), "category", "importance")


@query("summary_markdown")
def q_summary_markdown(spark, sf):
    t = _typed_summaries(spark, sf).where(F.col("ok"))
    return t.select("doc_id", summary_markdown(F.col("title"), F.col("summary"), F.col("key_points"),
                                               F.col("action_items"), F.col("category"),
                                               F.col("importance")).alias("markdown"))


@query("summary_json")
def q_summary_json(spark, sf):
    """Each valid summary as JSON text (typed fields, title omitted when absent)."""
    t = _typed_summaries(spark, sf).where(F.col("ok"))
    return t.select("doc_id", F.to_json(F.struct("title", "summary", "key_points", "action_items", "category",
                                                 "importance")).alias("json"))


@query("typed_classes")
def q_typed_classes(spark, sf):
    json_conf(spark)
    r = typed_classes(recover_json(derive.class_answers(spark, sf)))
    return r.select("doc_id", "ok", "reason", "category", "confidence", "explanation")


def _typed_meetings(spark, sf) -> DataFrame:
    json_conf(spark)
    return typed_meetings(derive.meeting_answers(spark, sf))


@query("typed_meetings")
def q_typed_meetings(spark, sf):
    return _typed_meetings(spark, sf).select("conv_id", "ok", "reason", "summary", F.to_json("risks").alias("risks"),
                                             F.to_json("action_items").alias("action_items"))


@query("action_items")
def q_action_items(spark, sf):
    """One row per action item of each valid meeting (none -> one row of NULLs)."""
    t = _typed_meetings(spark, sf).where(F.col("ok"))
    e = t.select("conv_id", F.posexplode_outer("action_items").alias("pos", "item"))
    return e.select("conv_id", "pos", F.col("item.owner").alias("owner"), F.col("item.task").alias("task"),
                    F.col("item.due").alias("due"))


@query("action_item_counts")
def q_action_item_counts(spark, sf):
    return (q_action_items(spark, sf).where(F.col("owner").isNotNull())
            .groupBy("owner").agg(F.count(F.lit(1)).alias("n")))


@query("meeting_report")
def q_meeting_report(spark, sf):
    t = _typed_meetings(spark, sf).where(F.col("ok"))
    return t.select("conv_id", meeting_report(F.col("summary"), F.col("action_items"), F.col("risks")).alias("report"))


# --- Step 7: catalogues --------------------------------------------------------

@query("catalogue_merge")
def q_catalogue_merge(spark, sf):
    configured, detected = derive.tool_catalogues(spark, sf)
    return catalogue_merge(configured, detected).select("config_id", "origin", "ord", "name", "command")


@query("template_defaults")
def q_template_defaults(spark, sf):
    t = template_defaults(derive.template_catalogues(spark, sf))
    return t.select("config_id", "pos", "name", "command", "description", "changed")


@query("lint_catalogue")
def q_lint_catalogue(spark, sf):
    json_conf(spark)
    return lint_configs(derive.config_documents(spark, sf))


@query("lint_counts")
def q_lint_counts(spark, sf):
    return q_lint_catalogue(spark, sf).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query("lint_report")
def q_lint_report(spark, sf):
    json_conf(spark)
    docs = derive.config_documents(spark, sf)
    return lint_report(lint_configs(docs), docs)


@query("selectable_items")
def q_selectable_items(spark, sf):
    configured, detected = derive.tool_catalogues(spark, sf)
    tools = (catalogue_merge(configured, detected)
             .withColumn("description", F.lit(None).cast("string"))
             .withColumn("aliases", F.lit(None).cast("array<string>"))
             .withColumn("promptCommand", F.lit(None).cast("string"))
             .withColumn("promptUseStdin", F.lit(None).cast("boolean"))
             .withColumn("ord", F.when(F.col("origin") == "config", F.col("ord"))
                         .otherwise(F.col("ord") + F.lit(1 << 30))))
    temps = template_defaults(derive.template_catalogues(spark, sf)).withColumnRenamed("pos", "ord")
    return selectable_items(tools, temps).select("config_id", "pos", "name", "command", "description",
                                                 "is_template", F.to_json("aliases").alias("aliases"))


@query("status_rows")
def q_status_rows(spark, sf):
    return status_rows(derive.status_logs(spark, sf))


@query("profile_rows")
def q_profile_rows(spark, sf):
    return profile_rows(status_rows(derive.status_logs(spark, sf))).select(
        "log_id", "line_no", "name", "command", "description", "auth_type", "prompt_command")


@query("lookup_cascade")
def q_lookup_cascade(spark, sf):
    return lookup_cascade(derive.misspelt_names(spark, sf), derive.part_catalogue(spark, sf))


@query("lookup_tiers")
def q_lookup_tiers(spark, sf):
    return q_lookup_cascade(spark, sf).groupBy("tier", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("search_topk")
def q_search_topk(spark, sf):
    return search_topk(derive.misspelt_names(spark, sf), derive.part_catalogue(spark, sf), k=10)


# --- Step 8: audits, tokens, template expansion, redirects ---------------------

def _joined(c: str) -> Column:
    return F.array_join(F.col(c), ",")


@query("command_screen")
def q_command_screen(spark, sf):
    a = audit_log(derive.command_log(spark, sf), S.command_rules("command"))
    return a.select("doc_id", "piece", "command", "ok", _joined("broken").alias("broken"))


@query("command_rule_counts")
def q_command_rule_counts(spark, sf):
    return rule_counts(audit_log(derive.command_log(spark, sf), S.command_rules("command")))


@query("command_name_screen")
def q_command_name_screen(spark, sf):
    c = derive.command_log(spark, sf).withColumn("name", F.split("command", " ").getItem(0))
    a = audit_log(c, S.command_name_rules("name"))
    return a.select("doc_id", "piece", "name", "ok", _joined("broken").alias("broken"))


@query("argument_screen")
def q_argument_screen(spark, sf):
    a = audit_log(derive.argument_log(spark, sf), S.argument_rules("args"))
    return a.select("doc_id", "piece", F.to_json("args").alias("args"), "ok", _joined("broken").alias("broken"))


@query("path_screen")
def q_path_screen(spark, sf):
    p = derive.path_log(spark, sf).withColumn("reason", S.path_reason("path"))
    return p.select("doc_id", "piece", "path", F.col("reason").isNull().alias("ok"), "reason")


@query("ref_screen")
def q_ref_screen(spark, sf):
    a = audit_log(derive.ref_log(spark, sf), S.ref_rules("ref"))
    return a.select("doc_id", "piece", "ref", "ok", _joined("broken").alias("broken"))


@query("placeholder_counts")
def q_placeholder_counts(spark, sf):
    c = derive.quoted_commands(spark, sf)
    return c.select("doc_id", "piece", S.placeholder_count("command").alias("placeholders"))


@query("command_tokens")
def q_command_tokens(spark, sf):
    c = derive.quoted_commands(spark, sf).withColumn("tokens", S.command_tokens("command"))
    return c.select("doc_id", "piece", F.element_at("tokens", 1).alias("cmd"), F.size("tokens").alias("n_tokens"),
                    F.to_json("tokens").alias("tokens"))


@query("expand_templates")
def q_expand_templates(spark, sf):
    e = expand_templates(derive.template_requests(spark, sf))
    return e.select("doc_id", "piece", "template_idx", "ok", "reason", "cmd", F.to_json("argv").alias("argv"))


@query("redirect_chains")
def q_redirect_chains(spark, sf):
    hops = derive.crawl_hops(spark, sf)
    starts = read_table(spark, sf, "pages").select(F.col("page_id").alias("start_id"), "url")
    return redirect_chains(starts, hops).select("start_id", "source", "final_url", "redirects", "ok", "reason")


# --- Step 9: Structured Streaming ---------------------------------------------

def _timed_wire_lines(spark, sf) -> DataFrame:
    """Wire lines with an event time: one second per line within a turn."""
    w = derive.wire_lines(spark, sf)
    return w.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 10
                                                  + F.col("seq")))


@query("assemble_stream")
def q_assemble_stream(spark, sf):
    """T5: the streamed answers assembled with keyed state equal the texts."""
    src = replay_wire_lines(spark, _timed_wire_lines(spark, sf), files=4)
    return run_to_table(spark, assemble_stream(src, watermark="1 day"), "assemble").select(
        "conv_id", "turn", "text", "complete")


@query("progress_chunks")
def q_progress_chunks(spark, sf):
    """Deltas in append mode, as they arrive."""
    src = replay_wire_lines(spark, _timed_wire_lines(spark, sf), files=4)
    return run_to_table(spark, progress_chunks(src), "progress")


# --- The batch pipeline end to end (the flagship) -----------------------------

@query("summary_pipeline")
def q_summary_pipeline(spark, sf):
    """Documents -> bounded text -> category -> summary prompt (rejects kept
    out) -> mock responder (T7) -> assembly (A1) -> JSON recovery (X1) ->
    typed summary (X2) -> Markdown (X6)."""
    json_conf(spark)
    prompts = _summary_render(derive.summary_variables(spark, sf)).where(F.col("ok"))
    # The detected category rides along with the pieces (no join back to the
    # prompts, which would render every document a second time).
    pieces = mock_responses(prompts.select("doc_id", F.col("category").alias("detected_category")), "doc_id",
                            keep=["detected_category"])
    answers = assemble(pieces, ["doc_id", "detected_category"], delta="delta", out="raw")
    typed = typed_summaries(recover_json(answers).drop("route"))
    md = summary_markdown(F.col("title"), F.col("summary"), F.col("key_points"), F.col("action_items"),
                          F.col("category"), F.col("importance"))
    return typed.select("doc_id", "detected_category", "ok", md.alias("markdown"))


@query("reframed_stream_text")
def q_reframed_stream_text(spark, sf):
    """T1 in Structured Streaming: 17-byte chunks arriving out of order across
    micro-batches are re-framed into lines with keyed state; the lines are
    parsed and assembled (A1) back into each turn's text."""
    json_conf(spark)
    chunks = derive.byte_chunks(spark, sf)
    last = F.max("chunk_no").over(Window.partitionBy("conv_id", "turn"))
    chunks = (chunks.withColumn("is_last", F.col("chunk_no") == last)
              .withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 10)))
    lines = run_to_table(spark, reframe_stream(replay_chunks(spark, chunks), watermark="1 day"), "reframe")
    return assemble(wire_deltas(lines), ["conv_id", "turn"])


@query("detected_tools")
def q_detected_tools(spark, sf):
    """Known tools found per configuration (C10 screen, C16 execCommand, ccs proxies)."""
    t = detect_tools(derive.installed_commands(spark, sf), known_tools_table(spark))
    return t.select("config_id", "ord", "name", "command", "prompt_command", "prompt_use_stdin")


from textloom.plans import extra  # noqa: E402

QUERIES.update(extra.QUERIES)
