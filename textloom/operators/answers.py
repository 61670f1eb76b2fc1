"""Answers to typed records.

X1 recovers the JSON in a model's answer. Its brace scan must skip quoted
text and jump past failed candidates, which no built-in expresses, so it is
one Python UDF that returns canonical JSON text. Everything
after that (type checks against the Summary, MeetingSummary and
classification shapes, explode of action items, Markdown and text reports)
is VARIANT access and string built-ins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.prompts import INPUT_CATEGORIES, SUMMARY_CATEGORIES

NO_JSON = "No valid JSON object found in response"
IMPORTANCE = ["low", "medium", "high"]

# JavaScript whitespace for trim and \s (Python's own \s and str.strip differ).
_JS_WS = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_TRIM = re.compile(f"^[{_JS_WS}]+|[{_JS_WS}]+$")
# Fixed value: the fenced-block pattern (any case, first match).
_FENCE = re.compile(f"```(?:json)?[{_JS_WS}]*([\\s\\S]*?)```", re.IGNORECASE | re.ASCII)


def _js_trim(s: str) -> str:
    return _TRIM.sub("", s)


def _reject_constant(name):
    raise ValueError(name)


def _loads(text: str):
    """JSON.parse: strict JSON, NaN/Infinity literals rejected, last duplicate key wins."""
    return json.loads(text, parse_constant=_reject_constant)


_BRACE_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)
_LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def _match_braces(text: str, start: int, ends: dict[int, int]) -> None:
    """Record where the brace group at ``start``, and every group opened inside it, ends (0: never closes).

    One token pass serves all of them: what follows an inner brace reads the
    same from there, so text with many unclosed braces is read once.
    """
    open_at: list[int] = []
    for token in _BRACE_TOKEN.finditer(text, start):
        if token[0] == "{":
            open_at.append(token.start())
        elif token[0] == "}":
            ends[open_at.pop()] = token.end()
            if not open_at:
                return
    ends.update(dict.fromkeys(open_at, 0))


def _candidates(text: str) -> Iterator[tuple[str, str]]:
    """Substrings that may be the answer's JSON, with their route, best first."""
    if text[:1] == "{" and text[-1:] == "}":
        yield text, "whole"
    fence = _FENCE.search(text)
    if fence and fence[1]:
        yield _js_trim(fence[1]), "fenced"
    ends: dict[int, int] = {}
    at = text.find("{")
    while at >= 0:
        if at not in ends:
            _match_braces(text, at, ends)
        if ends[at]:
            yield text[at:ends[at]], "braces"
        at = text.find("{", ends[at] or at + 1)


def recover_one(raw: str | None) -> tuple[str | None, str | None, str | None]:
    """(canonical JSON, route, reason) for one answer. Lone surrogates come out as escapes;
    objects nested deeper than the parser's stack count as no JSON."""
    for part, route in _candidates(_js_trim(raw or "")):
        try:
            out = json.dumps(_loads(part), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        except (ValueError, RecursionError):
            continue
        return _LONE_SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out), route, None
    return None, None, NO_JSON


RECOVER_SCHEMA = T.StructType([T.StructField("json", T.StringType()), T.StructField("route", T.StringType()),
                               T.StructField("reason", T.StringType())])


# Plain, not Arrow: a hundred answers at a time, where an Arrow batch holds ten thousand whole answers, three times over, in each worker.
recover_json_udf = F.udf(recover_one, RECOVER_SCHEMA, useArrow=False)


def recover_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``json`` (canonical text), ``route`` (whole / fenced / braces)
    and ``reason``. Rows stay in their partitions and pass through Python a
    hundred at a time."""
    r = df.withColumn("_rec", recover_json_udf(F.col(raw)))
    return (r.withColumn("json", F.col("_rec.json")).withColumn("route", F.col("_rec.route"))
            .withColumn("reason", F.col("_rec.reason")).drop("_rec"))


# ---------------------------------------------------------------------------
# Zod-style type tests over VARIANT.
# ---------------------------------------------------------------------------
def zod_type(x: Column) -> Column:
    """The type name Zod reports for a JSON value (NULL when missing)."""
    t = F.schema_of_variant(x)
    return (F.when(x.isNull(), F.lit(None))
            .when(t == "STRING", F.lit("string"))
            .when(t == "BOOLEAN", F.lit("boolean"))
            .when(t == "VOID", F.lit("null"))
            .when(t.startswith("ARRAY"), F.lit("array"))
            .when(t.startswith("OBJECT"), F.lit("object"))
            .otherwise(F.lit("number")))


def parse_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add ``name`` = expr, produced by a one-element explode. A filter on a
    column derived from it (such as ``ok``) can then not be pushed below the
    generator, which would inline the parse into every reference of the
    filter and parse each answer many times."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string_issue(v: Column, key: str, required: bool = True, min_message: str | None = None) -> Column:
    x = _get(v, f"$.{key}")
    t = zod_type(x)
    bad_type = F.format_string(f"{key}: Expected string, received %s", t)
    e = F.when(t.isNull(), F.lit(f"{key}: Required") if required else F.lit(None)).when(t != "string", bad_type)
    if min_message:
        e = e.when(F.length(x.cast("string")) < 1, F.lit(f"{key}: {min_message}"))
    return e


def _enum_issue(v: Column, key: str, values: list[str]) -> Column:
    x = _get(v, f"$.{key}")
    t = zod_type(x)
    expected = " | ".join(f"'{o}'" for o in values)
    return (F.when(t.isNull(), F.lit(f"{key}: Required"))
            .when(t != "string", F.format_string(f"{key}: Expected {expected}, received %s", t))
            .when(~x.cast("string").isin(*values),
                  F.format_string(f"{key}: Invalid enum value. Expected {expected}, received '%s'",
                                  x.cast("string"))))


def _string_array_issues(v: Column, key: str) -> Column:
    """Issues for an array of strings: the array itself, then each element."""
    x = _get(v, f"$.{key}")
    t = zod_type(x)
    head = (F.when(t.isNull(), F.lit(f"{key}: Required"))
            .when(t != "array", F.format_string(f"{key}: Expected array, received %s", t)))
    elems = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    per = F.transform(elems, lambda e, i: F.when(zod_type(e) != "string", F.format_string(
        f"{key}.%d: Expected string, received %s", i, zod_type(e))))
    return F.when(head.isNotNull(), F.array(head)).otherwise(F.array_compact(per))


def _string_array(v: Column, key: str) -> Column:
    return F.transform(F.try_variant_get(v, f"$.{key}", "array<variant>"), lambda e: e.cast("string"))


def _staged_fields(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each field's VARIANT value and Zod type name as columns of their own,
    so the checks reference them instead of re-extracting per branch."""
    for k in keys:
        df = df.withColumn(f"_x_{k}", F.try_variant_get(F.col("_v"), f"$.{k}", "variant"))
        df = df.withColumn(f"_t_{k}", zod_type(F.col(f"_x_{k}")))
    return df


def _s_string(k: str, required: bool = True, min_message: str | None = None) -> Column:
    x, t = F.col(f"_x_{k}"), F.col(f"_t_{k}")
    e = (F.when(t.isNull(), F.lit(f"{k}: Required") if required else F.lit(None))
         .when(t != "string", F.format_string(f"{k}: Expected string, received %s", t)))
    if min_message:
        e = e.when(F.length(x.cast("string")) < 1, F.lit(f"{k}: {min_message}"))
    return e


def _s_enum(k: str, values: list[str]) -> Column:
    x, t = F.col(f"_x_{k}"), F.col(f"_t_{k}")
    expected = " | ".join(f"'{o}'" for o in values)
    return (F.when(t.isNull(), F.lit(f"{k}: Required"))
            .when(t != "string", F.format_string(f"{k}: Expected {expected}, received %s", t))
            .when(~x.cast("string").isin(*values),
                  F.format_string(f"{k}: Invalid enum value. Expected {expected}, received '%s'", x.cast("string"))))


def _s_string_array(k: str) -> Column:
    x, t = F.col(f"_x_{k}"), F.col(f"_t_{k}")
    head = (F.when(t.isNull(), F.lit(f"{k}: Required"))
            .when(t != "array", F.format_string(f"{k}: Expected array, received %s", t)))
    elems = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
    per = F.transform(F.transform(elems, lambda e: zod_type(e)), lambda et, i: F.when(et != "string", F.format_string(
        f"{k}.%d: Expected string, received %s", i, et)))
    return F.when(head.isNotNull(), F.array(head)).otherwise(F.array_compact(per))


SUMMARY_FIELDS = ["title", "summary", "key_points", "action_items", "category", "importance"]


def typed_summaries(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Validate against the Summary shape (title optional; summary
    non-empty; key_points and action_items string arrays; category and
    importance enums; unknown keys dropped). Adds ok, reason (issues joined
    by "; "), and the typed fields for valid rows."""
    v = F.col("_v")
    issues = F.array_compact(F.flatten(F.array(
        F.array(_s_string("title", required=False)),
        F.array(_s_string("summary", min_message="Summary cannot be empty")),
        _s_string_array("key_points"),
        _s_string_array("action_items"),
        F.array(_s_enum("category", SUMMARY_CATEGORIES)),
        F.array(_s_enum("importance", IMPORTANCE)))))
    top = zod_type(v)
    out = _staged_fields(parse_once(df, "_v", F.try_parse_json(F.col(json_col))), SUMMARY_FIELDS)
    out = out.withColumn("_issues", issues).withColumn("_top", top)
    reason = (F.when(v.isNull(), F.coalesce(F.col("reason"), F.lit(NO_JSON)))
              .when(F.col("_top") != "object", F.format_string("Expected object, received %s", F.col("_top")))
              .otherwise(F.when(F.size("_issues") > 0, F.array_join("_issues", "; "))))
    out = out.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    ok = F.col("ok")

    def arr(k):
        return F.transform(F.try_variant_get(F.col(f"_x_{k}"), "$", "array<variant>"), lambda e: e.cast("string"))
    out = (out.withColumn("title", F.when(ok, F.col("_x_title").cast("string")))
           .withColumn("summary", F.when(ok, F.col("_x_summary").cast("string")))
           .withColumn("key_points", F.when(ok, arr("key_points")))
           .withColumn("action_items", F.when(ok, arr("action_items")))
           .withColumn("category", F.when(ok, F.col("_x_category").cast("string")))
           .withColumn("importance", F.when(ok, F.col("_x_importance").cast("string"))))
    return out.drop("_v", "_issues", "_top", *[f"_x_{k}" for k in SUMMARY_FIELDS], *[f"_t_{k}" for k in SUMMARY_FIELDS])


def _meeting_item_issues(v: Column) -> Column:
    x = _get(v, "$.action_items")
    t = zod_type(x)
    head = (F.when(t.isNull(), F.lit("action_items: Required"))
            .when(t != "array", F.format_string("action_items: Expected array, received %s", t)))
    elems = F.coalesce(F.try_variant_get(v, "$.action_items", "array<variant>"), F.array().cast("array<variant>"))

    def per_item(e, i):
        et = zod_type(e)
        fields = []
        for k in ("owner", "task", "due"):
            ft = zod_type(F.try_variant_get(e, f"$.{k}", "variant"))
            fields.append(F.when(ft.isNull(), F.format_string(f"action_items.%d.{k}: Required", i))
                          .when(ft != "string", F.format_string(f"action_items.%d.{k}: Expected string, received %s",
                                                                i, ft)))
        return F.when(et != "object", F.array(F.format_string("action_items.%d: Expected object, received %s",
                                                              i, et))).otherwise(F.array(*fields))
    per = F.flatten(F.transform(elems, per_item))
    return F.when(head.isNotNull(), F.array(head)).otherwise(F.array_compact(per))


MEETING_ITEM = "array<struct<owner:string,task:string,due:string>>"


def typed_meetings(df: DataFrame, refusal: str = "refusal", parsed: str = "parsed",
                   content: str = "content") -> DataFrame:
    """A refusal becomes "Model refused: ..."; a parsed object is used as
    is; otherwise the content text is parsed; none is an error; the result is
    checked against the MeetingSummary shape."""
    src = F.when(F.length(F.col(refusal)) > 0, F.lit(None)) \
        .when(F.col(parsed).isNotNull(), F.col(parsed)) \
        .when(F.length(F.col(content)) > 0, F.col(content))
    v = F.col("_v")
    issues = F.flatten(F.array(F.array(_string_issue(v, "summary")), _meeting_item_issues(v),
                               _string_array_issues(v, "risks")))
    top = zod_type(v)
    reason = (F.when(F.length(F.col(refusal)) > 0, F.concat(F.lit("Model refused: "), F.col(refusal)))
              .when(F.col("_src").isNull(), F.lit("No parsed output received from the model"))
              .when(v.isNull(), F.lit("Invalid JSON in model output"))
              .when(top != "object", F.format_string("Expected object, received %s", top))
              .otherwise(F.when(F.size(F.array_compact(issues)) > 0, F.array_join(F.array_compact(issues), "; "))))
    out = (parse_once(df.withColumn("_src", src), "_v", F.try_parse_json(F.col("_src")))
           .withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()))
    ok = F.col("ok")
    items = F.transform(F.try_variant_get(v, "$.action_items", "array<variant>"),
                        lambda e: F.struct(*[F.try_variant_get(e, f"$.{k}", "string").alias(k)
                                             for k in ("owner", "task", "due")]))
    return (out.withColumn("summary", F.when(ok, _get(v, "$.summary").cast("string")))
            .withColumn("action_items", F.when(ok, items))
            .withColumn("risks", F.when(ok, _string_array(v, "risks")))
            .drop("_v", "_src"))


def typed_classes(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Category in the six input classes, confidence a number in 0..1,
    reason a string."""
    v = F.col("_v")
    c = _get(v, "$.confidence")
    ct = zod_type(c)
    conf_issue = (F.when(ct.isNull(), F.lit("confidence: Required"))
                  .when(ct != "number", F.format_string("confidence: Expected number, received %s", ct))
                  .when(c.cast("double") < 0, F.lit("confidence: Number must be greater than or equal to 0"))
                  .when(c.cast("double") > 1, F.lit("confidence: Number must be less than or equal to 1")))
    issues = F.array_compact(F.array(_enum_issue(v, "category", INPUT_CATEGORIES), conf_issue,
                                     _string_issue(v, "reason")))
    top = zod_type(v)
    why = (F.when(v.isNull(), F.coalesce(F.col("reason"), F.lit(NO_JSON)))
           .when(top != "object", F.format_string("Expected object, received %s", top))
           .otherwise(F.when(F.size(issues) > 0, F.array_join(issues, "; "))))
    out = parse_once(df, "_v", F.try_parse_json(F.col(json_col))).withColumn("reason", why) \
        .withColumn("ok", F.col("reason").isNull())
    ok = F.col("ok")
    return (out.withColumn("category", F.when(ok, _get(v, "$.category").cast("string")))
            .withColumn("confidence", F.when(ok, c.cast("double")))
            .withColumn("explanation", F.when(ok, _get(v, "$.reason").cast("string")))
            .drop("_v"))


def summary_markdown(title: Column, summary: Column, key_points: Column, action_items: Column,
                     category: Column, importance: Column) -> Column:
    """X6: "# title" (or Untitled), the summary, optional Key Points and
    Action Items sections, then the category/importance footer; trimmed."""
    head = F.concat(F.lit("# "), F.when(F.length(title) > 0, title).otherwise(F.lit("Untitled")), F.lit("\n\n"),
                    summary, F.lit("\n\n"))
    points = F.when(F.size(key_points) > 0, F.concat(
        F.lit("## Key Points\n"), F.array_join(F.transform(key_points, lambda p: F.concat(F.lit("- "), p)), "\n"),
        F.lit("\n\n"))).otherwise(F.lit(""))
    actions = F.when(F.size(action_items) > 0, F.concat(
        F.lit("## Action Items\n"),
        F.array_join(F.transform(action_items, lambda p: F.concat(F.lit("- [ ] "), p)), "\n"),
        F.lit("\n\n"))).otherwise(F.lit(""))
    foot = F.concat(F.lit("_Category: "), category, F.lit(" | Importance: "), importance, F.lit("_"))
    from textloom.functions.text import js_trim
    return js_trim(F.concat(head, points, actions, foot))


def meeting_report(summary: Column, action_items: Column, risks: Column) -> Column:
    """X7 (meeting): Summary, Action items ("- task — owner (due ...)") and
    Risks sections, "  None" for an empty list."""
    items = F.when(F.size(action_items) == 0, F.lit("  None")).otherwise(F.array_join(F.transform(
        action_items, lambda a: F.concat(F.lit("- "), a["task"], F.lit(" — "), a["owner"], F.lit(" (due "),
                                         a["due"], F.lit(")"))), "\n"))
    rs = F.when(F.size(risks) == 0, F.lit("  None")).otherwise(
        F.array_join(F.transform(risks, lambda r: F.concat(F.lit("- "), r)), "\n"))
    return F.concat(F.lit("Summary\n"), summary, F.lit("\n\nAction items\n"), items, F.lit("\n\nRisks\n"), rs)
