"""Prompt rendering and validation as Column expressions.

A prompt is a ``PromptSpec``: id, version, the variables it takes, a
``checks`` function returning Zod-style issues as Columns, and a ``build``
function returning (system, user) Columns. Rendering a table is one
projection; rows failing a check go to the reject side with the reference's
message text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt texts, mode instructions and registry entries, exactly
# as the reference renders them.
# ---------------------------------------------------------------------------
SUMMARY_JSON_SCHEMA = """{
  "title": "Optional detected title",
  "summary": "A concise 3-5 sentence summary",
  "key_points": [
    "Main point one",
    "Main point two"
  ],
  "action_items": [
    "Reply to the sender",
    "Review the linked document"
  ],
  "category": "newsletter",
  "importance": "medium"
}"""

SUMMARY_SYSTEM = ("You are a summarization assistant. Return only a JSON object matching this schema:\n\n"
                  + SUMMARY_JSON_SCHEMA)

MODE_INSTRUCTIONS = {
    "tldr": "Provide a concise 3-5 sentence summary. Keep key_points and action_items short and focused.",
    "actions": "Focus on deadlines, tasks, and action_items. Extract every actionable item and explicitly "
               "mention any deadlines or dates.",
    "linkedin": "Turn the content into a short LinkedIn post draft. Use a professional, engaging tone and punchy "
                "key_points. Include a clear call to action in action_items if appropriate.",
    "technical": "Preserve technical details, links, code snippets, and terminology. Be precise and do not "
                 "oversimplify. Capture technical takeaways in key_points.",
}

SUMMARY_USER_HEAD = (
    "Instructions:\n"
    '- Pick the category from "article", "email", "newsletter", or "unknown" based on the content.\n'
    '- Pick the importance from "low", "medium", or "high" based on urgency and relevance.\n'
    "- Include the title only if one can be detected or inferred from the content.\n"
)
SUMMARY_USER_TAIL = "- Return only JSON. Do not use markdown code fences or add commentary.\n\nContent:\n---\n"

CLASSIFY_SYSTEM = """You classify content for an AI workflow router.

Return only JSON with this shape:
{
  "category": "article | meeting | git-diff | email | code | unknown",
  "confidence": 0.0,
  "reason": "Brief evidence-based explanation"
}

Confidence must be between 0 and 1. Use "unknown" when the evidence is ambiguous. Do not use markdown code fences or add commentary."""

MEETING_INSTRUCTIONS = """You are a structured meeting assistant.

Extract from the meeting transcript or notes:
1. A concise summary (2-4 sentences)
2. Action items with: owner, task, and due date/timeframe
3. Risks, blockers, or concerns

Output must be a JSON object matching this schema:
{
  "summary": "...",
  "action_items": [
    {"owner": "...", "task": "...", "due": "..."}
  ],
  "risks": ["..."]
}

Use empty arrays for action_items and risks if none are present.
Be specific, concise, and do not hallucinate details not in the transcript."""

DIFF_REQUESTS = """Provide:
1. A summary of the changes
2. Potential risks or issues
3. Whether the changes align with best practices
4. Any suggestions for improvement"""

SUMMARY_MODES = ["tldr", "actions", "linkedin", "technical"]
SUMMARY_CATEGORIES = ["article", "email", "newsletter", "unknown"]
INPUT_CATEGORIES = ["article", "meeting", "git-diff", "email", "code", "unknown"]

REGISTRY = [
    ("summarize-content", "1.0.0", "Summarize content for a chosen mode and audience.",
     [("content", "string", True, "Content to summarize"), ("mode", "SummaryMode", True, "Summary style"),
      ("maxLength", "positive integer", False, "Maximum summary length in words"),
      ("audience", "string", False, "Intended reader"),
      ("category", "SummaryCategory", False, "Detected content category"),
      ("source", "string", False, "Content source label")],
     ["title", "summary", "key_points", "action_items", "category", "importance"]),
    ("classify-input", "1.0.0", "Classify input so the launcher can recommend an appropriate workflow.",
     [("content", "string", True, "Content to classify")], ["category", "confidence", "reason"]),
    ("extract-meeting", "1.0.0", "Extract a summary, action items, and risks from meeting notes.",
     [("transcript", "string", True, "Meeting transcript or notes")], ["summary", "action_items", "risks"]),
]


# ---------------------------------------------------------------------------
# Zod-style issue builders (messages as Zod 3 words them).
# ---------------------------------------------------------------------------
def _enum_msg(values: list[str]) -> str:
    return "Invalid enum value. Expected " + " | ".join(f"'{v}'" for v in values) + ", received '%s'"


def required_string(col: Column, path: str, min_message: str) -> Column:
    return (F.when(col.isNull(), F.lit(f"{path}: Required"))
            .when(F.length(col) < 1, F.lit(f"{path}: {min_message}")))


def optional_nonempty(col: Column, path: str) -> Column:
    return F.when(F.length(col) < 1, F.lit(f"{path}: String must contain at least 1 character(s)"))


def enum_check(col: Column, path: str, values: list[str], required: bool = True) -> Column:
    bad = F.when(~col.isin(*values), F.format_string(f"{path}: " + _enum_msg(values), col))
    if required:
        return F.when(col.isNull(), F.lit(f"{path}: Required")).otherwise(bad)
    return bad


def positive_int(col: Column, path: str) -> Column:
    return F.when(col <= 0, F.lit(f"{path}: Number must be greater than 0"))


INT_VARIABLES = {"maxLength"}


@dataclass
class PromptSpec:
    """A versioned prompt: variable checks and a Column-level renderer."""
    id: str
    version: str
    checks: Callable[[dict[str, Column]], list[Column]]
    build: Callable[[dict[str, Column]], tuple[Column, Column]]
    variables: list[str] = field(default_factory=list)

    def render(self, df: DataFrame, **cols: str) -> DataFrame:
        """Adds prompt_id, prompt_version, ok, reason, system, user.

        ``cols`` maps each variable name to a column of ``df`` (missing
        optional variables are NULL)."""
        v = {name: (F.col(cols[name]) if name in cols
                    else F.lit(None).cast("int" if name in INT_VARIABLES else "string")) for name in self.variables}
        issues = F.array_compact(F.array(*self.checks(v)))
        reason = F.when(F.size(issues) > 0, F.concat(F.lit(f'Validation failed for prompt "{self.id}": '),
                                                     F.array_join(issues, ", ")))
        system, user = self.build(v)
        return (df.withColumn("prompt_id", F.lit(self.id)).withColumn("prompt_version", F.lit(self.version))
                .withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
                .withColumn("system", F.when(F.col("ok"), system))
                .withColumn("user", F.when(F.col("ok"), user)))


def mode_instruction(mode: Column) -> Column:
    """J9 as an expression: the 4-row mode table folded into a CASE (no join)."""
    e = None
    for m, text in MODE_INSTRUCTIONS.items():
        e = (F.when(mode == m, F.lit(f"{m}: {text}")) if e is None else e.when(mode == m, F.lit(f"{m}: {text}")))
    return e


def modes_table(spark: SparkSession) -> DataFrame:
    """The mode dimension (mode, instruction) for joins; 4 rows."""
    return spark.createDataFrame([(m, f"{m}: {t}") for m, t in MODE_INSTRUCTIONS.items()],
                                 "mode string, instruction string")


def prompt_dimension(spark: SparkSession) -> DataFrame:
    """Registered prompts with their variables and outputs."""
    rows = [(i, v, d, [(n, t, r, desc) for n, t, r, desc in vs], out) for i, v, d, vs, out in REGISTRY]
    return spark.createDataFrame(rows, "prompt_id string, prompt_version string, description string, "
                                       "variables array<struct<name:string,type:string,required:boolean,"
                                       "description:string>>, output array<string>")


def _summary_checks(v):
    return [required_string(v["content"], "content", "content is required"),
            enum_check(v["mode"], "mode", SUMMARY_MODES),
            positive_int(v["maxLength"], "maxLength"),
            optional_nonempty(v["audience"], "audience"),
            enum_check(v["category"], "category", SUMMARY_CATEGORIES, required=False),
            optional_nonempty(v["source"], "source")]


def _summary_build(v):
    category = F.coalesce(v["category"], F.lit("unknown"))
    content_type = F.when(category == "unknown", F.lit("content")).otherwise(category)
    source = F.coalesce(v["source"], F.lit("input"))
    constraints = F.array_compact(F.array(
        F.when(F.length(v["audience"]) > 0, F.format_string("Write for %s.", v["audience"])),
        F.when(v["maxLength"] != 0, F.format_string("Keep the summary within %d words.", v["maxLength"]))))
    extra = F.when(F.size(constraints) > 0, F.concat(F.lit("\n- "), F.array_join(constraints, "\n- "))) \
        .otherwise(F.lit(""))
    user = F.concat(F.lit("Summarize the following "), content_type, F.lit(" from "), source, F.lit(".\n\n"),
                    F.lit(SUMMARY_USER_HEAD), F.lit("- "), mode_instruction(v["mode"]), extra, F.lit("\n"),
                    F.lit(SUMMARY_USER_TAIL), v["content"], F.lit("\n---"))
    return F.lit(SUMMARY_SYSTEM), user


SUMMARIZE = PromptSpec("summarize-content", "1.0.0", _summary_checks, _summary_build,
                       ["content", "mode", "maxLength", "audience", "category", "source"])

CLASSIFY = PromptSpec(
    "classify-input", "1.0.0",
    lambda v: [required_string(v["content"], "content", "content is required")],
    lambda v: (F.lit(CLASSIFY_SYSTEM), F.concat(F.lit("Classify this content:\n\n---\n"), v["content"],
                                                F.lit("\n---"))),
    ["content"])

EXTRACT_MEETING = PromptSpec(
    "extract-meeting", "1.0.0",
    lambda v: [required_string(v["transcript"], "transcript", "transcript is required")],
    lambda v: (F.lit(MEETING_INSTRUCTIONS), F.concat(F.lit('Transcript:\n"""\n'), v["transcript"],
                                                     F.lit('\n"""'))),
    ["transcript"])


def diff_prompt(diff: Column, ref: Column, custom: Column) -> Column:
    """Target is the ref or "staged changes"; optional extra instructions."""
    target = F.when(F.coalesce(F.length(ref), F.lit(0)) > 0, ref).otherwise(F.lit("staged changes"))
    base = F.concat(F.lit("Please analyze the following git diff ("), target, F.lit("):\n\n"), diff,
                    F.lit("\n\n" + DIFF_REQUESTS))
    return F.when(F.coalesce(F.length(custom), F.lit(0)) > 0,
                  F.concat(base, F.lit("\n\nAdditional instructions:\n"), custom)).otherwise(base)
