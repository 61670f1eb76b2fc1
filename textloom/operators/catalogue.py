"""Catalogues of tools and templates: read (S6), merge (J1), add default
templates (J2), lint (A3, X7), one selectable list (O3), status tables to
profile rows (C12, C13).

Catalogues are tables keyed by ``config_id`` (one per user configuration),
so many configurations are processed at once; membership tests are equi
anti joins, never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.screens import is_safe_command, is_safe_tool_command, placeholder_count
from textloom.functions.text import JS_WS, js_trim

# ---------------------------------------------------------------------------
# Default templates, CLI proxy providers and messages.
# ---------------------------------------------------------------------------
DEFAULT_TEMPLATES = [
    ("review", "opencode run --model opencode/big-pickle --agent plan 'Review the following changes and provide "
               "feedback: $@'", "Code review with OpenCode", ["rev", "code-review"]),
    ("commit-zen", "opencode run --model opencode/big-pickle --agent plan 'Review the following changes on git and "
                   "generate a concise git commit message, group by logical changes with commitizen convention, do "
                   "atomic commit message'", "Generate commit message with OpenCode", ["zen", "logical-commit"]),
    ("summary", "ai summary --provider opencode --mode tldr $@", "Summarize content with OpenCode (free model)",
     ["sum", "summarize"]),
    ("architecture-explanation", "ccs gemini 'Explain this codebase architecture'", "Explain architecture with Gemini",
     ["arch", "arch-explanation"]),
    ("draft-pull-request", "ccs glm --permission-mode acceptEdits -p 'Create draft pr with what why how by gh cli'",
     "Create draft pull request with GLM", ["pr", "draft-pr"]),
    ("types", "ccs mm --permission-mode acceptEdits -p 'Improve TypeScript types: Remove any, add proper type guards, "
              "ensure strict mode compliance for: $@'", "Enhance type safety", ["typescript"]),
    ("test", "ccs mm --permission-mode acceptEdits -p 'Write tests using Arrange-Act-Assert pattern. Focus on "
             "behavior, not implementation details for: $@'", "Generate tests", ["spec", "tests"]),
    ("docs", "ccs mm --permission-mode acceptEdits -p 'Add JSDoc comments with @param and @returns. Include usage "
             "examples for: $@'", "Add documentation", ["document"]),
    ("explain", "ccs mm --permission-mode plan -p 'Explain this code in detail: 1) What it does 2) How it works 3) "
                "Design decisions: $@'", "Code explanation", ["explain-code"]),
]

CLI_PROXY_PROVIDERS = [
    ("gemini", "Google Gemini (OAuth)"), ("codex", "OpenAI Codex (OAuth)"), ("agy", "Antigravity (OAuth)"),
    ("qwen", "Qwen Code (OAuth)"), ("iflow", "Iflow (OAuth)"), ("kiro", "Kiro (OAuth)"),
    ("ghcp", "GitHub Copilot (OAuth)"),
]

ANSI_RE = r"\x1b\[[0-9;]*m"
_WS_IN = JS_WS[1:-1]
STATUS_ROW_RE = ("[│|]" + JS_WS + "*([^" + _WS_IN + "│|]+)" + JS_WS + "*[│|].*?[│|]" + JS_WS + r"*\[OK\]"
                 + JS_WS + "*[│|]")

MSG = {
    "tools_array": "Config must have a 'tools' array",
    "templates_array": "Config must have a 'templates' array",
    "tool_name": "Tool name is required and must be a non-empty string",
    "tool_command": "Tool command is required and must be a non-empty string",
    "tool_unsafe": "Tool command contains unsafe characters",
    "tool_description": "Tool description must be a string",
    "aliases_array": "Aliases must be an array of strings",
    "aliases_strings": "All aliases must be strings",
    "template_name": "Template name is required and must be a non-empty string",
    "template_command": "Template command is required and must be a non-empty string",
    "template_unsafe": "Template command contains unsafe characters or patterns",
    "template_many": "Template command should contain at most one $@ placeholder. Multiple placeholders are not "
                     "supported.",
    "template_leading": "Template command starts with $@. Consider placing the placeholder after the base command "
                        "for clarity.",
    "template_description": "Template description is required and must be a non-empty string",
}

# Leading ai-summary / ai-meeting word (followed by whitespace or the end).
_WORD_END = "(?=" + JS_WS + r"|\z)"
SUMMARY_OLD = r"\A" + JS_WS + "*ai-summary" + _WORD_END
MEETING_OLD = r"\A" + JS_WS + "*ai-meeting" + _WORD_END


def defaults_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, c, d, a) for i, (n, c, d, a) in enumerate(DEFAULT_TEMPLATES)],
                                 "default_idx int, name string, command string, description string, "
                                 "aliases array<string>")


# --- J1 -----------------------------------------------------------------------
def catalogue_merge(configured: DataFrame, detected: DataFrame, key: str = "config_id") -> DataFrame:
    """Keep every configured tool; add detected tools whose lower-cased name
    and lower-cased command both match no configured tool of the same
    configuration. No de-duplication inside either side. Two equi anti joins
    (one anti join with an OR condition would plan as a nested loop)."""
    names = configured.select(F.col(key).alias("_k1"), F.lower("name").alias("_n")).distinct()
    cmds = configured.select(F.col(key).alias("_k2"), F.lower("command").alias("_c")).distinct()
    d = (detected.join(names, (F.col(key) == F.col("_k1")) & (F.lower("name") == F.col("_n")), "left_anti")
         .join(cmds, (F.col(key) == F.col("_k2")) & (F.lower("command") == F.col("_c")), "left_anti"))
    return (configured.withColumn("origin", F.lit("config"))
            .unionByName(d.withColumn("origin", F.lit("detected")), allowMissingColumns=True))


# --- J2 -----------------------------------------------------------------------
def _rewrite(name: Column, command: Column) -> tuple[Column, Column]:
    """Summary/meeting command migration and whether it changed the row."""
    summary_hit = (name == "summary") & js_trim(command).rlike(SUMMARY_OLD)
    meeting_new = F.regexp_replace(command, MEETING_OLD, "ai meeting")
    meeting_hit = (name == "meeting") & command.rlike(MEETING_OLD) & (meeting_new != command)
    new = (F.when(summary_hit, F.regexp_replace(command, SUMMARY_OLD, "ai summary"))
           .when(meeting_hit, meeting_new).otherwise(command))
    return new, summary_hit | meeting_hit


def template_defaults(existing: DataFrame, defaults: list | None = None, key: str = "config_id") -> DataFrame:
    """Per configuration: add the default templates missing by (case-sensitive)
    name, migrate old summary/meeting commands, report ``changed``.

    A changed configuration comes back keyed by name (a later duplicate's
    values at the first duplicate's position) with defaults after it; an
    unchanged one comes back exactly as it was. ``pos`` orders the rows.
    """
    cols = ["command", "description", "aliases"]
    dedup = (existing.groupBy(key, "name")
             .agg(F.min("ord").alias("pos"), F.max_by(F.struct(*cols), F.col("ord")).alias("_v"))
             .select(key, "pos", "name", *[F.col("_v")[c].alias(c) for c in cols])
             .withColumn("added", F.lit(False)))
    configs = existing.select(key).distinct()
    # Each configuration paired with the fixed nine defaults: a bounded
    # explode of a literal array, not a join.
    rows = DEFAULT_TEMPLATES if defaults is None else defaults
    lit_defaults = F.array(*[F.struct(F.lit(i).alias("default_idx"), F.lit(n).alias("name"),
                                      F.lit(c).alias("command"), F.lit(d).alias("description"),
                                      F.array(*[F.lit(a) for a in al]).cast("array<string>").alias("aliases"))
                             for i, (n, c, d, al) in enumerate(rows)])
    wanted = configs.select(key, F.explode(lit_defaults).alias("_d")).select(key, "_d.*")
    missing = (wanted.join(dedup.select(key, "name"), [key, "name"], "left_anti")
               .withColumn("pos", F.lit(1 << 40) + F.col("default_idx")).drop("default_idx")
               .withColumn("added", F.lit(True)))
    merged = dedup.unionByName(missing)
    new_cmd, rewritten = _rewrite(F.col("name"), F.col("command"))
    merged = merged.withColumn("_rw", rewritten).withColumn("command", new_cmd)
    flags = merged.groupBy(key).agg(F.max(F.col("added") | F.col("_rw")).alias("changed"))
    changed_rows = (merged.join(flags.where("changed"), key)
                    .select(key, "pos", "name", "command", "description", "aliases", "changed"))
    same_rows = (existing.join(flags.where(~F.col("changed")), key)
                 .select(key, F.col("ord").alias("pos"), "name", "command", "description", "aliases", "changed"))
    return changed_rows.unionByName(same_rows)


# --- A3 / X7 --------------------------------------------------------------------
def _jtype(x: Column) -> Column:
    """JavaScript ``typeof``-like name for a VARIANT value (NULL = undefined)."""
    t = F.schema_of_variant(x)
    return (F.when(x.isNull(), F.lit(None)).when(t == "STRING", F.lit("string"))
            .when(t == "VOID", F.lit("null")).when(t.startswith("ARRAY"), F.lit("array"))
            .when(t.startswith("OBJECT"), F.lit("object")).when(t == "BOOLEAN", F.lit("boolean"))
            .otherwise(F.lit("number")))


def _field(e: Column, k: str) -> Column:
    return F.try_variant_get(e, f"$.{k}", "variant")


def _nonblank_string(e: Column, k: str) -> Column:
    x = _field(e, k)
    # A missing field, or an element that is no object, is not a string either.
    return F.coalesce((_jtype(x) == "string") & (F.length(js_trim(x.cast("string"))) > 0), F.lit(False))


def _alias_issue(e: Column) -> Column:
    a = _field(e, "aliases")
    t = _jtype(a)
    elems = F.try_variant_get(e, "$.aliases", "array<variant>")
    return (F.when(t.isNull(), F.lit(None))
            .when(t != "array", F.lit(MSG["aliases_array"]))
            .when(F.exists(elems, lambda v: _jtype(v) != "string"), F.lit(MSG["aliases_strings"])))


def _tool_issues(e: Column, i: Column) -> Column:
    p = F.format_string("tools[%d]", i)
    cmd = _field(e, "command")
    cmd_ok = _nonblank_string(e, "command")
    desc_t = _jtype(_field(e, "description"))
    issues = [
        F.when(~_nonblank_string(e, "name"), F.struct(F.concat(p, F.lit(".name")).alias("path"),
                                                      F.lit(MSG["tool_name"]).alias("message"))),
        F.when(~cmd_ok, F.struct(F.concat(p, F.lit(".command")).alias("path"), F.lit(MSG["tool_command"]).alias("message")))
        .when(~is_safe_tool_command(cmd.cast("string")),
              F.struct(F.concat(p, F.lit(".command")).alias("path"), F.lit(MSG["tool_unsafe"]).alias("message"))),
        F.when(desc_t.isNotNull() & (desc_t != "string"),
               F.struct(F.concat(p, F.lit(".description")).alias("path"),
                        F.lit(MSG["tool_description"]).alias("message"))),
        F.when(_alias_issue(e).isNotNull(), F.struct(F.concat(p, F.lit(".aliases")).alias("path"),
                                                     _alias_issue(e).alias("message"))),
    ]
    return F.array_compact(F.array(*issues))


def _template_issues(e: Column, i: Column) -> Column:
    p = F.format_string("templates[%d]", i)
    cmd = _field(e, "command").cast("string")
    n = placeholder_count(cmd)

    def issue(suffix, msg):
        return F.struct(F.concat(p, F.lit(suffix)).alias("path"), (F.lit(msg) if isinstance(msg, str) else msg)
                        .alias("message"))
    cmd_ok = _nonblank_string(e, "command")
    issues = [
        F.when(~_nonblank_string(e, "name"), issue(".name", MSG["template_name"])),
        F.when(~cmd_ok, issue(".command", MSG["template_command"]))
        .when(~is_safe_command(cmd), issue(".command", MSG["template_unsafe"])),
        F.when(cmd_ok & is_safe_command(cmd) & (n > 1), issue(".command", MSG["template_many"])),
        F.when(cmd_ok & is_safe_command(cmd) & (n == 1) & js_trim(cmd).startswith("$@"),
               issue(".command", MSG["template_leading"])),
        F.when(~_nonblank_string(e, "description"), issue(".description", MSG["template_description"])),
        F.when(_alias_issue(e).isNotNull(), issue(".aliases", _alias_issue(e))),
    ]
    return F.array_compact(F.array(*issues))


def lint_configs(configs: DataFrame, key: str = "config_id", text: str = "config_json") -> DataFrame:
    """A3: every violation of every configuration: (key, seq, path, message),
    in the reference's order (tools, then templates; fields in order)."""
    v = F.try_parse_json(F.col(text))
    tools = F.try_variant_get(F.col("_v"), "$.tools", "array<variant>")
    temps = F.try_variant_get(F.col("_v"), "$.templates", "array<variant>")
    per_tool = F.flatten(F.transform(F.coalesce(tools, F.array().cast("array<variant>")), lambda e, i: _tool_issues(e, i)))
    per_temp = F.flatten(F.transform(F.coalesce(temps, F.array().cast("array<variant>")),
                                     lambda e, i: _template_issues(e, i)))
    head_tools = F.when(tools.isNull(), F.array(F.struct(F.lit("tools").alias("path"),
                                                         F.lit(MSG["tools_array"]).alias("message"))))
    head_temps = F.when(temps.isNull(), F.array(F.struct(F.lit("templates").alias("path"),
                                                         F.lit(MSG["templates_array"]).alias("message"))))
    all_issues = F.concat(F.coalesce(head_tools, per_tool), F.coalesce(head_temps, per_temp))
    return (configs.withColumn("_v", v)
            .select(key, F.posexplode(all_issues).alias("seq", "issue"))
            .select(key, "seq", F.col("issue.path").alias("path"), F.col("issue.message").alias("message")))


def lint_report(violations: DataFrame, sources: DataFrame, key: str = "config_id") -> DataFrame:
    """The validation text per configuration that has violations."""
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("  "), F.col("path"), F.lit(": "),
                                                                  F.col("message")).alias("line"))))
    agg = violations.groupBy(key).agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("_body"))
    return (agg.join(sources.select(key, "source"), key, "left")
            .select(key, F.concat(F.lit("Config validation failed:\n\n"), F.col("_body"), F.lit("\n\nConfig file: "),
                                  F.coalesce(F.col("source"), F.lit(""))).alias("report")))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files (one JSON document each) as (source, config_json)."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("source"), F.col("value").alias("config_json")))


def explode_catalogue(configs: DataFrame, key: str = "config_id", text: str = "config_json") -> tuple[DataFrame, DataFrame]:
    """Tools and templates of each configuration as rows; ``ord`` is the
    array position."""
    v = F.try_parse_json(F.col(text))
    base = configs.withColumn("_v", v)
    tools = (base.select(key, F.posexplode(F.try_variant_get("_v", "$.tools", "array<variant>")).alias("ord", "e"))
             .select(key, "ord", *[F.try_variant_get("e", f"$.{k}", "string").alias(k)
                                   for k in ("name", "command", "description", "authType", "promptCommand")],
                     F.try_variant_get("e", "$.aliases", "array<string>").alias("aliases"),
                     F.try_variant_get("e", "$.promptUseStdin", "boolean").alias("promptUseStdin")))
    temps = (base.select(key, F.posexplode(F.try_variant_get("_v", "$.templates", "array<variant>")).alias("ord", "e"))
             .select(key, "ord", *[F.try_variant_get("e", f"$.{k}", "string").alias(k)
                                   for k in ("name", "command", "description")],
                     F.try_variant_get("e", "$.aliases", "array<string>").alias("aliases")))
    return tools, temps


# --- O3 -----------------------------------------------------------------------
def selectable_items(tools: DataFrame, templates: DataFrame, key: str = "config_id") -> DataFrame:
    """One list: tools first, then templates; missing description -> '',
    missing aliases -> []; ``pos`` keeps list order (templates after tools)."""
    empty = F.array().cast("array<string>")
    t = tools.select(key, F.col("ord"), F.lit(0).alias("_part"), "name", "command",
                     F.coalesce(F.when(F.length("description") > 0, F.col("description")), F.lit("")).alias("description"),
                     F.lit(False).alias("is_template"), F.coalesce("aliases", empty).alias("aliases"),
                     F.col("promptCommand").alias("prompt_command"),
                     F.col("promptUseStdin").alias("prompt_use_stdin"))
    m = templates.select(key, F.col("ord"), F.lit(1).alias("_part"), "name", "command", "description",
                         F.lit(True).alias("is_template"), F.coalesce("aliases", empty).alias("aliases"),
                         F.lit(None).cast("string").alias("prompt_command"),
                         F.lit(None).cast("boolean").alias("prompt_use_stdin"))
    return t.unionByName(m).withColumn("pos", F.col("_part") * F.lit(1 << 40) + F.col("ord")).drop("_part")


# --- C12 / C13 --------------------------------------------------------------------
def status_rows(logs: DataFrame, key: str = "log_id", text: str = "text") -> DataFrame:
    """Active profiles from status tables: colour codes removed, box or
    pipe rows whose last cell is [OK], header cell API excluded."""
    lines = logs.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), ANSI_RE, ""), "\n")).alias("line_no", "line"))
    prof = F.regexp_extract(F.col("line"), STATUS_ROW_RE, 1)
    return (lines.withColumn("profile", prof).where((F.col("profile") != "") & (F.col("profile") != "API"))
            .select(key, "line_no", "profile"))


def profile_rows(profiles: DataFrame, profile: str = "profile") -> DataFrame:
    """An active profile as a tool row."""
    p = F.col(profile)
    return profiles.select("*", F.concat(F.lit("ccs:"), p).alias("name"), F.concat(F.lit("ccs "), p).alias("command"),
                           F.concat(F.lit("CCS profile: "), p).alias("description"), F.lit("api_key").alias("auth_type"),
                           F.concat(F.lit("ccs "), p, F.lit(" --permission-mode plan -p")).alias("prompt_command"))


def cli_proxy_rows(spark: SparkSession) -> DataFrame:
    """The seven fixed OAuth proxy tools."""
    return spark.createDataFrame(
        [(f"ccs:{n}", f"ccs {n}", d, "oauth", f"ccs {n} --permission-mode plan -p") for n, d in CLI_PROXY_PROVIDERS],
        "name string, command string, description string, auth_type string, prompt_command string")


# ---------------------------------------------------------------------------
# The known tools the reference probes for, in its order
# (name, command, description, aliases, execCommand, promptCommand, promptUseStdin).
# ---------------------------------------------------------------------------
KNOWN_TOOLS = [
    ("claude", "claude", "Anthropic Claude CLI", None, None, "claude --permission-mode plan -p", None),
    ("cline", "cline", "Cline CLI - AI coding assistant", None, None, "cline -p", None),
    ("gemini", "gemini", "Google Gemini CLI", None, None, "gemini -p", None),
    ("agy", "agy", "Google Antigravity CLI", None, None, None, None),
    ("opencode", "opencode", "OpenCode CLI", None, None, "opencode run --model opencode/big-pickle", True),
    ("amp", "amp", "Sourcegraph Amp CLI", None, None, "amp -x", True),
    ("copilot", "copilot", "GitHub Copilot CLI", None, None, "copilot suggest", True),
    ("codex", "codex", "OpenAI Codex CLI", None, None, "codex exec", None),
    ("interpreter", "interpreter", "Open Interpreter CLI", ["i"], None, "interpreter exec", None),
    ("devin", "devin", "Devin CLI", None, None, "devin -p", None),
    ("kilo", "kilo", "Kilo Code CLI", None, None, None, None),
    ("pi", "pi", "Pi AI CLI", None, None, None, None),
    ("droid", "droid", "Factory Droid CLI", None, None, None, None),
    ("ollama", "ollama", "Ollama CLI", None, "ollama launch --model minimax-m2.5:cloud", None, None),
    ("cursor-agent", "cursor-agent", "Cursor AI Editor", None, None, None, None),
    ("cmd", "cmd", "Command Code CLI", None, None, "cmd -p", None),
    ("freebuff", "freebuff", "Freebuff - Free ad-supported AI coding agent (Codebuff variant)", None, None, None, None),
    ("grok", "grok", "xAI Grok Build CLI", None, None, "grok --permission-mode plan -p", None),
    ("mimo", "mimo", "Mi AI (mimocode) CLI", None, None, "mimo run", None),
    ("kimi", "kimi", "Kimi Code - Moonshot AI CLI", None, None, "kimi -p", None),
    ("reasonix", "reasonix", "Reasonix — DeepSeek-native terminal coding agent (multi-model)", None, None,
     "reasonix run --stdin", True),
    ("omp", "omp", "Oh My Pi CLI", None, None, "omp -p", None),
    ("fx", "fx", "fx.sh coding agent", None, None, "fx ask", None),
]
CCS_TOOL = ("ccs", "ccs", "CCS CLI (Claude Code Switch)")
WINDOWS_SHADOWED = ["cmd"]


def known_tools_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(KNOWN_TOOLS)],
        "ord int, name string, command string, description string, aliases array<string>, exec_command string, "
        "prompt_command string, prompt_use_stdin boolean")


def detect_tools(installed: DataFrame, known: DataFrame, key: str = "config_id", command: str = "command_name",
                 platform: str | None = None) -> DataFrame:
    """Tools found per configuration from the command names found on its
    machine, each once however often it is listed. Names failing the command-name screen (C10) are never found;
    ``cmd`` is skipped on Windows; a tool's ``execCommand`` replaces its
    command (C16). A ``ccs`` install adds the ccs tool and the seven OAuth
    proxy tools. ``known`` is the fixed 23-row table, broadcast."""
    from textloom.functions.screens import command_name_rules
    found = (installed.where(F.size(command_name_rules(F.col(command))) == 0)
             .select(key, F.col(command).alias("_cmd"), *([F.col(platform).alias("_platform")] if platform else [])))
    found = found.distinct()
    if platform:
        found = found.where(~((F.col("_platform") == "win32") & F.col("_cmd").isin(*WINDOWS_SHADOWED)))
    tools = (found.join(F.broadcast(known), F.col("_cmd") == known["command"])
             .select(key, "ord", "name", F.coalesce("exec_command", "command").alias("command"), "description",
                     "aliases", "prompt_command", "prompt_use_stdin"))
    proxies = F.array(*[F.struct(F.lit(f"ccs:{n}").alias("name"), F.lit(f"ccs {n}").alias("command"),
                                 F.lit(d).alias("description"),
                                 F.lit(f"ccs {n} --permission-mode plan -p").alias("prompt_command"))
                        for n, d in CLI_PROXY_PROVIDERS])
    ccs = found.where(F.col("_cmd") == "ccs").select(key).distinct()
    ccs_rows = ccs.select(key, F.lit(len(KNOWN_TOOLS)).alias("ord"), F.lit(CCS_TOOL[0]).alias("name"),
                          F.lit(CCS_TOOL[1]).alias("command"), F.lit(CCS_TOOL[2]).alias("description"),
                          F.lit(None).cast("string").alias("prompt_command"))
    proxy_rows = ccs.select(key, F.posexplode(proxies).alias("_i", "_p")).select(
        key, (F.lit(len(KNOWN_TOOLS) + 1) + F.col("_i")).alias("ord"), "_p.name", "_p.command", "_p.description",
        "_p.prompt_command")
    extra = ccs_rows.unionByName(proxy_rows).withColumn("aliases", F.lit(None).cast("array<string>")) \
        .withColumn("prompt_use_stdin", F.lit(None).cast("boolean"))
    return tools.unionByName(extra)
