"""Screens for commands, arguments, git refs and output paths as Column
expressions (C6-C11, C14, C15).

Each screen returns the list of rules a value breaks (``array_compact`` of
``when`` clauses), so an audit job can count rejects per rule; ``ok`` is an
empty list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.stage import let
from textloom.functions.text import JS_WS, js_trim, utf16_length

_WS_IN = JS_WS[1:-1]  # the class body, for use inside other classes
_B0, _B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# ---------------------------------------------------------------------------
# Allow-lists, forbidden shapes and names of the reference.
# ---------------------------------------------------------------------------
MAX_COMMAND_LENGTH = 500
MAX_ARGUMENT_LENGTH = 200
MAX_COMMAND_NAME_LENGTH = 100
_SAFE_COMMAND_CLASS = r"[a-zA-Z0-9._" + _WS_IN + r"\-\"':,!?/\\|$@`()\[\]<>]"
SAFE_COMMAND = "^" + _SAFE_COMMAND_CLASS + r"+\z"
DANGEROUS = [
    ("chaining_and", r"&&"),
    ("chaining_or", r"\|\|"),
    ("separator", r";"),
    ("substitution", r"\$\("),
    ("backtick_command", r"`[a-zA-Z0-9_]+`"),
    ("sudo", _B0 + "sudo" + _B1),
    ("rm_rf", _B0 + "rm" + JS_WS + "+-rf" + _B1),
    ("redirect_root", ">" + JS_WS + r"*/"),
]
# What a text must hold for the pattern to match at all: a plain search spares most texts the pattern.
DANGEROUS_MARK = {"chaining_and": "&&", "chaining_or": "||", "separator": ";", "substitution": "$(", "backtick_command": "`", "sudo": "sudo",
                  "rm_rf": "-rf", "redirect_root": ">"}
SAFE_TOOL_COMMAND = r"^[a-zA-Z0-9._" + _WS_IN + r"-]+\z"
SAFE_ARGUMENT = r"^[a-zA-Z0-9._\-\"/\\@#=" + _WS_IN + r",.:()\[\]{}]+\z"
SAFE_REF = r"^[a-zA-Z0-9._\-/~^@{}]+\z"
REF_SHELL_MARKS = r"[;&|`$()<>\[\]]"
SAFE_COMMAND_NAME = r"^[a-zA-Z0-9._-]+\z"
PROTECTED_ROOTS = ["etc", "root", "home", "usr", "var", "sys", "proc"]
DEVICE_NAMES = ["con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8",
                "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9"]
# Quote-aware split: runs of non-space, non-quote characters or quoted
# spans; an unterminated quote runs to the end.
TOKEN_RE = r"""(?s)((?:[^ '"]|'[^']*'|"[^"]*"|['"].*\z)+)"""


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _longer(c: Column, limit: int) -> Column:
    """More than ``limit`` UTF-16 units; a text has at least as many bytes, so short ones are not searched for pairs."""
    return (F.octet_length(c) > limit) & (utf16_length(c) > limit)


def command_rules(col) -> Column:
    """Broken rules of a template/prompt command (empty array = safe)."""
    def broken(t: Column) -> Column:
        rules = [F.when(F.length(t) == 0, F.lit("empty")),
                 F.when(_longer(t, MAX_COMMAND_LENGTH), F.lit("too_long")),
                 # Letters, digits and spaces, most of a text, are allowed: only the rest is held against the long list.
                 F.when((F.length(t) > 0) & ~F.regexp_replace(t, r"[\p{Alnum} ]+", "").rlike("^" + _SAFE_COMMAND_CLASS + r"*\z"), F.lit("characters"))]
        rules += [F.when(t.contains(DANGEROUS_MARK[name]) & t.rlike(p), F.lit(name)) for name, p in DANGEROUS]
        return F.array_compact(F.array(*rules))
    return let(js_trim(_c(col)), broken)  # trimmed once, not once a rule


def is_safe_command(col) -> Column:
    return F.size(command_rules(col)) == 0


def is_safe_tool_command(col) -> Column:
    """Configured tool commands: a stricter allow-list on the trimmed text."""
    return js_trim(_c(col)).rlike(SAFE_TOOL_COMMAND)


def argument_rules(col) -> Column:
    """C7 over array<string>: every argument within 200 units and allowed characters."""
    a = _c(col)
    return F.array_compact(F.array(
        F.when(F.exists(a, lambda x: ~(x.rlike(r"^\p{Alnum}+\z") | x.rlike(SAFE_ARGUMENT))), F.lit("characters")),
        F.when(F.exists(a, lambda x: _longer(x, MAX_ARGUMENT_LENGTH)), F.lit("too_long"))))


def ref_rules(col) -> Column:
    """Git ref allow-list, no leading dash, no '..', no shell marks."""
    r = _c(col)
    return F.array_compact(F.array(
        F.when(~r.rlike(SAFE_REF), F.lit("characters")),
        F.when(r.startswith("-"), F.lit("leading_dash")),
        F.when(r.contains(".."), F.lit("dotdot")),
        F.when(r.rlike(REF_SHELL_MARKS), F.lit("shell_marks"))))


def command_name_rules(col) -> Column:
    """Command names for PATH probing."""
    c = _c(col)
    return F.array_compact(F.array(
        F.when(~c.rlike(SAFE_COMMAND_NAME), F.lit("characters")),
        F.when(F.length(c) > MAX_COMMAND_NAME_LENGTH, F.lit("too_long"))))


def placeholder_count(col) -> Column:
    """C11: occurrences of ``$@``."""
    return F.regexp_count(_c(col), F.lit(r"\$@"))


def path_reason(col) -> Column:
    """NULL when the output path is acceptable, else absolute / escape /
    hidden / protected, decided in the reference's order."""
    raw = _c(col)
    n = F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    absolute = (n.startswith("/") | raw.rlike(r"^[A-Za-z]:[/\\]") | raw.startswith("\\")
                | n.rlike(r"^[A-Za-z]:"))
    segs = F.filter(F.split(n, "/"), lambda s: F.length(s) > 0)
    seg_reason = F.transform(segs, lambda s: F.when(s == "..", F.lit("escape"))
                             .when(s.startswith("."), F.lit("hidden"))
                             .when(F.lower(F.split(s, r"\.").getItem(0)).isin(*DEVICE_NAMES), F.lit("protected")))
    first_bad = F.element_at(F.array_compact(seg_reason), 1)
    first = F.lower(F.element_at(segs, 1))
    return (F.when(raw.isNull() | (F.length(js_trim(raw)) == 0), F.lit("escape"))
            .when((n == "") | (n == "."), F.lit("escape"))
            .when(absolute, F.lit("absolute"))
            .when(F.size(F.array_compact(seg_reason)) > 0, first_bad)
            .when(first.isin(*PROTECTED_ROOTS), F.lit("protected")))


def command_tokens(col) -> Column:
    """C14: split on spaces outside quotes (quotes kept)."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_RE), 1)


def strip_outer_quotes(token: Column) -> Column:
    """Remove one matching pair of outer quotes."""
    first, last = F.substring(token, 1, 1), F.substring(token, -1, 1)
    pair = (F.length(token) >= 2) & (((first == "'") & (last == "'")) | ((first == '"') & (last == '"')))
    return F.when(pair, token.substr(F.lit(2), F.length(token) - 2)).otherwise(token)
