"""Catalogue merge, template defaults, lint, status rows, routing, prompts, sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from textloom.operators import catalogue as C
from textloom.operators.prompts import EXTRACT_MEETING, SUMMARIZE
from textloom.operators.routing import meeting_route, mock_responses, providers_table, route_requests
from textloom.sources.sinks import check_output_path, write_requests

def box(rows, widths=(9, 22, 7)):
    """A table drawn with box lines, from rows of cells."""
    line = lambda left, cross, right: left + cross.join("─" * (w + 2) for w in widths) + right
    body = ["│" + "│".join(f" {cell:<{w}} " for cell, w in zip(row, widths)) + "│" for row in rows]
    return "\n".join([line("┌", "┬", "┐"), body[0], *(x for r in body[1:] for x in (line("├", "┼", "┤"), r)), line("└", "┴", "┘")])


HEAD = ("API", "Config", "Status")
DRAWN = box([HEAD, ("alpha-1", "~/.ccs/alpha-1.json", "[OK]"), ("beta", "~/.ccs/beta.json", "[!]"), ("g.d", "~/.ccs/g.d.json", "[OK]")])
COLOURED = DRAWN.replace("│", "\x1b[36m│\x1b[0m").replace("beta", "zeta")
PIPED = "|API|Config|Status|\n|:--|---|--:|\n| one_1 | a | [!] |\n|two|b|[OK]|\n| three | c | [OK] |"


def test_status_rows(spark):
    logs = spark.createDataFrame([(1, "Profiles\n\n" + DRAWN + "\n"), (2, COLOURED), (3, PIPED), (4, ""), (5, "nothing\nlike a table"), (6, None)], "log_id int, text string")
    got = {}
    for r in C.status_rows(logs).orderBy("log_id", "line_no").collect():
        got.setdefault(r["log_id"], []).append(r["profile"])
    assert got == {1: ["alpha-1", "g.d"], 2: ["alpha-1", "g.d"], 3: ["two", "three"]}


def test_merge_and_defaults(spark):
    cfg = spark.createDataFrame([(1, 0, "Claude", "claude"), (1, 1, "mine", "my-tool")],
                                "config_id int, ord int, name string, command string")
    det = spark.createDataFrame([(1, 0, "claude", "x"), (1, 1, "other", "MY-TOOL"), (1, 2, "new", "new")],
                                "config_id int, ord int, name string, command string")
    m = C.catalogue_merge(cfg, det).orderBy("origin", "ord").collect()
    assert [(r["origin"], r["name"]) for r in m] == [("config", "Claude"), ("config", "mine"), ("detected", "new")]
    ex = spark.createDataFrame([(1, 0, "summary", "  ai-summary --mode tldr $@", "d", []),
                                (1, 1, "meeting", "ai-meetingx", "d", []),
                                (1, 2, "summary", "  ai-summary x", "later", [])],
                               "config_id int, ord int, name string, command string, description string, aliases array<string>")
    t = {r["name"]: r for r in C.template_defaults(ex).collect()}
    assert t["summary"]["command"] == "ai summary x" and t["summary"]["pos"] == 0 and t["summary"]["changed"]
    assert t["meeting"]["command"] == "ai-meetingx"
    assert set(t) >= {n for n, _, _, _ in C.DEFAULT_TEMPLATES}


def test_lint(spark):
    doc = json.dumps({"tools": [{"name": "", "command": "bad;cmd", "description": 5, "aliases": [1]}],
                      "templates": [{"name": "t", "command": "$@ x", "description": "d"},
                                    {"name": "u", "command": "a $@ $@", "description": ""}]})
    df = spark.createDataFrame([(1, doc), (2, '{"tools": []}')], "config_id int, config_json string")
    got = [(r["config_id"], r["path"], r["message"]) for r in C.lint_configs(df).orderBy("config_id", "seq").collect()]
    assert got == [
        (1, "tools[0].name", C.MSG["tool_name"]), (1, "tools[0].command", C.MSG["tool_unsafe"]),
        (1, "tools[0].description", C.MSG["tool_description"]), (1, "tools[0].aliases", C.MSG["aliases_strings"]),
        (1, "templates[0].command", C.MSG["template_leading"]), (1, "templates[1].command", C.MSG["template_many"]),
        (1, "templates[1].description", C.MSG["template_description"]), (2, "templates", C.MSG["templates_array"])]


def test_routing(spark):
    cols = ("request_id int, provider string, default_provider string, has_api_key boolean, has_generic_key boolean, "
            "has_openai_key boolean, has_anthropic_key boolean, ollama_host string, has_openrouter_key boolean, "
            "base_url string, model string, env_model string, ollama_model string")
    rows = [(1, "mock", None, False, False, False, False, None, False, None, None, None, None),
            (2, "openai", None, True, False, False, False, None, False, "https://x/v1/", None, None, None),
            (3, "anthropic", None, False, False, False, False, None, False, None, None, None, None),
            (4, "ollama", None, False, False, False, False, None, False, None, None, None, None),
            (5, "unknown", None, False, False, False, False, None, False, None, None, None, None),
            (6, None, None, False, False, False, False, None, False, None, None, None, None),
            (7, None, None, False, False, False, True, None, False, None, None, None, None)]
    out = {r["request_id"]: r for r in route_requests(spark.createDataFrame(rows, cols), providers_table(spark)).collect()}
    assert out[1]["ok"] and out[2]["endpoint"] == "https://x/v1/chat/completions"
    assert out[2]["resolved_model"] == "gpt-4o-mini"
    assert out[3]["reason"].startswith("Anthropic provider requires an API key")
    assert out[4]["endpoint"] == "http://localhost:11434/api/chat" and out[4]["resolved_model"] == "llama3.1"
    assert out[5]["reason"] == "Unknown provider: unknown"
    assert out[6]["reason"].startswith("No provider configured")
    assert out[7]["route"] == "anthropic" and out[7]["ok"]


def test_meeting_route(spark):
    rows = [(1, False, None, True, False, None, "0"), (2, False, None, True, False, None, "2"),
            (3, False, None, True, False, None, "hot"), (4, False, None, True, False, None, "Infinity"),
            (5, False, None, True, False, None, "-1"), (6, True, None, True, False, None, None),
            (7, False, "https://openrouter.ai/api/v1", False, False, None, None), (8, False, None, False, False, None, None)]
    df = spark.createDataFrame(rows, "request_id int, openrouter boolean, base_url string, has_openai_key boolean, "
                                     "has_openrouter_key boolean, model string, temperature string")
    out = {r["request_id"]: r for r in meeting_route(df).collect()}
    assert out[1]["ok"] and out[2]["ok"] and out[2]["resolved_temperature"] == 2.0
    assert out[3]["reason"] == "--temperature must be a finite number" == out[4]["reason"]
    assert out[5]["reason"] == "--temperature must be between 0 and 2"
    assert out[6]["reason"] == "OPENROUTER_API_KEY is not set."
    assert out[7]["reason"] == "OPENAI_API_KEY or OPENROUTER_API_KEY is not set."
    assert out[8]["reason"] == "OPENAI_API_KEY is not set."


def test_prompts(spark):
    df = spark.createDataFrame([("Bun released a faster test runner.", "technical", 100, "TypeScript developers"),
                                ("", "tldr", None, None)], "content string, mode string, n int, aud string")
    out = SUMMARIZE.render(df, content="content", mode="mode", maxLength="n", audience="aud").collect()
    assert "technical:" in out[0]["user"] and "Write for TypeScript developers." in out[0]["user"]
    assert "within 100 words" in out[0]["user"] and "summarization assistant" in out[0]["system"]
    assert out[1]["reason"] == 'Validation failed for prompt "summarize-content": content: content is required'
    m = EXTRACT_MEETING.render(spark.createDataFrame([("Alex will ship on Friday.",)], "t string"), transcript="t")
    assert m.first()["user"] == 'Transcript:\n"""\nAlex will ship on Friday.\n"""'


def test_mock_and_sinks(spark):
    pieces = mock_responses(spark.createDataFrame([(1,)], "rid int"), "rid").orderBy("seq").collect()
    assert all(len(p["delta"]) <= 20 for p in pieces)
    assert json.loads("".join(p["delta"] for p in pieces))["title"] == "Mock Summary"
    assert check_output_path(spark, "out/report.md") is None
    assert check_output_path(spark, "/etc/passwd") == "absolute"
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-sink-"), "req")
    write_requests(spark.createDataFrame([("openai", "{}"), ("anthropic", "{}")], "provider string, body string"), target)
    assert sorted(d for d in os.listdir(target) if d.startswith("provider=")) == ["provider=anthropic", "provider=openai"]
