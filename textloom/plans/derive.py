"""Inputs derived from the generated tables, so that every registered query's
work grows with the tables. Each rule is a plain expression of the table's own
columns (mostly a key modulo n), and the oracle SQL derives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import read_table

# Hostile URLs from the reference's own URL tests, added to the
# crawled page URLs (ids below zero).
URL_CASES = [
    "http://127.0.0.1/secret",
    "http://localhost/secret",
    "http://169.254.169.254/",
    "http://2130706433/secret",
    "http://0x7f000001/secret",
    "http://0/secret",
    "http://2852039166/",
    "http://0x7f.0.0.1/secret",
    "https://example.com/article",
    "ftp://example.com/file",
    "not a url",
    "http://[::1]/",
    "http://metadata.google.internal/computeMetadata/v1/",
    "https://fda.gov/",
]

MODES = ["tldr", "actions", "linkedin", "technical"]


def hostile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    cases = spark.createDataFrame([(-(i + 1), u) for i, u in enumerate(URL_CASES)], "page_id long, url string")
    return pages.unionByName(cases)


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with category traits by doc_id % 5 (email header, unsubscribe,
    issue number, salutation, unchanged)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    k = F.col("doc_id") % 5
    text = (F.when(k == 0, F.concat(F.lit("From: a@b.c\n"), F.col("text")))
            .when(k == 1, F.concat(F.col("text"), F.lit(" Unsubscribe")))
            .when(k == 2, F.concat(F.col("text"), F.lit(" Issue #12")))
            .when(k == 3, F.concat(F.lit("Dear "), F.col("text")))
            .otherwise(F.col("text")))
    return d.withColumn("text", text)


def input_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a command line would give them: every page URL; every
    document as argument text, or piped with ``-`` when doc_id % 4 = 0."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("request_id"),
        F.array(F.col("url")).alias("args"), F.lit(None).cast("string").alias("piped"))
    docs = read_table(spark, sf_dir, "documents")
    pipe = F.col("doc_id") % 4 == 0
    d = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("request_id"),
                    F.when(pipe, F.array(F.lit("-"))).otherwise(F.array(F.col("text"))).alias("args"),
                    F.when(pipe, F.col("text")).alias("piped"))
    return pages.unionByName(d)


def doc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resolved as argument text: trimmed and bounded (as the
    reference resolves an argument), with their detected category."""
    from textloom.functions.text import bound_text, content_category, js_trim
    d = mixed_documents(spark, sf_dir)
    # Each stage is its own column, so the trimmed text is computed once and
    # referenced, not re-evaluated inside every branch of the bound.
    from textloom.functions.stage import pin
    out = (d.withColumn("_t", js_trim("text")).withColumn("content", bound_text("_t"))
           .withColumn("category", content_category(F.col("content"))).drop("text", "_t"))
    return pin(out, ["content", "category"])


def summary_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, mode): the mode of each document, by doc_id % 4. Reads identifiers only."""
    return mixed_documents(spark, sf_dir).select("doc_id", _mode())


def _mode() -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.col("doc_id") % 4 + 1).cast("int")).alias("mode")


def summary_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt variables per document: mode by doc_id % 4, an audience for
    every third, a word limit for every other."""
    d = doc_content(spark, sf_dir)
    return (d.withColumn("mode", _mode())
            .withColumn("audience", F.when(F.col("doc_id") % 3 == 0, F.lit("engineers")))
            .withColumn("max_length", F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 50 + 100).cast("int")))
            .withColumn("source_label", F.lit("argument")))


def bad_summary_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables with faults by rule: unknown mode (doc_id % 5 = 4), word
    limits from -2 to 4, empty audience (doc_id % 11 = 0), empty content
    (doc_id % 13 = 0)."""
    d = summary_variables(spark, sf_dir)
    k = F.col("doc_id")
    return (d.withColumn("mode", F.when(k % 5 == 4, F.lit("verbose")).otherwise(F.col("mode")))
            .withColumn("max_length", (k % 7 - 2).cast("int"))
            .withColumn("audience", F.when(k % 11 == 0, F.lit("")).otherwise(F.col("audience")))
            .withColumn("content", F.when(k % 13 == 0, F.lit("")).otherwise(F.col("content"))))


def patch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches from documents: staged or commit by doc_id % 2; ref by doc_id % 3
    (HEAD~1, none, main); extra instructions for doc_id % 5 = 0."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    return d.select(k.alias("patch_id"),
                    F.when(k % 2 == 0, F.lit("staged")).otherwise(F.lit("commit")).alias("kind"),
                    F.when(k % 3 == 0, F.lit("HEAD~1")).when(k % 3 == 2, F.lit("main")).alias("ref"),
                    F.col("text").alias("diff"),
                    F.when(k % 5 == 0, F.lit("Focus on security vulnerabilities")).alias("custom_prompt"))


def provider_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing requests from customers: explicit provider by c_custkey % 9
    (six known names, an upper-case name, an unknown name, none); environment
    default, key presence, hosts, base URLs and models by further key rules."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    names = F.array(*[F.lit(x) for x in ["openai", "anthropic", "ollama", "openrouter", "opencode", "mock",
                                         "OpenAI", "bogus"]])
    return c.select(
        k.alias("request_id"),
        F.try_element_at(names, (k % 9 + 1).cast("int")).alias("provider"),
        F.when(n % 5 == 0, F.lit("anthropic")).alias("default_provider"),
        (k % 11 == 0).alias("has_api_key"),
        (F.col("c_mktsegment") == "BUILDING").alias("has_generic_key"),
        (F.col("c_acctbal") > 5000).alias("has_openai_key"),
        (n % 2 == 0).alias("has_anthropic_key"),
        F.when(n % 3 == 0, F.lit("http://gpu-box:11434/")).alias("ollama_host"),
        (k % 4 == 0).alias("has_openrouter_key"),
        F.when(k % 10 == 0, F.lit("https://proxy.example.com/v1/")).alias("base_url"),
        F.when(k % 6 == 0, F.lit("custom-model")).alias("model"),
        F.when(k % 7 == 0, F.lit("env-model")).alias("env_model"),
        F.when(n % 4 == 0, F.lit("qwen2")).alias("ollama_model"))


TEMPERATURE_TEXTS = ["0", "2", "0.5", "hot", "Infinity", "0.5junk", "-1", "3", "", "--json", " 1.5 ", "0x1",
                     "1e0", "NaN", ".5"]


def meeting_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meeting requests from conversations (one per conversation): OpenRouter
    flag, base URL, key presence, model and temperature text by conv_id rules."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.col("conv_id")
    temps = F.array(*[F.lit(t) for t in TEMPERATURE_TEXTS])
    return c.select(
        k.alias("request_id"),
        (k % 4 == 1).alias("openrouter"),
        F.when(k % 5 == 2, F.lit("https://openrouter.ai/api/v1")).when(k % 5 == 3, F.lit("https://llm.example.com/v1"))
        .alias("base_url"),
        (k % 3 != 0).alias("has_openai_key"),
        (k % 2 == 0).alias("has_openrouter_key"),
        F.when(k % 6 == 0, F.lit("gpt-4.1")).alias("model"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.element_at(temps, (k % len(TEMPERATURE_TEXTS) + 1).cast("int")))
        .alias("temperature"))


WIRE_PROVIDERS = ["openai", "anthropic", "ollama"]
CHUNK_BYTES = 17


def conversation_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a streamed answer: pieces of at most 20 code
    points (newlines included), provider by conv_id % 3."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    names = F.array(*[F.lit(x) for x in WIRE_PROVIDERS])
    return (c.withColumn("provider", F.element_at(names, (F.col("conv_id") % 3 + 1).cast("int")))
            .withColumn("pieces", F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")),
                                                       F.lit("(?s).{1,20}"), 0)))


def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per wire line: (conv_id, turn, provider, seq, line, is_tail);
    every answer ends with its provider's end marker, which is the tail."""
    from textloom.operators.responses import END_MARKERS, to_wire_lines
    p = conversation_pieces(spark, sf_dir)
    body = (p.select("conv_id", "turn", "provider", F.posexplode("pieces").alias("seq", "delta"))
            .withColumn("line", to_wire_lines(None, F.col("provider")))
            .withColumn("is_tail", F.lit(False)).drop("delta"))
    marker = F.when(F.col("provider") == "openai", F.lit(END_MARKERS["openai"])) \
        .when(F.col("provider") == "anthropic", F.lit(END_MARKERS["anthropic"])) \
        .otherwise(F.lit(END_MARKERS["ollama"]))
    ends = p.select("conv_id", "turn", "provider", F.size("pieces").alias("seq"), marker.alias("line"),
                    F.lit(True).alias("is_tail"))
    return body.unionByName(ends)


def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's wire text (Anthropic lines preceded by SSE event lines),
    as UTF-8 bytes cut every 17 bytes, so lines and characters straddle
    chunks: (conv_id, turn, provider, chunk_no, bytes)."""
    from textloom.operators.responses import END_MARKERS, SSE_PREFIX
    p = conversation_pieces(spark, sf_dir)

    def wire(x):
        openai = F.concat(F.lit(SSE_PREFIX), F.to_json(F.struct(F.array(F.struct(
            F.struct(x.alias("content")).alias("delta"))).alias("choices"))))
        anthropic = F.concat(F.lit("event: content_block_delta\n" + SSE_PREFIX),
                             F.to_json(F.struct(F.lit("content_block_delta").alias("type"),
                                                F.struct(F.lit("text_delta").alias("type"),
                                                         x.alias("text")).alias("delta"))))
        ollama = F.to_json(F.struct(F.struct(F.lit("assistant").alias("role"), x.alias("content")).alias("message"),
                                    F.lit(False).alias("done")))
        return (F.when(F.col("provider") == "openai", openai).when(F.col("provider") == "anthropic", anthropic)
                .otherwise(ollama))
    marker = F.when(F.col("provider") == "openai", F.lit(END_MARKERS["openai"])) \
        .when(F.col("provider") == "anthropic", F.lit(END_MARKERS["anthropic"])) \
        .otherwise(F.lit(END_MARKERS["ollama"]))
    full = F.concat(F.array_join(F.transform("pieces", wire), "\n"),
                    F.when(F.size("pieces") > 0, F.lit("\n")).otherwise(F.lit("")), marker)
    b = p.select("conv_id", "turn", "provider", F.encode(full, "UTF-8").alias("_b"))
    n = F.ceil(F.octet_length("_b") / CHUNK_BYTES).cast("int")
    return (b.select("conv_id", "turn", "provider", "_b",
                     F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("chunk_no"))
            .select("conv_id", "turn", "provider", "chunk_no",
                    F.substring("_b", F.col("chunk_no") * CHUNK_BYTES + 1, CHUNK_BYTES).alias("bytes")))


def _wrap_answer(json_text, k):
    """An answer around a JSON text by k = id % 6: plain, fenced, in prose,
    prose with braces first, truncated, none."""
    return (F.when(k == 0, json_text)
            .when(k == 1, F.concat(F.lit("```json\n"), json_text, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Here is the summary: "), json_text, F.lit(" Hope this helps.")))
            .when(k == 3, F.concat(F.lit("Use {braces} carefully. "), json_text))
            .when(k == 4, json_text.substr(F.lit(1), F.length(json_text) - 5))
            .otherwise(F.lit("I cannot summarize this.")))


def summary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Summary answer per document, built from the document and its label
    (importance from quality; an action item when toxic), wrapped by
    doc_id % 6. Some carry faults by rule: no title (doc_id % 4 = 0), empty
    summary (doc_id % 17 = 0), unknown category (doc_id % 7 = 0)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id")
    cats = F.array(*[F.lit(x) for x in ["article", "email", "newsletter", "unknown"]])
    obj = F.struct(
        F.when(k % 4 != 0, F.concat(F.lit("Doc "), k.cast("string"))).alias("title"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("summary"),
        F.array(F.col("lang"), F.col("source")).alias("key_points"),
        F.when(F.col("toxic") == 1, F.array(F.lit("Review flagged content"))).otherwise(F.array().cast("array<string>"))
        .alias("action_items"),
        F.when(k % 7 == 0, F.lit("memo")).otherwise(F.element_at(cats, (k % 4 + 1).cast("int"))).alias("category"),
        F.when(F.col("quality") == 1, F.lit("high")).when(F.col("quality") == 0, F.lit("low"))
        .otherwise(F.lit("medium")).alias("importance"))
    j = d.join(lab, "doc_id", "left").select(k.alias("doc_id"), F.to_json(obj).alias("_j"))
    return j.select("doc_id", _wrap_answer(F.col("_j"), k % 6).alias("raw"))


def class_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification answer per document: class by doc_id % 6, confidence
    (doc_id % 12) / 10 (so some exceed 1), fenced when doc_id is even."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    k = F.col("doc_id")
    cats = F.array(*[F.lit(x) for x in ["article", "meeting", "git-diff", "email", "code", "unknown"]])
    obj = F.to_json(F.struct(F.element_at(cats, (k % 6 + 1).cast("int")).alias("category"),
                             ((k % 12) / 10.0).cast("double").alias("confidence"),
                             F.concat(F.lit("lang "), F.col("lang")).alias("reason")))
    raw = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(obj)
    return d.select("doc_id", raw.alias("raw"))


def meeting_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting answer per conversation: action items from assistant turns
    (owner = role, task = the turn's text, due = "turn <n>"), a risk for
    even ids. Refusal for conv_id % 7 = 3, parsed output for conv_id % 3 = 0,
    otherwise content; content cut short for conv_id % 5 = 4, absent for
    conv_id % 11 = 5, a numeric risk for conv_id % 13 = 6."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    items = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct(
        F.col("turn").alias("turn"), F.col("role").alias("owner"), F.col("text").alias("task"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("due")))))
    first = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.col("text"))))
    g = c.groupBy("conv_id").agg(items.alias("_items"), first.alias("_turns"))
    k = F.col("conv_id")
    obj = F.to_json(F.struct(
        F.element_at(F.col("_turns"), 1)["text"].alias("summary"),
        F.transform("_items", lambda s: F.struct(s["owner"].alias("owner"), s["task"].alias("task"),
                                                 s["due"].alias("due"))).alias("action_items"),
        F.when(k % 13 == 6, F.array(F.lit("1")))
        .when(k % 2 == 0, F.array(F.lit("Scope creep"))).otherwise(F.array().cast("array<string>")).alias("risks")))
    obj = F.when(k % 13 == 6, F.regexp_replace(obj, r'"risks":\["1"\]', '"risks":[1]')).otherwise(obj)
    c2 = g.select(k.alias("conv_id"), obj.alias("_c"))
    body = F.col("_c")
    return c2.select(
        "conv_id",
        F.when(k % 7 == 3, F.lit("I cannot help with that.")).alias("refusal"),
        F.when((k % 7 != 3) & (k % 3 == 0), body).alias("parsed"),
        F.when((k % 7 == 3) | (k % 3 == 0) | (k % 11 == 5), F.lit(None).cast("string"))
        .when(k % 5 == 4, body.substr(F.lit(1), F.length(body) - 3)).otherwise(body).alias("content"))


def tool_catalogues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Configured and detected tools per configuration (one per nation):
    configured = suppliers with even keys; detected = all suppliers, names
    upper-cased (or replaced for keys divisible by 3), commands in upper case
    rounded down to a multiple of 4 so some match only by command."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    configured = s.where(k % 2 == 0).select(F.col("s_nationkey").alias("config_id"), k.alias("ord"),
                                            F.col("s_name").alias("name"),
                                            F.concat(F.lit("run "), k.cast("string")).alias("command"))
    detected = s.select(F.col("s_nationkey").alias("config_id"), k.alias("ord"),
                        F.when(k % 3 == 0, F.concat(F.lit("det-"), k.cast("string"))).otherwise(F.upper("s_name"))
                        .alias("name"),
                        F.concat(F.lit("RUN "), (k - k % 4).cast("string")).alias("command"))
    return configured, detected


def template_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing templates per configuration (p_partkey / 20): summary, meeting
    and review entries by p_partkey % 6 (old command words for some), the
    rest named after the part."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    k = F.col("p_partkey")
    name = (F.when(k % 6 == 0, F.lit("summary")).when(k % 6 == 1, F.lit("meeting"))
            .when(k % 6 == 2, F.lit("review")).otherwise(F.col("p_name")))
    command = (F.when(k % 6 == 0, F.when(k % 12 == 0, F.lit("  ai-summary --mode tldr $@"))
                      .otherwise(F.lit("ai summary --mode tldr $@")))
               .when(k % 6 == 1, F.when(k % 4 == 1, F.lit("ai-meeting notes.md")).otherwise(F.lit("ai-meetingx notes.md")))
               .otherwise(F.concat(F.lit("echo "), F.col("p_name"))))
    return p.select((k / 20).cast("bigint").alias("config_id"), k.alias("ord"), name.alias("name"),
                    command.alias("command"), F.col("p_type").alias("description"),
                    F.array(F.col("p_brand")).alias("aliases"))


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration JSON documents of ten suppliers as tools (s_suppkey / 10) and a
    hundred parts as templates (p_partkey / 100): more rows make more
    documents, not longer ones. Faults by key rules (blank
    names and commands, unsafe commands, placeholders, a numeric description,
    a numeric alias)."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    k = F.col("s_suppkey")
    tool = F.to_json(F.struct(
        F.when(k % 10 == 3, F.lit("")).otherwise(F.col("s_name")).alias("name"),
        F.when(k % 5 == 0, F.lit("tool;rm")).when(k % 5 == 1, F.lit("  "))
        .otherwise(F.concat(F.lit("run-"), k.cast("string"))).alias("command"),
        F.when(k % 7 == 0, F.lit("__NUM__")).otherwise(F.lit("supplier")).alias("description"),
        F.array(F.when(k % 11 == 0, F.lit("__NUM__")).otherwise(F.concat(F.lit("s"), k.cast("string"))))
        .alias("aliases")))
    tool = F.replace(tool, F.lit('"__NUM__"'), F.lit("7"))
    tools = (s.groupBy(F.floor(k / 10).cast("bigint").alias("config_id"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, tool.alias("j")))),
                                           lambda x: x["j"]), ",").alias("tools")))
    q = F.col("p_partkey")
    temp = F.to_json(F.struct(
        F.col("p_name").alias("name"),
        F.when(q % 6 == 0, F.lit("$@ run")).when(q % 6 == 1, F.lit("a $@ b $@")).when(q % 6 == 2, F.lit("rm -rf /"))
        .when(q % 6 == 3, F.lit("")).otherwise(F.concat(F.lit("echo "), F.col("p_name"), F.lit(" $@"))).alias("command"),
        F.when(q % 9 == 0, F.lit("")).otherwise(F.col("p_type")).alias("description"),
        F.array(F.col("p_brand")).alias("aliases")))
    temps = (p.groupBy(F.floor(q / 100).cast("bigint").alias("config_id"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(q, temp.alias("j")))),
                                           lambda x: x["j"]), ",").alias("templates")))
    both = tools.join(temps, "config_id", "full")
    return both.select("config_id",
                       F.concat(F.lit('{"tools":['), F.coalesce("tools", F.lit("")), F.lit('],"templates":['),
                                F.coalesce("templates", F.lit("")), F.lit("]}")).alias("config_json"),
                       F.concat(F.lit("configs/"), F.col("config_id").cast("string"), F.lit(".json")).alias("source"))


def status_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CCS status table for every ten suppliers (s_suppkey / 10): box tables, box
    tables with colour codes, or pipe tables by table number % 3; a profile is [OK]
    unless its key is divisible by 3."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    log = F.floor(F.col("s_suppkey") / 10).cast("bigint")
    n = log % 3
    name = F.lower(F.col("s_name"))
    status = F.when(F.col("s_suppkey") % 3 == 0, F.lit("[!]")).otherwise(F.lit("[OK]"))
    bar = F.when(n == 1, F.lit("\x1b[90m│\x1b[39m")).when(n == 0, F.lit("│")).otherwise(F.lit("|"))
    row = F.concat(bar, F.lit(" "), name, F.lit(" "), bar, F.lit(" ~/.ccs/"), name, F.lit(".settings "), bar,
                   F.lit(" "), status, F.lit(" "), bar)
    g = s.groupBy(log.alias("log_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))),
                                 lambda x: x["r"]), "\n").alias("rows"),
        F.first(n).alias("style"))
    b = F.when(F.col("style") == 1, F.lit("\x1b[90m│\x1b[39m")).when(F.col("style") == 0, F.lit("│")).otherwise(F.lit("|"))
    header = F.concat(b, F.lit(" API "), b, F.lit(" Config "), b, F.lit(" Status "), b)
    return g.select("log_id", F.concat(F.lit("CCS API Profiles\n\n"), header, F.lit("\n"), F.col("rows"),
                                       F.lit("\n\nTotal: profiles\n")).alias("text"))


def part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items: the distinct part names, in order of first part key,
    with the first part's type as description and the word initials as alias."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    g = p.groupBy("p_name").agg(F.min("p_partkey").alias("ord"), F.min_by("p_type", "p_partkey").alias("description"))
    initials = F.array_join(F.transform(F.split("p_name", " "), lambda w: w.substr(1, 1)), "")
    return g.select("ord", F.col("p_name").alias("name"), "description", F.array(initials).alias("aliases"),
                    F.concat(F.lit("run-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("command"),
                    F.lit(None).cast("string").alias("prompt_command"),
                    F.lit(None).cast("boolean").alias("prompt_use_stdin"))


def misspelt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per part by p_partkey % 7: exact, upper case, last four
    characters, a letter dropped, two neighbours swapped, an inner substring,
    the initials (or an unrelated word when p_partkey % 14 = 6)."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = F.expr("""CASE p_partkey % 7
        WHEN 0 THEN p_name
        WHEN 1 THEN upper(p_name)
        WHEN 2 THEN substring(p_name, length(p_name) - 3)
        WHEN 3 THEN concat(substring(p_name, 1, CAST(p_partkey % length(p_name) AS INT)),
                           substring(p_name, CAST(p_partkey % length(p_name) AS INT) + 2))
        WHEN 4 THEN concat(substring(p_name, 1, CAST(p_partkey % (length(p_name) - 1) AS INT)),
                           substring(p_name, CAST(p_partkey % (length(p_name) - 1) AS INT) + 2, 1),
                           substring(p_name, CAST(p_partkey % (length(p_name) - 1) AS INT) + 1, 1),
                           substring(p_name, CAST(p_partkey % (length(p_name) - 1) AS INT) + 3))
        WHEN 5 THEN substring(p_name, 2, 5)
        ELSE CASE WHEN p_partkey % 14 = 6 THEN 'xyzzy'
             ELSE array_join(transform(split(p_name, ' '), w -> substring(w, 1, 1)), '') END END""")
    return p.select(F.col("p_partkey").alias("query_id"), q.alias("query"))


# Whatever is no ASCII letter, or neither that nor a space. Java scans the named class many times faster than [^A-Za-z ].
NOT_LETTERS, NOT_LETTERS_OR_SPACE = r"[^\p{Alpha}]+", r"[^\p{Alpha} ]"
UNSAFE_MARKS = [" && ls", " || true", "; rm x", " $(whoami)", " `whoami`", " sudo ls", " rm -rf /tmp", " > /dev/null", ""]


def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in pieces, split at full stops and line ends: doc_id,
    piece (from 0), text. Every character but the separators is in a piece."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(F.split("text", r"[.\n]", -1)).alias("piece", "text"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its files have fewer row groups than there are cores (a small table); else as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands from the pieces of documents: ASCII letters and
    spaces only, with an unsafe mark chosen by doc_id % 9 (none for 8)."""
    d = text_pieces(spark, sf_dir)
    marks = F.array(*[F.lit(m) for m in UNSAFE_MARKS])
    base = F.regexp_replace("text", NOT_LETTERS_OR_SPACE, "")
    return d.select("doc_id", "piece", F.concat(base, F.element_at(marks, (F.col("doc_id") % 9 + 1).cast("int"))).alias("command"))


def _words(joint: str) -> Column:
    """The ASCII words of a text with ``joint`` for whatever is between them."""
    return F.regexp_replace("text", NOT_LETTERS, joint)


def argument_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument lists: the words of each piece plus one more by
    doc_id % 5 (';', 'a|b', 201 x's, 'ok-arg', none)."""
    d = text_pieces(spark, sf_dir)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    k = F.col("doc_id") % 5
    extra = (F.when(k == 0, F.array(F.lit(";"))).when(k == 1, F.array(F.lit("a|b")))
             .when(k == 2, F.array(F.lit("x" * 201))).when(k == 3, F.array(F.lit("ok-arg")))
             .otherwise(F.array().cast("array<string>")))
    return d.select("doc_id", "piece", F.concat(words, extra).alias("args"))


def path_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output paths by doc_id % 10 around the ASCII words of each piece, one path segment a word."""
    d = text_pieces(spark, sf_dir)
    w = _words("/")
    k = F.col("doc_id") % 10
    path = (F.when(k == 0, F.concat(F.lit("out/"), w, F.lit(".md"))).when(k == 1, F.concat(F.lit("./"), w, F.lit(".md")))
            .when(k == 2, F.concat(F.lit("/tmp/"), w)).when(k == 3, F.concat(F.lit("C:/"), w))
            .when(k == 4, F.concat(F.lit("docs/."), w)).when(k == 5, F.concat(F.lit("../"), w))
            .when(k == 6, F.concat(F.lit("etc/"), w)).when(k == 7, F.concat(F.lit("con."), w))
            .when(k == 8, F.concat(F.lit("a\\..\\"), w)).otherwise(F.lit("   ")))
    return d.select("doc_id", "piece", path.alias("path"))


def ref_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs by doc_id % 6 around the ASCII words of each piece."""
    d = text_pieces(spark, sf_dir)
    w = _words("-")
    k = F.col("doc_id") % 6
    ref = (F.when(k == 0, F.concat(F.lit("HEAD~"), (F.col("doc_id") % 5).cast("string")))
           .when(k == 1, F.concat(F.lit("origin/"), w)).when(k == 2, F.lit("main;rm"))
           .when(k == 3, F.lit("-rf")).when(k == 4, F.lit("a..b")).otherwise(F.concat(w, F.lit("@{1}"))))
    return d.select("doc_id", "piece", ref.alias("ref"))


def quoted_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template-like commands with quoted prompts from the ASCII words of each piece."""
    d = text_pieces(spark, sf_dir)
    words = F.regexp_replace("text", NOT_LETTERS_OR_SPACE, "")
    k = F.col("doc_id") % 4
    prompt = (F.when(k == 0, F.concat(F.lit("'"), words, F.lit("'")))
              .when(k == 1, F.concat(F.lit('"'), words, F.lit(' $@"')))
              .when(k == 2, F.concat(F.lit("'"), words)).otherwise(words))
    return d.select("doc_id", "piece", F.concat(F.lit("tool"), (F.col("doc_id") % 3).cast("string"), F.lit(" -p "), prompt)
                    .alias("command"))


# Template commands for the expansion job (the nine defaults'
# commands are taken from the default catalogue; these add the reference's
# test shapes).
EXTRA_TEMPLATES = ["fake-ai --mode plan", "fake-ai -x 'Review: $@'", 'amp -x "Explain: $@"', "$@",
                   "claude -p 'Review $@ and $@'"]


def template_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launch requests from documents: template by doc_id % 14; arguments are
    the ASCII words of a piece unless doc_id % 3 = 0; the piece is piped
    text when doc_id is even. One request per piece."""
    from textloom.operators.catalogue import DEFAULT_TEMPLATES
    commands = [c for _, c, _, _ in DEFAULT_TEMPLATES] + EXTRA_TEMPLATES
    d = text_pieces(spark, sf_dir)
    k = F.col("doc_id")
    words = F.filter(F.split(F.regexp_replace("text", NOT_LETTERS_OR_SPACE, ""), " "), lambda w: w != "")
    arr = F.array(*[F.lit(c) for c in commands])
    return d.select("doc_id", "piece", (k % len(commands)).cast("int").alias("template_idx"),
                    F.element_at(arr, (k % len(commands) + 1).cast("int")).alias("command"),
                    F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(words).alias("args"),
                    F.when(k % 2 == 0, F.col("text")).alias("piped"))


def crawl_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl log from pages: each page redirects (302) to the next page while
    page_id % 8 <> 0; every 50th points to a private address; for
    page_id % 5 = 4 the target is scheme-relative. Some pages were fetched twice, with
    another outcome: a failure (page_id % 10 = 5) or another target (page_id % 10 = 1)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    j = p.join(nxt, "page_id", "left")
    k = F.col("page_id")
    redirect = (k % 8 != 0)
    location = (F.when(k % 50 == 49, F.lit("http://10.0.0.1/"))
                .when(k % 5 == 4, F.regexp_replace(F.col("next_url"), "^[A-Za-z]+:", ""))
                .otherwise(F.col("next_url")))
    once = j.select("page_id", "url", F.when(redirect, F.lit(302)).otherwise(F.lit(200)).alias("status"),
                    F.when(redirect, location).alias("location"))
    failed = p.where(k % 10 == 5).select("page_id", "url", F.lit(500).alias("status"), F.lit(None).cast("string").alias("location"))
    other = p.where(k % 10 == 1).select("page_id", "url", F.lit(302).alias("status"), F.lit("zz:other").alias("location"))
    return once.unionByName(failed).unionByName(other)


def installed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command names found per configuration (nation): a known tool's command
    by s_suppkey % 25, 'ccs' for 23, an invalid name for 24."""
    from textloom.operators.catalogue import KNOWN_TOOLS
    names = [c for _, c, *_ in KNOWN_TOOLS] + ["ccs", "bad;name"]
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    arr = F.array(*[F.lit(n) for n in names])
    return s.select(F.col("s_nationkey").cast("bigint").alias("config_id"),
                    F.element_at(arr, (F.col("s_suppkey") % len(names) + 1).cast("int")).alias("command_name"))
