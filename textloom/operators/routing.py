"""Provider routing and request bodies.

Routing is a ``coalesce``/``when`` chain over the request's columns plus a
broadcast join to the fixed six-row provider table; request bodies are
``to_json(struct(...))`` per provider. Secrets never enter a table: a request
carries only whether each key is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import JS_WS, js_trim

# ---------------------------------------------------------------------------
# Provider defaults, messages and the mock answer of the
# reference.
# ---------------------------------------------------------------------------
PROVIDERS = [
    # provider, default model, default base URL, path, key message (NULL: no key needed)
    ("openai", "gpt-4o-mini", "https://api.openai.com/v1", "/chat/completions",
     "OpenAI provider requires an API key. Set AI_SUMMARY_API_KEY or OPENAI_API_KEY."),
    ("anthropic", "claude-3-5-haiku-20241022", "https://api.anthropic.com/v1", "/messages",
     "Anthropic provider requires an API key. Set AI_SUMMARY_API_KEY or ANTHROPIC_API_KEY."),
    ("ollama", "llama3.1", "http://localhost:11434", "/api/chat", None),
    ("openrouter", "openrouter/free", "https://openrouter.ai/api/v1", "/chat/completions",
     "OpenRouter provider requires an API key. Set AI_SUMMARY_API_KEY or OPENROUTER_API_KEY."),
    ("opencode", "opencode/big-pickle", None, None, None),
    ("mock", None, None, None, None),
]
NO_PROVIDER = ("No provider configured. Set AI_SUMMARY_PROVIDER, or set an API key for the provider you "
               "want to use.")
TEMPERATURE = 0.1
ANTHROPIC_MAX_TOKENS = 2048

MEETING_DEFAULT_MODEL = "gpt-4o-2024-08-06"
MEETING_OPENROUTER_MODEL = "openrouter/free"
MEETING_OPENROUTER_BASE = "https://openrouter.ai/api/v1"
MEETING_MIN_TEMPERATURE = 0.0
MEETING_MAX_TEMPERATURE = 2.0

MOCK_RESPONSE = ('{"title":"Mock Summary","summary":"This is a mock summary generated because '
                 'AI_SUMMARY_PROVIDER is set to mock.","key_points":["Mock key point one","Mock key point two"],'
                 '"action_items":["Mock action item one"],"category":"article","importance":"low"}')
MOCK_PIECE = 20


def providers_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "provider string, default_model string, default_base_url string, "
                                            "path string, key_message string")


def _nz(c: Column) -> Column:
    """JavaScript truthiness for an optional string: NULL and '' are absent."""
    return F.when(F.length(c) > 0, c)


def route_requests(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Choose the provider, its model, base URL and endpoint.

    Request columns: provider, default_provider (the environment default),
    has_api_key (explicit key), has_generic_key, has_openai_key,
    has_anthropic_key, ollama_host, has_openrouter_key, base_url, model,
    env_model, ollama_model. ``providers`` is the six-row table above; it is
    broadcast (its size is fixed by the code, not the data).
    """
    def flag(name):
        return F.coalesce(F.col(name), F.lit(False))
    inferred = F.coalesce(
        _nz(F.col("provider")), _nz(F.col("default_provider")),
        F.when(flag("has_api_key") | flag("has_generic_key") | flag("has_openai_key"), F.lit("openai")),
        F.when(flag("has_anthropic_key"), F.lit("anthropic")),
        F.when(F.length(F.col("ollama_host")) > 0, F.lit("ollama")),
        F.when(flag("has_openrouter_key"), F.lit("openrouter")))
    df = requests.withColumn("route", F.lower(inferred))
    p = F.broadcast(providers.withColumnRenamed("provider", "_p"))
    df = df.join(p, F.col("route") == F.col("_p"), "left")
    key = (F.when(F.col("route") == "openai", flag("has_api_key") | flag("has_generic_key") | flag("has_openai_key"))
           .when(F.col("route") == "anthropic",
                 flag("has_api_key") | flag("has_generic_key") | flag("has_anthropic_key"))
           .when(F.col("route") == "openrouter",
                 flag("has_api_key") | flag("has_generic_key") | flag("has_openrouter_key"))
           .otherwise(F.lit(True)))
    reason = (F.when(F.col("route").isNull(), F.lit(NO_PROVIDER))
              .when(F.col("_p").isNull(), F.concat(F.lit("Unknown provider: "), F.col("route")))
              .when(~key, F.col("key_message")))
    base = F.coalesce(F.col("base_url"), F.when(F.col("route") == "ollama", F.col("ollama_host")),
                      F.col("default_base_url"))
    base = F.regexp_replace(base, "/$", "")
    model = (F.when(F.col("route") == "ollama", F.coalesce(F.col("model"), F.col("ollama_model"),
                                                           F.col("default_model")))
             .when(F.col("route") == "mock", F.lit(None))
             .otherwise(F.coalesce(F.col("model"), F.col("env_model"), F.col("default_model"))))
    ok = reason.isNull()
    return (df.withColumn("reason", reason).withColumn("ok", ok)
            .withColumn("resolved_model", F.when(ok, model))
            .withColumn("resolved_base_url", F.when(ok & F.col("path").isNotNull(), base))
            .withColumn("endpoint", F.when(ok & F.col("path").isNotNull(), F.concat(base, F.col("path"))))
            .drop("_p", "default_model", "default_base_url", "path", "key_message"))


def request_body(provider: Column, model: Column, system: Column, user: Column,
                 temperature: Column | None = None) -> Column:
    """The body each provider is sent (JSON text; opencode gets the
    messages joined by a blank line on stdin)."""
    if temperature is None:
        temperature = F.lit(TEMPERATURE)
    sys_msg = F.struct(F.lit("system").alias("role"), system.alias("content"))
    user_msg = F.struct(F.lit("user").alias("role"), user.alias("content"))
    chat = F.to_json(F.struct(model.alias("model"), F.array(sys_msg, user_msg).alias("messages"),
                              temperature.alias("temperature"), F.lit(True).alias("stream"),
                              F.struct(F.lit("json_object").alias("type")).alias("response_format")))
    anthropic = F.to_json(F.struct(model.alias("model"), system.alias("system"),
                                   F.array(user_msg).alias("messages"), temperature.alias("temperature"),
                                   F.lit(ANTHROPIC_MAX_TOKENS).alias("max_tokens"), F.lit(True).alias("stream")))
    ollama = F.to_json(F.struct(model.alias("model"), F.array(sys_msg, user_msg).alias("messages"),
                                F.lit(True).alias("stream"), F.lit("json").alias("format"),
                                F.struct(temperature.alias("temperature")).alias("options")))
    opencode = F.concat_ws("\n\n", system, user)
    return (F.when(provider.isin("openai", "openrouter"), chat)
            .when(provider == "anthropic", anthropic)
            .when(provider == "ollama", ollama)
            .when(provider == "opencode", opencode))


# JavaScript Number(): decimal (with optional sign, exponent, Infinity) or
# 0x/0o/0b integers; surrounding JavaScript whitespace ignored.
JS_DECIMAL = r"^[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"


def _radix(t: Column, base: int, exact: int) -> Column:
    """Digits after a two-character prefix as a double: the first ``exact`` significant ones, scaled by the rest."""
    digits = F.ltrim(F.substr(t, F.lit(3)), F.lit("0"))
    head = F.conv(F.substr(digits, F.lit(1), F.lit(exact)), base, 10).try_cast("double")
    return F.when(digits == "", F.lit(0.0)).otherwise(head * F.pow(F.lit(float(base)), F.greatest(F.length(digits) - exact, F.lit(0))))


def js_number(col: Column) -> Column:
    """JavaScript ``Number(text)`` as a double (NaN when not a number)."""
    t = js_trim(col)
    return (F.when(t == "", F.lit(0.0))
            .when(t.rlike(r"^[+]?Infinity$"), F.lit(float("inf")))
            .when(t == "-Infinity", F.lit(float("-inf")))
            .when(t.rlike(JS_DECIMAL), t.try_cast("double"))
            .when(t.rlike(r"^0[xX][0-9a-fA-F]+$"), _radix(t, 16, 15))
            .when(t.rlike(r"^0[oO][0-7]+$"), _radix(t, 8, 20))
            .when(t.rlike(r"^0[bB][01]+$"), _radix(t, 2, 60))
            .otherwise(F.lit(float("nan"))))


def temperature_check(col: Column) -> tuple[Column, Column]:
    """C17: (temperature, reason). Missing -> 0.1; '' or '--x' -> needs a
    value; not finite -> finite message; outside 0..2 -> range message."""
    v = js_number(col)
    finite = F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    reason = (F.when(col.isNull(), F.lit(None))
              .when((col == "") | col.startswith("--"), F.lit("--temperature requires a value"))
              .when(~finite, F.lit("--temperature must be a finite number"))
              .when((v < MEETING_MIN_TEMPERATURE) | (v > MEETING_MAX_TEMPERATURE),
                    F.lit("--temperature must be between 0 and 2")))
    temp = F.when(col.isNull(), F.lit(TEMPERATURE)).when(reason.isNull(), v)
    return temp, reason


def meeting_route(requests: DataFrame) -> DataFrame:
    """J7 + C17. Request columns: openrouter (flag), base_url, has_openai_key,
    has_openrouter_key, model, temperature (text as given)."""
    flag = F.coalesce(F.col("openrouter"), F.lit(False))
    is_or_base = F.coalesce(F.col("base_url").contains("openrouter.ai"), F.lit(False))
    use_or = flag | is_or_base
    okey = F.coalesce(F.col("has_openai_key"), F.lit(False))
    rkey = F.coalesce(F.col("has_openrouter_key"), F.lit(False))
    has_key = F.when(flag, rkey).when(is_or_base, rkey | okey).otherwise(okey)
    key_reason = (F.when(has_key, F.lit(None))
                  .when(flag, F.lit("OPENROUTER_API_KEY is not set."))
                  .when(is_or_base, F.lit("OPENAI_API_KEY or OPENROUTER_API_KEY is not set."))
                  .otherwise(F.lit("OPENAI_API_KEY is not set.")))
    temp, temp_reason = temperature_check(F.col("temperature"))
    reason = F.coalesce(temp_reason, key_reason)
    base = F.coalesce(F.col("base_url"), F.when(use_or, F.lit(MEETING_OPENROUTER_BASE)))
    model = F.coalesce(F.col("model"), F.when(use_or, F.lit(MEETING_OPENROUTER_MODEL)), F.lit(MEETING_DEFAULT_MODEL))
    ok = reason.isNull()
    return (requests.withColumn("reason", reason).withColumn("ok", ok)
            .withColumn("use_openrouter", use_or)
            .withColumn("resolved_base_url", F.when(ok, base))
            .withColumn("resolved_model", F.when(ok, model))
            .withColumn("resolved_temperature", F.when(ok, temp)))


def mock_responses(requests: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """The fixed mock answer in pieces of at most 20 characters, one row
    per piece: (key, [keep...], seq, delta)."""
    pieces = F.regexp_extract_all(F.lit(MOCK_RESPONSE), F.lit(".{1,%d}" % MOCK_PIECE), 0)
    return requests.select(F.col(key), *(keep or []), F.posexplode(pieces).alias("seq", "delta"))


__all__ = ["route_requests", "request_body", "meeting_route", "temperature_check", "mock_responses",
           "providers_table", "js_number", "JS_WS"]


def respond(requests: DataFrame, fn, schema: str) -> DataFrame:
    """Answer request rows with a user callable, batch by batch.

    ``fn(pdf) -> pdf`` receives a pandas DataFrame of request rows (with the
    columns the caller selected, e.g. request id, provider, endpoint, body)
    and returns answer rows in ``schema`` (e.g. one row per streamed piece:
    request id, seq, delta). It runs inside the tasks via ``mapInPandas``, so
    a client can be opened once per partition and requests are spread over
    the cluster; nothing passes through the driver."""
    def per_partition(batches):
        for pdf in batches:
            out = fn(pdf)
            if out is not None and len(out):
                yield out
    return requests.mapInPandas(per_partition, schema=schema)
