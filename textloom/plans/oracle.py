"""DuckDB SQL for each registered query: an independent statement of the same
result over the same parquet views, used as the correctness oracle.

Regex constants are shared with the Spark side where both engines read them the
same way (RE2 and Java agree on \\A, \\z, \\x{..}); RE2 has no look-around, so
those patterns are restated with groups here.
"""

from __future__ import annotations

from textloom.functions.text import ASTRAL, EMAIL_RE, JS_WS
from textloom.functions import address as AD
from textloom.functions.url import AUTHORITY_RE, DEC_RE, FORBIDDEN_HOST_RE, HEX_RE, OCT_RE, SCHEME_RE

ORACLE: dict[str, str] = {}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(r'\A' + JS_WS + r'+|' + JS_WS + r'+\z')}, '', 'g')"


def js_trim_end(x: str) -> str:
    return f"regexp_replace({x}, {q(JS_WS + r'+\z')}, '', 'g')"


def utf16_len(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, {q('[^' + ASTRAL[1:])}, '', 'g')))"


def bound(x: str, limit: int = 12000) -> str:
    # No supplementary characters occur in the generated text, where code
    # points and UTF-16 units agree; the length test counts units regardless.
    return f"(CASE WHEN {utf16_len(x)} > {limit} THEN {js_trim_end(f'substr({x}, 1, {limit})')} ELSE {x} END)"


def cut(x: str, limit: int = 12000) -> str:
    return f"({utf16_len(x)} > {limit})"


def html_text(x: str) -> str:
    t = f"regexp_replace({x}, '(?is)<script.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for ent, ch in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    t = f"regexp_replace({t}, {q(JS_WS + '+')}, ' ', 'g')"
    return js_trim(t)


def is_html(x: str) -> str:
    return (f"(starts_with({js_trim(f'lower({x})')}, '<!doctype html') "
            f"OR contains(lower({x}), '<html'))")


NEWSLETTER_SQL = ("(?i)(unsubscribe|newsletter|weekly update|daily digest|what you missed|issue"
                  + JS_WS + r"+#?\d+|(^|[^A-Za-z0-9_])subscribe([^A-Za-z0-9_]|$)|read this email online)")


def category(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, {q(EMAIL_RE)}) THEN 'email' "
            f"WHEN regexp_matches({x}, {q(NEWSLETTER_SQL)}) THEN 'newsletter' "
            f"WHEN contains(lower({x}), 'dear ') THEN 'email' ELSE 'unknown' END)")


HOSTILE_URLS = """(SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES
 (-1, 'http://127.0.0.1/secret'), (-2, 'http://localhost/secret'), (-3, 'http://169.254.169.254/'),
 (-4, 'http://2130706433/secret'), (-5, 'http://0x7f000001/secret'), (-6, 'http://0/secret'),
 (-7, 'http://2852039166/'), (-8, 'http://0x7f.0.0.1/secret'), (-9, 'https://example.com/article'),
 (-10, 'ftp://example.com/file'), (-11, 'not a url'), (-12, 'http://[::1]/'),
 (-13, 'http://metadata.google.internal/computeMetadata/v1/'), (-14, 'https://fda.gov/')) v(page_id, url))"""


def url_screen_sql(src: str, id_col: str, url_col: str) -> str:
    """Columns: id, url, scheme, host, ok, reason (DuckDB)."""
    num = (f"CASE WHEN regexp_matches(x, {q(HEX_RE)}) THEN (CASE WHEN length(x) = 2 THEN 0::BIGINT "
           f"WHEN length(ltrim(substr(x, 3), '0')) > 9 THEN {1 << 40} ELSE ('0x' || substr(x, 3))::BIGINT END) "
           f"WHEN regexp_matches(x, {q(OCT_RE)}) THEN (CASE WHEN length(ltrim(substr(x, 2), '0')) > 12 THEN {1 << 40} "
           f"ELSE list_reduce(list_transform(string_split(substr(x, 2), ''), lambda c: c::BIGINT), "
           f"lambda a, b: a * 8 + b, 0::BIGINT) END) "
           f"WHEN regexp_matches(x, {q(DEC_RE)}) THEN (CASE WHEN length(x) > 11 THEN {1 << 40} ELSE x::BIGINT END) "
           f"ELSE NULL END")

    def private4(a: str, b: str) -> str:
        return (f"({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) "
                f"OR ({a} = 192 AND {b} = 168) OR ({a} = 100 AND {b} BETWEEN 64 AND 127))")
    six = lambda k, n: f"('0x' || substr(six, {k}, {n}))::BIGINT"
    wide, narrow = q(AD._WIDE), q(AD._NARROW)
    raw_host = f"regexp_extract(cu, {q(AUTHORITY_RE)}, 1)"
    return f"""
WITH u0 AS (SELECT {id_col} AS id, {url_col} AS url,
    regexp_replace(regexp_replace({url_col}, '\\A[\\x00-\\x20]+|[\\x00-\\x20]+\\z', '', 'g'), '[\\t\\n\\r]', '', 'g') AS cu
  FROM {src}),
u1 AS (SELECT *, lower(regexp_extract(cu, {q(SCHEME_RE)}, 1)) AS scheme,
    regexp_matches(cu, {q(AUTHORITY_RE)}) AS auth_ok,
    lower(CASE WHEN starts_with({raw_host}, '[') THEN {raw_host} ELSE translate(CASE WHEN contains({raw_host}, '%') THEN url_decode({raw_host})
      ELSE {raw_host} END, {wide}, {narrow}) END) AS host,
    regexp_extract(cu, {q(AUTHORITY_RE)}, 2) AS port FROM u0),
u2 AS (SELECT *, starts_with(host, '[') AS br,
    CASE WHEN starts_with(host, '[') THEN regexp_replace(host, '^\\[|\\]$', '', 'g') ELSE host END AS inner_host,
    string_split(host, '.') AS raw_labels FROM u1),
v1 AS (SELECT *, CASE WHEN br THEN regexp_extract(inner_host, '(?s)^(.*:)([0-9.]+)$', 2) END AS dot, string_split(dot, '.') AS d FROM u2),
v2 AS (SELECT *, CASE WHEN contains(dot, '.') THEN CASE WHEN regexp_matches(dot, {q(AD.DOTTED_RE)}) THEN regexp_extract(inner_host, '(?s)^(.*:)([0-9.]+)$', 1)
      || format('{{:x}}:{{:x}}', TRY_CAST(d[1] AS INT) * 256 + TRY_CAST(d[2] AS INT), TRY_CAST(d[3] AS INT) * 256 + TRY_CAST(d[4] AS INT)) END
    WHEN br THEN inner_host END AS pairs, string_split(pairs, '::') AS halves FROM v1),
v3 AS (SELECT *, CASE WHEN halves[1] = '' THEN []::VARCHAR[] ELSE string_split(halves[1], ':') END AS l,
    CASE WHEN len(halves) < 2 OR halves[2] = '' THEN []::VARCHAR[] ELSE string_split(halves[2], ':') END AS r FROM v2),
v4 AS (SELECT *, CASE WHEN len(halves) = 1 AND len(l) = 8 THEN l WHEN len(halves) = 2 AND len(l) + len(r) <= 7
      THEN l || list_transform(range(8 - len(l) - len(r)), lambda x: '0') || r END AS groups FROM v3),
v5 AS (SELECT *, CASE WHEN contains(pairs, ':') AND len(list_filter(groups, lambda g: NOT regexp_matches(g, '^[0-9a-f]{{1,4}}$'))) = 0
      THEN array_to_string(list_transform(groups, lambda g: lpad(g, 4, '0')), '') END AS six FROM v4),
u3 AS (SELECT *, CASE WHEN len(raw_labels) > 1 AND raw_labels[len(raw_labels)] = ''
      THEN list_slice(raw_labels, 1, len(raw_labels) - 1) ELSE raw_labels END AS labels FROM v5),
u4 AS (SELECT *, list_transform(labels, lambda x: {num}) AS nums, len(labels) AS n,
    labels[len(labels)] AS last_label FROM u3),
u5 AS (SELECT *,
    CASE WHEN br THEN NULL
      WHEN NOT (last_label <> '' AND (regexp_matches(last_label, '^[0-9]+$') OR regexp_matches(last_label, {q(HEX_RE)}))) THEN NULL
      WHEN len(list_filter(nums, lambda v: v IS NULL)) > 0 OR n > 4
        OR len(list_filter(list_slice(nums, 1, n - 1), lambda v: v > 255)) > 0
        OR nums[n] >= pow(256, 5 - n) THEN -1
      ELSE list_reduce(list_slice(nums, 1, n - 1), lambda acc, v: acc * 256 + v, 0::BIGINT) * pow(256, 5 - n)::BIGINT + nums[n]
    END AS addr FROM u4),
u6 AS (SELECT *,
    (scheme = '' OR (scheme IN ('http', 'https') AND NOT (auth_ok
        AND (CASE WHEN br THEN six IS NOT NULL
                  ELSE host <> '' AND NOT regexp_matches(host, {q(FORBIDDEN_HOST_RE)}) END)
        AND (port = '' OR (length(port) <= 5 AND TRY_CAST(port AS INTEGER) <= 65535))))
      OR coalesce(addr = -1, false)) AS invalid,
    floor(addr / 16777216) AS a, floor(addr / 65536) % 256 AS b
    FROM u5),
u7 AS (SELECT *,
    (host IN ('localhost', 'localhost.localdomain') OR host IN ('metadata', 'metadata.google.internal')
     OR ends_with(host, '.metadata.google.internal')
     OR coalesce(addr >= 0 AND {private4('a', 'b')}, false)
     OR coalesce(six = repeat('0', 31) || '1' OR substr(six, 1, 2) IN ('fc', 'fd', 'ff') OR starts_with(six, 'fe80')
         OR (starts_with(six, repeat('0', 20) || 'ffff') AND {private4(six(25, 2), six(27, 2))}), false)
    ) AS private FROM u6)
SELECT id, url, scheme, CASE WHEN NOT invalid THEN host END AS host,
  CASE WHEN invalid THEN 'Invalid URL' WHEN scheme NOT IN ('http', 'https') THEN 'Only HTTP and HTTPS URLs are supported'
       WHEN private THEN 'URL points to a private, local, or metadata address' END AS reason
FROM u7"""


def _url_screen_full(src: str, id_col: str, url_col: str) -> str:
    return f"SELECT id, url, scheme, host, reason IS NULL AS ok, reason FROM ({url_screen_sql(src, id_col, url_col)})"


ORACLE["page_text"] = f"""
SELECT page_id, is_html, {cut('raw')} AS was_cut, {bound('raw')} AS text FROM (
  SELECT page_id, ih AS is_html, CASE WHEN ih THEN {html_text('html')} ELSE html END AS raw
  FROM (SELECT *, {is_html('html')} AS ih FROM pages))"""

ORACLE["page_gate"] = f"""
WITH s AS ({url_screen_sql('pages', 'page_id', 'url')}),
g AS (SELECT p.page_id, p.url, p.html, s.reason AS ureason FROM pages p JOIN s ON s.id = p.page_id),
h AS (SELECT *, CASE WHEN ureason IS NOT NULL THEN ureason
    WHEN strlen(html) > 1000000 THEN 'URL content exceeds 1000000 bytes'
    WHEN html IS NULL OR length(html) = 0 THEN 'Fetched URL returned empty content' END AS pre FROM g),
r AS (SELECT *, CASE WHEN pre IS NULL THEN {is_html('html')} END AS ih FROM h),
x AS (SELECT *, CASE WHEN ih THEN {html_text('html')} WHEN pre IS NULL THEN html END AS raw FROM r),
y AS (SELECT *, {bound('raw')} AS bounded FROM x),
z AS (SELECT *, coalesce(pre, CASE WHEN length({js_trim('bounded')}) = 0
    THEN 'Fetched URL returned empty content after extraction' END) AS reason FROM y)
SELECT page_id, url AS source, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN ih END AS is_html,
  CASE WHEN reason IS NULL THEN {cut('raw')} END AS was_cut,
  CASE WHEN reason IS NULL THEN bounded END AS content
FROM z"""

ORACLE["bound_text"] = f"""
SELECT doc_id, {utf16_len('t')} AS n_units, {cut('t')} AS was_cut, {bound('t')} AS content
FROM (SELECT doc_id, {js_trim('text')} AS t FROM documents)"""

ORACLE["url_screen"] = f"""
SELECT id AS page_id, url, scheme, host, reason IS NULL AS ok, reason
FROM ({url_screen_sql(HOSTILE_URLS, 'page_id', 'url')})"""

ORACLE["url_reject_counts"] = f"""
SELECT reason, count(*) AS n FROM ({url_screen_sql(HOSTILE_URLS, 'page_id', 'url')}) GROUP BY reason"""

MIXED_DOCS = """(SELECT doc_id, lang, source, CASE doc_id % 5
    WHEN 0 THEN 'From: a@b.c' || chr(10) || text WHEN 1 THEN text || ' Unsubscribe'
    WHEN 2 THEN text || ' Issue #12' WHEN 3 THEN 'Dear ' || text ELSE text END AS text FROM documents)"""

ORACLE["content_category"] = f"""
SELECT doc_id, lang, source, {category('c')} AS category
FROM (SELECT doc_id, lang, source, {bound(js_trim('text'))} AS c FROM {MIXED_DOCS})"""

ORACLE["category_counts"] = f"""
SELECT lang, source, category, count(*) AS n FROM ({ORACLE['content_category']}) GROUP BY ALL"""

RESOLVED = f"""
(WITH req AS (
   SELECT 'p' || page_id AS request_id, [url] AS args, NULL::VARCHAR AS piped FROM pages
   UNION ALL
   SELECT 'd' || doc_id, CASE WHEN doc_id % 4 = 0 THEN ['-'] ELSE [text] END,
          CASE WHEN doc_id % 4 = 0 THEN text END FROM documents),
 snap AS ({ORACLE['page_gate']}),
 k AS (SELECT r.*, r.args[1] AS first, len(r.args) AS n, s.url AS first_url,
         CASE WHEN len(r.args) = 0 THEN 'stdin' WHEN r.args[1] = '' THEN 'empty' WHEN r.args[1] = '-' THEN 'stdin'
              WHEN s.reason IS NULL OR s.reason = 'URL points to a private, local, or metadata address' THEN 'url'
              ELSE 'argument' END AS kind
       FROM req r LEFT JOIN ({url_screen_sql('(SELECT DISTINCT args[1] AS u FROM req)', 'u', 'u')}) s
         ON s.url = r.args[1]),
 j AS (SELECT k.*, g.source AS gsource, g.content AS gcontent, g.reason AS greason
       FROM k LEFT JOIN snap g ON k.kind = 'url' AND g.source = k.first),
 t AS (SELECT *, {js_trim("coalesce(piped, '')")} AS pt, {js_trim("array_to_string(args, ' ')")} AS jt FROM j),
 v AS (SELECT *, CASE WHEN kind = 'empty' THEN 'No input provided'
         WHEN kind = 'stdin' AND n > 0 AND length(pt) = 0 THEN 'No input provided via stdin'
         WHEN kind = 'stdin' AND length(pt) = 0 THEN 'No input provided'
         WHEN kind = 'url' THEN CASE WHEN gsource IS NULL THEN 'Failed to fetch URL: no snapshot' ELSE greason END
         WHEN kind = 'argument' AND length(jt) = 0 THEN 'No input provided' END AS reason FROM t)
 SELECT request_id, kind,
   CASE WHEN reason IS NULL THEN CASE WHEN kind = 'stdin' THEN 'stdin' WHEN kind = 'url' THEN first ELSE 'argument' END END AS source,
   reason IS NULL AS ok, reason,
   CASE WHEN reason IS NULL THEN CASE WHEN kind = 'stdin' THEN {bound('pt')} WHEN kind = 'url' THEN gcontent
        ELSE {bound('jt')} END END AS content
 FROM v)"""

ORACLE["resolve_inputs"] = f"SELECT * FROM {RESOLVED}"

ORACLE["outcome_report"] = f"SELECT kind, reason, count(*) AS n FROM {RESOLVED} GROUP BY ROLLUP (kind, reason)"


# --- Step 3: prompts --------------------------------------------------------
from textloom.operators import prompts as P  # noqa: E402

DOC_CONTENT = f"""(SELECT doc_id, lang, source, c AS content, {category('c')} AS category
  FROM (SELECT doc_id, lang, source, {bound(js_trim('text'))} AS c FROM {MIXED_DOCS}))"""

SUMMARY_VARS = f"""(SELECT *, ['tldr', 'actions', 'linkedin', 'technical'][doc_id % 4 + 1] AS mode,
    CASE WHEN doc_id % 3 = 0 THEN 'engineers' END AS audience,
    CASE WHEN doc_id % 2 = 0 THEN (doc_id % 50 + 100)::INT END AS max_length,
    'argument' AS source_label FROM {DOC_CONTENT})"""

BAD_SUMMARY_VARS = f"""(SELECT * REPLACE (
    CASE WHEN doc_id % 5 = 4 THEN 'verbose' ELSE mode END AS mode,
    (doc_id % 7 - 2)::INT AS max_length,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE audience END AS audience,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE content END AS content) FROM {SUMMARY_VARS})"""


def _mode_case(m: str) -> str:
    return "CASE " + " ".join(f"WHEN {m} = {q(k)} THEN {q(k + ': ' + v)}" for k, v in P.MODE_INSTRUCTIONS.items()) + " END"


def _enum_issue(col: str, path: str, values: list[str], required: bool) -> str:
    expected = " | ".join(f"'{v}'" for v in values)
    bad = f"WHEN {col} NOT IN ({', '.join(q(v) for v in values)}) THEN {q(path + ': Invalid enum value. Expected ' + expected + ', received ' + chr(39))} || {col} || {q(chr(39))}"
    req = f"WHEN {col} IS NULL THEN {q(path + ': Required')} " if required else ""
    return f"CASE {req}{bad} END"


SUMMARY_ISSUES = f"""list_filter([
    CASE WHEN content IS NULL THEN 'content: Required' WHEN length(content) < 1 THEN 'content: content is required' END,
    {_enum_issue('mode', 'mode', P.SUMMARY_MODES, True)},
    CASE WHEN max_length <= 0 THEN 'maxLength: Number must be greater than 0' END,
    CASE WHEN length(audience) < 1 THEN 'audience: String must contain at least 1 character(s)' END,
    {_enum_issue('category', 'category', P.SUMMARY_CATEGORIES, False)},
    CASE WHEN length(source_label) < 1 THEN 'source: String must contain at least 1 character(s)' END
  ], lambda x: x IS NOT NULL)"""


def _summary_rendered(src: str) -> str:
    return f"""(SELECT *, CASE WHEN len(issues) > 0 THEN 'Validation failed for prompt "summarize-content": '
      || array_to_string(issues, ', ') END AS reason FROM (SELECT *, {SUMMARY_ISSUES} AS issues FROM {src}))"""


SUMMARY_USER = f"""'Summarize the following ' || CASE WHEN coalesce(category, 'unknown') = 'unknown' THEN 'content'
    ELSE category END || ' from ' || coalesce(source_label, 'input') || '.' || chr(10) || chr(10)
  || {q(P.SUMMARY_USER_HEAD)} || '- ' || {_mode_case('mode')}
  || CASE WHEN len(cons) > 0 THEN chr(10) || '- ' || array_to_string(cons, chr(10) || '- ') ELSE '' END
  || chr(10) || {q(P.SUMMARY_USER_TAIL)} || content || chr(10) || '---'"""

ORACLE["summary_prompts"] = f"""
SELECT doc_id, 'summarize-content' AS prompt_id, '1.0.0' AS prompt_version, mode, reason IS NULL AS ok,
  CASE WHEN reason IS NULL THEN {q(P.SUMMARY_SYSTEM)} END AS system,
  CASE WHEN reason IS NULL THEN {SUMMARY_USER} END AS user
FROM (SELECT *, list_filter([CASE WHEN length(audience) > 0 THEN 'Write for ' || audience || '.' END,
        CASE WHEN max_length <> 0 THEN 'Keep the summary within ' || max_length || ' words.' END],
        lambda x: x IS NOT NULL) AS cons FROM {_summary_rendered(SUMMARY_VARS)})"""

ORACLE["prompt_rejects"] = f"""
SELECT doc_id, 'summarize-content' AS prompt_id, reason FROM {_summary_rendered(BAD_SUMMARY_VARS)}
WHERE reason IS NOT NULL"""

ORACLE["classify_prompts"] = f"""
SELECT doc_id, 'classify-input' AS prompt_id, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN {q(P.CLASSIFY_SYSTEM)} END AS system,
  CASE WHEN reason IS NULL THEN 'Classify this content:' || chr(10) || chr(10) || '---' || chr(10) || content
    || chr(10) || '---' END AS user
FROM (SELECT *, CASE WHEN content IS NULL THEN 'Validation failed for prompt "classify-input": content: Required'
        WHEN length(content) < 1 THEN 'Validation failed for prompt "classify-input": content: content is required'
        END AS reason FROM {DOC_CONTENT})"""

TRANSCRIPTS = f"""(SELECT conv_id, t AS transcript, length(t) > 0 AS ok,
    CASE WHEN length(t) = 0 THEN 'No meeting notes provided.' END AS reason
  FROM (SELECT conv_id, {js_trim("string_agg(text, chr(10) ORDER BY turn, text)")} AS t
        FROM conversations GROUP BY conv_id))"""

ORACLE["transcripts"] = f"SELECT * FROM {TRANSCRIPTS}"

ORACLE["meeting_prompts"] = f"""
SELECT conv_id, 'extract-meeting' AS prompt_id, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN {q(P.MEETING_INSTRUCTIONS)} END AS system,
  CASE WHEN reason IS NULL THEN 'Transcript:' || chr(10) || '\"\"\"' || chr(10) || transcript || chr(10) || '\"\"\"' END AS user
FROM (SELECT conv_id, transcript, CASE WHEN transcript IS NULL
        THEN 'Validation failed for prompt "extract-meeting": transcript: Required'
        WHEN length(transcript) < 1 THEN 'Validation failed for prompt "extract-meeting": transcript: transcript is required'
        END AS reason FROM {TRANSCRIPTS})"""

PATCHES = f"""(SELECT doc_id AS patch_id, CASE WHEN doc_id % 2 = 0 THEN 'staged' ELSE 'commit' END AS kind,
    CASE doc_id % 3 WHEN 0 THEN 'HEAD~1' WHEN 2 THEN 'main' END AS ref, text AS diff,
    CASE WHEN doc_id % 5 = 0 THEN 'Focus on security vulnerabilities' END AS custom_prompt FROM documents)"""

ORACLE["diff_prompts"] = f"""
SELECT patch_id, kind, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN strlen(d) > 8388608 THEN 'warn' ELSE 'ok' END AS status,
  reason,
  CASE WHEN reason IS NULL THEN 'Please analyze the following git diff (' ||
    CASE WHEN kind = 'commit' AND length(ref) > 0 THEN ref ELSE 'staged changes' END || '):' || chr(10) || chr(10)
    || d || chr(10) || chr(10) || {q(P.DIFF_REQUESTS)}
    || CASE WHEN length(custom_prompt) > 0 THEN chr(10) || chr(10) || 'Additional instructions:' || chr(10) || custom_prompt
       ELSE '' END END AS prompt
FROM (SELECT *, CASE WHEN kind <> 'staged' AND coalesce(ref, '') = '' THEN 'Missing required ref for commit diff'
        WHEN strlen(diff) > 10485760 THEN 'Diff too large (exceeds 10MB limit). Consider analyzing specific files or commits separately.'
        WHEN length(d) = 0 THEN 'No changes found in diff' END AS reason
      FROM (SELECT *, {js_trim("coalesce(diff, '')")} AS d FROM {PATCHES}))"""

ORACLE["mode_prompts"] = f"""
SELECT doc_id, mode, {_mode_case('mode')} AS instruction FROM {SUMMARY_VARS}"""


# --- Step 4: routing ----------------------------------------------------------
from textloom.operators import routing as R  # noqa: E402
from textloom.plans.derive import TEMPERATURE_TEXTS  # noqa: E402

PROVIDERS_SQL = "(VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else q(x) for x in row) + ")" for row in R.PROVIDERS
) + ") pv(p, default_model, default_base_url, path, key_message)"

PROVIDER_REQ = """(SELECT c_custkey AS request_id,
    ['openai', 'anthropic', 'ollama', 'openrouter', 'opencode', 'mock', 'OpenAI', 'bogus'][c_custkey % 9 + 1] AS provider,
    CASE WHEN c_nationkey % 5 = 0 THEN 'anthropic' END AS default_provider,
    c_custkey % 11 = 0 AS has_api_key, c_mktsegment = 'BUILDING' AS has_generic_key, c_acctbal > 5000 AS has_openai_key,
    c_nationkey % 2 = 0 AS has_anthropic_key, CASE WHEN c_nationkey % 3 = 0 THEN 'http://gpu-box:11434/' END AS ollama_host,
    c_custkey % 4 = 0 AS has_openrouter_key,
    CASE WHEN c_custkey % 10 = 0 THEN 'https://proxy.example.com/v1/' END AS base_url,
    CASE WHEN c_custkey % 6 = 0 THEN 'custom-model' END AS model,
    CASE WHEN c_custkey % 7 = 0 THEN 'env-model' END AS env_model,
    CASE WHEN c_nationkey % 4 = 0 THEN 'qwen2' END AS ollama_model FROM customer)"""

ORACLE["route_requests"] = f"""
WITH r AS (SELECT *, lower(coalesce(nullif(provider, ''), nullif(default_provider, ''),
    CASE WHEN has_api_key OR has_generic_key OR has_openai_key THEN 'openai' END,
    CASE WHEN has_anthropic_key THEN 'anthropic' END, CASE WHEN length(ollama_host) > 0 THEN 'ollama' END,
    CASE WHEN has_openrouter_key THEN 'openrouter' END)) AS route FROM {PROVIDER_REQ}),
j AS (SELECT * FROM r LEFT JOIN {PROVIDERS_SQL} ON r.route = pv.p),
k AS (SELECT *, CASE WHEN route IS NULL THEN {q(R.NO_PROVIDER)} WHEN p IS NULL THEN 'Unknown provider: ' || route
    WHEN route IN ('openai', 'anthropic', 'openrouter') AND NOT (has_api_key OR has_generic_key OR
      CASE route WHEN 'openai' THEN has_openai_key WHEN 'anthropic' THEN has_anthropic_key ELSE has_openrouter_key END)
    THEN key_message END AS reason,
  regexp_replace(coalesce(base_url, CASE WHEN route = 'ollama' THEN ollama_host END, default_base_url), '/$', '') AS base
  FROM j)
SELECT request_id, route AS provider, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN CASE WHEN route = 'ollama' THEN coalesce(model, ollama_model, default_model)
    WHEN route = 'mock' THEN NULL ELSE coalesce(model, env_model, default_model) END END AS model,
  CASE WHEN reason IS NULL AND path IS NOT NULL THEN base END AS base_url,
  CASE WHEN reason IS NULL AND path IS NOT NULL THEN base || path END AS endpoint
FROM k"""

ORACLE["request_payloads"] = f"""
WITH v AS (SELECT *, ['openai', 'anthropic', 'ollama', 'openrouter', 'opencode'][doc_id % 5 + 1] AS provider
           FROM ({ORACLE['summary_prompts']}) WHERE ok),
j AS (SELECT v.*, pv.default_model AS m FROM v LEFT JOIN {PROVIDERS_SQL} ON v.provider = pv.p)
SELECT doc_id, provider, CASE
  WHEN provider IN ('openai', 'openrouter') THEN to_json({{'model': m, 'messages': [{{'role': 'system', 'content': system}},
      {{'role': 'user', 'content': "user"}}], 'temperature': 0.1::DOUBLE, 'stream': true,
      'response_format': {{'type': 'json_object'}}}})::VARCHAR
  WHEN provider = 'anthropic' THEN to_json({{'model': m, 'system': system, 'messages': [{{'role': 'user', 'content': "user"}}],
      'temperature': 0.1::DOUBLE, 'max_tokens': 2048, 'stream': true}})::VARCHAR
  WHEN provider = 'ollama' THEN to_json({{'model': m, 'messages': [{{'role': 'system', 'content': system}},
      {{'role': 'user', 'content': "user"}}], 'stream': true, 'format': 'json', 'options': {{'temperature': 0.1::DOUBLE}}}})::VARCHAR
  WHEN provider = 'opencode' THEN system || chr(10) || chr(10) || "user" END::VARCHAR AS body
FROM j"""

_TEMPS = "[" + ", ".join(q(t) for t in TEMPERATURE_TEXTS) + "]"
_WS_T = js_trim("temperature")

ORACLE["meeting_route"] = f"""
WITH req AS (SELECT DISTINCT conv_id AS request_id, conv_id % 4 = 1 AS openrouter,
    CASE WHEN conv_id % 5 = 2 THEN 'https://openrouter.ai/api/v1' WHEN conv_id % 5 = 3 THEN 'https://llm.example.com/v1' END AS base_url,
    conv_id % 3 <> 0 AS has_openai_key, conv_id % 2 = 0 AS has_openrouter_key,
    CASE WHEN conv_id % 6 = 0 THEN 'gpt-4.1' END AS model,
    CASE WHEN conv_id % 17 = 0 THEN NULL ELSE {_TEMPS}[conv_id % {len(TEMPERATURE_TEXTS)} + 1] END AS temperature
  FROM conversations),
n AS (SELECT *, {_WS_T} AS t FROM req),
v AS (SELECT *, CASE WHEN t = '' THEN 0.0::DOUBLE
    WHEN regexp_matches(t, '^[+]?Infinity$') THEN 'inf'::DOUBLE WHEN t = '-Infinity' THEN '-inf'::DOUBLE
    WHEN regexp_matches(t, {q(R.JS_DECIMAL)}) THEN TRY_CAST(t AS DOUBLE)
    WHEN regexp_matches(t, '^0[xX][0-9a-fA-F]{{1,15}}$') THEN ('0x' || substr(t, 3))::BIGINT::DOUBLE
    ELSE 'nan'::DOUBLE END AS num FROM n),
w AS (SELECT *, coalesce(openrouter, false) OR coalesce(contains(base_url, 'openrouter.ai'), false) AS use_or,
    coalesce(contains(base_url, 'openrouter.ai'), false) AS is_or_base FROM v),
x AS (SELECT *, coalesce(
    CASE WHEN temperature IS NULL THEN NULL WHEN temperature = '' OR starts_with(temperature, '--') THEN '--temperature requires a value'
      WHEN isnan(num) OR isinf(num) THEN '--temperature must be a finite number'
      WHEN num < 0 OR num > 2 THEN '--temperature must be between 0 and 2' END,
    CASE WHEN (CASE WHEN openrouter THEN has_openrouter_key WHEN is_or_base THEN has_openrouter_key OR has_openai_key
                    ELSE has_openai_key END) THEN NULL
      WHEN openrouter THEN 'OPENROUTER_API_KEY is not set.'
      WHEN is_or_base THEN 'OPENAI_API_KEY or OPENROUTER_API_KEY is not set.'
      ELSE 'OPENAI_API_KEY is not set.' END) AS reason FROM w)
SELECT request_id, reason IS NULL AS ok, reason, use_or AS use_openrouter,
  CASE WHEN reason IS NULL THEN coalesce(base_url, CASE WHEN use_or THEN 'https://openrouter.ai/api/v1' END) END AS base_url,
  CASE WHEN reason IS NULL THEN coalesce(model, CASE WHEN use_or THEN 'openrouter/free' END, 'gpt-4o-2024-08-06') END AS model,
  CASE WHEN reason IS NULL THEN CASE WHEN temperature IS NULL THEN 0.1 ELSE num END END AS temperature
FROM x"""

ORACLE["mock_responses"] = f"""
SELECT doc_id AS response_id, (i - 1)::INT AS seq, pieces[i] AS delta
FROM documents, (SELECT regexp_extract_all({q(R.MOCK_RESPONSE)}, '.{{1,20}}') AS pieces) m,
  range(1, len(m.pieces) + 1) AS r(i)"""


# --- Step 5: stream round trips: the expected text is the source text --------
for _name, _k in [("openai_text", 0), ("anthropic_text", 1), ("ollama_text", 2)]:
    ORACLE[_name] = f"SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id % 3 = {_k}"
ORACLE["reframed_text"] = "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations"


# --- Step 6: JSON recovery and typed answers ----------------------------------
# Recovery restated in SQL: whole text, first fenced block, then the first
# balanced brace group that is valid JSON. The brace groups come from a
# string-aware regex nested to depth 3 (RE2 has no recursion); DuckDB's
# json_valid also admits NaN and trailing commas. Neither occurs in the
# generated answers.
_STR = r'"(?:[^"\\]|\\.)*"'
_L0 = r'\{(?:[^{}"]|' + _STR + r')*\}'
_L1 = r'\{(?:[^{}"]|' + _STR + '|' + _L0 + r')*\}'
_L2 = r'\{(?:[^{}"]|' + _STR + '|' + _L1 + r')*\}'
BALANCED = "(?s)" + _L2
FENCE_SQL = "(?is)```(?:json)?" + JS_WS + "*(.*?)```"


def recover_sql(raw: str) -> str:
    t = js_trim(raw)
    f = f"regexp_extract({t}, {q(FENCE_SQL)}, 1)"
    return (f"coalesce(CASE WHEN starts_with({t}, '{{') AND ends_with({t}, '}}') AND json_valid({t}) THEN {t} END, "
            f"CASE WHEN {f} <> '' AND json_valid({js_trim(f)}) THEN {js_trim(f)} END, "
            f"list_filter(regexp_extract_all({t}, {q(BALANCED)}), lambda c: json_valid(c))[1])")


def ztype(expr: str) -> str:
    return (f"(CASE WHEN {expr} IS NULL THEN NULL WHEN {expr} = 'VARCHAR' THEN 'string' WHEN {expr} = 'NULL' THEN 'null' "
            f"WHEN {expr} = 'ARRAY' THEN 'array' WHEN {expr} = 'OBJECT' THEN 'object' WHEN {expr} = 'BOOLEAN' THEN 'boolean' "
            f"ELSE 'number' END)")


def jt(j: str, key: str) -> str:
    return ztype(f"json_type({j}, '$.{key}')")


def string_issue(j: str, key: str, required: bool = True, min_message: str | None = None) -> str:
    t = jt(j, key)
    req = f"'{key}: Required'" if required else "NULL"
    m = (f" WHEN length(json_extract_string({j}, '$.{key}')) < 1 THEN {q(key + ': ' + min_message)}"
         if min_message else "")
    return f"CASE WHEN {t} IS NULL THEN {req} WHEN {t} <> 'string' THEN '{key}: Expected string, received ' || {t}{m} END"


def enum_issue(j: str, key: str, values: list[str]) -> str:
    t = jt(j, key)
    exp = " | ".join(f"'{v}'" for v in values)
    v = f"json_extract_string({j}, '$.{key}')"
    return (f"CASE WHEN {t} IS NULL THEN '{key}: Required' WHEN {t} <> 'string' THEN {q(key + ': Expected ' + exp + ', received ')} || {t} "
            f"WHEN {v} NOT IN ({', '.join(q(x) for x in values)}) THEN {q(key + ': Invalid enum value. Expected ' + exp + ', received ' + chr(39))} || {v} || {q(chr(39))} END")


def string_array_issues(j: str, key: str) -> str:
    t = jt(j, key)
    et = ztype("json_type(e)")
    return (f"CASE WHEN {t} IS NULL THEN ['{key}: Required'] WHEN {t} <> 'array' THEN ['{key}: Expected array, received ' || {t}] "
            f"ELSE list_filter(list_transform(json_extract({j}, '$.{key}[*]'), lambda e, i: CASE WHEN {et} <> 'string' "
            f"THEN '{key}.' || (i - 1) || ': Expected string, received ' || {et} END), lambda x: x IS NOT NULL) END")


SUMMARY_ANSWERS = """(WITH d AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  s AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS summary, [lang, source] AS kp,
    CASE WHEN toxic = 1 THEN ['Review flagged content'] ELSE []::VARCHAR[] END AS ai,
    CASE WHEN doc_id % 7 = 0 THEN 'memo' ELSE ['article', 'email', 'newsletter', 'unknown'][doc_id % 4 + 1] END AS cat,
    CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'medium' END AS imp FROM d),
  j AS (SELECT doc_id, (CASE WHEN doc_id % 4 <> 0
      THEN to_json({'title': 'Doc ' || doc_id, 'summary': summary, 'key_points': kp, 'action_items': ai, 'category': cat, 'importance': imp})
      ELSE to_json({'summary': summary, 'key_points': kp, 'action_items': ai, 'category': cat, 'importance': imp}) END)::VARCHAR AS j FROM s)
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN j WHEN 1 THEN '```json' || chr(10) || j || chr(10) || '```'
    WHEN 2 THEN 'Here is the summary: ' || j || ' Hope this helps.' WHEN 3 THEN 'Use {braces} carefully. ' || j
    WHEN 4 THEN substr(j, 1, length(j) - 5) ELSE 'I cannot summarize this.' END AS raw FROM j)"""

_SUMMARY_ISSUES = ("list_filter(flatten([[" + string_issue("j", "title", required=False) + "], ["
                   + string_issue("j", "summary", min_message="Summary cannot be empty") + "], "
                   + string_array_issues("j", "key_points") + ", " + string_array_issues("j", "action_items")
                   + ", [" + enum_issue("j", "category", P.SUMMARY_CATEGORIES) + "], ["
                   + enum_issue("j", "importance", ["low", "medium", "high"]) + "]]), lambda x: x IS NOT NULL)")

TYPED_SUMMARIES = f"""(WITH r AS (SELECT doc_id, {recover_sql('raw')} AS j FROM {SUMMARY_ANSWERS}),
  v AS (SELECT doc_id, j, CASE WHEN j IS NULL THEN 'No valid JSON object found in response'
      WHEN {ztype('json_type(j)')} <> 'object' THEN 'Expected object, received ' || {ztype('json_type(j)')}
      ELSE (SELECT CASE WHEN len(x) > 0 THEN array_to_string(x, '; ') END FROM (SELECT {_SUMMARY_ISSUES} AS x)) END AS reason
    FROM r)
  SELECT doc_id, reason IS NULL AS ok, reason,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.title') END AS title,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.summary') END AS summary,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.key_points[*]') END AS key_points,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.action_items[*]') END AS action_items,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.category') END AS category,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.importance') END AS importance
  FROM v)"""

ORACLE["typed_summaries"] = f"""SELECT * REPLACE (to_json(key_points)::VARCHAR AS key_points,
  to_json(action_items)::VARCHAR AS action_items) FROM {TYPED_SUMMARIES}"""

ORACLE["summary_markdown"] = f"""
SELECT doc_id, {js_trim("'# ' || CASE WHEN length(title) > 0 THEN title ELSE 'Untitled' END || chr(10) || chr(10) || summary || chr(10) || chr(10) || CASE WHEN len(key_points) > 0 THEN '## Key Points' || chr(10) || array_to_string(list_transform(key_points, lambda p: '- ' || p), chr(10)) || chr(10) || chr(10) ELSE '' END || CASE WHEN len(action_items) > 0 THEN '## Action Items' || chr(10) || array_to_string(list_transform(action_items, lambda p: '- [ ] ' || p), chr(10)) || chr(10) || chr(10) ELSE '' END || '_Category: ' || category || ' | Importance: ' || importance || '_'")} AS markdown
FROM {TYPED_SUMMARIES} WHERE ok"""

ORACLE["summary_json"] = f"""
SELECT doc_id, (CASE WHEN title IS NULL THEN to_json({{'summary': summary, 'key_points': key_points, 'action_items': action_items, 'category': category, 'importance': importance}})
  ELSE to_json({{'title': title, 'summary': summary, 'key_points': key_points, 'action_items': action_items, 'category': category, 'importance': importance}}) END)::VARCHAR AS json
FROM {TYPED_SUMMARIES} WHERE ok"""

_CONF = "json_extract(j, '$.confidence')::DOUBLE"
_CONF_T = jt("j", "confidence")
ORACLE["typed_classes"] = f"""
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '```json' || chr(10) || o || chr(10) || '```' ELSE o END AS raw
    FROM (SELECT doc_id, to_json({{'category': ['article', 'meeting', 'git-diff', 'email', 'code', 'unknown'][doc_id % 6 + 1],
      'confidence': ((doc_id % 12) / 10.0)::DOUBLE, 'reason': 'lang ' || lang}})::VARCHAR AS o FROM documents)),
r AS (SELECT doc_id, {recover_sql('raw')} AS j FROM a),
v AS (SELECT doc_id, j, CASE WHEN j IS NULL THEN 'No valid JSON object found in response'
    WHEN {ztype('json_type(j)')} <> 'object' THEN 'Expected object, received ' || {ztype('json_type(j)')}
    ELSE (SELECT CASE WHEN len(x) > 0 THEN array_to_string(x, '; ') END FROM (SELECT list_filter([
      {enum_issue('j', 'category', P.INPUT_CATEGORIES)},
      CASE WHEN {_CONF_T} IS NULL THEN 'confidence: Required' WHEN {_CONF_T} <> 'number' THEN 'confidence: Expected number, received ' || {_CONF_T}
        WHEN {_CONF} < 0 THEN 'confidence: Number must be greater than or equal to 0'
        WHEN {_CONF} > 1 THEN 'confidence: Number must be less than or equal to 1' END,
      {string_issue('j', 'reason')}], lambda x: x IS NOT NULL) AS x)) END AS reason FROM r)
SELECT doc_id, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN json_extract_string(j, '$.category') END AS category,
  CASE WHEN reason IS NULL THEN {_CONF} END AS confidence,
  CASE WHEN reason IS NULL THEN json_extract_string(j, '$.reason') END AS explanation
FROM v"""

MEETING_ANSWERS = """(WITH g AS (SELECT conv_id, arg_min(text, turn) AS first_text,
      coalesce(list({'owner': role, 'task': text, 'due': 'turn ' || turn} ORDER BY turn) FILTER (WHERE role = 'assistant'),
               []) AS items FROM conversations GROUP BY conv_id),
  o AS (SELECT conv_id, to_json({'summary': first_text, 'action_items': items,
      'risks': CASE WHEN conv_id % 13 = 6 THEN ['1'] WHEN conv_id % 2 = 0 THEN ['Scope creep'] ELSE []::VARCHAR[] END})::VARCHAR AS o0
    FROM g),
  c AS (SELECT conv_id, CASE WHEN conv_id % 13 = 6 THEN replace(o0, '"risks":["1"]', '"risks":[1]') ELSE o0 END AS body FROM o)
  SELECT conv_id, CASE WHEN conv_id % 7 = 3 THEN 'I cannot help with that.' END AS refusal,
    CASE WHEN conv_id % 7 <> 3 AND conv_id % 3 = 0 THEN body END AS parsed,
    CASE WHEN conv_id % 7 = 3 OR conv_id % 3 = 0 OR conv_id % 11 = 5 THEN NULL
      WHEN conv_id % 5 = 4 THEN substr(body, 1, length(body) - 3) ELSE body END AS content FROM c)"""

_ITEM_T = ztype("json_type(e)")


def _field_issue(f: str) -> str:
    t = ztype(f"json_type(e, '$.{f}')")
    return (f"CASE WHEN {t} IS NULL THEN 'action_items.' || (i - 1) || '.{f}: Required' WHEN {t} <> 'string' "
            f"THEN 'action_items.' || (i - 1) || '.{f}: Expected string, received ' || {t} END")


_ITEM_ISSUES = (f"CASE WHEN {jt('j', 'action_items')} IS NULL THEN ['action_items: Required'] "
                f"WHEN {jt('j', 'action_items')} <> 'array' THEN ['action_items: Expected array, received ' || {jt('j', 'action_items')}] "
                f"ELSE list_filter(flatten(list_transform(json_extract(j, '$.action_items[*]'), lambda e, i: "
                f"CASE WHEN {_ITEM_T} <> 'object' THEN ['action_items.' || (i - 1) || ': Expected object, received ' || {_ITEM_T}] "
                f"ELSE [{_field_issue('owner')}, {_field_issue('task')}, {_field_issue('due')}] END)), lambda x: x IS NOT NULL) END")

TYPED_MEETINGS = f"""(WITH a AS (SELECT *, CASE WHEN parsed IS NOT NULL THEN parsed WHEN length(content) > 0 THEN content END AS src
    FROM {MEETING_ANSWERS}),
  b AS (SELECT *, CASE WHEN json_valid(src) THEN src END AS j FROM a),
  v AS (SELECT conv_id, j, CASE WHEN length(refusal) > 0 THEN 'Model refused: ' || refusal
      WHEN src IS NULL THEN 'No parsed output received from the model'
      WHEN j IS NULL THEN 'Invalid JSON in model output'
      WHEN {ztype('json_type(j)')} <> 'object' THEN 'Expected object, received ' || {ztype('json_type(j)')}
      ELSE (SELECT CASE WHEN len(x) > 0 THEN array_to_string(x, '; ') END FROM (SELECT list_filter(flatten([[{string_issue('j', 'summary')}],
        {_ITEM_ISSUES}, {string_array_issues('j', 'risks')}]), lambda x: x IS NOT NULL) AS x)) END AS reason FROM b)
  SELECT conv_id, reason IS NULL AS ok, reason,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.summary') END AS summary,
    CASE WHEN reason IS NULL THEN json_extract_string(j, '$.risks[*]') END AS risks,
    CASE WHEN reason IS NULL THEN list_transform(json_extract(j, '$.action_items[*]'), lambda e:
      {{'owner': json_extract_string(e, '$.owner'), 'task': json_extract_string(e, '$.task'), 'due': json_extract_string(e, '$.due')}}) END AS items
  FROM v)"""

ORACLE["typed_meetings"] = f"""
SELECT conv_id, ok, reason, summary, to_json(risks)::VARCHAR AS risks, to_json(items)::VARCHAR AS action_items
FROM {TYPED_MEETINGS}"""

ORACLE["action_items"] = f"""
SELECT conv_id, (i - 1)::INT AS pos, items[i].owner AS owner, items[i].task AS task, items[i].due AS due
FROM {TYPED_MEETINGS} m, range(1, len(m.items) + 1) r(i) WHERE ok
UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL FROM {TYPED_MEETINGS} WHERE ok AND len(items) = 0"""

ORACLE["action_item_counts"] = f"""
SELECT owner, count(*) AS n FROM ({ORACLE['action_items']}) WHERE owner IS NOT NULL GROUP BY owner"""

ORACLE["meeting_report"] = f"""
SELECT conv_id, 'Summary' || chr(10) || summary || chr(10) || chr(10) || 'Action items' || chr(10)
  || CASE WHEN len(items) = 0 THEN '  None' ELSE array_to_string(list_transform(items, lambda a: '- ' || a.task || ' — ' || a.owner || ' (due ' || a.due || ')'), chr(10)) END
  || chr(10) || chr(10) || 'Risks' || chr(10)
  || CASE WHEN len(risks) = 0 THEN '  None' ELSE array_to_string(list_transform(risks, lambda r: '- ' || r), chr(10)) END AS report
FROM {TYPED_MEETINGS} WHERE ok"""


# --- Step 7: catalogues ---------------------------------------------------------
from textloom.functions import screens as S  # noqa: E402
from textloom.operators import catalogue as CT  # noqa: E402

TOOLS_C = """(SELECT s_nationkey AS config_id, s_suppkey AS ord, s_name AS name, 'run ' || s_suppkey AS command
  FROM supplier WHERE s_suppkey % 2 = 0)"""
TOOLS_D = """(SELECT s_nationkey AS config_id, s_suppkey AS ord,
  CASE WHEN s_suppkey % 3 = 0 THEN 'det-' || s_suppkey ELSE upper(s_name) END AS name,
  'RUN ' || (s_suppkey - s_suppkey % 4) AS command FROM supplier)"""

MERGED = f"""(SELECT config_id, 'config' AS origin, ord, name, command FROM {TOOLS_C} c
UNION ALL SELECT config_id, 'detected', ord, name, command FROM {TOOLS_D} d
WHERE NOT EXISTS (SELECT 1 FROM {TOOLS_C} c WHERE c.config_id = d.config_id AND lower(c.name) = lower(d.name))
  AND NOT EXISTS (SELECT 1 FROM {TOOLS_C} c WHERE c.config_id = d.config_id AND lower(c.command) = lower(d.command)))"""

ORACLE["catalogue_merge"] = f"SELECT * FROM {MERGED}"

_DEFAULTS_SQL = "(VALUES " + ", ".join(
    f"({i}, {q(n)}, {q(c)}, {q(d)}, [{', '.join(q(a) for a in al)}])" for i, (n, c, d, al) in enumerate(CT.DEFAULT_TEMPLATES)
) + ") dv(default_idx, name, command, description, aliases)"
_WS = JS_WS
_SUM_OLD = "^" + _WS + "*ai-summary(" + _WS + "|$)"
_MEET_OLD = "^" + _WS + "*ai-meeting(" + _WS + "|$)"

TEMPLATES_E = """(SELECT (p_partkey // 20)::BIGINT AS config_id, p_partkey AS ord,
  CASE p_partkey % 6 WHEN 0 THEN 'summary' WHEN 1 THEN 'meeting' WHEN 2 THEN 'review' ELSE p_name END AS name,
  CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 12 = 0 THEN '  ai-summary --mode tldr $@' ELSE 'ai summary --mode tldr $@' END
    WHEN 1 THEN CASE WHEN p_partkey % 4 = 1 THEN 'ai-meeting notes.md' ELSE 'ai-meetingx notes.md' END
    ELSE 'echo ' || p_name END AS command, p_type AS description, [p_brand] AS aliases FROM part)"""

TEMPLATE_DEFAULTS = f"""(WITH e AS {TEMPLATES_E},
  dd AS (SELECT config_id, name, min(ord) AS pos, arg_max(command, ord) AS command, arg_max(description, ord) AS description,
           arg_max(aliases, ord) AS aliases, false AS added FROM e GROUP BY config_id, name),
  miss AS (SELECT c.config_id, dv.name, (1::BIGINT << 40) + dv.default_idx AS pos, dv.command, dv.description, dv.aliases, true AS added
           FROM (SELECT DISTINCT config_id FROM e) c, {_DEFAULTS_SQL}
           WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.config_id = c.config_id AND dd.name = dv.name)),
  m AS (SELECT * FROM dd UNION ALL SELECT config_id, name, pos, command, description, aliases, added FROM miss),
  r AS (SELECT *, CASE WHEN name = 'summary' AND regexp_matches({js_trim('command')}, {q(_SUM_OLD)})
                        THEN regexp_replace(command, {q(_SUM_OLD)}, 'ai summary\\1')
                       WHEN name = 'meeting' AND regexp_matches(command, {q(_MEET_OLD)})
                        THEN regexp_replace(command, {q(_MEET_OLD)}, 'ai meeting\\1') ELSE command END AS new_command FROM m),
  f AS (SELECT config_id, bool_or(added OR new_command <> command) AS changed FROM r GROUP BY config_id)
  SELECT r.config_id, pos, name, new_command AS command, description, aliases, true AS changed
    FROM r JOIN f ON f.config_id = r.config_id WHERE f.changed
  UNION ALL SELECT e.config_id, ord AS pos, name, command, description, aliases, false
    FROM e JOIN f ON f.config_id = e.config_id WHERE NOT f.changed)"""

ORACLE["template_defaults"] = f"SELECT config_id, pos, name, command, description, changed FROM {TEMPLATE_DEFAULTS}"

CONFIG_DOCS = """(WITH t AS (SELECT s_suppkey // 10 AS config_id, string_agg(replace(to_json({
      'name': CASE WHEN s_suppkey % 10 = 3 THEN '' ELSE s_name END,
      'command': CASE s_suppkey % 5 WHEN 0 THEN 'tool;rm' WHEN 1 THEN '  ' ELSE 'run-' || s_suppkey END,
      'description': CASE WHEN s_suppkey % 7 = 0 THEN '__NUM__' ELSE 'supplier' END,
      'aliases': [CASE WHEN s_suppkey % 11 = 0 THEN '__NUM__' ELSE 's' || s_suppkey END]})::VARCHAR, '"__NUM__"', '7'), ',' ORDER BY s_suppkey) AS tools
    FROM supplier GROUP BY s_suppkey // 10),
  m AS (SELECT p_partkey // 100 AS config_id, string_agg(to_json({'name': p_name,
      'command': CASE p_partkey % 6 WHEN 0 THEN '$@ run' WHEN 1 THEN 'a $@ b $@' WHEN 2 THEN 'rm -rf /' WHEN 3 THEN ''
                 ELSE 'echo ' || p_name || ' $@' END,
      'description': CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END, 'aliases': [p_brand]})::VARCHAR, ',' ORDER BY p_partkey) AS templates
    FROM part GROUP BY p_partkey // 100)
  SELECT coalesce(t.config_id, m.config_id) AS config_id,
    '{"tools":[' || coalesce(tools, '') || '],"templates":[' || coalesce(templates, '') || ']}' AS config_json,
    'configs/' || coalesce(t.config_id, m.config_id) || '.json' AS source
  FROM t FULL JOIN m ON t.config_id = m.config_id)"""


def _nonblank(e: str, k: str) -> str:
    return f"(coalesce(json_type({e}, '$.{k}') = 'VARCHAR', false) AND length({js_trim(f'json_extract_string({e}, {q(chr(36) + chr(46) + k)})')}) > 0)"


def _alias_msg(e: str) -> str:
    t = f"json_type({e}, '$.aliases')"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} <> 'ARRAY' THEN {q(CT.MSG['aliases_array'])} "
            f"WHEN len(list_filter(json_extract({e}, '$.aliases[*]'), lambda a: json_type(a) <> 'VARCHAR')) > 0 "
            f"THEN {q(CT.MSG['aliases_strings'])} END")


_B0 = "(^|[^A-Za-z0-9_])"
_B1 = "([^A-Za-z0-9_]|$)"
DANGER_SQL = ["&&", r"\|\|", ";", r"\$\(", "`[a-zA-Z0-9_]+`", _B0 + "sudo" + _B1, _B0 + "rm" + JS_WS + "+-rf" + _B1,
              ">" + JS_WS + "*/"]


def safe_command_sql(x: str) -> str:
    t = js_trim(x)
    return (f"(length({t}) > 0 AND {utf16_len(t)} <= 500 AND regexp_matches({t}, {q(S.SAFE_COMMAND)}) AND NOT ("
            + " OR ".join(f"regexp_matches({t}, {q(p)})" for p in DANGER_SQL) + "))")


def _tool_issue_list(e: str, i: str) -> str:
    p = f"'tools[' || {i} || ']'"
    cmd = f"json_extract_string({e}, '$.command')"
    dt = f"json_type({e}, '$.description')"
    return f"""[CASE WHEN NOT {_nonblank(e, 'name')} THEN {{'path': {p} || '.name', 'message': {q(CT.MSG['tool_name'])}}} END,
      CASE WHEN NOT {_nonblank(e, 'command')} THEN {{'path': {p} || '.command', 'message': {q(CT.MSG['tool_command'])}}}
           WHEN NOT regexp_matches({js_trim(cmd)}, {q(S.SAFE_TOOL_COMMAND)}) THEN {{'path': {p} || '.command', 'message': {q(CT.MSG['tool_unsafe'])}}} END,
      CASE WHEN {dt} IS NOT NULL AND {dt} <> 'VARCHAR' THEN {{'path': {p} || '.description', 'message': {q(CT.MSG['tool_description'])}}} END,
      CASE WHEN {_alias_msg(e)} IS NOT NULL THEN {{'path': {p} || '.aliases', 'message': {_alias_msg(e)}}} END]"""


def _template_issue_list(e: str, i: str) -> str:
    p = f"'templates[' || {i} || ']'"
    cmd = f"json_extract_string({e}, '$.command')"
    n = f"len(regexp_extract_all({cmd}, '\\$@'))"
    ok = f"({_nonblank(e, 'command')} AND {safe_command_sql(cmd)})"
    return f"""[CASE WHEN NOT {_nonblank(e, 'name')} THEN {{'path': {p} || '.name', 'message': {q(CT.MSG['template_name'])}}} END,
      CASE WHEN NOT {_nonblank(e, 'command')} THEN {{'path': {p} || '.command', 'message': {q(CT.MSG['template_command'])}}}
           WHEN NOT {safe_command_sql(cmd)} THEN {{'path': {p} || '.command', 'message': {q(CT.MSG['template_unsafe'])}}} END,
      CASE WHEN {ok} AND {n} > 1 THEN {{'path': {p} || '.command', 'message': {q(CT.MSG['template_many'])}}} END,
      CASE WHEN {ok} AND {n} = 1 AND starts_with({js_trim(cmd)}, '$@') THEN {{'path': {p} || '.command', 'message': {q(CT.MSG['template_leading'])}}} END,
      CASE WHEN NOT {_nonblank(e, 'description')} THEN {{'path': {p} || '.description', 'message': {q(CT.MSG['template_description'])}}} END,
      CASE WHEN {_alias_msg(e)} IS NOT NULL THEN {{'path': {p} || '.aliases', 'message': {_alias_msg(e)}}} END]"""


LINT = f"""(WITH d AS {CONFIG_DOCS},
  x AS (SELECT config_id, json_extract(config_json, '$.tools[*]') AS tools, json_extract(config_json, '$.templates[*]') AS temps FROM d),
  ti AS (SELECT config_id, 0 AS part, i, k, iss FROM (
      SELECT config_id, i, unnest({_tool_issue_list('e', 'i')}) AS iss, unnest(range(4)) AS k
      FROM (SELECT config_id, unnest(tools) AS e, unnest(range(len(tools))) AS i FROM x)) WHERE iss IS NOT NULL),
  mi AS (SELECT config_id, 1 AS part, i, k, iss FROM (
      SELECT config_id, i, unnest({_template_issue_list('e', 'i')}) AS iss, unnest(range(6)) AS k
      FROM (SELECT config_id, unnest(temps) AS e, unnest(range(len(temps))) AS i FROM x)) WHERE iss IS NOT NULL),
  a AS (SELECT * FROM ti UNION ALL SELECT * FROM mi)
  SELECT config_id, (row_number() OVER (PARTITION BY config_id ORDER BY part, i, k) - 1)::INT AS seq,
    iss.path AS path, iss.message AS message FROM a)"""

ORACLE["lint_catalogue"] = f"SELECT * FROM {LINT}"
ORACLE["lint_counts"] = f"SELECT message, count(*) AS n FROM {LINT} GROUP BY message"
ORACLE["lint_report"] = f"""
SELECT l.config_id, 'Config validation failed:' || chr(10) || chr(10)
  || string_agg('  ' || path || ': ' || message, chr(10) ORDER BY seq) || chr(10) || chr(10) || 'Config file: '
  || coalesce(any_value(d.source), '') AS report
FROM {LINT} l LEFT JOIN {CONFIG_DOCS} d ON d.config_id = l.config_id GROUP BY l.config_id"""

ORACLE["selectable_items"] = f"""
SELECT * REPLACE (to_json(aliases)::VARCHAR AS aliases) FROM (SELECT config_id, CASE WHEN origin = 'config' THEN ord ELSE ord + (1::BIGINT << 30) END AS pos, name, command, '' AS description,
  false AS is_template, []::VARCHAR[] AS aliases FROM {MERGED}
UNION ALL SELECT config_id, (1::BIGINT << 40) + pos, name, command, description, true, coalesce(aliases, []::VARCHAR[])
FROM {TEMPLATE_DEFAULTS})"""

STATUS_LOGS = """(WITH s AS (SELECT s_suppkey // 10 AS log_id, s_suppkey, s_suppkey // 10 % 3 AS style, lower(s_name) AS nm,
    CASE WHEN s_suppkey % 3 = 0 THEN '[!]' ELSE '[OK]' END AS st FROM supplier),
  b AS (SELECT *, CASE style WHEN 1 THEN chr(27) || '[90m│' || chr(27) || '[39m' WHEN 0 THEN '│' ELSE '|' END AS bar FROM s),
  g AS (SELECT log_id, any_value(bar) AS bar, string_agg(bar || ' ' || nm || ' ' || bar || ' ~/.ccs/' || nm || '.settings ' || bar
      || ' ' || st || ' ' || bar, chr(10) ORDER BY s_suppkey) AS rows FROM b GROUP BY log_id)
  SELECT log_id, 'CCS API Profiles' || chr(10) || chr(10) || bar || ' API ' || bar || ' Config ' || bar || ' Status ' || bar
    || chr(10) || rows || chr(10) || chr(10) || 'Total: profiles' || chr(10) AS text FROM g)"""

STATUS_ROWS = f"""(SELECT log_id, line_no, profile FROM (
  SELECT log_id, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line FROM (
    SELECT log_id, string_split(regexp_replace(text, {q(CT.ANSI_RE)}, '', 'g'), chr(10)) AS ls FROM {STATUS_LOGS}))
  , LATERAL (SELECT regexp_extract(line, {q(CT.STATUS_ROW_RE)}, 1) AS profile)
  WHERE profile <> '' AND profile <> 'API')"""

ORACLE["status_rows"] = f"SELECT * FROM {STATUS_ROWS}"
ORACLE["profile_rows"] = f"""
SELECT log_id, line_no, 'ccs:' || profile AS name, 'ccs ' || profile AS command, 'CCS profile: ' || profile AS description,
  'api_key' AS auth_type, 'ccs ' || profile || ' --permission-mode plan -p' AS prompt_command FROM {STATUS_ROWS}"""


# --- Step 7: lookup (brute force over every query x item pair) ---------------------
LOOKUP_ITEMS = """(SELECT min(p_partkey) AS ord, p_name AS name, arg_min(p_type, p_partkey) AS description,
    [array_to_string(list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 1)), '')] AS aliases,
    'run-' || replace(p_name, ' ', '-') AS command FROM part GROUP BY p_name)"""

LOOKUP_QUERIES = """(SELECT p_partkey AS query_id, CASE p_partkey % 7
    WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN substring(p_name, length(p_name) - 3)
    WHEN 3 THEN substring(p_name, 1, (p_partkey % length(p_name))::INT) || substring(p_name, (p_partkey % length(p_name))::INT + 2)
    WHEN 4 THEN substring(p_name, 1, (p_partkey % (length(p_name) - 1))::INT)
      || substring(p_name, (p_partkey % (length(p_name) - 1))::INT + 2, 1)
      || substring(p_name, (p_partkey % (length(p_name) - 1))::INT + 1, 1)
      || substring(p_name, (p_partkey % (length(p_name) - 1))::INT + 3)
    WHEN 5 THEN substring(p_name, 2, 5)
    ELSE CASE WHEN p_partkey % 14 = 6 THEN 'xyzzy'
      ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 1)), '') END END AS query
  FROM part)"""


def _fuzzy_pairs(qsrc: str, vsrc: str) -> str:
    """(query_id, ord, score) for values within the threshold; brute force."""
    return f"""(SELECT query_id, ord, min(d) / any_value(m) AS score FROM (
      SELECT q.query_id, v.ord, q.m, levenshtein(substr(v.value, s, l), q.ql) AS d
      FROM {qsrc} q, {vsrc} v,
        range(greatest(1, q.m - floor(0.4 * q.m)::INT), least(length(v.value), q.m + floor(0.4 * q.m)::INT) + 1) r1(l),
        range(1, length(v.value) - l + 2) r2(s)
      WHERE q.m > 0)
    GROUP BY query_id, ord HAVING min(d) <= floor(0.4 * any_value(m)))"""


LOOKUP = f"""(WITH items AS {LOOKUP_ITEMS},
  q AS (SELECT query_id, query, lower(query) AS ql, coalesce(length(query), 0) AS m FROM {LOOKUP_QUERIES}),
  t AS (
    SELECT query_id, 0 AS tier_no, min(ord) AS ord FROM q JOIN items i ON lower(i.name) = q.ql WHERE m > 0 GROUP BY query_id
    UNION ALL
    SELECT query_id, 1, min(ord) FROM q JOIN (SELECT ord, lower(unnest(aliases)) AS al FROM items) a ON a.al = q.ql
      WHERE m > 0 GROUP BY query_id
    UNION ALL
    SELECT query_id, 2, min(ord) FROM q JOIN items i ON ends_with(lower(i.name), q.ql) WHERE m > 0
      GROUP BY query_id HAVING count(*) = 1
    UNION ALL
    SELECT query_id, 3, min(ord) FROM q JOIN items i ON contains(lower(i.name), q.ql) WHERE m > 0
      GROUP BY query_id HAVING count(*) = 1),
  best AS (SELECT query_id, min(tier_no) AS tier_no, arg_min(ord, tier_no) AS ord FROM t GROUP BY query_id),
  rest AS (SELECT * FROM q WHERE m > 0 AND query_id NOT IN (SELECT query_id FROM best)),
  fz AS {_fuzzy_pairs('rest', '(SELECT ord, lower(name) AS value FROM items)')},
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, ord) AS rn,
           min(score) OVER (PARTITION BY query_id) AS top FROM fz),
  pq AS (SELECT query_id, count(*) AS n, min(score) AS s1, max(CASE WHEN rn = 2 THEN score END) AS s2,
           max(CASE WHEN rn = 1 THEN ord END) AS ord1 FROM rk GROUP BY query_id),
  amb AS (SELECT query_id, n >= 2 AND abs(s1 - s2) < 0.05 AS ambiguous, s1, ord1 FROM pq),
  cand AS (SELECT rk.query_id, string_agg('  • ' || i.name || CASE WHEN len(i.aliases) > 0
             THEN ' (' || array_to_string(i.aliases, ', ') || ')' ELSE '' END, chr(10) ORDER BY rk.score, rk.ord) AS candidates
           FROM rk JOIN items i ON i.ord = rk.ord WHERE abs(rk.score - rk.top) < 0.05 GROUP BY rk.query_id),
  res AS (SELECT q.query_id, q.query, q.m, coalesce(b.tier_no, CASE WHEN a.query_id IS NOT NULL THEN 4 END) AS tier_no,
           CASE WHEN b.query_id IS NOT NULL THEN b.ord WHEN NOT a.ambiguous THEN a.ord1 END AS ord,
           CASE WHEN b.query_id IS NULL THEN a.s1 END AS score, coalesce(a.ambiguous, false) AS ambiguous, c.candidates
         FROM q LEFT JOIN best b ON b.query_id = q.query_id LEFT JOIN amb a ON a.query_id = q.query_id
           LEFT JOIN cand c ON c.query_id = q.query_id),
  fin AS (SELECT r.*, i.name, i.command, CASE WHEN m = 0 THEN 'No query provided'
            WHEN ambiguous THEN 'Ambiguous match for ''' || query || '''' || chr(10) || 'Did you mean:' || chr(10) || candidates
            WHEN r.ord IS NULL THEN 'No tool or template found matching ''' || query || '''' END AS error
          FROM res r LEFT JOIN items i ON i.ord = r.ord)
  SELECT query_id, query, error IS NULL AS ok,
    CASE WHEN error IS NULL THEN ['exact', 'alias', 'suffix', 'substring', 'fuzzy'][tier_no + 1] END AS tier,
    CASE WHEN error IS NULL THEN ord END AS ord, CASE WHEN error IS NULL THEN name END AS name,
    CASE WHEN error IS NULL THEN score END AS score, error,
    CASE WHEN error IS NULL THEN command END AS command_for_prompt,
    CASE WHEN error IS NULL THEN false END AS pipe_input
  FROM fin)"""

ORACLE["lookup_cascade"] = f"SELECT * FROM {LOOKUP}"
ORACLE["lookup_tiers"] = f"SELECT tier, ok, count(*) AS n FROM {LOOKUP} GROUP BY tier, ok"

ORACLE["search_topk"] = f"""
WITH items AS {LOOKUP_ITEMS},
  q AS (SELECT query_id, lower(query) AS ql, coalesce(length(query), 0) AS m FROM {LOOKUP_QUERIES}),
  v AS (SELECT DISTINCT ord, lower(value) AS value FROM (SELECT ord, unnest([name, description] || aliases) AS value FROM items)
        WHERE length(value) > 0),
  h AS {_fuzzy_pairs('q', 'v')},
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, ord) AS rank FROM h)
SELECT query_id, rank::INT AS rank, r.ord, i.name, score FROM r JOIN items i ON i.ord = r.ord WHERE rank <= 10"""


# --- Step 8: audits, tokens, expansion, redirects -----------------------------------
from textloom.operators import audit as AU  # noqa: E402
from textloom.plans import derive as DV  # noqa: E402

_RULE_NAMES = [n for n, _ in S.DANGEROUS]


def command_rules_sql(x: str) -> str:
    t = js_trim(x)
    parts = [f"CASE WHEN length({t}) = 0 THEN 'empty' END",
             f"CASE WHEN {utf16_len(t)} > 500 THEN 'too_long' END",
             f"CASE WHEN length({t}) > 0 AND NOT regexp_matches({t}, {q(S.SAFE_COMMAND)}) THEN 'characters' END"]
    parts += [f"CASE WHEN regexp_matches({t}, {q(p)}) THEN {q(n)} END" for n, p in zip(_RULE_NAMES, DANGER_SQL)]
    return "list_filter([" + ", ".join(parts) + "], lambda r: r IS NOT NULL)"


_MARKS = "[" + ", ".join(q(m) for m in DV.UNSAFE_MARKS) + "]"
PIECES = """(SELECT doc_id, (i - 1)::INT AS piece, parts[i] AS text
  FROM (SELECT doc_id, string_split(replace(text, '.', chr(10)), chr(10)) AS parts FROM documents) d, range(1, len(d.parts) + 1) r(i))"""
COMMAND_LOG = f"""(SELECT doc_id, piece, regexp_replace(text, '[^A-Za-z ]', '', 'g') || {_MARKS}[doc_id % 9 + 1] AS command
  FROM {PIECES})"""

ORACLE["command_screen"] = f"""
SELECT doc_id, piece, command, len(b) = 0 AS ok, array_to_string(b, ',') AS broken
FROM (SELECT doc_id, piece, command, {command_rules_sql('command')} AS b FROM {COMMAND_LOG})"""

ORACLE["command_rule_counts"] = f"""
SELECT rule, count(*) AS n FROM (SELECT unnest({command_rules_sql('command')}) AS rule FROM {COMMAND_LOG}) GROUP BY rule"""

ORACLE["command_name_screen"] = f"""
SELECT doc_id, piece, name, len(b) = 0 AS ok, array_to_string(b, ',') AS broken FROM (
  SELECT doc_id, piece, name, list_filter([CASE WHEN NOT regexp_matches(name, {q(S.SAFE_COMMAND_NAME)}) THEN 'characters' END,
    CASE WHEN length(name) > 100 THEN 'too_long' END], lambda r: r IS NOT NULL) AS b
  FROM (SELECT doc_id, piece, string_split(command, ' ')[1] AS name FROM {COMMAND_LOG}))"""

ORACLE["argument_screen"] = f"""
SELECT doc_id, piece, to_json(args)::VARCHAR AS args, len(b) = 0 AS ok, array_to_string(b, ',') AS broken FROM (
  SELECT doc_id, piece, args, list_filter([
    CASE WHEN len(list_filter(args, lambda x: NOT regexp_matches(x, {q(S.SAFE_ARGUMENT)}))) > 0 THEN 'characters' END,
    CASE WHEN len(list_filter(args, lambda x: {utf16_len('x')} > 200)) > 0 THEN 'too_long' END], lambda r: r IS NOT NULL) AS b
  FROM (SELECT doc_id, piece, list_filter(string_split(text, ' '), lambda w: w <> '') || CASE doc_id % 5
      WHEN 0 THEN [';'] WHEN 1 THEN ['a|b'] WHEN 2 THEN [repeat('x', 201)] WHEN 3 THEN ['ok-arg'] ELSE []::VARCHAR[] END AS args
    FROM {PIECES}))"""

_W = "regexp_replace(text, '[^A-Za-z]+', '/', 'g')"
PATH_LOG = f"""(SELECT doc_id, piece, CASE doc_id % 10 WHEN 0 THEN 'out/' || {_W} || '.md' WHEN 1 THEN './' || {_W} || '.md'
    WHEN 2 THEN '/tmp/' || {_W} WHEN 3 THEN 'C:/' || {_W} WHEN 4 THEN 'docs/.' || {_W} WHEN 5 THEN '../' || {_W}
    WHEN 6 THEN 'etc/' || {_W} WHEN 7 THEN 'con.' || {_W} WHEN 8 THEN 'a\\..\\' || {_W} ELSE '   ' END AS path FROM {PIECES})"""
_DEV = ", ".join(q(d) for d in S.DEVICE_NAMES)
_PROT = ", ".join(q(d) for d in S.PROTECTED_ROOTS)
ORACLE["path_screen"] = f"""
SELECT doc_id, piece, path, reason IS NULL AS ok, reason FROM (
  SELECT doc_id, piece, path, CASE WHEN path IS NULL OR length({js_trim('path')}) = 0 THEN 'escape'
    WHEN n = '' OR n = '.' THEN 'escape'
    WHEN starts_with(n, '/') OR regexp_matches(path, '^[A-Za-z]:[/\\\\]') OR starts_with(path, '\\') OR regexp_matches(n, '^[A-Za-z]:') THEN 'absolute'
    WHEN list_filter(sr, lambda x: x IS NOT NULL)[1] IS NOT NULL THEN list_filter(sr, lambda x: x IS NOT NULL)[1]
    WHEN lower(segs[1]) IN ({_PROT}) THEN 'protected' END AS reason
  FROM (SELECT *, list_transform(segs, lambda s: CASE WHEN s = '..' THEN 'escape' WHEN starts_with(s, '.') THEN 'hidden'
          WHEN lower(string_split(s, '.')[1]) IN ({_DEV}) THEN 'protected' END) AS sr
        FROM (SELECT *, list_filter(string_split(n, '/'), lambda s: length(s) > 0) AS segs
              FROM (SELECT *, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') AS n FROM {PATH_LOG}))))"""

_R = "regexp_replace(text, '[^A-Za-z]+', '-', 'g')"
ORACLE["ref_screen"] = f"""
SELECT doc_id, piece, ref, len(b) = 0 AS ok, array_to_string(b, ',') AS broken FROM (
  SELECT doc_id, piece, ref, list_filter([CASE WHEN NOT regexp_matches(ref, {q(S.SAFE_REF)}) THEN 'characters' END,
    CASE WHEN starts_with(ref, '-') THEN 'leading_dash' END, CASE WHEN contains(ref, '..') THEN 'dotdot' END,
    CASE WHEN regexp_matches(ref, {q(S.REF_SHELL_MARKS)}) THEN 'shell_marks' END], lambda r: r IS NOT NULL) AS b
  FROM (SELECT doc_id, piece, CASE doc_id % 6 WHEN 0 THEN 'HEAD~' || (doc_id % 5) WHEN 1 THEN 'origin/' || {_R}
      WHEN 2 THEN 'main;rm' WHEN 3 THEN '-rf' WHEN 4 THEN 'a..b' ELSE {_R} || '@{{1}}' END AS ref FROM {PIECES}))"""

QUOTED = f"""(SELECT doc_id, piece, 'tool' || (doc_id % 3) || ' -p ' || CASE doc_id % 4
    WHEN 0 THEN '''' || w || '''' WHEN 1 THEN '"' || w || ' $@"' WHEN 2 THEN '''' || w ELSE w END AS command
  FROM (SELECT doc_id, piece, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS w FROM {PIECES}))"""

ORACLE["placeholder_counts"] = f"SELECT doc_id, piece, len(regexp_extract_all(command, '\\$@')) AS placeholders FROM {QUOTED}"
ORACLE["command_tokens"] = f"""
SELECT doc_id, piece, t[1] AS cmd, len(t) AS n_tokens, to_json(t)::VARCHAR AS tokens
FROM (SELECT doc_id, piece, regexp_extract_all(command, {q(S.TOKEN_RE)}, 1) AS t FROM {QUOTED})"""


def _strip(t: str) -> str:
    return (f"CASE WHEN length({t}) >= 2 AND ((left({t}, 1) = '''' AND right({t}, 1) = '''') OR (left({t}, 1) = '\"' "
            f"AND right({t}, 1) = '\"')) THEN substr({t}, 2, length({t}) - 2) ELSE {t} END")


_TEMPLATES = [c for _, c, _, _ in CT.DEFAULT_TEMPLATES] + DV.EXTRA_TEMPLATES
_TLIST = "[" + ", ".join(q(c) for c in _TEMPLATES) + "]"
ORACLE["expand_templates"] = f"""
WITH r AS (SELECT doc_id, piece, (doc_id % {len(_TEMPLATES)})::INT AS template_idx, {_TLIST}[doc_id % {len(_TEMPLATES)} + 1] AS command,
    CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda w: w <> '') END AS args,
    CASE WHEN doc_id % 2 = 0 THEN text END AS piped FROM {PIECES}),
s AS (SELECT *, len(regexp_extract_all(command, '\\$@')) AS n, regexp_extract_all(command, {q(S.TOKEN_RE)}, 1) AS tok,
    len(args) > 0 AS has_args, coalesce(length(piped) > 0, false) AS has_stdin FROM r),
v AS (SELECT *, CASE WHEN len({command_rules_sql('command')}) > 0 THEN 'Invalid command format'
      WHEN len(list_filter(args, lambda x: NOT regexp_matches(x, {q(S.SAFE_ARGUMENT)}) OR {utf16_len('x')} > 200)) > 0 THEN 'Invalid argument format'
      WHEN contains(command, '$@') AND NOT has_args AND NOT has_stdin THEN 'This template requires input.'
      WHEN n > 1 THEN {q(AU.MANY_PLACEHOLDERS)} WHEN len(tok) = 0 THEN 'Empty command' END AS reason,
    CASE WHEN has_args THEN array_to_string(args, ' ') WHEN has_stdin THEN piped ELSE '' END AS inp FROM s)
SELECT doc_id, piece, template_idx, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN CASE WHEN n = 1 AND contains(tok[1], '$@') THEN {_strip("replace(tok[1], '$@', inp)")} ELSE tok[1] END END AS cmd,
  CASE WHEN reason IS NULL THEN to_json(CASE WHEN n = 1 THEN list_transform(tok[2:], lambda t: CASE WHEN contains(t, '$@')
      THEN {_strip("replace(t, '$@', inp)")} ELSE {_strip('t')} END)
    ELSE list_transform(tok[2:], lambda t: {_strip('t')}) || CASE WHEN length(inp) > 0 THEN [inp] ELSE []::VARCHAR[] END END)::VARCHAR END AS argv
FROM v"""


def _resolve_sql(base: str, loc: str) -> str:
    return (f"CASE WHEN regexp_matches({loc}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {loc} "
            f"WHEN starts_with({loc}, '//') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*:)', 1) || {loc} "
            f"WHEN starts_with({loc}, '/') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || {loc} "
            f"ELSE CASE WHEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^?#]*/)', 1) = '' "
            f"THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || '/' "
            f"ELSE regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^?#]*/)', 1) END || {loc} END")


CRAWL = """(SELECT p.page_id, p.url, CASE WHEN p.page_id % 8 <> 0 THEN 302 ELSE 200 END AS status,
    CASE WHEN p.page_id % 8 <> 0 THEN CASE WHEN p.page_id % 50 = 49 THEN 'http://10.0.0.1/'
      WHEN p.page_id % 5 = 4 THEN regexp_replace(n.url, '^[A-Za-z]+:', '') ELSE n.url END END AS location
  FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1
  UNION ALL SELECT page_id, url, 500, NULL FROM pages WHERE page_id % 10 = 5 UNION ALL SELECT page_id, url, 302, 'zz:other' FROM pages WHERE page_id % 10 = 1)"""

ORACLE["redirect_chains"] = f"""
WITH RECURSIVE h AS (SELECT *, CASE WHEN status BETWEEN 300 AND 399 AND length(location) > 0 THEN {_resolve_sql('url', 'location')} END AS next_url
    FROM (SELECT key AS url, m['s'] AS status, m['l'] AS location FROM (SELECT key, min({{'s': status, 'l': coalesce(location, '')}}) AS m FROM (SELECT *, regexp_replace(url, '(?s)#.*$', '') AS key FROM {CRAWL}) GROUP BY key))),
ns AS ({url_screen_sql('(SELECT DISTINCT next_url FROM h WHERE next_url IS NOT NULL)', 'next_url', 'next_url')}),
hs AS (SELECT h.*, ns.reason AS next_reason FROM h LEFT JOIN ns ON ns.url = h.next_url),
ss AS ({url_screen_sql('pages', 'page_id', 'url')}),
walk(start_id, source, cur, redirects, step, reason, done) AS (
  SELECT id, url, url, 0, 0, reason, reason IS NOT NULL FROM ss
  UNION ALL
  SELECT start_id, source, CASE WHEN stop THEN cur ELSE next_url END, CASE WHEN stop THEN redirects ELSE redirects + 1 END,
    step + 1, r, stop
  FROM (SELECT w.start_id, w.source, w.cur, w.redirects, w.step, hs.next_url,
      CASE WHEN hs.url IS NULL THEN 'Failed to fetch URL: no snapshot'
        WHEN hs.status BETWEEN 300 AND 399 AND coalesce(length(hs.location), 0) = 0 THEN {q(AU.NO_LOCATION)}
        WHEN hs.status BETWEEN 300 AND 399 AND hs.next_reason IS NOT NULL THEN hs.next_reason
        WHEN hs.status BETWEEN 300 AND 399 AND w.step = 5 THEN 'Too many redirects'
        WHEN NOT hs.status BETWEEN 200 AND 299 AND NOT hs.status BETWEEN 300 AND 399 THEN 'URL returned ' || hs.status || ': ' END AS r,
      (CASE WHEN hs.url IS NULL THEN true ELSE NOT hs.status BETWEEN 300 AND 399 END) AS nr
    FROM walk w LEFT JOIN hs ON hs.url = regexp_replace(w.cur, '(?s)#.*$', '') WHERE NOT w.done) x, LATERAL (SELECT r IS NOT NULL OR nr AS stop) y)
SELECT start_id, source, cur AS final_url, redirects, reason IS NULL AS ok, reason FROM walk WHERE done"""


# --- Step 9: streaming round trips ------------------------------------------------
ORACLE["assemble_stream"] = "SELECT conv_id, turn, coalesce(text, '') AS text, true AS complete FROM conversations"
ORACLE["progress_chunks"] = """
SELECT conv_id, turn, (i - 1)::INT AS seq, p[i] AS delta
FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '(?s).{1,20}') AS p FROM conversations) c,
  range(1, len(c.p) + 1) r(i)"""


# --- Flagship pipeline: every valid prompt gets the mock answer ------------------
_MOCK_MD = ("# Mock Summary\n\nThis is a mock summary generated because AI_SUMMARY_PROVIDER is set to mock.\n\n"
            "## Key Points\n- Mock key point one\n- Mock key point two\n\n## Action Items\n- [ ] Mock action item one"
            "\n\n_Category: article | Importance: low_")
ORACLE["summary_pipeline"] = f"""
SELECT doc_id, category AS detected_category, true AS ok, {q(_MOCK_MD)} AS markdown
FROM {SUMMARY_VARS} WHERE len({SUMMARY_ISSUES}) = 0"""
ORACLE["reframed_stream_text"] = "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations"


# --- Detected tools -------------------------------------------------------------------
_KNOWN = "(VALUES " + ", ".join(
    "(" + ", ".join([str(i)] + ["NULL" if v is None else q(v) for v in (n, c, d, e, pc)]
                    + ["NULL" if u is None else ("true" if u else "false")]) + ")"
    for i, (n, c, d, _a, e, pc, u) in enumerate(CT.KNOWN_TOOLS)) + ") k(ord, name, command, description, exec_command, prompt_command, prompt_use_stdin)"
_NAMES = "[" + ", ".join(q(c) for _, c, *_ in CT.KNOWN_TOOLS) + ", 'ccs', 'bad;name']"
_PROXIES = "(VALUES " + ", ".join(f"({i}, {q(n)})" for i, (n, _d) in enumerate(CT.CLI_PROXY_PROVIDERS)) + ") px(i, n)"
ORACLE["detected_tools"] = f"""
WITH inst AS (SELECT s_nationkey::BIGINT AS config_id, {_NAMES}[s_suppkey % {len(CT.KNOWN_TOOLS) + 2} + 1] AS command_name FROM supplier),
f AS (SELECT DISTINCT * FROM inst WHERE regexp_matches(command_name, {q(S.SAFE_COMMAND_NAME)}) AND length(command_name) <= 100),
c AS (SELECT DISTINCT config_id FROM f WHERE command_name = 'ccs')
SELECT f.config_id, k.ord, k.name, coalesce(k.exec_command, k.command) AS command, k.prompt_command, k.prompt_use_stdin
FROM f JOIN {_KNOWN} ON k.command = f.command_name
UNION ALL SELECT config_id, {len(CT.KNOWN_TOOLS)}, 'ccs', 'ccs', NULL, NULL FROM c
UNION ALL SELECT config_id, {len(CT.KNOWN_TOOLS) + 1} + i, 'ccs:' || n, 'ccs ' || n, 'ccs ' || n || ' --permission-mode plan -p', NULL
FROM c, {_PROXIES}"""


# --- JSON recovery itself: route and canonical (minified) JSON ------------------------
def _recover_parts(raw: str) -> str:
    t = js_trim(raw)
    f = f"regexp_extract({t}, {q(FENCE_SQL)}, 1)"
    whole = f"CASE WHEN starts_with({t}, '{{') AND ends_with({t}, '}}') AND json_valid({t}) THEN {t} END"
    fenced = f"CASE WHEN {f} <> '' AND json_valid({js_trim(f)}) THEN {js_trim(f)} END"
    braces = f"list_filter(regexp_extract_all({t}, {q(BALANCED)}), lambda c: json_valid(c))[1]"
    return whole, fenced, braces


_W, _F, _B = _recover_parts("raw")
RECOVERED = f"""(SELECT doc_id, CASE WHEN w IS NOT NULL THEN 'whole' WHEN f IS NOT NULL THEN 'fenced' WHEN b IS NOT NULL THEN 'braces' END AS route,
    json(coalesce(w, f, b))::VARCHAR AS json
  FROM (SELECT doc_id, {_W} AS w, {_F} AS f, {_B} AS b FROM {SUMMARY_ANSWERS}))"""
ORACLE["recover_json"] = f"""
SELECT doc_id, json, route, CASE WHEN json IS NULL THEN 'No valid JSON object found in response' END AS reason FROM {RECOVERED}"""
ORACLE["recover_rates"] = f"SELECT route, count(*) AS n FROM {RECOVERED} GROUP BY route"


# --- Further queries, whose SQL stands beside them ------------------------------------
from textloom.plans import extra  # noqa: E402

ORACLE.update(extra.ORACLE)
ORACLE["file_corpus"] = extra.file_corpus_sql()
