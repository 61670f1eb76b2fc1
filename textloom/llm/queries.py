"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.chat import format_chats, loss_text, read_chats
from textloom.llm.common import scratch_path
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.fim import fill_in_middle, restored
from textloom.llm.line_dedup import line_dedup
from textloom.llm.packing import pack
from textloom.llm.quality import quality_rules
from textloom.llm.secrets_crf import digest_columns, find_secrets, fit
from textloom.llm.setsketch import near_dedup
from textloom.llm.simhash_bk import near_simhash
from textloom.llm.spm import round_trip
from textloom.llm.suffix_dedup import suffix_dedup
from textloom.llm.token_align import align_corpus
from textloom.llm.warc import dedup_archives, page_records, read_archives, write_archives
from textloom.session import ensure_checkpoint_dir, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_warc")
def op1_warc(spark, sf):
    """Pages written as archives, repeated payloads resolved to revisits, the new archives read back."""
    raw, deduped = scratch_path(spark, "warc"), scratch_path(spark, "warc")
    write_archives(page_records(read_table(spark, sf, "pages")), raw)
    dedup_archives(spark, raw, deduped)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read_archives(spark, deduped, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
     b AS (SELECT payload_digest, payload_bytes, max(page_id) AS best FROM h GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM h JOIN b USING (payload_digest, payload_bytes)"""


TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file: the installed package's, else below TOKENIZERS."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf):
    return pack(read_table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json")).drop("ids")


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf):
    """All documents encoded and decoded again."""
    return round_trip(read_table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op5_chat_format")
def op5_chat_format(spark, sf):
    """All conversations and conversation -7 (control strings as texts), formatted and read back."""
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    back = read_chats(format_chats(rows.unionByName(extra))).withColumn("loss", loss_text())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE["op5_chat_format"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
     e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                  length(regexp_replace(role, '(</?s|\[/?INST)(\\*)([>\]])', '\1\\\2\3', 'g')) AS role_len,
                  length(regexp_replace(text, '(</?s|\[/?INST)(\\*)([>\]])', '\1\\\2\3', 'g')) AS text_len FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(text_len + CASE WHEN role = before THEN 7 ELSE 13 + role_len END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op6_exact_dedup")
def op6_exact_dedup(spark, sf):
    return exact_dedup(read_table(spark, sf, "documents"))


ORACLE["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


@query("op8_quality_rules")
def op8_quality_rules(spark, sf):
    return quality_rules(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query("op7_line_dedup")
def op7_line_dedup(spark, sf):
    """Per document what is left of its lines."""
    docs = line_dedup(read_table(spark, sf, "documents").select("doc_id", "text"), min_words=1)
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("kept_chars"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op9_near_dedup")
def op9_near_dedup(spark, sf):
    return near_dedup(read_table(spark, sf, "documents"))


@query("op10_secret_scans")
def op10_secret_scans(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return digest_columns(find_secrets(docs, fit(docs), with_text=False))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf):
    return suffix_dedup(read_table(spark, sf, "documents")).drop("kept")


@query("op11_fill_in_middle")
def op11_fill_in_middle(spark, sf):
    """All documents transformed, and rebuilt from output and form."""
    done = fill_in_middle(read_table(spark, sf, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored()).alias("restored_sha256"))


ORACLE["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     g AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
     p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


@query("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark, sf):
    return near_simhash(read_table(spark, sf, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark, sf):
    return align_corpus(read_table(spark, sf, "documents"), (tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")))
