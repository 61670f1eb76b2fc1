"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted by (turn, role, text);
array functions then merge neighbouring turns of one role into one block and
join everything into one string:

    <s>role[INST]text[/INST]next text of the same role</s><s>role[INST]...</s>

Control strings inside roles and texts get a backslash before their last
character (one more where they already have some), which reading back removes,
so any text survives and no text can open or close a block.

The loss mask lists the spans of trained-on text (code points of the formatted
string): the escaped texts of the given roles, without any marker.

Null roles and texts count as empty; rows of null conversations form one
conversation; repeated rows are kept as turns of their own; an empty table gives
no rows. A conversation's text is one value by nature, so its rows meet in one
group; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"(</?s|\[/?INST)(\\*)([>\]])", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(</?s|\[/?INST)\\(\\*)([>\]])", "$1$2$3")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, length>>) per conversation; ``start`` from 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    got = (turns.select(F.col(conv_col).alias("conv_id"),
                        F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
           .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")))

    def part(t, i):
        role = escape(t["role"])
        opening = F.concat(F.lit(OPEN), role, F.lit(SEP))
        mark = (F.when(i == 0, opening).when(F.get("ts", i - 1)["role"] == t["role"], F.lit(NEXT))
                .otherwise(F.concat(F.lit(CLOSE), opening)))
        return F.struct(mark.alias("mark"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss"))

    # The generator keeps the planner from inlining one array step into the next.
    got = got.select("conv_id", F.inline(F.array(F.struct(F.transform("ts", part).alias("parts")))))
    size = lambda p: F.length(p["mark"]) + F.length(p["body"])
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda a, p: F.struct((a["at"] + size(p)).alias("at"), F.when(
            p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["mark"])).alias("start"),
                                                             F.length(p["body"]).cast("long").alias("length"))))
        ).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    whole = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(CLOSE))
    return got.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns read back from ``formatted``: (conv_id, formatted, loss_spans, turns array<struct<role, text>>)."""
    blocks = F.split("formatted", r"</s>")

    def block(b):
        body = F.substring_index(b, SEP, 1)
        role = unescape(F.substring(body, len(OPEN) + 1, 1 << 30))
        texts = F.split(F.substr(b, F.length(body) + len(SEP) + 1), r"\[/INST\]")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), block)))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
