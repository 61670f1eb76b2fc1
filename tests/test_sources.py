"""Sources and small library jobs: text corpus (S1), catalogue files (S6),
byte gate (S7), prompt registry (P6), user responder (U1)."""

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from textloom.operators.catalogue import explode_catalogue, read_catalogue
from textloom.operators.prompts import prompt_dimension
from textloom.operators.routing import MOCK_RESPONSE, respond
from textloom.sources.inputs import byte_gate, read_text_corpus


def test_text_corpus(spark):
    d = tempfile.mkdtemp(prefix="textloom-corpus-")
    with open(os.path.join(d, "a.txt"), "wb") as f:
        f.write(b"  hello \xff world \n")
    with open(os.path.join(d, "blank.txt"), "wb") as f:
        f.write(b" \n\t ")
    with open(os.path.join(d, "big.txt"), "wb") as f:
        f.write(b"x" * 1_000_005)
    rows = {os.path.basename(r["source"]): r for r in read_text_corpus(spark, d).collect()}
    assert rows["a.txt"]["content"] == "hello � world"
    assert not rows["blank.txt"]["ok"] and rows["blank.txt"]["reason"].startswith("File is empty: ")
    assert rows["big.txt"]["ok"] and len(rows["big.txt"]["content"]) == 12000


def test_catalogue_files(spark):
    d = tempfile.mkdtemp(prefix="textloom-config-")
    doc = {"tools": [{"name": "x", "command": "x", "aliases": ["y"]}],
           "templates": [{"name": "t", "command": "t $@", "description": "d"}]}
    with open(os.path.join(d, "config.json"), "w") as f:
        json.dump(doc, f, indent=2)
    cfg = read_catalogue(spark, d).withColumn("config_id", F.lit(1))
    tools, temps = explode_catalogue(cfg)
    assert [(r["ord"], r["name"], r["aliases"]) for r in tools.collect()] == [(0, "x", ["y"])]
    assert [(r["name"], r["command"]) for r in temps.collect()] == [("t", "t $@")]


def test_byte_gate(spark):
    df = spark.createDataFrame([("a" * 10,), ("é" * 6,)], "t string")
    got = [r["gate_ok"] for r in byte_gate(df, "t", limit=10).collect()]
    assert got == [True, False]


def test_prompt_registry(spark):
    rows = {r["prompt_id"]: r for r in prompt_dimension(spark).collect()}
    assert set(rows) == {"summarize-content", "classify-input", "extract-meeting"}
    assert rows["extract-meeting"]["variables"][0]["name"] == "transcript"


def test_respond_with_user_callable(spark):
    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(rid, i, MOCK_RESPONSE[j:j + 20]) for rid in pdf["rid"] for i, j in
               enumerate(range(0, len(MOCK_RESPONSE), 20))]
        return pd.DataFrame(out, columns=["rid", "seq", "delta"])
    req = spark.range(5).select(F.col("id").alias("rid"))
    out = respond(req, pieces, "rid long, seq int, delta string")
    texts = out.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))),
                                                            lambda s: s["delta"]), "").alias("t")).collect()
    assert len(texts) == 5 and all(json.loads(r["t"])["title"] == "Mock Summary" for r in texts)
