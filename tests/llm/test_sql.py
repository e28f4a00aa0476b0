"""Numbered queries with a SQL form, and the chat and licence operators on edge cases."""

import time

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from loamtree.llm import chat_format, license_scan, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], sf_dir)


def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", "a\\<|end|>\n"), (1, 1, "user", "x<|part|>"), (1, 3, "assistant", "</s>[INST] \\"), (1, 4, "user", None), (None, 1, "user", "n"), (None, None, None, "<|"),
        (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 1, "<|turn|>", "<|text|>\\\\"), (4, 1, "assistant", "é😀" * 5000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "pieces": F.lit("x"), "formatted": F.lit(None)})
    out = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(turns)).collect()}
    assert len(out) == 5
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, r in out.items():
        want = sorted([x for x in rows if x[0] == conv], key=order)
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in want]
        assert r.loss_text == "".join(x[3] or "" for x in want if x[2] == "assistant")
    assert chat_format.parse_chats(chat_format.format_chats(turns.limit(0))).count() == 0


def test_licences(spark):
    mit = dict(license_scan.KNOWN[:1])["MIT"]
    rows = [
        (1, "Copyright (c) 2001 Someone\n\n" + mit.upper().replace(" ", "  ")), (2, "text\n" + "Released under the MIT licence.\nmore"), (3, None), (4, ""), (5, "MIT"), (6, "Licensed under CC BY 4.0.\nReleased under the MIT License.\nLicensed under CC-BY 4.0"),
        (5, "MIT"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit("x"), "digest": F.lit(1), "line": F.lit(2), "row": F.lit(3)})
    out = sorted((r.doc_id, r.license, r.notices, r.n_notices) for r in license_scan.license_scan(docs).collect())
    assert [x for x in out if x[0] not in (5,)] == [(1, "MIT", "MIT", 1), (2, None, "MIT", 1), (3, None, "", 0), (4, None, "", 0), (6, None, "CC-BY-4.0,MIT", 3)]
    assert sum(x[0] == 5 for x in out) == 2
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_a_conversation_of_very_many_turns(spark):
    """Work is in proportion to the turns: 60,000 of them, and texts of many parts with characters outside the base plane."""
    n = 60_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("😀<|end|> "), F.col("id").cast("string")).alias("text"))
    long = spark.createDataFrame([(2, 0, "assistant", "é😀x" * 50_000), (2, 1, "user", ""), (2, 2, "assistant", "y\\" * 70_000)], "conv_id int, turn long, role string, text string")
    began = time.time()
    out = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(turns.unionByName(long))).collect()}
    assert time.time() - began < 30
    assert [t.text for t in out[1].turns] == [f"😀<|end|> {i}" for i in range(n)]
    assert out[1].loss_text == "".join(f"😀<|end|> {i}" for i in range(1, n, 2))
    assert out[2].loss_text == "é😀x" * 50_000 + "y\\" * 70_000
