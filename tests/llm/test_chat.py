"""Canonical turns, the reversible template, the loss mask."""

from __future__ import annotations

import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainwise.llm import chat
from tests.compare import difference, oracle_connection
from tests.llm.conftest import FOLDER


def test_matches_oracle(spark):
    assert difference(chat.query(spark, FOLDER), oracle_connection(FOLDER), chat.ORACLE) is None


def test_layouts_become_the_same_turns(spark):
    want = [("user", "ask"), ("assistant", "say")]
    records = {
        "messages": {"messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": "say"}]},
        "from_value": {"conversations": [{"from": "human", "value": "ask"}, {"from": "gpt", "value": "say"}]},
        "instruction": {"instruction": "ask", "output": "say"},
        "prompt_completion": {"prompt": "ask", "completion": "say"},
        "prompt_response": {"response": "say", "prompt": "ask"},
        "question_answer": {"question": "ask", "answer": "say"},
        "turn_rows": {"turns": [{"turn": 2, "role": "assistant", "text": "say"}, {"turn": 1, "role": "user", "text": "ask"}]},
        "instruction_input": {"instruction": "ask", "input": "", "output": "say"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()]
    got = chat.canonical_turns(spark.createDataFrame(rows, "name string, payload string"), "payload").collect()
    for r in got:
        turns = [tuple(t) for t in r.turns if t.text]
        assert (r.layout, turns) == (r.name, want), r


def test_unknown_and_broken_records(spark):
    rows = [(1, "{bad"), (2, None), (3, '{"other": 1}'), (4, "[]"), (5, '{"prompt": null, "completion": "x"}')]
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(rows, "id int, payload string"), "payload").collect()}
    assert all(got[i].layout is None and got[i].turns is None for i in (1, 2, 3, 4))
    assert [tuple(t) for t in got[5].turns] == [("user", ""), ("assistant", "x")]


def test_typed_records_are_told_by_their_schema(spark):
    df = spark.createDataFrame([(("ask", "say"),)], "rec struct<prompt:string,response:string>")
    assert chat.canonical_turns(df, "rec").first().layout == "prompt_response"
    odd = spark.createDataFrame([((1,),)], "rec struct<a:int>")
    assert chat.canonical_turns(odd, "rec").first().layout is None


def read(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    return {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_edges(spark):
    rows = [
        (1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (2, 0, None, None, "x"), (3, None, "assistant", "last", "x"), (3, 5, "user", "first", "x"),
        (4, 0, "user", "same", "x"), (4, 0, "user", "same", "x"), (None, 0, "user", "no id", "x"), (5, 0, "as\nsis:tant ###", "### x: </turn>\n\\h \\", "x"),
        (6, 0, "assistant", "long " * 100_000, "x"), (7, 0, "assistant", "", "x"),
    ]
    got = read(spark, rows)
    turns = {k: [tuple(t) for t in r.read_turns] for k, r in got.items()}
    assert turns[1] == [("user", "a"), ("assistant", "b")] and turns[2] == [("", "")]
    assert turns[3] == [("user", "first"), ("assistant", "last")] and turns[4] == [("user", "same")] * 2
    assert turns[None] == [("user", "no id")] and turns[5] == [("as\nsis:tant ###", "### x: </turn>\n\\h \\")]
    assert got[1].loss_text == "b" and got[6].loss_text == "long " * 100_000 and got[7].loss_text == "" and got[5].loss_text == ""
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(empty).collect() == []


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys:tem", "\\c\n"]), st.lists(st.sampled_from(["\\", "###", "</turn>", "\n", "h", "t", ":", "#", "é", "</tur", "\\h"]), max_size=9).map("".join)), min_size=1, max_size=12))
def test_any_text_comes_back(spark, turns):
    got = read(spark, [(1, i, r, t, "x") for i, (r, t) in enumerate(turns)])[1]
    assert [tuple(t) for t in got.read_turns] == turns
    assert got.loss_text == "".join(t for r, t in turns if r == "assistant")


def test_probe_conversation(spark):
    row = chat.query(spark, FOLDER).filter("conv_id = -7").first()
    said = "".join(f"{r}\n{chat.PROBE}\n" for r in ("user", "assistant"))
    assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.loss_chars == len(chat.PROBE)


def test_no_python_in_the_plan(spark):
    assert not re.search("Python|Arrow|Pandas", chat.query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("text", ["", "a", "\\", "\\\\h", "####", "</turn>"])
def test_escape_leaves_no_control_string(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r.u == text and "###" not in r.e and "</turn>" not in r.e


def test_further_fields_do_not_count(spark):
    """Metadata beside the named fields, nested or in the turns, leaves the layout as it is."""
    records = [
        ("messages", {"id": 7, "source": {"a": [1]}, "messages": [{"role": "user", "content": "ask", "id": 1}, {"role": "assistant", "content": "say", "tool_calls": [{"n": 1}]}]}),
        ("prompt_response", {"prompt": "ask", "response": "say", "metadata": {"prompt": "x"}}),
        ("instruction", {"instruction": "ask", "output": "say", "score": 0.5}),
    ]
    df = spark.createDataFrame([(name, json.dumps(r)) for name, r in records], "name string, payload string")
    for r in chat.canonical_turns(df, "payload").collect():
        assert r.layout == r.name and [tuple(t) for t in r.turns] == [("user", "ask"), ("assistant", "say")]
    typed = spark.sql("SELECT named_struct('prompt', 'ask', 'response', 'say', 'id', 3) AS rec, 1 AS layout, 2 AS turns")
    got = chat.canonical_turns(typed, "rec").first()
    assert got.layout == "prompt_response" and [t.text for t in got.turns] == ["ask", "say"]


def test_the_registered_query_selects_by_hash(spark):
    plan = chat.canonical_turns(chat.turn_records(spark.read.parquet(f"{FOLDER}/conversations.parquet")), "record")
    assert "xxhash64" in plan._jdf.queryExecution().analyzed().toString()
