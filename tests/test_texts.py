"""Golden cases worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators import dialect as S
from memloom.operators import entities as E
from memloom.operators import registry as R
from memloom.operators import transcripts as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return df.select(column.alias("out")).first()[0]


def test_space_and_rounding(spark):
    assert one(spark, X.trim("t"), t=" \n a b ﻿") == "a b"
    assert one(spark, X.round_half_up(F.col("x"), 3), x=-0.0005) == 0
    assert one(spark, X.round_half_up(F.col("x"), 3), x=0.0005) == 0.001


@pytest.mark.parametrize(
    ("text", "room"),
    [("fix the bug in the python code", "technical"), ("the roadmap and the sprint deadline", "planning"), ("we decided and chose an option", "decisions"), ("Hello there.", "general"), ("a digital clock", "technical")],
)
def test_rooms(spark, text, room):
    assert one(spark, T.detect_room("t"), t=text) == room


def chunks(spark, text):
    df = spark.createDataFrame([("f", text)], "path string, content string")
    return [(r["chunk_index"], r["content"]) for r in T.chunk_exchanges(df, "path").orderBy("chunk_index").collect()]


def test_exchanges_end_at_rules_and_take_eight_lines(spark):
    reply = "\n".join(f"line number {i}" for i in range(12))
    text = f"lost\n> first question of all\n{reply}\n---\nlost too\n> second\n> third question, which has no reply"
    found = chunks(spark, text)
    assert found[0] == (0, "> first question of all\n" + " ".join(f"line number {i}" for i in range(8)))
    assert found[1] == (1, "> third question, which has no reply")
    assert len(found) == 2


def test_tiny_chunks_go(spark):
    assert chunks(spark, "> Hi\nHi\n\n> Ok\nOk") == []
    assert chunks(spark, "") == []


def test_long_unbroken_text_is_grouped(spark):
    found = chunks(spark, "\n".join(f"this is line number {i}" for i in range(30)))
    assert [c.count("\n") + 1 for _, c in found] == [25, 5]


def normalized(spark, content, path="f.json"):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    return T.normalize(df).first()["content"]


def test_exports(spark):
    slack = json.dumps([{"type": "message", "user": "U1", "text": "Hey team"}, {"type": "message", "user": "U2", "text": "Hi!"}, {"type": "join", "user": "U3"}, {"type": "message", "user": "U1", "text": "What are we working on?"}, {"type": "message", "username": "U3", "text": "The new feature"}])
    assert normalized(spark, slack) == "> Hey team\nHi!\n\n> What are we working on?\nThe new feature\n"
    flat = json.dumps({"messages": [{"role": "user", "content": " a "}, {"role": "system", "content": "no"}, {"role": "assistant", "content": ["b", {"type": "text", "text": "c"}, {"type": "image"}]}]})
    assert normalized(spark, flat) == "> a\nb c\n"
    privacy = json.dumps([{"chat_messages": [{"role": "human", "content": "a"}]}, {"chat_messages": [{"role": "ai", "content": {"text": "b"}}]}])
    assert normalized(spark, privacy) == "> a\nb\n"
    tree = json.dumps({"mapping": {"a": {"parent": None, "message": {"author": {"role": "user"}, "content": {"parts": ["x"]}}, "children": ["b"]}, "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["y", 1]}}, "children": ["a"]}}})
    assert normalized(spark, tree) == "> x\ny\n"
    for odd in ("", "  ", "[1, 2", '{"a": 1}', "null", "[]", '[{"role": "user", "content": "only one"}]', "> a\n> b\n> c\n[]"):
        assert normalized(spark, odd) == odd


def test_summary(spark):
    text = "We decided to use GraphQL instead of REST because it reduces over-fetching."
    assert one(spark, S.compress("t"), t=text) == '0:GRAPH'[:2] + '???|graphql_rest_over-fetching|"We decided to use GraphQL instead of REST because it..."|determ|DECISION'
    assert one(spark, S.compress("t"), t="") == "0:???|misc"
    assert one(spark, S.count_tokens("t"), t="") == 1
    assert one(spark, S.encode_emotions(F.split("t", ",")), t="joy,trust,fear") == "joy+trust+fear"
    assert one(spark, S.encode_entity(F.col("t")), t="UnknownPerson") == "UNK"
    assert one(spark, S.encode_entity(F.col("t"), skip=["gandalf"]), t="Gandalf") is None


def test_decode(spark):
    found = one(spark, S.decode("t"), t="001|ALC|2024-01-01|Title\nARC:up->down\n001:ALC|tea|0.9\nT:001<->002|label")
    assert (found["file"], found["title"], found["arc"], found["zettels"], found["tunnels"]) == ("001", "Title", "up->down", ["001:ALC|tea|0.9"], ["T:001<->002|label"])


def test_file_of_zettels(spark):
    schema = (
        "source_file string, emotional_arc string, zettels array<struct<id:string,people:array<string>,topics:array<string>,content:string,origin_label:string,notes:string,title:string,"
        "emotional_weight:double,emotional_tone:array<string>,origin_moment:boolean,sensitivity:string,date_context:string>>, tunnels array<struct<from:string,to:string,label:string>>"
    )
    z = ("zettel-7", ["Bob", "Alice"], ["tea"], None, None, "genesis", "Part - the beginning", None, ["grief"], True, "Maximum care", "May")
    df = spark.createDataFrame([("001-first-talk.txt", "calm", [z], [("z-1", "z-2", "same: idea")])], schema)
    text = df.select(S.encode_file(F.struct("*")).alias("x")).first()[0]
    assert text == '001|ALI+BOB|May|first-talk\nARC:calm\n7:ALI+BOB|tea|"the beginning"|0.5|grief|ORIGIN+SENSITIVE+GENESIS\nT:1<->2|same'


def entities(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    return {r["name"]: r for r in E.classify(E.score(E.candidates(df, "k"), df, "k")).collect()}


def test_three_verbs_hide_the_pronoun(spark):
    text = "Bob said hi. Bob asked. Bob told them.\nBob wrote. Bob.\nAlice said no. Alice asked her. Alice told me. Alice."
    found = entities(spark, text)
    assert {n: (r["type"], r["confidence"], r["frequency"]) for n, r in found.items()} == {"Bob": ("uncertain", 0.4, 5), "Alice": ("uncertain", 0.4, 4)}
    assert len(found["Bob"]["person_signals"]) == 3


def test_projects_and_rare_names(spark):
    found = entities(spark, "building Quill. Quill v2. Quill-core is out. import Quill")
    assert found["Quill"]["type"] == "project" and found["Quill"]["person_score"] == 0
    assert entities(spark, "Rare Rare") == {}
    assert entities(spark, "") == {}


@pytest.mark.parametrize(("context", "kind", "sure"), [("I saw Grace at the park", "person", 1.0), ("the grace of the architecture", "concept", 0.7999999999999999), ("", "person", 1.0), ("Grace said hi and Grace laughed", "person", 0.95)])
def test_lookup_of_a_common_word(spark, context, kind, sure):
    people = R.seed(spark.createDataFrame([("Grace", None, None, 0)], "name string, relationship string, context string, ord int"), spark.createDataFrame([], "alias string, canonical string, ord int"))
    nothing = spark.createDataFrame([], "name string, ord int"), spark.createDataFrame([], "word string, inferred_type string, confidence double, confirmed boolean")
    words = spark.createDataFrame([(1, "grace", context)], "word_id int, word string, context string")
    found = R.lookup(words, people, *nothing).first()
    assert (found["type"], found["confidence"]) == (kind, sure)
