"""Places of turns in long conversations, and time that does not grow with the square of the turns."""

from __future__ import annotations

import time

import pytest

from frameflow.llm import chat

SAID = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("n", [1, 127, 128, 129, 700])
def test_places_of_turns(spark, n):
    rows = [(1, k, "assistant" if k % 2 else "user", "x" * (k % 5) + ("</s>" if k == 3 else "") + "\U0001f600" * (k % 2)) for k in range(n)]
    got = chat.format_chats(spark.createDataFrame(rows, SAID)).first()
    assert len(got["spans"]) == n
    for s, (_, _, role, _) in zip(got["spans"], rows, strict=True):
        assert got["formatted"][s["start"] : s["start"] + s["length"]] == s["body"]
        assert s["loss"] == (role == "assistant")
    bare = chat.format_chats(spark.createDataFrame(rows, SAID), places=False).first()
    assert [(s["role"], s["body"], s["length"], s["loss"]) for s in bare["spans"]] == [(s["role"], s["body"], s["length"], s["loss"]) for s in got["spans"]]


@pytest.mark.parametrize("places", [False, True])
def test_time_follows_the_turns(spark, places):
    took = []
    for n in (500, 4_000, 16_000):
        rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as text")
        began = time.time()
        out = chat.format_chats(rows, places=places)
        assert (chat.digest(out).first()["n_turns"] if not places else len(out.first()["spans"])) == n
        took.append(time.time() - began)
    assert took[2] < 6 * took[1] + 4
