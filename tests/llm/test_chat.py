"""Transcripts: the path against all paths, blocks against whole conversations, texts that must not change."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string"


def random_model(rng):
    step = np.log(rng.dirichlet(np.ones(chat.STATES), chat.STATES + 1))
    for state in range(chat.STATES + 1):
        for role in range(len(chat.ROLES)):
            if state // 2 != role or state == chat.STATES:
                step[state][2 * role + 1] = -math.inf
    return {"step": step.tolist(), "sign": [np.log(rng.dirichlet(np.ones(n), chat.STATES)).tolist() for n in chat.SIZES]}


def observed(rng, n):
    return [tuple(int(rng.integers(size)) for size in chat.SIZES) for _ in range(n)]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(5):
        model, seen = random_model(rng), observed(rng, 4)

        def score(p, model=model, seen=seen):
            steps = model["step"][chat.STATES][p[0]] + sum(model["step"][a][b] for a, b in zip(p, p[1:], strict=False))
            return steps + sum(kind[s][v] for s, o in zip(p, seen, strict=True) for kind, v in zip(model["sign"], o, strict=True))

        assert tuple(chat.viterbi(model, seen)) == max(np.ndindex(*[chat.STATES] * 4), key=score)


def test_blocks_find_the_path_of_the_whole():
    rng = np.random.default_rng(1)
    for _ in range(20):
        model, parts = random_model(rng), [observed(rng, int(n)) for n in rng.integers(0, 9, 6)]
        ends = chat.chain([chat.transfer(model, part) for part in parts])
        joined = [s for part, (a, b) in zip(parts, ends, strict=True) if part for s in chat.viterbi(model, part, a, b)]
        assert joined == chat.viterbi(model, [o for part in parts for o in part])


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))

    def text(role):
        if rng.random() < 0.05:
            return ""
        out = words(int(rng.integers(2, 20))) + ("?" if rng.random() < (0.7 if role == "user" else 0.1) else ".")
        for _ in range(int(rng.integers(0, 4))):
            out += ("\n\n" if rng.random() < 0.3 else "\n") + ("    " if rng.random() < 0.3 else "") + words(int(rng.integers(1, 12)))
        return out

    roles = lambda i: ["system"] * (i % 3 == 0) + ["user", "assistant"] * 3
    rows = [(i, t, role, text(role)) for i in range(200) for t, role in enumerate(roles(i))]
    return chat.fit(chat.blocks_of(spark.createDataFrame(rows, TURNS)))


def recovered(spark, model, rows):
    blocks = chat.blocks_of(spark.createDataFrame(rows, TURNS))
    return chat.parse(chat.transcripts_of(blocks), model)


def test_texts_stay_as_they_are(model):
    text = "System: be brief\n\nUser: How do I write it?\n\nAssistant: Sure: here is code\n\n    def f():\n        return 1\n\n    # Note: a\n\nUser: \n\nAssistant: done"
    code = "Sure: here is code\n\n    def f():\n        return 1\n\n    # Note: a"
    assert [t[:2] for t in chat.turns_of(model, text)] == [("system", "be brief"), ("user", "How do I write it?"), ("assistant", code), ("user", ""), ("assistant", "done")]
    assert chat.turns_of(model, " \n\n") == []


def test_long_conversations_and_ties(spark, model):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Is this line {t}?\nmore text") for t in range(2_000)]
    rows += [(2, 0, "user", f"{i} is a tie") for i in range(5_000)]  # more than a block under one turn number
    rows += [(3, 0, None, None), (None, None, "user", "hi there"), (4, 0, "tool", "42 found"), (4, 1, "user", "x" * 300_000), (1, 0, "user", "Is this line 0?\nmore text")]
    out = recovered(spark, model, rows).cache()
    one = out.filter("conv_id = 1").orderBy("turn_no").collect()
    # one turn in ten has no marker: a few of those are read on with the turn before, but no line is lost, moved or counted twice
    assert [r.turn_no for r in one] == list(range(len(one))) and len(one) >= 1_950
    assert [x for r in one for x in r.text.split("\n") if x] == [x for r in rows[:2_000] for x in r[3].split("\n")]
    roles = {x: r.role for r in one for x in r.text.split("\n")}
    assert sum(roles[f"Is this line {r[1]}?"] == r[2] for r in rows[:2_000]) >= 1_950
    tied = out.filter("conv_id = 2").collect()
    assert sorted(r.turn_no for r in tied) == list(range(len(tied)))
    assert sorted(line for r in tied for line in r.text.split("\n") if line) == sorted(r[3] for r in rows if r[0] == 2)
    assert out.filter("conv_id = 3").count() == 0 and out.filter("conv_id is null").first().text == "hi there"
    four = out.filter("conv_id = 4").orderBy("turn_no").collect()
    assert four[-1].rendered.endswith("\n<|end|>\n") and "".join(r.text for r in four).replace("\n", "") == "42 found" + "x" * 300_000
    assert [t[:2] for t in chat.turns_of(model, "User: What is 6 by 7?\n\nTool: 42 found\n\nAssistant: 42.")] == [("user", "What is 6 by 7?"), ("other", "42 found"), ("assistant", "42.")]


def test_extra_columns_and_empty_tables(spark, model):
    rows = spark.createDataFrame([(1, 0, "user", "Hello?"), (1, 1, "assistant", "Yes.")], TURNS).withColumns({"part": F.lit("own"), "b": F.lit(1), "h": F.lit(2)})
    assert [r.role for r in chat.parse(chat.transcripts_of(chat.blocks_of(rows)), model).orderBy("turn_no").collect()] == ["user", "assistant"]
    assert recovered(spark, model, spark.createDataFrame([], TURNS).collect()).count() == 0
