import re

from pyspark.sql import functions as F

from taproom.llm import chat_format

TURN = "array<struct<turn:long,role:string,text:string>>"


def turns(*pairs):
    return [(i, r, t) for i, (r, t) in enumerate(pairs)]


def examples(spark, rows):
    frame = spark.createDataFrame(rows, f"pair long, chosen {TURN}, rejected {TURN}, prompt_id string")
    return {r.pair: r for r in chat_format.preference_examples(frame).collect()}


def test_prefix_is_rendered_once_and_masks_cover_the_reply(spark):
    a = turns(("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "ok é"))
    b = turns(("user", "hi"), ("assistant", "yes"), ("user", "less"))
    got = examples(spark, [(1, a, b, "x"), (2, a, a, "x"), (3, a, [], None), (4, None, b, None), (5, a[:2], a, "")])
    one = got[1]
    assert one.n_prefix == 2 and one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert one.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\nok é<|end|>\n"
    runs = [int(x) for x in one.chosen_mask.split()]
    assert sum(map(abs, runs)) == len(one.chosen)
    at, trained = 0, ""
    for n in runs:
        trained += one.chosen[at : at + n] if n > 0 else ""
        at += abs(n)
    assert trained == "ok é<|end|>\n"
    assert one.rejected_mask == f"-{len(one.rejected)}"
    assert (got[2].n_prefix, got[2].chosen, got[2].rejected) == (4, "", "")
    assert got[3].n_prefix == 0 and got[3].prompt == "" and got[3].rejected == "" and got[3].chosen
    assert got[4].chosen == "" and got[4].rejected
    assert got[5].n_prefix == 2 and got[5].chosen == "" and got[5].rejected == one.chosen


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [
        (1, 0, "user", "q", 1), (1, 1, "assistant", None, 2), (1, 1, "assistant", None, 2), (2, None, None, "x", 3),
        (None, 0, "user", "alone", 1), (3, 0, "assistant", "first", 1),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    whole = chat_format.conversations(frame)
    got = {r.conv_id: r for r in whole.select("conv_id", "turns", chat_format.echoed(F.col("turns")).alias("e")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "q"), ("assistant", ""), ("assistant", "")]
    assert [t.text for t in got[1].e] == ["q", "", ""]
    assert got[2].turns == got[2].e and got[2].turns[0].role == ""
    assert [t.text for t in got[3].e] == [""]
    assert got[None].turns[0].text == "alone"
    assert chat_format.conversations(frame.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    whole = chat_format.conversations(frame)
    pairs = whole.select("conv_id", F.col("turns").alias("chosen"), chat_format.echoed(F.col("turns")).alias("rejected"))
    plan = chat_format.preference_examples(pairs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
