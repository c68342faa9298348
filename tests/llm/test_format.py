"""Chat formatting: round trips over layouts, marks in texts, long conversations, edges."""
import hashlib
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import chat_format as C

SF = "/root/testdata/sf0.001"
NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] <\\s>", "a\nb\x00\x01", "[[/INST]", "</", "[ROLE]x[TEXT]y[/ROLE]",
         "\\", "\U0001f600 漢字", "", "<s", "s>", "<\\\\/s>\\", "[INST", "$1\\2"]


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def conversations(spark, rows, **extra):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def through(rows, **kw):
    return C.read_back(C.formatted(C.canonical(C.records_of_turns(rows, **kw))))


def test_query_equals_the_table(spark):
    want = {-1: [("user", NASTY[0]), ("assistant", NASTY[0])]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = C.op12_chat_format(spark, SF)
    assert digests(got) == {k: digest(t) for k, t in want.items()}
    minus = got.where("conv_id = -1").first()
    assert minus["loss_chars"] == len(NASTY[0])
    assert minus["formatted_chars"] == 2 * len(NASTY[0]) + 6 + len("[INST][/INST]<s></s>")


def test_marks_in_texts_and_roles_come_back(spark):
    turns = [(r, a) for a in NASTY for r in ("user", "assistant", "system", "tool [TEXT]", "human", "")]
    rows = [(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(turns[:: c])]
    rows += [(3, 0, "user", NASTY[5]), (3, 1, "assistant", NASTY[2]), (4, 0, "system", NASTY[4]), (4, 1, "user", NASTY[6]),
             (4, 2, "assistant", NASTY[9])]
    want: dict = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r, t))
    df = conversations(spark, rows)
    for size in (3, 16):
        assert digests(through(df, size=size)) == {k: digest(t) for k, t in want.items()}
    text = C.formatted(C.canonical(C.records_of_turns(df))).where("conv_id = 4").first()["formatted"]
    assert text.count("[TEXT]") == 0 and text.count("[SYS]") == 1 and "[\\/ROLE]" in text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="[]<>/\\sINSTROLEXY "))
def test_no_mark_is_left_inside_and_unescaping_undoes(text):
    import re
    out = re.sub(rf"([<\[])(\\*{C._TAG}[>\]])", r"\1\\\2", text)
    assert not re.search(rf"[<\[]{C._TAG}[>\]]", out) and C.UNESCAPE.sub(r"\1\2", out) == text


def test_layouts_become_canonical_turns(spark):
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages",
         [("user", "q"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": "q", "name": "n"}], "id": 7}, "messages", [("user", "q")]),
        ({"messages": []}, "messages", []),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": 3}, {"from": "tool", "value": "t"}]},
         "sharegpt", [("user", "q"), ("assistant", "3"), ("tool", "t")]),
        ({"dialog": {"turns": [{"speaker": {"role": "user"}, "utterance": {"text": "hi"}}]}}, "dialogue", [("user", "hi")]),
        ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"completion": "c", "prompt": ""}, "completion", [("user", ""), ("assistant", "c")]),
        ({"question": "q", "response": "r"}, "response", [("user", "q"), ("assistant", "r")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"system": "s", "instruction": "i", "input": "", "output": "o"}, "instruction",
         [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"prompt": "p"}, None, None), ({"messages": "none"}, None, None), ([1], None, None)]
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(98, "not json"), (99, None)]
    df = spark.createDataFrame(rows, "id long, record string").withColumns({k: F.lit(1) for k in ("layout", "turns", "mask")})
    got = {r["id"]: r for r in C.formatted(C.canonical(df)).collect()}
    for i, (_, layout, turns) in enumerate(cases):
        assert got[i]["layout"] == layout
        assert (got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == (turns or got[i]["turns"])
        assert (got[i]["formatted"] is None) == (layout is None)
    assert got[98]["layout"] is None and got[99]["turns"] is None and got[2]["formatted"] == ""


def test_edges(spark, clash):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"),
            (5, None, "assistant", "first"), (6, 0, "assistant", "w " * 200_000)]
    df = conversations(spark, rows, **{k: v for k, v in clash.items() if k not in ("turn", "role", "text")}, piece=1, at=2, t=3)
    want = {None: [("", ""), ("user", "x")], 5: [("assistant", "first"), ("user", "a"), ("user", "a"), ("user", "b")],
            6: [("assistant", "w " * 200_000)]}
    assert digests(through(df)) == {k: digest(t) for k, t in want.items()}
    assert through(conversations(spark, [])).count() == 0
