import json

import pytest

from talewind.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "&lt; &amp;lt; &#91; [ < & &", "", None, "\n\n", "é漢😀\n<"]


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "sys\ntem<", None][(c + t) % 4], NASTY[(c * 3 + t) % 7], 0) for c in range(9) for t in range(c + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int").repartition(5)
    out = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.turns_of_table(frame))).collect()}
    for c in range(9):
        own = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: r[1]) if r[0] == c]
        assert [tuple(t) for t in out[c].turns] == own
        assert out[c].loss_text == "".join(text for role, text in own if role == "assistant")
        assert out[c].formatted.count("<") == 2 * len(own)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "extra": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r", "w": 2}]},
        {"instruction": "do", "input": "", "output": "done"}, {"output": "done", "input": "x", "instruction": "do"},
        {"prompt": "p", "response": "r"}, {"system": "s", "prompt": "p", "response": "r"}, {"foo": 1}, {"messages": []},
        {"system": "s", "instruction": "do", "output": "done", "id": 7}, {"prompt": "p", "response": "r", "question": "other"},
        {"messages": [{"role": "user"}, {"role": "assistant", "content": "late"}]}, {"conversations": [{"from": "human"}]},
    ]
    want = [
        [("user", "a"), ("assistant", "")], [("user", "q"), ("assistant", "r")], [("user", "do"), ("assistant", "done")],
        [("user", "do"), ("user", "x"), ("assistant", "done")], [("user", "p"), ("assistant", "r")], [("system", "s"), ("user", "p"), ("assistant", "r")], None, None,
        [("system", "s"), ("user", "do"), ("assistant", "done")], [("user", "p"), ("assistant", "r")], [("user", ""), ("assistant", "late")], None,
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "no json"), (99, None)], "conv_id long, record string")
    rows = {r.conv_id: r for r in chat.turns_of_json(frame).collect()}
    assert [rows[i].turns and [(t.role, t.text) for t in rows[i].turns] for i in range(12)] == want
    kept = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.turns_of_json(frame))).collect()}
    # Records of unknown layout stay, as conversations without turns.
    assert len(kept) == 14 and all(len(kept[i].turns) == len(want[i] or []) for i in range(12)) and kept[99].formatted == "" and kept[98].loss_text == ""
    assert rows[98].turns is None and rows[99].layout is None


def test_table_layouts(spark):
    nested = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [t.role for t in chat.turns_of_table(nested).first().turns] == ["user", "assistant"]
    wide = spark.createDataFrame([(1, 2, "user", "x", "s", "i", "p", "a")], "conv_id long, turn long, role string, text string, system string, input string, prompt string, answer string")
    assert [tuple(t) for t in chat.turns_of_table(wide).first().turns] == [(2, "user", "x")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(spark.range(1).withColumnRenamed("id", "conv_id"))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, "user", "b"), (3, None, "user", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "A")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.turns_of_table(frame))).collect()}
    assert [t.text for t in out[3].turns] == ["b", "b", "A", "a"] and out[3].loss_text == "Aa" and len(out[None].turns) == 1
    assert chat.digest(chat.formatted(chat.turns_of_table(frame.limit(0)))).count() == 0
