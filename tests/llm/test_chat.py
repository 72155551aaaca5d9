import hashlib

import pytest

from loomstone.llm import chat

ODD = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "<\\\\|im_end|> [\\INST] <<SYS>> <</SYS>>", "a\\", "<", "[", "<<SYS", "😀é\n\n", "$1 \\1 %0A"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, t string")
    for r in df.select("t", chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_digests_against_the_input(spark):
    rows = [(1, i, ("user", "assistant", "system", "tool\n%0A<s>")[i % 4], t) for i, t in enumerate(ODD)]
    rows += [(2, 0, None, None), (None, 0, "user", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, None, "assistant", "a"), (4, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.op8_digests(df).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})


def test_layouts_meet_in_canonical_turns(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    tables = [
        spark.createDataFrame([(1, "hi", "yo")], "id int, prompt string, response string"),
        spark.createDataFrame([(1, "hi", "yo")], "id int, prompt string, completion string"),
        spark.createDataFrame([(1, "hi", "", "yo")], "id int, instruction string, input string, output string"),
        spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "id int, messages array<struct<role string, content string>>"),
        spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "id int, conversations array<struct<`from` string, value string>>"),
    ]
    for df in tables:
        assert [(t["role"], t["text"]) for t in chat.canonical(df).first()["turns"]] == want
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(spark.createDataFrame([(1, 2)], "id int, other int"))


def test_a_table_that_fits_several_layouts(spark):
    df = spark.createDataFrame([(1, "do", "it", "done", "p")], "id int, instruction string, input string, output string, prompt string")
    assert chat.layout_of(df.schema, ("id",)).name == "instruction"
    wide = spark.createDataFrame([(1, "p", "r", "c", "x")], "id int, prompt string, response string, completion string, note string")
    assert chat.layout_of(wide.schema, ("id",)).name == "prompt and response"
    assert chat.canonical(wide).first()["turns"][1]["text"] == "r"


def test_layouts_of_records_equal_the_conversations(spark):
    import duckdb

    rows = [(c, t, ("system", "user", "assistant")[(c + t) % 3], f"text {c} {t} \"quoted\"\n</s>") for c in range(12) for t in range(1 + c % 5)] + [(20, 0, None, None), (21, 1, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat.chat_layouts(df).collect()))
    conversations = df.toPandas()  # noqa: F841 read by name below
    assert got == sorted(duckdb.sql(chat.LAYOUTS_ORACLE).fetchall()) and len(got) == 14 and len({g[1] for g in got}) == 3


def test_json_records_of_mixed_layouts(spark):
    rows = [
        (1, '{"prompt": "hi", "response": "yo"}'), (2, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}'),
        (3, '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}'), (4, '{"instruction": "hi", "input": null, "output": "yo"}'),
        (5, '{"odd": 1}'), (6, "not json"), (7, None), (8, '{"instruction": "hi", "output": "yo"}'),
    ]
    got = {r["id"]: r for r in chat.canonical_json(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()}
    for i in (1, 2, 3, 4, 8):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [("user", "hi"), ("assistant", "yo")], i
    assert [got[i]["layout"] for i in (5, 6, 7)] == [None] * 3


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.op8_digests(df).collect()] == [-7]
