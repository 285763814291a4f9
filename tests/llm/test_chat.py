import hashlib
import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keepsake.llm import chat
from keepsake.llm.queries import QUERIES


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check(convs, got):
    assert len(got) == len(convs)
    for r in got:
        turns = convs[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_query_against_the_table(spark):
    sf = "/root/testdata/sf0.001"
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r["conv_id"]].append((r["role"], r["text"] or ""))
    convs[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = QUERIES["op6_chat_format"](spark, sf).collect()
    check(convs, got)
    assert len({r["layout"] for r in got} & {lay.name for lay in chat.LAYOUTS}) >= len(chat.LAYOUTS) - 1 and None not in {r["layout"] for r in got}


NASTY = ["", "<|turn|>user<|text|>x<|end|>", "␛1␛0␛␛2", "<s></s>[INST][/INST]<<SYS>><</SYS>>", "<<|end|>", "é𝄞\u0000\t\"\\",
         "[" * 50 + "INST]", "␛<|im_start|>", "x" * 200000]


def test_hard_texts_round_trip(spark):
    convs = {i: [("user", t), ("assistant", t), ("assistant", t + "!")] for i, t in enumerate(NASTY)}
    convs[100] = [("", ""), ("<|turn|>", "role"), ("assistant", "")]
    rows = [(i, k, r, t) for i, ts in convs.items() for k, (r, t) in enumerate(ts)]
    rows += [(200, 1, "assistant", "b"), (200, 0, None, None)]
    convs[200] = [("", ""), ("assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    formatted = chat.format_chat(chat.conversation_records(df))
    check(convs, chat.digest_columns(formatted).collect())
    for (s,) in formatted.select("chat.segments").collect():
        for seg in s[1::3]:
            for c in ("<|turn|>", "<|end|>", "<|text|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>"):
                assert c not in seg["text"]
    assert chat.digest_columns(chat.format_chat(chat.conversation_records(df.limit(0)))).count() == 0


@pytest.mark.parametrize("record,want", [
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"output": "o", "instruction": "i", "input": "x"}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]),
    ({"turns": [{"text": "t", "role": "user"}]}, [("user", "t")]),
    ({"prompt": 5, "response": "r"}, [("user", "5"), ("assistant", "r")]),
    ({"id": 7, "messages": [{"role": "user", "content": "a", "name": "Ann", "at": {"x": 1}}], "tags": ["t"]}, [("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "b", {"type": "image", "url": "u"}]}]}, [("user", "ab")]),
    ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, [("system", "s"), ("user", "a")]),
    ({"system": "", "prompt": "p", "completion": "c", "source": "web"}, [("user", "p"), ("assistant", "c")]),
    ({"messages": []}, []),
    ({"conversations": [], "id": 1}, []),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "user"}]}, None),
    ({"messages": "text"}, None),
    ({"prompt": "p"}, None),
    ({"prompt": "p", "completion": "c", "messages": [{"role": "r", "content": "m"}]}, [("r", "m")]),
    ({"turns": [{"role": "model", "text": "t"}]}, [("model", "t")]),
    ({"other": 1}, None),
    (None, None),
])
def test_layouts(spark, record, want):
    df = spark.createDataFrame([(1, json.dumps(record) if record else None)], "id long, record string")
    row = chat.format_chat(df).select("chat.turns").first()[0]
    assert (None if row is None else [tuple(t) for t in row]) == want


def test_text_that_is_not_json(spark):
    df = spark.createDataFrame([(1, "no json {")], "id long, record string")
    assert chat.format_chat(df).first()["chat"]["formatted"] is None


def test_loss_is_the_canonical_assistant_alone(spark):
    records = [{"turns": [{"role": r, "text": r} for r in ("model", "gpt", "bot", "assistant")]},
               {"conversations": [{"from": r, "value": r} for r in ("human", "model", "gpt", "bot", "assistant")]}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id long, record string")
    got = [[s["text"] for s in r["chat"]["segments"] if s["loss"]] for r in chat.format_chat(df).orderBy("id").collect()]
    assert got == [["assistant"], ["model", "gpt", "bot", "assistant"]]


def test_control_strings_with_digits_and_clashing_names(spark):
    text = "<|reserved_special_token_0|> <|im_start|> <|1|>"
    df = spark.createDataFrame([(1, json.dumps({"prompt": text, "completion": text}))], "id long, record string")
    row = chat.format_chat(df).first()["chat"]
    assert "<|reserved" not in row["formatted"] and "<|1|>" not in row["formatted"]
    assert [t["text"] for t in row["turns"]] == [text, text]
    with pytest.raises(ValueError, match="out_col"):
        chat.format_chat(df.withColumn("chat", F.lit(1)))
    assert chat.format_chat(df.withColumn("chat", F.lit(1)), out_col="formatted_chat").columns[-1] == "formatted_chat"


def test_too_long_a_record_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "LONGEST", 40)
    df = spark.createDataFrame([(1, json.dumps({"prompt": "p" * 100, "completion": "c"}))], "id long, record string")
    with pytest.raises(Exception, match=chat.TOO_LONG):
        chat.format_chat(df).collect()
