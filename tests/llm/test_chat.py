import hashlib
import time

import pytest
from pyspark.sql import functions as F

from strandframe.llm import chat, queries

from .oracle import compare


def test_query_matches_sql(spark):
    compare(spark, queries.op1_chat, queries.OP1_SQL)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, blocks int")
    return {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}, {
        r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_conversations(df))).collect()
    }


def test_odd_texts_come_back(spark):
    odd = ["", None, "\\", "\\\\.", "[\\.", "<\\.", "[+]", "[:]", "<s>", "</s>", "</s>[INST] ok [/INST]", "a[+]\\", "😀[<\\", "[\\\\.", "<" * 5, "x" * 100_000]
    rows = [(1, k, ["user", "assistant", "user", "assistant", "assistant", None, "ro[:]le"][k % 7], t, "clash", 3) for k, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "same", None, None)] * 2 + [(None, None, "user", "no id", None, None)]
    parsed, digest = run(spark, rows)
    assert [(t["role"], t["text"]) for t in parsed[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[:16]]
    assert parsed[1]["learned"] == [r[3] or "" for r in rows[:16] if r[2] == "assistant"]
    assert [t["text"] for t in parsed[2]["turns"]] == ["same", "same"]
    assert parsed[2]["formatted"] == "<s>assistant[:]same[+]same</s>"
    assert digest[2]["loss_chars"] == 8 and digest[2]["loss_sha256"] == hashlib.sha256(b"samesame").hexdigest()
    assert digest[None]["n_turns"] == 1 and digest[None]["loss_chars"] == 0


def test_empty_table(spark):
    assert run(spark, []) == ({}, {})


def test_long_conversations_take_linear_time(spark):
    turns = spark.range(20_000).selectExpr("1L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('é <', id) text")
    began = time.time()
    got = chat.digests(chat.read_back(chat.format_conversations(turns))).collect()[0]
    assert time.time() - began < 30
    texts = [f"é <{k}" for k in range(20_000)]
    learned = "".join(t for k, t in enumerate(texts) if k % 3)
    assert got["n_turns"] == 20_000 and got["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{'assistant' if k % 3 else 'user'}\n{t}\n" for k, t in enumerate(texts)).encode()).hexdigest()


def test_a_mask_of_other_places_is_an_error(spark):
    df = chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", "ab")], "conv_id long, turn long, role string, text string"))
    wrong = df.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))))
    with pytest.raises(Exception, match="whole texts"):
        chat.read_back(wrong).collect()
