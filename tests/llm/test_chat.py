import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        out[conv] = [(role, text) for _, role, text in mine]
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\", "<|", "|>", "<|end|>", "<|next|>", "<|turn|>", "<|says|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<", "[", "\n", "é😀", "a", " "]), max_size=12).map("".join), min_size=1, max_size=30))
def test_round_trip(spark, texts):
    rows = [(k // 5, k % 5, ["user", "assistant", "assistant", "system", "a\n<|says|>"][zlib.crc32(t.encode()) % 5], t, "") for k, t in enumerate(texts)]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    want = brute(rows)
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.loss_text for r in got} == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in want.items()}


def test_template_and_nulls(spark):
    rows = [(1, 1, "assistant", "b", ""), (1, 0, "user", "a", None), (1, 2, "assistant", None, ""), (None, 0, None, "x</s>", ""), (1, 1, "assistant", "b", "")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].formatted == "<s><|turn|>user<|says|>a<|end|><|turn|>assistant<|says|>b<|next|>b<|next|><|end|></s>"
    assert got[None].formatted == "<s><|turn|><|says|>x<\\/s><|end|></s>"
    assert [got[1].formatted[x.start : x.end] for x in got[1].loss] == ["b", "b", ""] and got[None].loss == []
    assert chat.format_chats(spark.createDataFrame(rows, SCHEMA).limit(0)).collect() == []


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in rows])
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat.op2_chat_format(spark, "/root/testdata/sf0.001").collect():
        turns = want.pop(r.conv_id)
        said = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said))
    assert not want


def test_neighbours_are_one_block(spark):
    rows = [(1, k, role, f"t{k}", "") for k, role in enumerate(["user", "user", "assistant", "assistant", "user", "assistant"])]
    df = spark.createDataFrame(rows, SCHEMA).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    (row,) = df.select(chat.merged(F.col("turns")).alias("b")).collect()
    assert [(b.role, b.texts) for b in row.b] == [("user", ["t0", "t1"]), ("assistant", ["t2", "t3"]), ("user", ["t4"]), ("assistant", ["t5"])]


def test_long_texts_and_long_conversations(spark):
    rows = [(1, k, "assistant" if k % 3 else "user", f"é<|{k}", "") for k in range(6000)] + [(2, 0, "assistant", "😀<s>\\" * 100_000, ""), (2, 0, "assistant", "tie", ""), (2, 0, "assistant", "tie", "")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = brute(rows)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
        assert len(got[conv].loss) == sum(role == "assistant" for role, _ in turns)
