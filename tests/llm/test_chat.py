import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import chat

TEXT = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[SEP]", "\\", "\n", " a ", "é", "<", "[", "\n[SEP]\n", "\n</s>", "$1"]), max_size=6).map("".join)
CASES: list = []


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a[INST]b", ""]), TEXT), min_size=1, max_size=6))
def collect(case):
    CASES.append(case)


def test_round_trip_of_random_conversations(spark):
    collect()
    rows = [(i, t, role, text, "x") for i, case in enumerate(CASES) for t, (role, text) in enumerate(case)]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    back = formatted.select("conv_id", "formatted", "loss_mask", chat.read_chat(formatted["formatted"]).alias("turns"), chat.loss_texts(formatted["formatted"], formatted["loss_mask"]).alias("loss")).collect()
    assert len(back) == len(CASES)
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == CASES[r.conv_id]
        assert sum(x.chars for x in r.loss_mask) == len(r.formatted)
        at, under = 0, []
        for x in r.loss_mask:
            if x.loss:
                under.append(r.formatted[at : at + x.chars])
            at += x.chars
        spoken = [t for role, t in CASES[r.conv_id] if role == "assistant"]
        assert [re.sub(r"\\" + chat.CONTROL, r"\1", u) for u in under] == spoken == r.loss
        assert sum(x.bytes for x in r.loss_mask) == len(r.formatted.encode())


def test_query(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "assistant", "c"), (None, 0, None, "x")], "conv_id long, turn int, role string, text string")
    rows = {r.conv_id: r for r in chat.op4_chat(turns).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[1].n_turns == 3 and rows[1].turns_sha256 == sha("user\n\nassistant\nb\nassistant\nc\n") and rows[1].loss_sha256 == sha("bc") and rows[1].loss_chars == 2
    assert rows[-7].loss_sha256 == sha(chat.EXTRA_TEXT) and rows[-7].n_turns == 2 and rows[None].n_turns == 1
    assert [r.conv_id for r in chat.op4_chat(turns.limit(0)).collect()] == [-7]


def test_long_conversation(spark):
    turns = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    assert {r.conv_id: r.n_turns for r in chat.op4_chat(turns).collect()} == {1: 5000, -7: 2}


def test_the_loss_comes_from_the_mask(spark):
    """Another mask over the same text gives another loss; more runs than a group of the running sums."""
    turns = spark.range(700).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('é', id, '</s>') AS text")
    made = chat.format_chat(turns)
    (row,) = made.select(chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert row.loss == [f"é{i}</s>" for i in range(1, 700, 2)]
    other = F.transform("loss_mask", lambda r: F.struct(r["chars"], r["bytes"], (~r["loss"] & (r["chars"] > 7) & (r["chars"] < 10)).alias("loss")))
    (row,) = made.select(chat.loss_texts(F.col("formatted"), other).alias("loss")).collect()
    assert row.loss != [] and not any(f"é{i}</s>" in row.loss for i in range(1, 700, 2))


def test_running_sums(spark):
    values = [[], [5], [1, 2, 3], list(range(1000))]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<long>").select("i", chat.running_sums(F.col("v")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: [sum(v[:k]) for k in range(len(v))] for i, v in enumerate(values)}


def test_equal_turns_repeated_rows_and_text_ids(spark):
    rows = [("a", 1, "user", "x"), ("a", 1, "assistant", "y"), ("a", 1, "assistant", "y"), ("a", None, "system", "first"), ("a", 2, None, None)]
    got = {r.conv_id: r for r in chat.op4_chat(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {"a", "-7"} and got["a"].n_turns == 5 and got["a"].loss_sha256 == sha("yy")
    assert got["a"].turns_sha256 == sha("system\nfirst\nassistant\ny\nassistant\ny\nuser\nx\n\n\n")
