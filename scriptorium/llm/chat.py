r"""Conversations to training text and back, in Spark expressions only.

Turn structs are collected and sorted, and adjacent turns of one role are merged into a block:

    <s>[INST]\n role \n[/INST]\n text \n[SEP]\n text \n</s>

A control string inside a role or text gets one backslash before it, and loses one when read back; so "\n</s>",
"\n[/INST]\n" and "\n[SEP]\n" occur in the output only as marks, and splitting at them is exact.

Defined cases: a null text counts as empty; a null role as an empty role; rows of equal turn go by role, then text;
null turns come first; repeated rows are turns of their own; rows without conv_id make one conversation; ids and turns
keep their types; a conversation of any length becomes one text, as its output demands; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values of this project).
CONTROL = r"(<s>|</s>|\[/?INST\]|\[SEP\])"
OPEN, ROLE_END, BETWEEN, CLOSE = "<s>[INST]\n", "\n[/INST]\n", "\n[SEP]\n", "\n</s>"
#: Elements in a group of the two-level running sums.
GROUP = 256
#: The one conversation that the query adds.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): one row for each conversation of (conv_id, turn, role, text).

    loss_mask holds (chars, bytes, loss) runs in order; runs under the loss are the escaped texts of assistant turns.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    roles = sorted_turns.select("conv_id", "turns", F.col("turns.role").alias("roles"), F.size("turns").alias("n"))

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("roles", i - 1) != t["role"])
        last = (i == F.col("n") - 1) | (F.get("roles", i + 1) != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))).otherwise(F.lit(BETWEEN)).alias("before"),
            escape(t["text"]).alias("text"),
            F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("after"),
            (t["role"] == "assistant").alias("loss"),
        )

    pieces = roles.select("conv_id", F.transform("turns", piece).alias("pieces"))
    run = lambda text, loss: F.struct(F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), loss.alias("loss"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.flatten(F.transform("pieces", lambda p: F.array(run(p["before"], F.lit(False)), run(p["text"], p["loss"]), run(p["after"], F.lit(False))))).alias("loss_mask"),
    )


def read_chat(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    quoted = lambda mark: rf"\Q{mark}\E"
    blocks = F.filter(F.split(formatted, quoted(CLOSE), -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substr(block, F.lit(len(OPEN) + 1)), ROLE_END, 1))
        texts = F.split(F.substr(block, F.locate(ROLE_END, block) + len(ROLE_END)), quoted(BETWEEN), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def let(value: Column, use) -> Column:
    """use(value), with value computed once, also where use needs it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column) -> Column:
    """For each element of an array of longs the sum of those before it: sums of groups first, then within a group."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n)

    def with_groups(v: Column) -> Column:
        groups = F.transform(upto(F.ceil(F.size(v) / GROUP).cast("int")), lambda g: total(F.slice(v, g * GROUP + 1, F.lit(GROUP))))
        bases = let(groups, lambda s: F.transform(upto(F.size(s)), lambda g: total(F.slice(s, F.lit(1), g))))
        place = lambda i: F.floor(i / GROUP).cast("int")
        return let(bases, lambda b: F.transform(upto(F.size(v)), lambda i: F.get(b, place(i)) + total(F.slice(v, place(i) * GROUP + 1, i % GROUP))))

    return let(values, with_groups)


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """array<string>: what lies under the mask's runs of loss, unescaped. Runs are cut by bytes, which needs no search from the start."""
    runs = F.arrays_zip(F.transform(loss_mask, lambda r: r["loss"]).alias("loss"), F.transform(loss_mask, lambda r: r["bytes"]).alias("bytes"), running_sums(F.transform(loss_mask, lambda r: r["bytes"])).alias("start"))
    cut = lambda data, r: unescape(F.substring(data, (r["start"] + 1).cast("int"), r["bytes"].cast("int")).cast("string"))
    return let(formatted.cast("binary"), lambda data: F.transform(F.filter(runs, lambda r: r["loss"]), lambda r: cut(data, r)))


def with_extra(conversations: DataFrame) -> DataFrame:
    """All conversations plus the contract's conversation of two turns made of control strings."""
    kinds = {c: conversations.schema[c].dataType for c in ("conv_id", "turn")}
    rows = conversations.sparkSession.range(2).select(F.lit(EXTRA_ID).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def op4_chat(conversations: DataFrame) -> DataFrame:
    """The contract's digests: turns read back from the formatted text, the loss cut from it by the mask."""
    formatted = format_chat(with_extra(conversations))
    back = formatted.select("conv_id", read_chat(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'),
w AS (SELECT *, lag(role) OVER o AS before, length(regexp_replace(text, '{CONTROL}', '\\\1', 'g')) AS n, length(regexp_replace(role, '{CONTROL}', '\\\1', 'g')) AS r FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before IS NULL OR before <> role THEN r + {len(OPEN) + len(ROLE_END) + len(CLOSE)} ELSE {len(BETWEEN)} END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id"""
