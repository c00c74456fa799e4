"""Chat formatting with cumulative-snapshot collapse, by DataFrame functions alone.

Chat logs often hold a conversation many times, as it grew. A rolling hash over (position,
role, text) marks every turn prefix of every conversation; a conversation whose whole hash is
a longer one's prefix is a snapshot and goes, as do all but the smallest id of equal ones.
Only those that remain are rendered. Texts shuffle once, for rendering; hashes do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_text


def _turns(chats: DataFrame) -> DataFrame:
    """(chat, conv_id, turn, role, m, text): cleaned rows; chat is what holds a conversation's turns together."""
    role = F.coalesce(F.lower(F.trim(F.col("role").cast("string"))), F.lit("user"))
    t = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), as_text(F.col("text")).alias("text"))
    t = t.withColumn("m", F.md5(F.col("text").cast("binary")))
    lone = F.concat(F.lit("row:"), F.md5(F.concat_ws("\n", F.col("role"), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.col("m")).cast("binary")))
    return t.withColumn("chat", F.coalesce(F.col("conv_id").cast("string"), lone))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(chat, conv_id, i, n, a, b): 128-bit hash of the first i distinct turns, of n."""
    by = Window.partitionBy("chat").orderBy(F.col("turn").asc_nulls_last(), "role", "m")
    running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.coalesce(F.col("turn").eqNullSafe(F.lag("turn").over(by)) & (F.col("role") == F.lag("role").over(by)) & (F.col("m") == F.lag("m").over(by)), F.lit(False))
    t = turns.select("chat", "conv_id", "turn", "role", "m").withColumn("again", same)
    t = t.withColumn("i", F.count_if(~F.col("again")).over(running))
    for name, salt in (("a", 1), ("b", 2)):
        h = F.when(F.col("again"), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), "i", "role", "m"))
        t = t.withColumn(name, F.bit_xor(h).over(running))
    return t.where(~F.col("again")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chat"))).select("chat", "conv_id", "i", "n", "a", "b")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(chat, n_turns, n_equal) of the conversations that no other one continues or equals.

    Of equal conversations the smallest conv_id stays.
    """
    p = _prefixes(turns)
    whole = p.where("i = n").groupBy("i", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "chat")).alias("first"), F.count(F.lit(1)).alias("n_equal"))
    inner = p.where("i < n").select("i", "a", "b").distinct()
    return whole.join(inner, ["i", "a", "b"], "left_anti").select(F.col("first.chat").alias("chat"), F.col("i").alias("n_turns"), "n_equal")


def chat_text(turns: Column, role_open: str = "<|im_start|>", close: str = "<|im_end|>") -> Column:
    """One string of an ordered array of (role, text): a block for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(role_open), t["role"], F.lit("\n"), t["text"], F.lit(f"{close}\n"))), "")


def format_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, n_assistant, rendered) of every maximal conversation.

    Turns go by turn (null last), role and the text's MD5; identical rows count once. Roles are
    trimmed and lower-cased, a null role is "user", a null text is empty. A row with a null
    conv_id is a conversation of one turn. An empty table gives an empty result; other columns
    are ignored. One conversation is one rendered string, so its turns meet in one task; its
    prefix hashes stream through a window that spills.
    """
    turns = _turns(chats)
    kept = turns.join(maximal_conversations(turns), "chat")
    turn = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "m", "text")
    out = kept.groupBy("chat").agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_equal"), F.sort_array(F.collect_set(turn)).alias("turns"))
    said = F.size(F.filter("turns", lambda t: t["role"] == "assistant")).cast("long")
    return out.select("conv_id", "n_turns", "n_equal", said.alias("n_assistant"), chat_text(F.col("turns")).alias("rendered"))


FORMAT_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(lower(trim(role)), 'user') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT *, coalesce(conv_id::VARCHAR, 'row:' || md5(role || chr(10) || coalesce(turn::VARCHAR, '') || chr(10) || md5(text))) AS chat FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY turn NULLS LAST, role, md5(text)) AS i FROM c),
p AS (SELECT chat, conv_id, i, role, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY chat ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM n),
w AS (SELECT chat, min(conv_id) AS conv_id, max(i) AS n, max_by(r, i) AS r, count(*) FILTER (WHERE role = 'assistant') AS a FROM p GROUP BY chat),
e AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_equal, a AS n_assistant, r AS rendered FROM w GROUP BY n, a, r),
q AS (SELECT DISTINCT p.i, p.r FROM p JOIN w USING (chat) WHERE p.i < w.n)
SELECT e.* FROM e LEFT JOIN q ON q.i = e.n_turns AND q.r = e.rendered WHERE q.i IS NULL
"""
