"""Chat formatting of logged conversations: cumulative snapshots collapse to the longest.

A chat front end often logs the whole conversation again after every turn. Each turn gets a
rolling hash of all turns up to it (an exclusive-or of position-bound turn hashes, two of 64
bits), so a conversation is a prefix of a longer one exactly if its last rolling hash is one
of the other's earlier ones. An anti-join on (position, hash) keeps the maximal ones; equal
conversations keep the one with the smallest id. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table, text_or_empty


def _ties(turns: DataFrame) -> DataFrame:
    """(__conv, __turn, __role, __text, place): the order of the texts of turns that share conversation, place and role.

    Their texts are the only ones that the collapse reads whole; most logs have no such turn.
    Both tables are written, so that Spark sees their size when it plans the joins with them.
    """
    keys = [F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), text_or_empty("role").alias("__role")]
    tied = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    tied = materialize(tied, "chat-ties")
    some = turns.select(*(k.alias(f"_{n}") for k, n in zip((F.col("conv_id"), F.col("turn"), text_or_empty("role")), ("c", "t", "r"))), text_or_empty("text").alias("__text"))
    same = F.col("_c").eqNullSafe(F.col("__conv")) & F.col("_t").eqNullSafe(F.col("__turn")) & (F.col("_r") == F.col("__role"))
    texts = some.join(tied, same).select("__conv", "__turn", "__role", "__text").distinct()
    by_text = Window.partitionBy("__conv", "__turn", "__role").orderBy("__text")
    ranked = texts.select("__conv", "__turn", "__role", F.xxhash64("__text").alias("__hash"), F.xxhash64(F.lit("b"), "__text").alias("__hash_b"), F.row_number().over(by_text).alias("place"))
    return materialize(ranked, "chat-ties")


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the maximal conversations.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Turns are taken in the
    order (turn, role, text), null turns first, also where several rows share turn and role.
    Repeated rows count as turns, null roles and texts as empty, a null conv_id as one
    conversation; no rows give no rows. Both sides of the anti-join are distinct before they
    meet: a first turn or a conversation that a third of the log shares is one row there.
    The turns of one conversation meet in a task as hashes, its texts of any length do not.
    """
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.col("place").asc_nulls_first())
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slim = turns.select("conv_id", "turn", text_or_empty("role").alias("role"), F.xxhash64(text_or_empty("text")).alias("hash"), F.xxhash64(F.lit("b"), text_or_empty("text")).alias("hash_b"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn")) & (F.col("role") == F.col("__role")) & (F.col("hash") == F.col("__hash")) & (F.col("hash_b") == F.col("__hash_b"))
    placed = slim.join(_ties(turns), same, "left").withColumn("at", F.row_number().over(by_turn))
    rolled = placed.select(
        "conv_id",
        "at",
        F.bit_xor(F.xxhash64("at", "role", "hash")).over(so_far).alias("h"),
        F.bit_xor(F.xxhash64("hash_b", "role", "at")).over(so_far).alias("g"),
        (F.row_number().over(by_turn) == F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).alias("last"),
    )
    whole = rolled.filter("last").groupBy("at", "h", "g").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = rolled.filter(~F.col("last")).select("at", "h", "g").distinct()
    return whole.join(inner, ["at", "h", "g"], "left_anti").select("conv_id", F.col("at").cast("long").alias("n_turns"), "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """Render the maximal conversations: conv_id, n_turns, copies, chat.

    A turn is ``<|role|>``, a line end, the text, a line end and ``<|end|>``; line ends join
    turns. Nulls, ties, repeated rows and empty tables are as in ``collapse_snapshots``. A
    conversation is one row of the result, so its whole rendering must fit into a row.
    """
    kept = collapse_snapshots(turns)
    rows = turns.select("conv_id", F.struct("turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text")).alias("row"))
    chats = (
        rows.join(kept.withColumnRenamed("conv_id", "__kept"), F.col("conv_id").eqNullSafe(F.col("__kept")))
        .groupBy("__kept", "n_turns", "copies")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
    )
    line = F.transform("rows", lambda r: F.concat(F.lit("<|"), r["role"], F.lit("|>\n"), r["text"], F.lit("\n<|end|>")))
    return chats.select(F.col("__kept").alias("conv_id"), "n_turns", "copies", F.array_join(line, "\n").alias("chat"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, collapsed and rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op5_chat": op5_chat}
ORACLE_SQL = {
    "op5_chat": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        ), c AS (
            SELECT conv_id, count(*) AS n_turns,
                   list(role || chr(31) || text ORDER BY turn, role, text) AS turns,
                   string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) ORDER BY turn, role, text) AS chat
            FROM t GROUP BY conv_id
        ), u AS (
            SELECT min(conv_id) AS conv_id, count(*) AS copies, any_value(n_turns) AS n_turns, any_value(chat) AS chat, turns FROM c GROUP BY turns
        ), p AS (
            SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)
        )
        SELECT conv_id, n_turns, copies, chat FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = u.turns)
    """
}
