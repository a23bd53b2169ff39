"""Chat formatting with cumulative-snapshot collapse.

A logged conversation that is a prefix of a longer one (the log was written again after further turns) is dropped, and
of equal conversations the one of smallest conv_id stays. Each turn gets two rolling hashes of all turns up to it; a
conversation is a snapshot if its last pair is an inner pair of another. Both sides of the anti-join hold a key at most
once, so a first turn or a conversation that a third of all rows share costs no more than any other.

Defined results: null role and text are empty ones; a turn that stands twice in a conversation with equal role and text
counts once; turns are ordered by (turn, role, text), null numbers first; rows without conv_id form one conversation.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.common import with_columns_of


def number_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their position k and two rolling hashes of the turns up to it."""
    turns = with_columns_of(conversations, "conv_id", "turn", "role", "text").na.fill("", ["role", "text"]).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("k", F.row_number().over(order))
    for seed in (1, 2):
        # hashes of (position, turn) combined by exclusive or: the running value is that of a sequence
        turns = turns.withColumn(f"h{seed}", F.bit_xor(F.xxhash64(F.lit(seed), "k", "role", "text")).over(upto))
    return turns


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one continues."""
    n = F.max("k").over(Window.partitionBy("conv_id"))
    marked = turns.select("conv_id", "k", "h1", "h2", n.alias("n"))
    whole = marked.where("k = n").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = marked.where("k < n").select("k", "h1", "h2").distinct()
    return whole.join(inner, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the kept conversations as marked-up text."""
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    own = kept.select(F.col("conv_id").alias("id"), "n_turns", "n_copies")
    rows = turns.select("conv_id", "k", line.alias("line")).join(own, F.col("conv_id").eqNullSafe(F.col("id")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "")
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(body.alias("rendered"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = render(turns, maximal(turns))
    return out.select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.col("n_copies").cast("bigint").alias("n_copies"), F.length("rendered").cast("bigint").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


OP1_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, k, n, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '')
             OVER (PARTITION BY conv_id ORDER BY k) AS body FROM k),
whole AS (SELECT body, k, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY body, k)
SELECT conv_id, CAST(k AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
       CAST(length(body) AS BIGINT) AS n_chars, sha256(body) AS rendered_sha256
FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.k AND p.body = w.body)
"""
