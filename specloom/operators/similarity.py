"""Pairwise similarity of conversions and its distributions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.functions.text import blank, jaccard_of, normalize, tokens


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of the standard library; the order of its arguments matters."""
    return pd.Series([1.0 if not x and not y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def with_seq_ratio(pairs: DataFrame) -> DataFrame:
    """Adds seq_ratio to pairs (a, b), computed once for each distinct ordered pair of normalised texts."""
    p = pairs.withColumns({"na": normalize(F.col("a")), "nb": normalize(F.col("b"))})
    # rows meet by 256-bit hashes of the two texts, so that texts themselves are not compared in the join
    p = p.withColumns({"ha": F.sha2(F.coalesce("na", F.lit("")), 256), "hb": F.sha2(F.coalesce("nb", F.lit("")), 256)})
    scored = p.groupBy("ha", "hb").agg(F.first("na").alias("na"), F.first("nb").alias("nb")).select("ha", "hb", _sequence_ratio("na", "nb").alias("seq_ratio"))
    return p.drop("na", "nb").join(scored, ["ha", "hb"]).drop("ha", "hb")


def with_jaccard(pairs: DataFrame) -> DataFrame:
    """Adds jaccard to pairs, from their token arrays ta and tb where they have them."""
    ta, tb = (F.col(t) if t in pairs.columns else tokens(F.col(c)) for t, c in (("ta", "a"), ("tb", "b")))
    return pairs.withColumn("jaccard", jaccard_of(ta, tb)).drop("ta", "tb")


def with_tokens(texts: DataFrame) -> DataFrame:
    """Adds the token array t of the column text, once for each text and not for each pair."""
    return texts.withColumn("t", tokens(F.col("text")))


def llm_human_pairs(conversions: DataFrame, humans: DataFrame) -> DataFrame:
    """req_id, annotator, a = the machine's text, b = a human's; blank human texts give none. Token arrays t go along as ta, tb."""
    has = "t" in conversions.columns
    h = humans.where(blank(F.col("text")) != "").select("req_id", "annotator", F.col("text").alias("b"), *([F.col("t").alias("tb")] if has else []))
    return conversions.select("req_id", F.col("text").alias("a"), *([F.col("t").alias("ta")] if has else [])).join(h, "req_id")


def human_pairs(humans: DataFrame) -> DataFrame:
    """req_id, i, j, a, b: every earlier human text of a requirement with every later one.

    The texts of a requirement are few: they are gathered in one array and paired there, without a self-join.
    """
    has = "t" in humans.columns
    arr = humans.where(blank(F.col("text")) != "").groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "text", *(["t"] if has else [])))).alias("h"))
    left = arr.select("req_id", "h", F.posexplode("h").alias("i", "x"))
    later = F.slice(F.col("h"), F.col("i") + 2, F.greatest(F.size("h") - F.col("i") - 1, F.lit(0)))
    arrays = [F.col("x.t").alias("ta"), F.col("y.t").alias("tb")] if has else []
    return left.select("req_id", "x", "i", F.posexplode(later).alias("k", "y")).select("req_id", F.col("x.annotator").alias("i"), F.col("y.annotator").alias("j"), F.col("x.text").alias("a"), F.col("y.text").alias("b"), *arrays)


def distribution(df: DataFrame, value: str) -> DataFrame:
    """n, mean, median (midpoint), min, max and population deviation; zeros for no rows."""
    x = F.col(value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(F.count(x).alias("n"), zero(F.avg(x)).alias("mean"), zero(F.percentile(x, 0.5)).alias("median"), zero(F.min(x)).alias("min"), zero(F.max(x)).alias("max"), zero(F.stddev_pop(x)).alias("std"))


def per_requirement(requirements: DataFrame, pairs: DataFrame, values: tuple[str, ...] = ("jaccard",)) -> DataFrame:
    """n_humans and mean and max of each measure for every requirement, zeros where it has no human text."""
    cells: list[Column] = [F.count("*").alias("n_humans")]
    for v in values:
        cells += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max")]
    return requirements.select("req_id").join(pairs.groupBy("req_id").agg(*cells), "req_id", "left").fillna(0)
