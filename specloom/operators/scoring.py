"""Scores of missing-slot detection over long rows (req_id, slot, gold, llm). A missing slot is the positive class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import MANDATORY, is_missing, slot_value


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to rows with tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _cells(g: Column, p: Column) -> list[Column]:
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")]


def slot_confusion(evals: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn, tn of each slot; with ``slots`` (column slot) every one of them has a row."""
    out = evals.groupBy("slot").agg(*_cells(is_missing(F.col("gold")), is_missing(F.col("llm"))))
    if slots is None:
        return out
    return slots.select("slot").distinct().join(out, "slot", "left").fillna(0, ["tp", "fp", "fn", "tn"])


def slot_prf(evals: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    return prf(slot_confusion(evals, slots)).withColumn("support_gold_missing", F.col("tp") + F.col("fn"))


def micro(evals: DataFrame) -> DataFrame:
    return prf(slot_confusion(evals).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def macro(evals: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Means over slots; one without support counts as 0."""
    return slot_prf(evals, slots).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def lens(evals: DataFrame, kind: str) -> DataFrame:
    """Of the slots whose gold value is ``kind``: filled and flagged, by slot and overall (slot is null)."""
    flagged = is_missing(F.col("llm"))
    out = evals.where(slot_value(F.col("gold")) == kind).rollup("slot").agg(F.count("*").alias("n"), F.count_if(~flagged).alias("filled"), F.count_if(flagged).alias("flagged"))
    return out.withColumns({"fill_rate": ratio(F.col("filled"), F.col("n")), "flag_rate": ratio(F.col("flagged"), F.col("n"))})


def overall_incomplete(evals: DataFrame, mandatory: tuple[str, ...] = MANDATORY) -> DataFrame:
    """req_id, llm_incomplete: whether a mandatory slot is flagged."""
    return evals.groupBy("req_id").agg(F.coalesce(F.bool_or(F.col("slot").isin(*mandatory) & is_missing(F.col("llm"))), F.lit(False)).alias("llm_incomplete"))


def verdict(rows: DataFrame) -> DataFrame:
    """2x2 of the overall verdict over rows (gold_incomplete, llm_incomplete), positive = incomplete."""
    g, p = F.coalesce(F.col("gold_incomplete"), F.lit(False)), F.coalesce(F.col("llm_incomplete"), F.lit(False))
    out = rows.agg(*_cells(g, p), F.count("*").alias("n"))
    return prf(out).withColumn("agreement", ratio(F.col("tp") + F.col("tn"), F.col("n")))


def slot_match(evals: DataFrame) -> DataFrame:
    g, p = is_missing(F.col("gold")), is_missing(F.col("llm"))
    return evals.select("req_id", "slot", g.alias("gold_missing"), p.alias("llm_missing"), (g == p).alias("match"))


def comparison(evals: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """One row per requirement with 0/1 columns gold_, llm_ and match_ per slot."""
    m = slot_match(evals)
    cells = []
    for s in slots:
        here = F.col("slot") == s
        cells += [F.max(F.when(here, F.col(c).cast("int"))).alias(f"{a}_{s}") for a, c in (("gold", "gold_missing"), ("llm", "llm_missing"), ("match", "match"))]
    return m.groupBy("req_id").agg(*cells)
