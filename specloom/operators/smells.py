"""Smell records and the requirement-level rules over ordered segment labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The smell columns of a report, in order.
SMELLS = (
    "Non-atomic requirement",
    "Incomplete requirement",
    "Incorrect order requirement",
    "Coordination ambiguity",
    "Not requirement",
    "Incomplete condition",
    "Incomplete system response",
    "Passive voice",
    "Not precise verb",
)


def fired(segments: DataFrame) -> DataFrame:
    """One row per smell column with a value: req_id, segment_id, smell, value."""
    cells = F.array(*[F.struct(F.lit(s).alias("smell"), F.trim(F.coalesce(F.col(f"`{s}`"), F.lit(""))).alias("value")) for s in SMELLS])
    return segments.select("req_id", "segment_id", F.explode(cells).alias("c")).select("req_id", "segment_id", "c.smell", "c.value").where("value <> ''")


def frequency(smells: DataFrame, ordinal: str) -> DataFrame:
    """Firings by smell, most frequent first, ties in order of first occurrence; a missing name counts as '?'."""
    name = F.coalesce(F.col("smell"), F.lit("?")).alias("smell")
    return smells.groupBy(name).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def summary(checks: DataFrame) -> DataFrame:
    """checks: req_id, passed (null: the tool failed), n_smells. Failures of the tool are left out of the rate."""
    out = checks.agg(F.count("*").alias("n"), F.count_if(F.col("passed")).alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.count_if(F.col("passed").isNull()).alias("n_error"), F.count_if(F.col("n_smells") > 0).alias("n_with_smells"))
    out = out.withColumn("n_scored", F.col("n") - F.col("n_error"))
    return out.withColumn("pass_rate", F.coalesce(F.try_divide(F.col("n_passed").cast("double"), F.col("n_scored").cast("double")), F.lit(0.0)))


def with_any(segments: DataFrame) -> DataFrame:
    """req_id, has_smell."""
    any_here = F.lit(False)
    for s in SMELLS:
        any_here = any_here | (F.trim(F.coalesce(F.col(f"`{s}`"), F.lit(""))) != "")
    return segments.groupBy("req_id").agg(F.bool_or(any_here).alias("has_smell"))


def per_requirement(segments: DataFrame) -> DataFrame:
    """req_id, n_smells, patterns: cells with a smell, and the patterns recommended, in order of segments."""
    n = sum(((F.trim(F.coalesce(F.col(f"`{s}`"), F.lit(""))) != "").cast("int") for s in SMELLS[1:]), (F.trim(F.coalesce(F.col(f"`{SMELLS[0]}`"), F.lit(""))) != "").cast("int"))
    patterns = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.trim(F.coalesce("pattern", F.lit(""))).alias("p")))), lambda x: x["p"]), lambda p: p != "")
    return segments.withColumn("n", n).groupBy("req_id").agg(F.sum("n").alias("n_smells"), patterns.alias("patterns"))


# ---- rules over the lower-cased labels of a requirement's segments, in order ----------------------

def _count(labels: Column, test) -> Column:
    return F.size(F.filter(labels, test))


def _is_condition(x: Column) -> Column:
    return x.contains("cond")


def _is_response(x: Column) -> Column:
    return x.contains("sysresp") | x.contains("srs")


def structure_counts(labels: Column) -> dict[str, Column]:
    """Scopes, conditions before and after the first response, responses. A multiple condition counts twice."""
    first = F.array_position(F.transform(labels, _is_response), True)
    cut = F.when(first > 0, first.cast("int")).otherwise(F.size(labels) + 1)
    head = F.slice(labels, F.lit(1), cut - 1)
    tail = F.slice(labels, cut, F.size(labels) - cut + 1)
    weight = lambda arr: F.aggregate(arr, F.lit(0), lambda a, x: a + F.when(x.contains("multcond"), 2).when(_is_condition(x), 1).otherwise(0))
    return {
        "n_scope": _count(labels, lambda x: x.contains("scope")),
        "n_cond_before": weight(head),
        "n_cond_after": F.when(first > 0, weight(tail)).otherwise(0),
        "n_resp": F.aggregate(labels, F.lit(0), lambda a, x: a + F.when(x.contains("multsrs"), 2).when(_is_response(x), 1).otherwise(0)),
    }


def requirement_rules(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Flags non_atomic, incomplete, incorrect_order, coordination, not_requirement from ``labels`` (array of strings)."""
    low = F.transform(F.coalesce(F.col(labels), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    c = structure_counts(low)
    conditions = c["n_cond_before"] + c["n_cond_after"]
    # or-joined conditions: a label that says so, or an "or" segment between two conditions
    neighbours = F.exists(F.sequence(F.lit(0), F.greatest(F.size(low) - 3, F.lit(0))), lambda i: F.coalesce(_is_condition(F.get(low, i)) & (F.get(low, i + 1) == "or") & _is_condition(F.get(low, i + 2)), F.lit(False)))
    flags = {
        "non_atomic": c["n_resp"] > 1,
        "incomplete": (conditions + c["n_scope"] > 0) & (c["n_resp"] == 0),
        "incorrect_order": (c["n_cond_after"] > 0) & (c["n_resp"] > 0),
        "coordination": F.exists(low, lambda x: x.contains("coordamb")) | neighbours,
        "not_requirement": (conditions == 0) & (c["n_resp"] == 0),
    }
    return df.withColumns({**{k: v for k, v in c.items()}, **flags})


# Fixed values in the rules below: parts of the labels that segments bear.
def segment_rules(df: DataFrame, label: str = "label") -> DataFrame:
    """Flags of one segment by its label: missing parts of conditions and responses, passive voice, vague verbs."""
    x = F.lower(F.coalesce(F.col(label), F.lit("")))
    has = lambda *p: F.coalesce(F.lit(False) if not p else x.rlike("|".join(p)), F.lit(False))
    cond, resp = has("cond"), has("sysresp", "srs")
    return df.withColumns({
        "no_actor_cond": has("condposincomplnonoun", "conditions9", "conditions10", "conditions11", "conditionposs10"),
        "no_verb_cond": has("condposincomplnoverb", "condposincomplnonounnoverb", "conditionwithsymbol", "condcontwithnoverb", "multcond.*noverb", "conditions10", "conditions11", "conditionposs10"),
        "no_modal_resp": has("sysrespincomplnomodal"),
        "no_verb_resp": has("sysrespincomplnoverb", "sysrespincomplnomodalnoverb"),
        "passive_cond": cond & has("passivecond", "cond.*passive"),
        "passive_resp": has("passivesr", "sysresp.*passive"),
        "vague_cond": cond & has("ambverb") & ~resp,
        "vague_resp": resp & has("ambverb"),
    })
