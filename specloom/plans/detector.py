"""Smell detection from parse trees: segments, their rules, requirement rules and a recommended pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions import verbs as V
from specloom.operators import clauses, smells, spans

# The messages of the smells.
MESSAGES = {
    "Non-atomic requirement": "The requirement has more than one action in the system response.",
    "Incomplete requirement": "The requirement does not have a system response.",
    "Incorrect order requirement": "The condition clause of the requirement is after the system response.",
    "Coordination ambiguity": "Requirement contains multiple conditions separated by conjunction OR.",
    "Not requirement": "The sentence does not contain a system response nor condition nor a scope phrase.",
    "Incomplete condition": "Verb is missing in the condition.",
    "Incomplete system response": "Modal verb is missing in the SR.",
    "Passive voice": "Passive voice in the {}.",
    "Not precise verb": "Not precise verb in the {}.",
}


def segment_table(tree_rows: DataFrame) -> DataFrame:
    """Segments with their kind of condition and the flags of segment-level smells."""
    s = clauses.segment_requirements(tree_rows)
    names = F.split("label", " ")
    cond, resp = F.exists(names, lambda x: x.startswith("cond") | x.startswith("multCond")), F.exists(names, lambda x: x.startswith("sysresp") | x.startswith("multSrs"))
    first_cond = names[0].startswith("cond") | names[0].startswith("multCond")
    kind = F.when(cond & F.col("main").isNotNull(), V.condition_kind(F.col("main")))
    time = (F.col("label") == "conditionNoVerb") & F.lower(F.split("text", " ")[0]).isin("after", "before")
    s = s.withColumns({"kind": kind, "time": time, "cond": cond, "resp": resp})
    bare = F.exists(names, lambda x: x.isin("condContNoVerb", "conditionWithSymbol") | x.contains("IncomplNo"))
    return s.withColumns({
        "Incomplete condition": cond & ~time & (first_cond & F.col("noverb") | bare & ~names[0].startswith("sysresp") | F.array_contains(names, "condContNoVerb")),
        "Incomplete system response": resp & (~F.col("modal") | (F.size("verbs") == 0)) | F.col("acts"),
        "Passive voice": (cond | resp) & F.col("passive"),
        "Not precise verb": F.coalesce((cond | resp) & V.is_vague(V.stem_udf(F.col("main"))), F.lit(False)),
    })


def requirement_table(segments: DataFrame) -> DataFrame:
    """One row per requirement: labels in order, structure, flags and pattern."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(c).alias("v")))), lambda x: x["v"])
    is_or = F.when((F.col("label") == "notMatch") & (F.lower(F.trim(F.translate("text", ",", ""))) == "or"), "or").otherwise(F.col("label"))
    flat = F.flatten(F.transform(ordered("shown"), lambda x: F.split(x, " ")))
    g = segments.withColumn("shown", is_or).groupBy("req_id").agg(flat.alias("labels"), ordered("kind").alias("kinds"), F.count_if("time").alias("times"), F.count("*").alias("n"))
    g = smells.requirement_rules(g.withColumn("kinds", F.filter("kinds", lambda x: x.isNotNull())))
    kind = V.structure_type(F.col("n_scope"), F.col("n_cond_before") + F.col("n_cond_after"), F.col("n_resp"))
    n = V.pattern_number(kind, F.col("kinds"), F.col("n_scope"), F.col("times"))
    return g.withColumns({"structure": kind, "pattern": F.coalesce(V.pattern_name(n), F.lit("")), "template": F.coalesce(V.pattern_template(n), F.lit(""))})


def report(tree_rows: DataFrame) -> DataFrame:
    """Rows as a smell report holds them: one per segment, requirement-level values on the first only."""
    seg = segment_table(tree_rows).persist()  # read by four branches below; lost parts are worked out again
    req = requirement_table(seg)
    flags = dict(zip(smells.SMELLS[:5], ("non_atomic", "incomplete", "incorrect_order", "coordination", "not_requirement"), strict=True))
    first = F.col("k") == 1
    part = F.when(F.col("label").startswith("cond") | F.col("label").startswith("multCond"), "condition").otherwise("system response")
    say = lambda on, name: F.when(on, F.replace(F.lit(MESSAGES[name]), F.lit("{}"), part)).otherwise("").alias(name)
    # segments are counted over the file: by the requirements' ordinal where rows have one, else by their ids
    place = tree_rows.groupBy("req_id").agg(F.min("ordinal" if "ordinal" in tree_rows.columns else "req_id").alias("place"))
    req = req.join(place, "req_id").withColumn("inner", F.sum("n").over(Window.partitionBy("place").orderBy("req_id")) - F.col("n"))
    offset = spans.offsets(req.groupBy("place").agg(F.sum("n").alias("n")), "place", place)
    req = req.join(offset, F.col("place").eqNullSafe(F.col("_key"))).withColumn("start", F.col("before") + F.col("inner"))
    joined = seg.drop("start").join(req.select("req_id", *flags.values(), "pattern", "template", "start"), "req_id").withColumn("overall", F.col("start") + F.col("k"))
    cells = [say(first & F.col(flags[s]), s) for s in smells.SMELLS[:5]] + [say(F.col(f"`{s}`"), s) for s in smells.SMELLS[5:]]
    return joined.select("req_id", F.concat_ws("_", "req_id", F.col("overall").cast("string")).alias("segment_id"), F.col("text").alias("segment"), *cells, F.when(first, F.col("pattern")).otherwise("").alias("pattern"), F.when(first, F.col("template")).otherwise("").alias("template"), F.col("k").alias("ordinal"))


def totals(rows: DataFrame) -> DataFrame:
    """Requirements, those with a smell, and the number of requirements that each smell marks."""
    marked = [F.count_distinct(F.when(F.trim(f"`{s}`") != "", F.col("req_id"))).alias(s) for s in smells.SMELLS]
    any_smell = F.greatest(*[(F.trim(f"`{s}`") != "").cast("int") for s in smells.SMELLS])
    return rows.agg(F.count_distinct("req_id").alias("requirements"), F.count_distinct(F.when(any_smell == 1, F.col("req_id"))).alias("with_smells"), *marked)
