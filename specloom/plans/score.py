"""Scoring of a run, end to end: gold and conversion records to the nested results, their file and the comparison rows.

Both tracks read one frame with a row per evaluated requirement, so slot scores, lenses and the verdict are one wide
aggregate of it, and similarity is computed once per pair of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import MANDATORY, SLOTS, blank, is_missing, slot_value
from specloom.operators import similarity
from specloom.operators.scoring import ratio
from specloom.sources.records import write_json

#: Measures of two texts by name; more may be registered. The first is the one that summaries put first.
MEASURES: dict[str, Callable[[DataFrame], DataFrame]] = {"seq_ratio": similarity.with_seq_ratio, "jaccard": similarity.with_jaccard}


def register_measure(name: str, add: Callable[[DataFrame], DataFrame]) -> None:
    """Make ``add``, which adds a column ``name`` to pairs (a, b), a measure of all reports."""
    MEASURES[name] = add


def conversion_similarity(pairs: DataFrame, measure: str = "seq_ratio") -> DataFrame:
    """Pairs (a, b) with the column similarity: the measure of that name."""
    return MEASURES[measure](pairs).withColumnRenamed(measure, "similarity")


def similarity_pair(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the struct similarity of all registered measures."""
    for add in MEASURES.values():
        pairs = add(pairs)
    return pairs.withColumn("similarity", F.struct(*MEASURES)).drop(*MEASURES)


def evaluation_sets(gold: DataFrame, records: DataFrame, exemplars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold rows joined with their records, and those of them left out as exemplars; in gold order by ``ordinal``."""
    both = gold.join(records.withColumnRenamed("reqId", "req_id"), "req_id")
    ids = exemplars.select("req_id").distinct()
    return both.join(ids, "req_id", "left_anti"), both.join(ids, "req_id", "left_semi").select("req_id", "ordinal")


def requirement_rows(evaluated: DataFrame) -> DataFrame:
    """One row per requirement with its slots, matches, verdicts, similarity to the human texts and smell check."""
    gold = F.struct(*[F.coalesce(F.col(f"gold_{s}"), F.lit("")).alias(s) for s in SLOTS])
    base = evaluated.select(
        "req_id", "ordinal", "nl_text", F.filter(F.transform("annotations", lambda a: a["rimay"]), lambda t: blank(t) != "").alias("human_texts"), F.coalesce("rimay", F.lit("")).alias("llm_text"),
        gold.alias("gold_slots"), "llm_slots", F.coalesce("gold_incomplete", F.lit(False)).alias("gold_overall"), "check_passed", F.coalesce("check_smells", F.array().cast(evaluated.schema["check_smells"].dataType)).alias("check_smells"),
    )
    flag = lambda c: F.coalesce(is_missing(c), F.lit(False))
    match = F.struct(*[(flag(F.col(f"llm_slots.{s}")) == flag(F.col(f"gold_slots.{s}"))).alias(s) for s in SLOTS])
    overall = F.lit(False)
    for s in MANDATORY:
        overall = overall | flag(F.col(f"llm_slots.{s}"))
    base = base.withColumns({"slot_match": match, "llm_overall": overall}).withColumn("verdict_match", F.col("gold_overall") == F.col("llm_overall"))
    sim = per_requirement(llm_pairs(base))
    joined = base.join(sim, "req_id", "left")
    zero = [F.coalesce(F.col("n_humans"), F.lit(0).cast("bigint")).alias("n_humans")] + [F.coalesce(f"{m}_{x}", F.lit(0.0)).alias(f"{m}_{x}") for m in MEASURES for x in ("mean", "max")]
    return joined.withColumn("similarity", F.struct(*zero)).drop("n_humans", *[f"{m}_{x}" for m in MEASURES for x in ("mean", "max")])


def llm_pairs(rows: DataFrame) -> DataFrame:
    """req_id, a = the machine's text, b = each human one, with all measures."""
    pairs = rows.select("req_id", F.col("llm_text").alias("a"), F.posexplode("human_texts").alias("annotator", "b"))
    for add in MEASURES.values():
        pairs = add(pairs)
    return pairs


def human_pairs(rows: DataFrame) -> DataFrame:
    """req_id, a, b: each earlier human text with each later one, with all measures."""
    pairs = similarity.human_pairs(rows.select("req_id", F.posexplode("human_texts").alias("annotator", "text")))
    for add in MEASURES.values():
        pairs = add(pairs)
    return pairs


def per_requirement(pairs: DataFrame) -> DataFrame:
    """req_id, n_humans, and mean and max of every measure."""
    cells = [f(m).alias(f"{m}_{x}") for m in MEASURES for x, f in (("mean", F.avg), ("max", F.max))]
    return pairs.groupBy("req_id").agg(F.count("*").alias("n_humans"), *cells)


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def field_accuracy(rows: DataFrame, slots: tuple[str, ...] = SLOTS) -> DataFrame:
    """One row, column field_accuracy: n, per_slot, micro, macro, the lenses on implied and missing slots, the verdict."""
    flag = lambda c: F.coalesce(is_missing(c), F.lit(False))
    cells = [F.count("*").alias("n")]
    for s in slots:
        g, p = flag(F.col(f"gold_slots.{s}")), flag(F.col(f"llm_slots.{s}"))
        implied = slot_value(F.col(f"gold_slots.{s}")) == "implied"
        cells += [F.count_if(x).alias(f"{k}_{s}") for k, x in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p), ("if", implied & ~p), ("im", implied & p))]
    g, p = F.col("gold_overall"), F.col("llm_overall")
    cells += [F.count_if(x).alias(k) for k, x in (("both", g & p), ("llm", ~g & p), ("gold", g & ~p), ("none", ~g & ~p))]
    one = rows.agg(*cells)
    c = lambda k, s: F.col(f"{k}_{s}")
    total = lambda k: sum((c(k, s) for s in slots[1:]), c(k, slots[0]))
    per_slot = F.struct(*[F.struct(*[c(k, s).alias(k) for k in ("tp", "fp", "fn", "tn")], *_prf(c("tp", s), c("fp", s), c("fn", s)), (c("tp", s) + c("fn", s)).alias("support_gold_missing")).alias(s) for s in slots])
    one = one.withColumn("per_slot", per_slot)
    mean = lambda f: (sum((F.col(f"per_slot.{s}.{f}") for s in slots[1:]), F.col(f"per_slot.{slots[0]}.{f}")) / len(slots)).alias(f)
    lens_i = lambda a, b: F.struct((a + b).alias("n_implied"), a.alias("llm_filled"), b.alias("llm_flagged_missing"), ratio(a, a + b).alias("fill_rate"))
    lens_m = lambda a, b: F.struct((a + b).alias("n_missing"), a.alias("llm_flagged_missing"), b.alias("llm_silently_filled"), ratio(a, a + b).alias("flag_rate"))
    both, llm, gold, none = (F.col(k) for k in ("both", "llm", "gold", "none"))
    verdict = F.struct(
        F.struct(both.alias("both_incomplete"), llm.alias("llm_incomplete_gold_complete"), gold.alias("gold_incomplete_llm_complete"), none.alias("both_complete")).alias("confusion"),
        ratio(both + none, F.col("n")).alias("agreement_rate"), F.col("n"), *_prf(both, llm, gold),
    )
    return one.select(F.struct(
        "n", "per_slot", F.struct(*_prf(total("tp"), total("fp"), total("fn"))).alias("micro"), F.struct(mean("precision"), mean("recall"), mean("f1")).alias("macro"),
        F.struct(lens_i(total("if"), total("im")).alias("overall"), F.struct(*[lens_i(c("if", s), c("im", s)).alias(s) for s in slots]).alias("per_slot")).alias("implied_analysis"),
        F.struct(lens_m(total("tp"), total("fn")).alias("overall"), F.struct(*[lens_m(c("tp", s), c("fn", s)).alias(s) for s in slots]).alias("per_slot")).alias("missing_analysis"),
        verdict.alias("overall_verdict"),
    ).alias("field_accuracy"))


def distributions(pairs: DataFrame) -> list[Column]:
    """For each measure the struct n, mean, median, min, max, std over pairs, then their number."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.struct(F.count(m).alias("n"), zero(F.avg(m)).alias("mean"), zero(F.percentile(m, 0.5)).alias("median"), zero(F.min(m)).alias("min"), zero(F.max(m)).alias("max"), zero(F.stddev_pop(m)).alias("std")).alias(m) for m in MEASURES]
    return [*out, F.count("*").alias("n_pairs")]


def _in_order(value: Column) -> Column:
    """The values of a group by ordinal."""
    return F.transform(F.array_sort(F.collect_list(F.struct("ordinal", value.alias("v")))), lambda x: x["v"])


def smell_summary(rows: DataFrame) -> DataFrame:
    """One row: counts, pass rate without tool errors, and firings by smell, the most frequent first, then the earliest."""
    n = rows.agg(
        F.count("*").alias("n"), F.count_if("check_passed").alias("n_passed"), F.count_if(~F.col("check_passed")).alias("n_failed"), F.count_if(F.col("check_passed").isNull()).alias("n_error"),
        F.count("check_passed").alias("n_scored"), F.count_if(F.size("check_smells") > 0).alias("n_with_smells"),
    ).withColumn("pass_rate", ratio(F.col("n_passed"), F.col("n_scored")))
    fired = rows.select("ordinal", F.posexplode("check_smells").alias("k", "s")).groupBy(F.coalesce("s.smell", F.lit("?")).alias("smell")).agg(F.count("*").alias("c"), F.min(F.struct("ordinal", "k")).alias("at"))
    ranked = fired.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "at", "smell"))).alias("a"))
    frequency = ranked.select(F.map_from_entries(F.transform("a", lambda x: F.struct(x["smell"], -x["c"]))).alias("smell_frequency"))
    return _beside(n, frequency).select(F.struct("n", "n_passed", "n_failed", "n_error", "n_scored", "pass_rate", "n_with_smells", "smell_frequency").alias("check"))


def _beside(*rows: DataFrame) -> DataFrame:
    """Frames of one row each, as one."""
    out = rows[0].withColumn("_k", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def conversion_quality(rows: DataFrame, checker: str = "tool") -> DataFrame:
    """One row, column conversion_quality: both similarity distributions and the smell check."""
    blank_ids = rows.agg(F.count_if(F.size("human_texts") > 0).alias("n_evaluated"), F.filter(_in_order(F.when(F.size("human_texts") == 0, F.col("req_id"))), lambda x: x.isNotNull()).alias("skipped_req_ids"))
    llm = _beside(llm_pairs(rows).agg(*distributions(rows)), blank_ids)
    llm = llm.select(F.struct(*MEASURES, "n_pairs", "n_evaluated", F.size("skipped_req_ids").alias("n_skipped_no_humans"), "skipped_req_ids").alias("llm_vs_human"))
    human = human_pairs(rows).agg(*distributions(rows)).select(F.struct(*MEASURES, "n_pairs").alias("human_human"))
    return _beside(llm, human, smell_summary(rows)).select(F.struct(F.struct("llm_vs_human", "human_human").alias("similarity"), F.col("check").alias(checker)).alias("conversion_quality"))


def score_run(gold: DataFrame, records: DataFrame, exemplars: DataFrame, run: str, meta: DataFrame | None = None, checker: str = "tool", gold_path: str = "", scored_at: str = "") -> DataFrame:
    """The results of a run, one nested row: counts, both tracks, a struct per requirement in gold order, a null verdict."""
    name = check_run_name(run.split("/")[0])
    evaluated, skipped = evaluation_sets(gold, records, exemplars)
    rows = requirement_rows(evaluated)
    ids = skipped.agg(_in_order(F.col("req_id")).alias("skipped_ids"))
    n = _beside(gold.agg(F.count("*").alias("gold")), records.agg(F.count("*").alias("converted")), rows.agg(F.count("*").alias("evaluated")), ids)
    counts = n.select(F.struct("gold", "converted", "evaluated", F.size("skipped_ids").cast("bigint").alias("skipped"), "skipped_ids").alias("counts"))
    each = F.struct(
        F.col("req_id").alias("reqId"), "nl_text", F.col("human_texts").alias("human_rimays"), F.col("llm_text").alias("llm_rimay"), "gold_slots", "llm_slots", "slot_match", "gold_overall", "llm_overall", "verdict_match",
        "similarity", F.col("check_passed").alias(f"{checker}_passed"), F.col("check_smells").alias(f"{checker}_smells"),
    )
    listed = rows.agg(_in_order(each).alias("requirements"))
    parts = [counts, field_accuracy(rows), conversion_quality(rows, checker), listed]
    if meta is not None:
        parts.append(meta.select(F.struct(*meta.columns).alias("meta")))
    out = _beside(*parts)
    strategy = run.rsplit("/", 1)[-1] if "/" in run else name
    head = [F.lit(run).alias("run"), F.lit(strategy).alias("strategy"), F.lit(scored_at).alias("scored_at"), F.lit(gold_path).alias("gold_csv"), (F.col("meta") if meta is not None else F.create_map().cast("map<string,string>")).alias("meta")]
    return out.select(*head, "counts", "field_accuracy", "conversion_quality", "requirements", F.lit(None).cast("string").alias("verdict"))


def comparison_rows(rows: DataFrame, strategy: str, checker: str = "tool") -> DataFrame:
    """The 25 columns of the comparison file, from :func:`requirement_rows`, in gold order."""
    cells = [F.lit(strategy).alias("strategy"), F.col("req_id").alias("reqId")]
    for s in SLOTS:
        cells += [F.col(f"gold_slots.{s}").alias(f"gold_{s}"), F.col(f"llm_slots.{s}").alias(f"llm_{s}"), F.col(f"slot_match.{s}").alias(f"match_{s}")]
    cells += [F.col("gold_overall").alias("gold_overall_incomplete"), F.col("llm_overall").alias("llm_overall_incomplete"), "verdict_match", "similarity.n_humans", "similarity.seq_ratio_mean", "similarity.seq_ratio_max", "similarity.jaccard_mean", F.col("check_passed").alias(f"{checker}_passed")]
    return rows.orderBy("ordinal").select(*cells)


def check_run_name(name: str) -> str:
    """The name of a run's folder; an error if it is empty, begins with a dash or holds a slash."""
    if not name or name.startswith("-") or "/" in name:
        raise ValueError(f"not a name of a run folder: {name!r}")
    return name


def valid_run_name(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[^/-][^/]*$"), F.lit(False))


def result_or_first(expected: DataFrame, results: DataFrame) -> DataFrame:
    """For each expected (call_id, req_id) the result (call_id, ordinal, req_id, ...) of that id, else the call's first."""
    j = results.withColumnsRenamed({"req_id": "found_id"}).join(expected.withColumnRenamed("req_id", "wanted"), "call_id")
    rank = F.struct((F.coalesce(F.col("found_id") != F.col("wanted"), F.lit(True))).alias("other"), "ordinal")
    return j.groupBy("call_id", F.col("wanted").alias("req_id")).agg(F.min_by(F.struct(*[c for c in j.columns if c not in ("call_id", "wanted")]), rank).alias("r")).select("call_id", "req_id", "r.*")


def write_results(results: DataFrame, path: str) -> None:
    """The results as one JSON file, as run discovery reads it."""
    write_json(results, path)
