import hashlib
import re

import pytest
from pyspark.sql import functions as F

from specloom.functions import text as X
from specloom.operators import scoring, similarity, smells, spans
from specloom.plans import registry


def evals(spark, rows):
    return spark.createDataFrame(rows, "req_id string, slot string, gold string, llm string")


def test_confusion_has_one_of_each(spark):
    e = evals(spark, [("a", "actor", "missing", "missing"), ("b", "actor", "present", "missing"), ("c", "actor", "missing", "filled"), ("d", "actor", "implied", "filled")])
    r = scoring.slot_confusion(e).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)


def test_blank_and_null_gold_are_not_missing(spark):
    e = evals(spark, [("a", "actor", "", "filled"), ("b", "actor", None, "filled"), ("c", "actor", " Missing ", "missing")])
    r = scoring.slot_confusion(e.fillna("", ["gold"])).first()
    assert (r.tp, r.tn) == (1, 2)


def test_all_slots_have_rows_and_zero_scores(spark):
    slots = spark.createDataFrame([(s,) for s in X.SLOTS], "slot string")
    out = {r.slot: r for r in scoring.slot_prf(evals(spark, [("a", "actor", "missing", "missing")]), slots).collect()}
    assert len(out) == 5 and out["scope"].f1 == 0.0 and out["actor"].f1 == 1.0 and out["actor"].support_gold_missing == 1
    assert scoring.macro(evals(spark, [("a", "actor", "missing", "missing")]), slots).first().f1 == pytest.approx(0.2)


def test_micro_recall(spark):
    e = evals(spark, [("a", "actor", "missing", "missing"), ("a", "action", "missing", "filled")])
    r = scoring.micro(e).first()
    assert r.recall == 0.5 and r.precision == 1.0


def test_lenses(spark):
    e = evals(spark, [("a", "actor", "implied", "filled"), ("b", "actor", "implied", "missing"), ("c", "scope", "missing", "filled"), ("d", "scope", "missing", "missing")])
    assert [r.fill_rate for r in scoring.lens(e, "implied").where("slot IS NULL").collect()] == [0.5]
    r = scoring.lens(e, "missing").where("slot IS NULL").first()
    assert (r.filled, r.flag_rate) == (1, 0.5)


def test_only_mandatory_slots_make_incomplete(spark):
    e = evals(spark, [("a", "scope", "present", "missing"), ("b", "actor", "present", "missing")])
    assert {r.req_id: r.llm_incomplete for r in scoring.overall_incomplete(e).collect()} == {"a": False, "b": True}


def test_verdict_agreement(spark):
    rows = spark.createDataFrame([(False, False), (True, True), (False, True)], "gold_incomplete boolean, llm_incomplete boolean")
    r = scoring.verdict(rows).first()
    assert r.agreement == pytest.approx(2 / 3) and (r.tn, r.tp, r.fp, r.fn) == (1, 1, 1, 0)


def test_empty_input_scores_zero(spark):
    e = evals(spark, [])
    assert scoring.micro(e).first().f1 == 0.0
    assert scoring.verdict(spark.createDataFrame([], "gold_incomplete boolean, llm_incomplete boolean")).first().agreement == 0.0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize_and_jaccard(spark):
    assert one(spark, X.normalize(F.lit("The App must <MISSING_ACTION>."))) == "the app must ."
    j = lambda a, b: one(spark, X.jaccard_of(X.tokens(F.lit(a)), X.tokens(F.lit(b))))
    assert j("a b c", "b c d") == 0.5 and j("", " ") == 1.0 and j("", "a") == 0.0


def test_strip_and_fences(spark):
    assert one(spark, X.strip_placeholders(F.lit("When <MISSING_ACTOR> , , the App must <MISSING_ACTION> ."))) == "When, the App must."
    assert one(spark, X.strip_fences(F.lit("```text\nThe App must act.\n```"))) == "The App must act."
    assert one(spark, X.strip_fences(F.lit("plain"))) == "plain"
    assert one(spark, X.final_line(F.lit("x\nFinal: a\n\nFinal Rimay:\n **b** \nc"))) == "b"
    assert one(spark, X.final_line(F.lit("a\n\n*b*\n"))) == "b"
    assert one(spark, X.preclean(F.lit("the “main  panel” now , lock  in"))) == "the main_panel now, lock  in".replace("  ", " ")


def conversions(spark):
    h = spark.createDataFrame([("r", 1, "a b c"), ("r", 2, "b c d"), ("r", 3, "a b c"), ("q", 1, " ")], "req_id string, annotator int, text string")
    m = spark.createDataFrame([("r", "a b c"), ("q", "z")], "req_id string, text string")
    return m, h


def test_pair_counts_and_similarity(spark):
    m, h = conversions(spark)
    assert similarity.human_pairs(h).count() == 3
    pairs = similarity.with_seq_ratio(similarity.with_jaccard(similarity.llm_human_pairs(m, h)))
    d = similarity.distribution(pairs, "jaccard").first()
    assert d.n == 3 and d.max == 1.0 and d.median == 1.0 and d.min == 0.5
    out = {r.req_id: r for r in similarity.per_requirement(m, pairs).collect()}
    assert out["q"].n_humans == 0 and out["q"].jaccard_mean == 0.0 and out["r"].n_humans == 3
    assert {round(r.seq_ratio, 3) for r in pairs.collect()} == {1.0, 0.6}


def test_distribution_of_nothing(spark):
    d = similarity.distribution(spark.createDataFrame([], "v double"), "v").first()
    assert (d.n, d.mean, d.std) == (0, 0.0, 0.0)


def test_smell_summary(spark):
    c = spark.createDataFrame([("a", True, 0), ("b", False, 2), ("c", None, None)], "req_id string, passed boolean, n_smells int")
    r = smells.summary(c).first()
    assert (r.n, r.n_scored, r.n_error, r.pass_rate, r.n_with_smells) == (3, 2, 1, 0.5, 1)


def test_spans(spark):
    s = spark.createDataFrame([("r", 0, 3, "a"), ("r", 2, 5, "b"), ("r", 7, 8, "c"), ("r", 7, 8, "d")], "id string, start int, end int, label string")
    assert sorted((r.start, r.end, r.labels) for r in spans.merge_spans(s, "id").collect()) == [(0, 5, "a b"), (7, 8, "c d")]
    assert spans.dedupe_spans(s, "id").count() == 3


def _precleaned(s):
    """The rules as plain substitutions."""
    word = lambda m: re.sub(r"\s+", "_", re.sub("[“”]", "", m[0]).strip())
    s = re.sub("(“|”).*?(”|“)", word, s.replace(":", ""))
    for pattern, by in (
        ("[()']", ""), ("-", "_"), (",{2,4}", ","), (";", ""), (r"<lb>(Note|Notes|NOTE).+([a-zA-Z]|[0-9]|\.)$", ""), (r"<lb>(To illustrate).+\.", ""), (r"(<lb><bullet>)(.*)(,|;)", r"\1\2"),
        ("<lb><bullet>", r"\\*"), ("<lb>", ", "), (r"(\w+)( )(,)", r"\1\3"), (", *,", ","), (r"(lock\w+)\s{1,3}(in)", r"\1_\2"), (r"\s{2,}", " "),
    ):
        s = re.sub(pattern, by, s)
    return s


def test_preclean_runs_over_all_conversations(spark, tmp_path):
    texts = ["plain: (a) b-c ,, d;", "open “the  main panel” now , “x”", "a “b c\nd” e “f g” h", "one ” two", "“ a b ”“c d”", "locked  in the block , clock in", "do<lb><bullet>one,<lb><bullet>two;<lb>Note this.", "x<lb>To illustrate it.", "if a < b , c", "", None]
    spark.createDataFrame([(i, 0, "u", x) for i, x in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.cleaned_sha256 for r in registry.QUERIES["preclean_conversations"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(_precleaned(x or "").encode()).hexdigest() for i, x in enumerate(texts)}
