"""Tree relations and marks against a plain walk over nested lists, and how clauses of a sentence become segments."""

import random

from pyspark.sql import functions as F

from specloom.operators import clause_patterns as C
from specloom.operators import clauses, treebank

LABELS = ["S", "NP", "VP", "SBAR", "IN", "VBZ", "MD"]


def random_tree(r, levels=0):
    if levels > 5 or r.random() < 0.25 and levels:
        return f"({r.choice(LABELS)} {r.choice(['if', 'is', 'x'])})"
    return f"({r.choice(LABELS)} " + " ".join(random_tree(r, levels + 1) for _ in range(r.randint(1, 3))) + ")"


class Plain:
    """A condition on node i of a list of nodes, by parents and children alone."""

    def __init__(self, nodes):
        self.n = nodes
        self.kids = [[m["pre"] for m in nodes if m["parent"] == n["pre"]] for n in nodes]

    def up(self, i):
        while (i := self.n[i]["parent"]) >= 0:
            yield i

    def down(self, i):
        for k in self.kids[i]:
            yield k
            yield from self.down(k)

    def edge(self, i):
        while self.kids[i]:
            i = self.kids[i][0]
            yield i

    def related(self, how, i):
        up = list(self.up(i))
        sisters = self.kids[up[0]] if up else [i]
        at = sisters.index(i)
        return {
            "child": self.kids[i], "first": self.kids[i][:1], "below": list(self.down(i)), "leftmost": list(self.edge(i)), "above": up, "next": sisters[at + 1 : at + 2], "prev": sisters[:at][-1:],
            "later": sisters[at + 1 :], "earlier": sisters[:at], "parent": up[:1], "first_of": up[:1] if at == 0 else [], "last_of": up[:1] if at == len(sisters) - 1 else [],
        }[how]

    def holds(self, p, i):
        import re

        kind, what = p
        if kind == "tag":
            return self.n[i]["label"] in what
        if kind == "like":
            return re.search(what, self.n[i]["label"]) is not None
        if kind in ("both", "either"):
            return (all if kind == "both" else any)(self.holds(q, i) for q in what)
        if kind == "no":
            return not self.holds(what, i)
        return any(self.holds(what, j) for j in self.related(kind, i))


def test_marks_equal_a_plain_walk(spark):
    r = random.Random(2)
    trees = [(i, random_tree(r)) for i in range(60)]
    hows = ("child", "first", "below", "leftmost", "above", "next", "prev", "later", "earlier", "parent", "first_of", "last_of")
    made = [(h, C.either(C.tag("NP", "is"), C.like("V"))) for h in hows]
    made += [(h, C.both(C.tag("S", "NP", "VP"), (g, C.no((h, C.tag("VP", "x")))))) for h, g in zip(hows, reversed(hows), strict=True)]
    marks = C.Marks(made)
    rows = marks.mark(treebank.read_nodes(spark.createDataFrame(trees, "i int, tree string")))
    cols = [F.expr(f"transform(filter(nodes, n -> {marks.holds(p, 'n')}), n -> n.pre)").alias(f"p{k}") for k, p in enumerate(made)]
    got = {x.i: x for x in rows.select("i", *cols).collect()}
    for i, t in trees:
        plain = Plain(treebank.read(t))
        for k, p in enumerate(made):
            assert list(got[i][f"p{k}"]) == [n["pre"] for n in plain.n if plain.holds(p, n["pre"])], (p, t)


def test_patterns_equal_a_plain_walk(spark):
    """On the tree shapes that the queries are made of, every clause and passive pattern, and each of the former fits some."""
    from specloom.plans import registry as R

    r = random.Random(3)
    trees = []
    for k, lead in enumerate(R._LEADS):
        for _ in range(4):
            wrap = r.random() < 0.4
            t = f"(ROOT (S {lead} {'(S ' if wrap else ''}{r.choice(R._MAINS)}{')' if wrap else ''} {r.choice(R._TAILS[:4])}))"
            trees.append((len(trees), t.replace("@", "user").replace("%", "mail")))
    df = spark.createDataFrame(trees, "req_id int, tree string")
    got = {x.req_id: {(c["name"], c["head"]): c["passive"] for c in x.found} for x in clauses.marked(df).select("req_id", clauses.found_clauses().alias("found")).collect()}
    seen = set()
    for i, t in trees:
        plain = Plain(treebank.read(t))
        want = {(name, n["pre"]): any(plain.holds(C.PASSIVES[k], n["pre"]) for k in C.passives_of(name)) for name, p in clauses.PATTERNS.items() for n in plain.n if plain.holds(p, n["pre"])}
        seen |= {name for name, _ in want}
        assert got[i] == want, t
    assert set(C.CLAUSES) - seen <= {"scopeSC1", "scopeSC2", "conditionS4"}


def segments(spark, tree):
    rows = clauses.segment_requirements(spark.createDataFrame([("r", tree)], "req_id string, tree string")).collect()
    return [(r.label, r.text) for r in sorted(rows, key=lambda r: r.k)]


def test_a_response_ends_where_a_condition_in_it_begins(spark):
    t = "(S (PP (IN For) (NP (DT each) (NN user))) (, ,) (NP (NN System)) (VP (MD must) (VP (VB send) (NP (NN mail)) (SBAR (IN if) (S (NP (NN it)) (VP (VBZ has) (NP (NN text))))))) (. .))"
    assert segments(spark, t) == [("scope", "For each user"), ("notMatch", ","), ("sysresp", "System must send mail"), ("condition", "if it has text"), ("notMatch", ".")]


def test_what_goes_on_with_a_segment_is_attached(spark):
    t = "(S (SBAR (IN if) (S (NP (NN x)) (VP (VBZ has) (NP (NN y))))) (CC and) (NP (NN z)) (VP (VBZ is) (ADJP (JJ set))) (, ,) (NP (NN System)) (VP (MD must) (VP (VB send) (NP (NN mail)))) (CC and) (VP (VBZ stops)))"
    assert segments(spark, t) == [("condition", "if x has y"), ("condCont", "and z is set ,"), ("multSrs", "System must send mail"), ("sysrespCont", "and stops")]


def test_as_soon_as_beside_a_response(spark):
    t = "(S (ADVP (RB as) (RB soon)) (PP (IN as) (S (NP (DT the) (NN user)) (VP (VBZ logs)))) (, ,) (NP (NN System)) (VP (MD must) (VP (VB send) (NP (NN mail)))))"
    assert segments(spark, t) == [("condition", "as soon as the user logs ,"), ("sysresp", "System must send mail")]


def test_overlapping_clauses_are_one(spark):
    c = lambda s, e, name, p=False: (s, e, name, "condition", p, s, e, False, False)
    rows = [([c(5, 9, "b"), c(0, 6, "a", True), c(9, 12, "d"), c(10, 11, "e"), c(20, 21, "f")],), ([],)]
    df = spark.createDataFrame(rows, "found array<struct<start:int,end:int,name:string,kind:string,passive:boolean,head:int,to:int,several:boolean,joined:boolean>>")
    got = [[(x["start"], x["end"], x["name"], x["passive"]) for x in r.m] for r in df.select(clauses.merged().alias("m")).collect()]
    assert got == [[(0, 9, "a", True), (9, 12, "d", False), (20, 21, "f", False)], []]


def test_odd_rows(spark):
    rows = [("a", None), ("b", ""), ("c", "(S (broken"), (None, "(S (NP (NN x)))"), ("d", "(S)"), ("d", "(S (NP (NN x)))"), ("d", "(S (NP (NN x)))")]
    got = clauses.segment_requirements(spark.createDataFrame(rows, "req_id string, tree string")).collect()
    assert sorted((str(r.req_id), r.label, r.text) for r in got) == [("None", "notMatch", "x"), ("d", "notMatch", "x"), ("d", "notMatch", "x")]


def test_trees_are_dealt_out_and_marked_without_a_search_per_node(spark):
    """A tree of 20,000 sisters in a table of one partition: conditions are worked out by places, not by scans of the array."""
    n = 20_000
    wide = "(S " + " ".join("(NP x)" if k % 2 else "(VP y)" for k in range(n)) + ")"
    made = [C.both(C.tag("VP"), C.later(C.tag("NP", "VP"), C.earlier(C.tag("VP")))), C.both(C.like("N"), C.no(C.later(C.tag("NP")))), C.above(C.tag("S")), C.like("^S$")]
    marks = C.Marks(made)
    rows = marks.mark(treebank.read_nodes(spark.createDataFrame([(wide,), (None,), ("(S)",)], "tree string").coalesce(1)))
    counts = [F.expr(f"size(filter(nodes, n -> {marks.holds(p, 'n')}))") for p in made]
    assert sorted(tuple(r) for r in rows.select(*counts).collect()) == [(0, 0, 0, 0), (0, 0, 0, 1), (n // 2, 1, 2 * n, 1)]
    trees = spark.createDataFrame([("r", "(S (NP (NN x)))")], "req_id string, tree string").coalesce(1)
    d = clauses.marked(trees)
    assert "exists(" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
