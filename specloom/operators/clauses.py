"""Segments of requirements from constituency trees: clauses by pattern, trimmed and merged, gaps labelled by their words.

Everything is a column over one row per requirement, then one row per segment: no shuffle, no Python beyond the reader.
Steps: nodes -> clauses that patterns find -> responses and scopes end where a clause inside them begins -> overlapping
clauses become one -> gaps between them. Where no pattern fits, the words are cut before those that open a clause.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.operators import clause_patterns as C
from specloom.operators.treebank import read_nodes

#: Words that open a condition, words that open a clause, verbs that make a passive, signs of comparison, modals of a response, openers of a time phrase.
OPENERS = ("when", "where", "while", "if", "until", "once")
CUTS = (*OPENERS, "then", "for", "else", "otherwise")
AUXILIARIES = ("is", "are", "was", "were", "be", "been", "has", "have")
SYMBOLS = ("=", "<", ">", "≠", "<>")
RESPONSE_MODALS = ("must", "shall", "should", "will")
TIMES = ("upon", "on", "after", "before")

#: All patterns; what a pattern's clause is called. Conditions without a verb of their own have names of their own.
PATTERNS = {**C.CLAUSES, **C.LOOSE}
KINDS = {**{k: "condition" for k in PATTERNS if k.startswith("condition")}, **{k: "conditionNoVerb" for k in ("conditionS10", "conditionS11", "conditionS12")}, **{k: "scope" for k in ("scopeSC1", "scopeSC2")}, **{k: "sysresp" for k in ("sysrespSR", "sysrespStartSR", "sysrespPlain")}}
#: Clauses that end where others begin inside them, by pattern.
TRIMS = {"sysrespSR": ("scopeSC2", "conditionS4"), "sysrespStartSR": ("scopeSC2", "conditionS4"), "sysrespPlain": ("scopeSC2", "conditionS4", "conditionHolding"), "scopeSC1": ("conditionS8",)}

_ACT = C.either(C.tag("VP"), C.like("^VB"))
#: A verb phrase that joins two or more actions, and the phrase of a response that does or that another one follows.
_JOINS_ACTIONS = C.both(C.tag("VP"), C.child(C.tag("CC", ",")), C.child(_ACT, C.later(_ACT)), C.no(C.above(C.tag("SBAR"))))
SEVERAL_ACTIONS = C.next_(C.tag("VP"), C.either(_JOINS_ACTIONS, C.below(_JOINS_ACTIONS), C.later(C.tag("CC", ","), C.next_(C.tag("VP")))))
_OR, _CLAUSE = C.both(C.tag("CC"), C.child(C.tag("or"))), C.tag("VP", "S", "SBAR")
_JOINED = C.either(C.both(C.child(_OR), C.child(_CLAUSE, C.later(_CLAUSE))), C.child(_OR, C.next_(C.tag("SBAR"))))
#: Clauses joined by 'or', which may bind in more than one way, in the node or in the clause after it.
JOINED_BY_OR = C.either(_JOINED, C.below(_JOINED))
JOINED_BY_OR_NEXT = C.next_(JOINED_BY_OR)


def _needs(name: str) -> tuple[C.Pattern, C.Pattern | None, C.Pattern | None, C.Pattern | None]:
    """A clause's pattern, and what makes it passive, several actions, or joined by 'or' (None: nothing does)."""
    passive = [C.PASSIVES[k] for k in C.passives_of(name)]
    joined = JOINED_BY_OR_NEXT if name in C.PARTS else JOINED_BY_OR
    return PATTERNS[name], C.either(*passive) if passive else None, SEVERAL_ACTIONS if name.startswith("sysresp") else None, joined if name.startswith("condition") else None


MARKS = C.Marks([p for name in PATTERNS for p in _needs(name) if p])


def found_clauses(nodes: str = "nodes") -> Column:
    """The clauses that each pattern finds in marked nodes, in order of patterns: start, end, name, kind, passive, head (the matched node), to (last node), several, joined.

    A clause ends with the matched node n, or with the sisters that are parts of it."""
    after = f"get({nodes}, n.last + 1)"
    ends = {None: "n.end", "next": f"{after}.end", "next.first": f"get({nodes}, n.last + 2).end", "next.next": f"get({nodes}, {after}.last + 1).end"}
    out = []
    for name, pattern in PATTERNS.items():
        parts = C.PARTS.get(name)
        passive, several, joined = (MARKS.holds(p, "n") if p else "false" for p in _needs(name)[1:])
        to = f"{after}.last" if parts else "n.last"
        row = f"named_struct('start', n.start, 'end', {ends[parts]}, 'name', '{name}', 'kind', '{KINDS[name]}', 'passive', {passive}, 'head', n.pre, 'to', {to}, 'several', {several}, 'joined', {joined})"
        out.append(f"transform(filter(hits, n -> {MARKS.holds(pattern, 'n')}), n -> {row})")
    # the few nodes that any pattern fits are taken first, bound by a list of one
    hits = f"filter({nodes}, n -> {MARKS.any_of(list(PATTERNS.values()), 'n')})"
    return F.expr(f"get(transform(array({hits}), hits -> concat({', '.join(out)})), 0)")


_FIELDS = ("start", "end", "name", "kind", "passive", "head", "to", "several", "joined")


def _clause_with(c: str, **changes: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {changes.get(f) or f'{c}.{f}'}" for f in _FIELDS) + ")"


def strict(clauses: str = "found") -> Column:
    """Clauses of loose patterns only where no other pattern of their kind fits, and conditions of these only beside a response."""
    loose = ", ".join(map(repr, C.LOOSE))
    same = f"exists({clauses}, d -> left(d.name, 4) = left(c.name, 4) AND NOT d.name IN ({loose}))"
    return F.expr(f"filter({clauses}, c -> NOT c.name IN ({loose}) OR NOT {same} AND (c.kind = 'sysresp' OR exists({clauses}, d -> d.kind = 'sysresp')))")


def trimmed(clauses: str = "found") -> Column:
    """Clauses cut where one that TRIMS names for their pattern begins inside them; those left without a word go."""
    cut = "NULL"
    for name, others in TRIMS.items():
        inside = f"filter({clauses}, d -> d.name IN ({', '.join(map(repr, others))}) AND d.start > c.start AND d.end <= c.end)"
        cut = f"if(c.name = '{name}', array_min(transform({inside}, d -> d.start)), {cut})"
    return F.expr(f"filter(transform({clauses}, c -> {_clause_with('c', end=f'coalesce({cut}, c.end)')}), c -> c.start < c.end)")


def merged(clauses: str = "found") -> Column:
    """Overlapping clauses as one, in order. It is what the longest of them is (the first of equals), passive if any is."""
    order = "CASE WHEN a.start <> b.start THEN a.start - b.start WHEN a.end <> b.end THEN b.end - a.end ELSE 0 END"
    longer = "c.end - c.start > z.end - z.start"
    one = {f: f"if({longer}, c.{f}, z.{f})" for f in ("name", "kind", "head", "to")} | {f: f"(z.{f} OR c.{f})" for f in ("passive", "several", "joined")}
    both = _clause_with("c", start="z.start", end="greatest(z.end, c.end)", **one)
    # the last one so far is taken as a list of one or none, so that it is bound once
    last = f"transform(slice(done, greatest(size(done), 1), 1), z -> if(c.start >= z.end, array(z, c), array({both})))"
    add = f"if(size(done) = 0, array(c), concat(slice(done, 1, size(done) - 1), flatten({last})))"
    return F.expr(f"aggregate(array_sort({clauses}, (a, b) -> {order}), slice({clauses}, 1, 0), (done, c) -> {add})")


def closed(clauses: str = "found", pairs: str = "pairs") -> Column:
    """A last response that 'else' or 'otherwise' opens takes all from the clause before it to the end, and a condition that
    holds further clauses the connectives behind it, up to the next clause: words without a verb."""
    before, n = f"coalesce(get({clauses}, i - 1).end, 0)", f"size({pairs})"
    after = f"coalesce(get({clauses}, i + 1).start, {n})"
    turns = "w -> lower(w.w) IN ('else', 'otherwise')"
    opens = f"exists(slice({pairs}, {before} + 1, greatest(c.start - {before}, 0)), {turns})"
    behind = f"slice({pairs}, c.end + 1, greatest({after} - c.end, 0))"
    # words that the last response takes are not the condition's too
    taken = f"i = size({clauses}) - 2 AND get({clauses}, i + 1).kind = 'sysresp' AND exists({behind}, {turns})"
    idle = f"exists({behind}, w -> length(w.w) > 1) AND NOT exists({behind}, w -> w.t = 'MD' OR w.t LIKE 'VB%') AND NOT coalesce({taken}, false)"
    ended = f"if(c.name = 'conditionHolding' AND {idle}, {_clause_with('c', end=after)}, c)"
    return F.expr(f"transform({clauses}, (c, i) -> if(i = size({clauses}) - 1 AND c.kind = 'sysresp' AND {opens}, {_clause_with('c', start=before, end=n)}, {ended}))")


# ---- words with their tags (arrays of w, t, at) ------------------------------------------------


def place(pairs: Column, test: Callable[[Column], Column], after: Column | None = None) -> Column:
    """Index of the first word that meets ``test`` (beyond ``after``), or null."""
    hit = F.transform(pairs, (lambda x, i: test(x) & (i > after)) if after is not None else test)
    return F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)) - 1


def lower(x: Column) -> Column:
    return F.lower(x["w"])


def is_verb(x: Column) -> Column:
    return x["t"].startswith("VB")


def passive(pairs: Column) -> Column:
    """A form of 'be' or 'have' right before a participle, adverbs left out."""
    own = F.filter(pairs, lambda x: ~x["t"].startswith("RB"))
    return F.exists(F.transform(own, lambda x, i: is_verb(x) & lower(x).isin(*AUXILIARIES) & (F.get(own, i + 1)["t"] == "VBN")), lambda x: F.coalesce(x, F.lit(False)))


def lacks_verb(pairs: Column) -> Column:
    """No verb, or a sign of comparison before the first one: what is compared has no verb."""
    verb = place(pairs, is_verb)
    sign = place(pairs, lambda x: x["w"].isin(*SYMBOLS) | x["t"].isin("SYM", "XX"))
    return verb.isNull() | F.coalesce(sign < verb, F.lit(False))


def main_verb(pairs: Column) -> Column:
    """The last of the first run of verbs, adverbs left out: the verb after its auxiliaries."""
    own = F.filter(pairs, lambda x: ~x["t"].startswith("RB"))
    verb = place(own, is_verb)
    other = place(own, lambda x: ~is_verb(x), verb)
    return F.when(verb.isNotNull(), F.get(own, F.coalesce(other, F.size(own)) - 1)["w"])


def _joined_verb(pairs: Column, after: Column) -> Column:
    """Index of the first conjunction or comma beyond ``after`` that a verb in its base form follows, or null."""
    hit = F.transform(pairs, lambda x, i: x["t"].isin("CC", ",") & (i > after) & F.coalesce(F.get(pairs, i + 1)["t"] == "VB", F.lit(False)))
    return F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)) - 1


def _facts(pairs: Column) -> dict[str, Column]:
    opens = place(pairs, lambda x: lower(x).isin(*OPENERS))
    modal = place(pairs, lambda x: (x["t"] == "MD") & lower(x).isin(*RESPONSE_MODALS))
    three = F.array_join(F.transform(F.slice(pairs, 1, 3), lower), " ")
    return {
        "noun": place(pairs, lambda x: x["t"].startswith("NN") | ((x["t"] == "PRP") & (lower(x) == "it"))), "modal": modal, "verb": place(pairs, is_verb), "opener": opens,
        "for": place(pairs, lambda x: (lower(x) == "for") & (x["t"] == "IN")), "time": place(pairs, lambda x: lower(x).isin(*TIMES) & (x["t"] == "IN")),
        "acts": place(pairs, is_verb, modal), "sign": place(pairs, lambda x: x["w"].isin(*SYMBOLS)), "more": _joined_verb(pairs, modal), "phrase": F.when(three.isin("in case that", "as soon as"), F.lit(0)),
    }


def _decisions(f: dict[str, Column]) -> list[tuple[str, Column]]:
    """Label and condition, tried in order; facts are places of first words, null where there is none."""
    has, lacks = (lambda k: f[k].isNotNull()), (lambda k: f[k].isNull())
    answers, asks = has("modal") & lacks("opener") & lacks("phrase"), has("opener") & lacks("modal")
    return [
        ("scope", has("for") & lacks("modal") & lacks("opener") & lacks("verb") & (f["for"] < f["noun"])),
        ("scopeIncompl", has("for") & lacks("modal") & lacks("opener") & lacks("verb")),
        ("multSrs", answers & (f["noun"] < f["modal"]) & (f["acts"] < f["more"])),
        ("sysresp", answers & (f["noun"] < f["modal"]) & has("acts")),
        ("sysrespIncomplNoVerb", answers & (f["noun"] < f["modal"])),
        ("sysrespIncorr", answers & has("acts")),
        ("condPosIncomplNoNounNoVerb", asks & lacks("noun") & lacks("verb")),
        ("condPosIncomplNoNoun", asks & lacks("noun")),
        ("conditionWithSymbol", asks & lacks("verb") & has("sign")),
        ("condPosIncomplNoVerb", asks & lacks("verb")),
        ("condition", asks & (f["opener"] < F.greatest(f["noun"], f["verb"]))),
        ("condPosIncorr", asks),
        ("conditionWithModalVerb", has("opener") & has("modal") & (f["opener"] < f["modal"]) & (f["opener"] == 0) & has("noun") & lacks("acts")),
        ("condition", has("phrase") & has("noun") & has("verb") & lacks("modal")),
        ("conditionNoVerb", (f["time"] == 0) & has("noun") & lacks("verb") & lacks("modal")),
    ]


LABELS = ("scope", "scopeIncompl", "multSrs", "sysresp", "sysrespIncomplNoVerb", "sysrespIncorr", "condPosIncomplNoNounNoVerb", "condPosIncomplNoNoun", "conditionWithSymbol", "condPosIncomplNoVerb", "condition", "condPosIncorr", "conditionWithModalVerb", "conditionNoVerb", "notMatch")


def ladder(pairs: Column) -> Column:
    """The label of a run of words by their tags alone: the first decision that holds."""
    out = F.lit("notMatch")
    for label, holds in reversed(_decisions(_facts(pairs))):
        out = F.when(holds, label).otherwise(out)
    return out


def cuts(pairs: Column) -> Column:
    """Spans (start, end) of a run of words, cut before words that open a clause, and before a mark if a modal follows it
    sooner than the next such word or mark. Parts of less than three words of two letters or more stay with the one before."""
    mark = lambda x: x["w"].isin(",", ";")
    word = lambda x: lower(x).isin(*CUTS)

    def opens(x: Column, i: Column) -> Column:
        sooner = F.get(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda y: (y["t"] == "MD") | word(y) | mark(y)), F.lit(0))
        return F.when((i == 0) | word(x) | (mark(x) & F.coalesce((sooner["t"] == "MD") & ~word(sooner) & ~mark(sooner), F.lit(False))), i)

    starts = F.filter(F.transform(pairs, opens), lambda s: s.isNotNull())
    n = F.size(pairs)
    long_ = lambda a, b: F.size(F.filter(F.slice(pairs, a + 1, b - a), lambda x: F.length(x["w"]) > 1))
    # bound by one-element arrays, so that each step is worked out once
    kept = F.get(F.transform(F.array(starts), lambda ss: F.filter(ss, lambda s, j: (j == 0) | (long_(s, F.coalesce(F.get(ss, j + 1), n)) >= 3))), F.lit(0))
    return F.get(F.transform(F.array(kept), lambda ss: F.transform(ss, lambda s, j: F.struct(s.alias("start"), F.coalesce(F.get(ss, j + 1), n).alias("end")))), F.lit(0))


def _words_in(pairs: Column, start: Column, end: Column) -> Column:
    return F.slice(pairs, start + 1, F.greatest(end - start, F.lit(0)))


def _gap(start: Column, end: Column) -> Column:
    nothing = {"name": "string", "kind": "string", "passive": "boolean", "head": "int", "to": "int", "several": "boolean", "joined": "boolean"}
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])


def _with_gaps(clauses: Column, n: Column) -> Column:
    """Clauses in order with what lies between them."""

    def around(i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(clauses, i - 1)["end"])
        return F.array(_gap(before, F.coalesce(F.get(clauses, i)["start"], n)), F.get(clauses, i))

    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.size(clauses)), around))
    return F.filter(parts, lambda c: c.isNotNull() & (c["start"] < c["end"]))


def _pieces(pairs: Column) -> Column:
    """Labels of the parts that a run of words is cut into, those without one left out, and which of them follow an 'or'."""
    label = lambda p: F.struct(ladder(_words_in(pairs, p["start"], p["end"])).alias("label"), (F.lower(F.get(pairs, p["start"] - 1)["w"]) == "or").alias("after_or"), p["start"].alias("start"))
    # a scope stands first; behind other words 'for' belongs to these
    return F.filter(F.transform(cuts(pairs), label), lambda p: (p["label"] != "notMatch") & ((p["start"] == 0) | ~p["label"].startswith("scope")))


def by_words(pairs: Column) -> Column:
    """The label of a run of words that no pattern fits: those of its parts, or that of conditions joined by 'or'."""

    def named(parts: Column) -> Column:
        ambiguous = F.exists(F.slice(parts, 2, F.size(parts)), lambda p: p["label"].startswith("cond") & F.coalesce(p["after_or"], F.lit(False))) & F.get(parts, F.lit(0))["label"].startswith("cond")
        return F.when(F.size(parts) == 0, "notMatch").when(ambiguous, "multCondCoordAmb").otherwise(F.array_join(F.transform(parts, lambda p: p["label"]), " "))

    return F.get(F.transform(F.array(_pieces(pairs)), named), F.lit(0))


def _nested(nodes: Column, pairs: Column, heads: Column, p: Column) -> Column:
    """' condition' or ' condContNoVerb' for each clause below a clause that an opening word begins and that is none of its own."""
    first_word = lambda m: F.lower(F.get(pairs, m["start"])["w"])
    below = F.filter(nodes, lambda m: (m["label"] == "SBAR") & (m["pre"] > p["head"]) & (m["last"] <= p["to"]) & (m["start"] >= p["start"]) & (m["end"] <= p["end"]) & first_word(m).isin(*OPENERS) & ~F.array_contains(heads, m["pre"]))
    verb = lambda m: F.exists(F.slice(pairs, m["start"] + 1, m["end"] - m["start"]), is_verb)
    return F.array_join(F.transform(below, lambda m: F.when(verb(m), " condition").otherwise(" condContNoVerb")), "")


def _label(nodes: Column, pairs: Column, heads: Column, p: Column) -> Column:
    own = F.when(p["several"], "multSrs").when(p["joined"], "multCondCoordAmb").otherwise(p["kind"])
    nested = F.when(p["joined"], "").otherwise(_nested(nodes, pairs, heads, p))
    return F.when(p["kind"].isNull(), by_words(_words_in(pairs, p["start"], p["end"]))).otherwise(F.concat(own, nested))


def attached(labels: Column, words: Column) -> Column:
    """Labels in order with those of runs without one that go on with the segment before: after a response one with a verb,
    after a condition one with 'and' among its first two words and a verb or a sign of comparison."""

    def label(x: Column, i: Column) -> Column:
        run = F.get(words, i)
        before = F.when(i > 0, F.get(labels, i - 1))
        has = lambda test: F.exists(run, test)
        sign = has(lambda w: w["w"].isin(*SYMBOLS))
        joins = F.exists(F.slice(run, 1, 2), lambda w: lower(w) == "and")
        goes_on = F.when((before.contains("sysresp") | before.contains("multSrs")) & has(is_verb), "sysrespCont").when(before.contains("cond") & joins & has(is_verb), "condCont").when(before.contains("cond") & joins & sign, "condContNoVerb")
        return F.when((x == "notMatch") & F.coalesce(before != "notMatch", F.lit(False)), F.coalesce(goes_on, x)).otherwise(x)

    return F.transform(labels, label)


def marked(trees: DataFrame) -> DataFrame:
    """req_id, nodes with the marks of all patterns, and pairs (words with their tags) of each readable tree of (req_id, tree)."""
    # dealt out: a few megabytes of trees, which one task would read, take long
    dealt = trees.select("req_id", "tree").repartition(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = read_nodes(dealt).where(F.size("nodes") > 0)
    d = d.withColumn("pairs", F.expr("transform(filter(nodes, n -> n.leaf), n -> named_struct('w', n.label, 't', coalesce(get(nodes, n.parent).label, ''), 'at', n.pre))"))
    return MARKS.mark(d)


def segment_rows(trees: DataFrame) -> DataFrame:
    """A row per segment of each row (req_id, tree): req_id, k, label, start, end, name (of the pattern, or null), kind, passive,
    head, to and more of its clause, with the tree's nodes and its words with tags."""
    d = marked(trees).withColumn("found", found_clauses())
    d = d.withColumn("found", strict()).withColumn("found", trimmed()).withColumn("found", merged()).withColumn("found", closed()).withColumn("spans", cuts(F.col("pairs")))
    parts = F.when(F.size("found") > 0, _with_gaps(F.col("found"), F.size("pairs"))).otherwise(F.transform("spans", lambda s: _gap(s["start"], s["end"])))
    d = d.withColumns({"parts": parts, "heads": F.transform("found", lambda c: c["head"])})
    d = d.withColumn("labels", F.transform("parts", lambda p: _label(F.col("nodes"), F.col("pairs"), F.col("heads"), p)))
    # words that hold neither condition nor response are one segment
    whole = (F.size("found") == 0) & ~F.exists("labels", lambda x: x.contains("cond") | x.contains("sysresp") | x.contains("multSrs"))
    one = F.array(_gap(F.lit(0), F.size("pairs")))
    d = d.withColumns({"whole": whole, "parts": F.when(whole, one).otherwise(F.col("parts")), "labels": F.when(whole, F.array(F.lit("notMatch"))).otherwise(F.col("labels"))})
    words = F.transform("parts", lambda p: _words_in(F.col("pairs"), p["start"], p["end"]))
    d = d.withColumn("words", words).withColumn("labels", attached(F.col("labels"), F.col("words")))
    # the outer form: the plain one lets a test for empty arrays be pushed down, for which all steps would be written out in one
    rows = d.select("req_id", "nodes", "whole", F.posexplode_outer(F.arrays_zip("parts", "labels", "words")).alias("k", "row")).where(F.size("row.words") > 0)
    return rows.select("req_id", (F.col("k") + 1).alias("k"), "row.parts.*", F.col("row.labels").alias("label"), F.col("row.words").alias("words"), "nodes", "whole")


def segment_requirements(trees: DataFrame) -> DataFrame:
    """req_id, k, start, end, label, passive, noverb, acts, verbs, main, modal, text: the segments of every row (req_id, tree).

    Words that hold neither a condition nor a response are one segment without a verb of its own.
    Labels of clauses below a segment, or of the parts of one found by its words, stand side by side. Rows without a
    readable tree, or with a tree without words, have no segments; rows of one req_id are segmented each on its own."""
    s = segment_rows(trees)
    # words of a clause without those of the clauses below it
    own = F.filter("words", lambda x: F.col("head").isNull() | ~F.exists("nodes", lambda b: (b["label"] == "SBAR") & (b["pre"] > F.col("head")) & (b["pre"] < x["at"]) & (b["last"] >= x["at"])))
    s = s.withColumn("own", own)
    modal = place(F.col("own"), lambda x: x["t"] == "MD")
    s = s.withColumn("said", F.when(F.col("label").startswith("sysresp") | F.col("label").startswith("multSrs"), F.slice("own", F.coalesce(modal, F.lit(-1)) + 2, F.size("own"))).otherwise(F.col("own")))
    noun = place(F.col("words"), lambda x: x["t"].startswith("NN"))
    has_modal = F.exists("words", lambda x: x["t"] == "MD")
    acts = (F.col("label") == "notMatch") & ~has_modal & place(F.col("words"), is_verb, noun).isNotNull()
    verbs = F.transform(F.filter("words", is_verb), lambda x: x["w"])
    text = F.array_join(F.transform("words", lambda x: x["w"]), " ")
    return s.select(
        "req_id", "k", "start", "end", "label", (~F.col("whole") & (F.coalesce("passive", F.lit(False)) | passive(F.col("said")))).alias("passive"), (F.col("whole") | lacks_verb(F.col("words"))).alias("noverb"),
        F.coalesce(acts, F.lit(False)).alias("acts"), verbs.alias("verbs"), main_verb(F.col("said")).alias("main"), has_modal.alias("modal"), text.alias("text"),
    )
