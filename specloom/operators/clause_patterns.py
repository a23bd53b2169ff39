"""Clause and passive patterns over trees, stated once and rendered as Spark expressions or as SQL.

A pattern is a condition on a node: a test of its label, a relation to another node that meets a condition, or a
combination of these. Relations are comparisons of preorder intervals. For Spark conditions become bits of the nodes of
each tree's own array, batch by batch (no shuffle); as SQL a relation is an EXISTS over a node table, joined within its tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A condition on a node: ("tag", names), ("like", expression), ("both" | "either", conditions), ("no", condition) or (relation, condition).
Pattern = tuple

#: Bits of one marks field.
WORD = 63


#: Nodes whose conditions are worked out together: a bound on memory, trees stay whole.
TOGETHER = 50_000


class Places:
    """Where the nodes related to each of n nodes in a row stand; place n stands for none."""

    def __init__(self, root: np.ndarray, last: np.ndarray, parent: np.ndarray, chain: np.ndarray):
        n = self.n = len(root)
        at = self.at = np.arange(n)
        self.last, self.edge = root + last, at + chain
        self.parent = np.where(parent < 0, n, root + parent)
        lasts, parents = np.append(self.last, -1), np.append(self.parent, -1)
        after = self.last + 1
        next_to = np.where((self.parent < n) & (parents[after] == self.parent), after, n)
        prev_to = np.full(n + 1, n)
        prev_to[next_to] = at
        self.one = {
            "first": np.where(self.last > at, at + 1, n), "next": next_to, "prev": prev_to[:n], "parent": self.parent,
            "first_of": np.where(self.parent == at - 1, self.parent, n), "last_of": np.where(lasts[self.parent] == self.last, self.parent, n),
        }

    def related(self, how: str, holds: np.ndarray) -> np.ndarray:
        """For each node whether one so related to it is among those that hold (of n nodes and false for none)."""
        if how in self.one:
            out = holds[self.one[how]]
        elif how in ("below", "leftmost"):
            sums = np.concatenate([[0], np.cumsum(holds)])
            out = sums[(self.last if how == "below" else self.edge) + 1] > sums[self.at + 1]
        elif how == "above":
            own = np.flatnonzero(holds)
            begin, end = np.bincount(own + 1, minlength=self.n + 1), np.bincount(self.last[own] + 1, minlength=self.n + 1)
            out = np.cumsum(begin - end)[: self.n] > 0
        else:
            own = np.flatnonzero(holds)
            # of several values for one place the last one stays: the greatest, or of places in descending order the least
            far = np.full(self.n + 1, self.n if how == "earlier" else -1)
            own = own[::-1] if how == "earlier" else own
            far[self.parent[own]] = own
            far[self.n] = self.n if how == "earlier" else -1
            out = far[: self.n] >= 0 if how == "child" else far[self.parent] > self.at if how == "later" else far[self.parent] < self.at
        return np.append(out, False)


class Marks:
    """Spark: every one of some conditions is a bit of each node, worked out from the inside out.

    Batches of trees come as Arrow columns; a condition is worked out for all nodes of many trees at once, by their places,
    and a test of labels for each distinct label. Conditions that patterns share are worked out once.
    """

    def __init__(self, patterns: list[Pattern]):
        self.bit = {p: k for k, p in enumerate(dict.fromkeys(patterns))}
        self.words = (len(self.bit) - 1) // WORD + 1
        step: dict[Pattern, int] = {}

        def add(p: Pattern) -> int:
            if p not in step:
                kind, what = p
                inner = what if kind in ("tag", "like") else tuple(add(q) for q in (what if kind in ("both", "either") else (what,)))
                self.steps.append((kind, inner))
                step[p] = len(self.steps) - 1
            return step[p]

        #: Kind of a condition and what it tests of labels, or the numbers of the conditions in it.
        self.steps: list[tuple[str, tuple]] = []
        self.marked = [add(p) for p in self.bit]

    def holds(self, p: Pattern, n: str) -> str:
        """SQL text of one of the conditions on a marked node n."""
        return self.any_of([p], n)

    def any_of(self, patterns: list[Pattern], n: str) -> str:
        """SQL text: whether at least one of these conditions holds on a marked node n."""
        masks: dict[int, int] = {}
        for p in patterns:
            word, bit = divmod(self.bit[p], WORD)
            masks[word] = masks.get(word, 0) | 1 << bit
        return "(" + " OR ".join(f"({n}.m{w} & {m}L) != 0L" for w, m in masks.items()) + ")"

    def _bits(self, places: Places, codes: np.ndarray, labels: list[str]) -> list[np.ndarray]:
        """The words of bits of some whole trees; ``codes`` are the labels' numbers."""
        known: list[np.ndarray] = []
        for kind, what in self.steps:
            if kind in ("tag", "like"):
                test = set(what).__contains__ if kind == "tag" else re.compile(what, re.ASCII).search
                out = np.append(np.array([bool(test(x)) for x in labels], bool)[codes], False)
            elif kind in ("both", "either"):
                out = (np.logical_and if kind == "both" else np.logical_or).reduce([known[k] for k in what])
            elif kind == "no":
                out = ~known[what[0]]
                out[-1] = False
            else:
                out = places.related(kind, known[what[0]])
            known.append(out)
        words = [np.zeros(places.n, np.int64) for _ in range(self.words)]
        for k, step in enumerate(self.marked):
            words[k // WORD] |= known[step][:-1].astype(np.int64) << (k % WORD)
        return words

    def _marked(self, column: pa.ListArray) -> pa.ListArray:
        """Arrays of nodes with the words of bits added to each node."""
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        nodes, total = column.flatten(), int(offsets[-1])
        last, parent, chain = (nodes.field(f).to_numpy(zero_copy_only=False) for f in ("last", "parent", "chain"))
        words = [np.zeros(total, np.int64) for _ in range(self.words)]
        roots = np.repeat(offsets[:-1], sizes)
        bounds = np.unique(np.append(offsets[np.searchsorted(offsets, np.arange(0, total, TOGETHER))], total))
        for a, b in pairwise(bounds.tolist()):
            label = nodes.field("label").slice(a, b - a).dictionary_encode()
            places = Places(roots[a:b] - a, last[a:b], parent[a:b], chain[a:b])
            for word, bits in zip(words, self._bits(places, label.indices.to_numpy(), label.dictionary.to_pylist()), strict=True):
                word[a:b] = bits
        names = [f.name for f in nodes.type]
        every = pa.StructArray.from_arrays([*map(nodes.field, names), *map(pa.array, words)], names=[*names, *(f"m{w}" for w in range(self.words))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), every)

    def mark(self, rows: DataFrame, nodes: str = "nodes") -> DataFrame:
        """``rows`` with fields m0, m1 ... of bits added to each node of the array."""
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        kinds[nodes] = kinds[nodes].removesuffix(">>") + "".join(f",m{w}:bigint" for w in range(self.words)) + ">>"

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([self._marked(c) if n == nodes else c for n, c in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

        return rows.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))


#: For the node table: how a node x is related to n.
_JOINS = {
    "child": "{x}.parent = {n}.pre",
    "first": "{x}.parent = {n}.pre AND {x}.pre = {n}.pre + 1",
    "below": "{x}.pre > {n}.pre AND {x}.pre <= {n}.last",
    "leftmost": "{x}.pre > {n}.pre AND {x}.pre <= {n}.pre + {n}.chain",
    "above": "{x}.pre < {n}.pre AND {x}.last >= {n}.last",
    "next": "{x}.parent = {n}.parent AND {n}.parent >= 0 AND {x}.pre = {n}.last + 1",
    "prev": "{x}.parent = {n}.parent AND {n}.parent >= 0 AND {x}.last = {n}.pre - 1",
    "later": "{x}.parent = {n}.parent AND {n}.parent >= 0 AND {x}.pre > {n}.last",
    "earlier": "{x}.parent = {n}.parent AND {n}.parent >= 0 AND {x}.last < {n}.pre",
    "parent": "{x}.pre = {n}.parent",
    "first_of": "{x}.pre = {n}.parent AND {n}.pre = {x}.pre + 1",
    "last_of": "{x}.pre = {n}.parent AND {n}.last = {x}.last",
}


class Table:
    """SQL text: a node is an alias of the table ``nodes`` (key and the fields of a node); a relation is an EXISTS."""

    def __init__(self, nodes: str = "nodes", key: str = "req_id"):
        self.nodes, self.key, self.names = nodes, key, count()

    def holds(self, p: Pattern, n: str) -> str:
        kind, what = p
        if kind == "tag":
            return f"{n}.label IN ({', '.join(repr(x) for x in what)})"
        if kind == "like":
            return f"regexp_matches({n}.label, '{what}')"
        if kind in ("both", "either"):
            return "(" + (" AND " if kind == "both" else " OR ").join(self.holds(q, n) for q in what) + ")"
        if kind == "no":
            return f"NOT {self.holds(what, n)}"
        x = f"x{next(self.names)}"
        return f"EXISTS (SELECT 1 FROM {self.nodes} {x} WHERE {x}.{self.key} = {n}.{self.key} AND {_JOINS[kind].format(x=x, n=n)} AND {self.holds(what, x)})"


# ---- conditions on a node ---------------------------------------------------------------------


def tag(*names: str) -> Pattern:
    """The label is one of these."""
    return "tag", names


def like(regex: str) -> Pattern:
    """The regular expression is found in the label."""
    return "like", regex


def both(*ps: Pattern) -> Pattern:
    return ("both", ps) if len(ps) > 1 else ps[0]


def either(*ps: Pattern) -> Pattern:
    return ("either", ps) if len(ps) > 1 else ps[0]


def no(p: Pattern) -> Pattern:
    return "no", p


def _relation(how: str) -> Callable[..., Pattern]:
    return lambda *ps: (how, both(*ps))


child, first, below, leftmost, above = map(_relation, ("child", "first", "below", "leftmost", "above"))
next_, prev, later, earlier = map(_relation, ("next", "prev", "later", "earlier"))
parent, first_of, last_of = map(_relation, ("parent", "first_of", "last_of"))


# ---- the patterns -----------------------------------------------------------------------------
# Labels, words and expressions in the patterns below; an expression is found anywhere in a label.

NOMINAL, VERBAL = like("N.?"), like("VB.?")
CONJUNCTION, STRICT_CONJUNCTION = like("(IN|WHADVP|WRB)"), like("^(IN|WHADVP|WRB)$")
IN_CLAUSE = above(like("(VP|SBAR)"))
IN_VERB = above(like("(VP)"))
ONCE = both(tag("IN"), child(like("^(Once|once)$")))
PLACE = child(like("(of|to|in|In|at|At|on|On)"))
COMPLEMENT = either(later(tag("NP")), later(tag("PP")))
VERB_FIRST = leftmost(VERBAL)
VERB_WITH_COMPLEMENT = leftmost(VERBAL, COMPLEMENT)
MODAL_PHRASE = both(tag("VP"), child(tag("MD")))
#: a modal verb phrase right after a subject
AFTER_SUBJECT = prev(tag("NP"), either(child(like("NN.?")), child(tag("NP")), child(tag("PRP"))))


def statement(verbs: Pattern, subject: Pattern = NOMINAL) -> Pattern:
    """A subject right before a verb phrase that meets ``verbs``."""
    return both(subject, next_(tag("VP"), verbs))


def _opened(verbs: Pattern) -> Pattern:
    """S1: a question word before a clause whose first clause holds a statement."""
    return both(like("WH.?"), next_(tag("S"), first(tag("S"), child(statement(verbs)))), parent(tag("SBAR")), no(above(tag("VP"))))


def _once(verbs: Pattern) -> Pattern:
    """S3"""
    return both(ONCE, next_(tag("S"), child(statement(verbs))), either(parent(tag("SBAR")), parent(tag("S"))), parent(no(tag("VP"))))


def _after_response(verbs: Pattern, kept_out: str) -> Pattern:
    """S4: a subordinate clause with a noun phrase before it, below a modal verb phrase."""
    heads = either(prev(tag("IN"), no(child(like(kept_out)))), prev(tag("WHADVP")), prev(tag("WRB")))
    return both(tag("SBAR"), child(tag("S"), child(statement(verbs)), heads), earlier(tag("NP")), above(MODAL_PHRASE, AFTER_SUBJECT, above(tag("S"))))


def _common(verbs: Pattern, that: Pattern, without: Pattern = no(below(tag("that")))) -> Pattern:
    """S7, S8: a clause with a conjunction; ``that`` says what stands below, ``verbs`` what follows the subject on its left edge."""
    return both(tag("SBAR"), child(STRICT_CONJUNCTION, without, next_(tag("S"), that, leftmost(NOMINAL, verbs))), no(IN_VERB))


HOLDS_THAT, HOLDS_NO_CLAUSE = below(tag("SBAR"), leftmost(like("(That|that)"))), no(below(tag("SBAR")))
_VERBS_FOLLOW = either(later(tag("VP"), either(VERB_FIRST, child(tag("VP"), VERB_FIRST))), later(VERBAL))

_TO_DO = both(tag("S"), child(tag("VP"), child(tag("TO"), next_(tag("VP")))))
_FOR_SCOPE = child(tag("IN"), child(like("^(For|for)$")), next_(tag("NP"), either(leftmost(NOMINAL), leftmost(tag("DT")))))
_ON = tag("IN"), child(like("^(Upon|upon|On|on)$"))


def _action(verb: Pattern, plain: Pattern) -> list[Pattern]:
    """What a verb may govern: ``verb`` is the condition on it, ``plain`` that on one with a complement."""
    adjective = both(tag("ADJP"), child(tag("JJ"), next_(tag("S"), child(tag("VP"), either(child(tag("TO"), next_(tag("VP"))), child(tag("TO"), next_(VERBAL)))))))
    return [
        both(plain, COMPLEMENT),
        both(verb, next_(tag("S"), child(tag("NP"), later(tag("VP"))))),
        both(verb, next_(_TO_DO)),
        both(verb, later(tag("VP"), child(like("VB?")))),
        both(verb, next_(tag("SBAR"), child(tag("IN"), child(tag("that")), next_(tag("S"))))),
        both(verb, next_(adjective)),
        both(verb, next_(tag("ADJP"), child(tag("JJ"))), later(_TO_DO)),
        both(verb, next_(tag("JJ")), later(tag("S"))),
    ]


_ACTOR = both(tag("NP"), child(like("\\b(NN.?|NP|PRP)\\b")))


def _responds(plain: Pattern) -> Pattern:
    """An actor right before a modal verb phrase that acts; ``plain`` is the verb that a complement suffices for."""
    acts = either(leftmost(either(*_action(VERBAL, plain))), leftmost(tag("VP"), child(VERBAL, COMPLEMENT)))
    return both(_ACTOR, next_(tag("VP"), child(tag("MD"), later(tag("VP"), acts))))


_WITH_TEXT_BEFORE = both(parent(tag("S")), no(above(like("^(SBAR)$"))), earlier(like("[A-Za-z]")))

#: Clause patterns in order of their names.
CLAUSES: dict[str, Pattern] = {
    "conditionS1": _opened(VERB_FIRST),
    "conditionS3": _once(VERB_FIRST),
    "conditionS4": _after_response(VERB_FIRST, "^(that|with)$"),
    "conditionS5": both(CONJUNCTION, no(PLACE), next_(tag("S"), child(statement(VERB_WITH_COMPLEMENT, tag("NP")))), no(IN_CLAUSE)),
    "conditionS6": both(CONJUNCTION, no(PLACE), next_(statement(VERB_WITH_COMPLEMENT, tag("NP"))), no(IN_CLAUSE)),
    "conditionS7": _common(_VERBS_FOLLOW, HOLDS_THAT),
    "conditionS8": _common(_VERBS_FOLLOW, HOLDS_NO_CLAUSE, no(below(tag("that", "as")))),
    "conditionS9": both(tag("SBAR"), child(CONJUNCTION, next_(tag("S"), child(tag("VP"), child(tag("VBG"), either(next_(tag("NP")), next_(tag("PP")))), no(later(tag("NP"))), no(earlier(tag("NP")))))), no(above(tag("VP")))),
    "conditionS10": both(tag("PP"), child(*_ON, next_(tag("NP"), child(tag("NP"), below(tag("NN")), later(tag("PP"))))), no(IN_CLAUSE)),
    "conditionS11": both(tag("IN"), child(like("^(Upon|upon|On|on|After|after|Before|before)$")), next_(tag("NP"), child(tag("NP"), below(tag("NN")), later(tag("PP")))), no(IN_CLAUSE), no(above(tag("PP")))),
    "conditionS12": both(tag("PP"), child(tag("IN"), child(like("^(After|after|Before|before)$")), next_(tag("NP"), no(child(VERBAL)), child(NOMINAL))), parent(tag("S"))),
    "scopeSC1": both(tag("PP"), _FOR_SCOPE, parent(tag("S"), child(like("(RB|,|ADVP)"), either(next_(tag("NP"), next_(tag("VP"))), next_(tag("S"), child(tag("NP"), next_(tag("VP")))))))),
    "scopeSC2": both(tag("PP"), _FOR_SCOPE, either(last_of(MODAL_PHRASE, prev(tag("NP"))), last_of(tag("VP"), last_of(MODAL_PHRASE, prev(tag("NP"))))), no(above(tag("PP")))),
    "sysrespSR": both(_responds(tag("VB")), _WITH_TEXT_BEFORE),
    "sysrespStartSR": both(_responds(VERBAL), first_of(tag("S")), no(above(like("^(SBAR|VP|NP)$")))),
}

_PARTICIPLE = next_(tag("VP"), first(tag("VBN")))
_IS = both(VERBAL, child(like("(is|are|was|were)")), next_(tag("VP"), first(tag("VBN"), no(child(tag("based"))))))
_BEEN = both(tag("VBN"), child(tag("been")), _PARTICIPLE)
_BEEN_BELOW = either(child(_BEEN), child(tag("VP"), first(_BEEN)))
_HAS = both(tag("VBZ"), child(like("(has|have)")), later(tag("VP"), _BEEN_BELOW))
_HAS_LOOSE = both(like("VB*"), child(like("(has|have)")), later(tag("VP"), either(_BEEN_BELOW, child(tag("ADVP"), next_(tag("VBN"))), child(tag("ADVP"), next_(tag("VP"), child(tag("VBN")))))))
_NOT_OF_TO = no(child(like("(of|to)")))


def _passive_follows(verb: Pattern, *more: Pattern) -> Pattern:
    return either(later(tag("VP"), either(child(verb), child(tag("VP"), child(verb)))), later(verb), *more)


def _passive_conditions(verb: Pattern, *more: Pattern) -> dict[str, Pattern]:
    """The patterns of conditions with a passive ``verb``; ``more`` are further ways for the last of them."""
    p = first(verb)
    return {
        "conditionS1": _opened(p),
        "conditionS2": both(tag("SBAR"), child(tag("WHADVP"), next_(tag("S"), child(statement(p)))), parent(tag("S"), parent(tag("SBAR"))), parent(no(tag("VP")))),
        "conditionS3": _once(p),
        "conditionS4": _after_response(p, "^that$"),
        "conditionS5": both(CONJUNCTION, next_(tag("S"), child(statement(p))), no(IN_CLAUSE)),
        "conditionS6": both(CONJUNCTION, _NOT_OF_TO, next_(statement(p)), no(IN_CLAUSE)),
        "conditionS7": _common(_passive_follows(verb), HOLDS_THAT),
        "conditionS8": _common(_passive_follows(verb, *more), HOLDS_NO_CLAUSE),
    }


_BE = both(VERBAL, child(tag("be")))
_BE_DONE = both(_BE, _PARTICIPLE)
_PASSIVE_ACT = either(*map(child, _action(_BE_DONE, _BE_DONE)), child(tag("VP"), child(_BE_DONE, COMPLEMENT)))
_DONE_ACT = either(*map(child, _action(tag("VBN"), either(tag("VBN"), both(tag("VP"), first(tag("VBN")))))))


def _passive_response(*ways: Pattern) -> Pattern:
    return both(_ACTOR, next_(tag("VP"), child(tag("MD"), *ways)))


#: Passive patterns: 16 of conditions, by the condition's own name and the tense, and 3 of responses.
PASSIVES: dict[str, Pattern] = {
    **{f"{k}Passive1": p for k, p in _passive_conditions(_IS).items()},
    **{f"{k}Passive2": p for k, p in _passive_conditions(_HAS, later(tag("VP"), child(_HAS_LOOSE))).items()},
    "sysrespPassive1": both(_passive_response(later(tag("VP"), _PASSIVE_ACT)), _WITH_TEXT_BEFORE),
    "sysrespPassive2": both(_passive_response(later(tag("VP"), _PASSIVE_ACT)), first_of(tag("S")), no(above(like("^(SBAR)$")))),
    "sysrespPassive3": both(_passive_response(later(_BE), later(tag("VP"), _DONE_ACT)), _WITH_TEXT_BEFORE),
}
_SAID = child(either(tag("VP"), like("^VB")))
#: Further patterns of our own, each for requirements without any clause of its kind: a response whose verb has no
#: complement, and a condition that holds further clauses.
LOOSE: dict[str, Pattern] = {
    "conditionHolding": both(tag("SBAR"), first(STRICT_CONJUNCTION, no(either(child(tag("that", "as", "in", "so", "of", "to")), child(child(tag("that", "as")))))), child(tag("S", "SINV", "SQ"), below(like("^VB"))), no(above(tag("SBAR"), no(first(tag("SBAR")))))),
    "sysrespPlain": both(tag("NP"), next_(tag("VP"), child(tag("MD")), _SAID), no(above(tag("SBAR")))),
}
#: The parts that make up a clause's text besides the matched node: none, the next sister, its first child, or the next two.
PARTS = {"conditionS1": "next.first", "conditionS3": "next", "conditionS5": "next", "conditionS6": "next.next", "conditionS11": "next", "sysrespSR": "next", "sysrespStartSR": "next", "sysrespPlain": "next"}


def passives_of(clause: str) -> list[str]:
    kind = "sysresp" if clause.startswith("sysresp") else clause
    return [k for k in PASSIVES if k.startswith(f"{kind}Passive")]
