"""Verb and structure rules as column expressions, and the stemmer they rest on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stems of verbs that say too little, and pattern names with their templates.
VAGUE_STEMS = (
    "accomplish", "account", "come", "consid", "default", "defin", "do", "done", "get", "got", "gotten", "make", "perform", "process", "propos", "rais", "read", "support", "want",
)
STATE_VERBS = ("is", "are", "be", "has", "have", "contain", "contains", "equal", "equals")
PATTERNS = {
    1: "1. Scope and SR",
    2: "2. Scope, condition(Precondition LE), and SR",
    3: "3. Scope, condition(Trigger), and SR",
    4: "4. Scope, condition (Time Adverb) and SR",
    5: "5. System response",
    6: "6. Condition(Precondition LE), and SR",
    7: "7. Condition(Trigger), and SR",
    8: "8. Condition (Time Adverb) and SR",
    9: "9. Scope, multiple conditions, and SR",
    10: "10. Multiple conditions, and SR",
    11: "11. Others",
}
TEMPLATES = {
    1: 'For each|all|... "Text" ,|then the? Actor must <Action> (every "Text")?.',
    2: 'For each|all|... "Text", if <Property> is equal to | is less or equal to |... "Value" ,|then the? Actor must <Action> (every "Text")?.',
    3: 'For each|all|... "Text", when the? Actor <Action> (every "Frequency")?,|then the? Actor must <Action> (every "Text")?.',
    4: 'For each|all|... "Text", after|before "Text" ,|then the? Actor must <Action> (every "Text")?.',
    5: 'The? Actor must <Action> (every "Text")?.',
    6: 'If <Property> is equal to | is less or equal to |... "Value" ,|then the? Actor must <Action> (every "Text")?.',
    7: 'When the? Actor <Action> (every "Frequency")? ,|then the? Actor must <Action> (every "Text")?.',
    8: 'After|Before "Text" ,|then the? Actor must <Action> (every "Text")?.',
    9: 'For each|all|... "Text", if <Property> is equal to | is less or equal to |... "Value" ,|and  when the? Actor <Action> (every "Frequency")? ,|then the? Actor must <Action> (every "Text")?.',
    10: 'If <Property> is equal to | is less or equal to |... "Value" ,|and  when the? Actor <Action> (every "Frequency"),|then the? Actor must <Action> (every "Text")?.',
}


def condition_kind(verb: Column) -> Column:
    """A state verb makes a logical expression, any other of two letters or more a trigger."""
    v = F.lower(F.trim(F.coalesce(verb, F.lit(""))))
    return F.when(v.isin(*STATE_VERBS), "logicalExpression").when(F.length(v) > 1, "trigger").otherwise("")


def structure_type(scopes: Column, conditions: Column, responses: Column) -> Column:
    """Name of a requirement's structure by its numbers of scopes, conditions and responses."""
    scope = F.when(scopes >= 1, "scope").otherwise("")
    cond = F.when(conditions > 1, "MultCond").when(conditions == 1, "Cond").otherwise("")
    resp = F.when(responses > 1, "MultSrs").otherwise("SysResp")
    name = F.concat(scope, cond, resp)
    return F.when((responses < 1) | (scopes < 0) | (conditions < 0), "otherType").otherwise(F.concat(F.lower(F.substr(name, F.lit(1), F.lit(1))), F.substr(name, F.lit(2))))


def pattern_number(kind: Column, conditions: Column, scopes: Column, times: Column) -> Column:
    """The recommended pattern: ``conditions`` is the array of condition kinds, ``times`` the number of time conditions.

    Null where a single condition has neither kind nor time.
    """
    k = F.lower(kind)
    n = F.size(conditions)
    one = F.try_element_at(conditions, F.lit(1))

    def single(trigger: int, logical: int, time: int) -> Column:
        return F.when((n == 1) & (one == "trigger"), trigger).when((n == 1) & (one == "logicalExpression"), logical).when(n == 1, 11).when(times == 1, time)

    other = F.when(n == 1, F.when(scopes > 0, single(3, 2, 8)).otherwise(single(7, 6, 8)))
    other = other.when(times == 1, 8).when(n > 1, F.when(scopes > 0, 9).otherwise(10)).when(scopes > 0, 1).otherwise(5)
    return (
        F.when(k.isin("sysresp", "multsrs"), 5).when(k.isin("scopesysresp", "scopemultsrs"), 1).when(k.isin("multcondsysresp", "multcondmultsrs"), 10)
        .when(k.isin("scopemultcondsysresp", "scopemultcondmultsrs"), 9).when(k.isin("condsysresp", "condmultsrs"), single(7, 6, 8))
        .when(k.isin("scopecondsysresp", "scopecondmultsrs"), single(3, 2, 4)).when(k == "othertype", other)
    )


def pattern_name(number: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in PATTERNS.items() for x in (k, v)]), number)


def pattern_template(number: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in TEMPLATES.items() for x in (k, v)]), number), F.lit(""))


# ---- Porter's stemmer (Porter 1980), written from the paper's rules ------------------------------

_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """Consonants and vowels as c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    s = _shape(w)
    return sum(a == "v" and b == "c" for a, b in zip(s, s[1:], strict=False))


def _short_end(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, by in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + by if _measure(w[: -len(end)]) else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short_end(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda w: None if w is None else known.setdefault(w, stem(w)))


def is_vague(stemmed: Column) -> Column:
    return stemmed.isin(*VAGUE_STEMS)
