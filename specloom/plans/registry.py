"""Registered queries: each operator on the driver's tables, with the same question as SQL.

Roles: labels and documents give slot judgements (slot = language, gold missing = low quality, flagged = toxic);
conversations give human versions (conv_id = requirement, turn = annotator), their first turn being the machine's.
Rules that the tables' texts never fire run on texts made from whole tables, by expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import text as X
from specloom.functions import verbs as V
from specloom.operators import clause_patterns as patterns
from specloom.operators import clauses, scoring, similarity, smells, spans, treebank
from specloom.plans import detector, prompts, score
from specloom.sources import records

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r10(c: str) -> Column:
    return F.round(F.col(c), 10).alias(c)


def evals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    gold = F.when(F.col("quality") == 0, "missing").when(F.col("n_chars") % 3 == 0, "implied").otherwise("present")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("req_id"), F.coalesce("lang", F.lit("none")).alias("slot"), gold.alias("gold"), F.when(F.col("toxic") == 1, "missing").otherwise("filled").alias("llm"))


EV = """ev AS (SELECT l.doc_id AS req_id, coalesce(d.lang, 'none') AS slot,
  CASE WHEN l.quality = 0 THEN 'missing' WHEN d.n_chars % 3 = 0 THEN 'implied' ELSE 'present' END AS gold,
  CASE WHEN l.toxic = 1 THEN 'missing' ELSE 'filled' END AS llm FROM labels l JOIN documents d USING (doc_id)),
sl AS (SELECT DISTINCT coalesce(lang, 'none') AS slot FROM documents)"""
CELLS = """count(*) FILTER (gold = 'missing' AND llm = 'missing') AS tp, count(*) FILTER (gold <> 'missing' AND llm = 'missing') AS fp,
  count(*) FILTER (gold = 'missing' AND llm <> 'missing') AS fn, count(*) FILTER (gold <> 'missing' AND llm <> 'missing') AS tn"""
CONF = f"""{EV}, c0 AS (SELECT slot, {CELLS} FROM ev GROUP BY slot),
c AS (SELECT sl.slot, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM sl LEFT JOIN c0 USING (slot))"""


def _prf(src: str) -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM
 (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall FROM {src})"""


def _slots(spark, d):
    return table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("slot"))


@query(f"WITH {CONF} SELECT slot, tp, fp, fn, tn FROM c")
def slot_confusion(spark, d):
    return scoring.slot_confusion(evals(spark, d), _slots(spark, d))


@query(f"WITH {CONF} SELECT slot, tp, fp, fn, tn, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, tp + fn AS support_gold_missing FROM ({_prf('c')})")
def slot_prf(spark, d):
    return scoring.slot_prf(evals(spark, d), _slots(spark, d)).select("slot", "tp", "fp", "fn", "tn", r10("precision"), r10("recall"), r10("f1"), "support_gold_missing")


@query(f"WITH {CONF}, m AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c) SELECT tp, fp, fn, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1 FROM ({_prf('m')})")
def micro_average(spark, d):
    return scoring.micro(evals(spark, d)).select("tp", "fp", "fn", r10("precision"), r10("recall"), r10("f1"))


@query(f"WITH {CONF} SELECT round(avg(precision), 10) AS precision, round(avg(recall), 10) AS recall, round(avg(f1), 10) AS f1 FROM ({_prf('c')})")
def macro_average(spark, d):
    return scoring.macro(evals(spark, d), _slots(spark, d)).select(r10("precision"), r10("recall"), r10("f1"))


def _lens_sql(kind: str) -> str:
    return f"""WITH {EV} SELECT slot, count(*) AS n, count(*) FILTER (llm <> 'missing') AS filled, count(*) FILTER (llm = 'missing') AS flagged,
 round(count(*) FILTER (llm <> 'missing') / count(*)::DOUBLE, 10) AS fill_rate, round(count(*) FILTER (llm = 'missing') / count(*)::DOUBLE, 10) AS flag_rate
 FROM ev WHERE gold = '{kind}' GROUP BY ROLLUP (slot)"""


def _lens(spark, d, kind):
    return scoring.lens(evals(spark, d), kind).select("slot", "n", "filled", "flagged", r10("fill_rate"), r10("flag_rate"))


@query(_lens_sql("implied"))
def implied_lens_rollup(spark, d):
    return _lens(spark, d, "implied")


@query(_lens_sql("missing"))
def missing_lens_rollup(spark, d):
    return _lens(spark, d, "missing")


VERDICT = f"""{EV}, v AS (SELECT gold, llm FROM ev), q AS (SELECT {CELLS}, count(*) AS n FROM v)"""


def _verdict(spark, d):
    e = evals(spark, d)
    return scoring.verdict(e.select((F.col("gold") == "missing").alias("gold_incomplete"), (F.col("llm") == "missing").alias("llm_incomplete")))


@query(f"WITH {VERDICT} SELECT tp, fp, fn, tn, n, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, round((tp + tn) / n::DOUBLE, 10) AS agreement FROM ({_prf('q')})")
def overall_verdict(spark, d):
    return _verdict(spark, d).select("tp", "fp", "fn", "tn", "n", r10("precision"), r10("recall"), r10("f1"), r10("agreement"))


@query(f"WITH {EV} SELECT gold = 'missing' AS gold_incomplete, llm = 'missing' AS llm_incomplete, count(*) AS n FROM ev GROUP BY 1, 2")
def verdict_confusion_2x2(spark, d):
    return evals(spark, d).groupBy((F.col("gold") == "missing").alias("gold_incomplete"), (F.col("llm") == "missing").alias("llm_incomplete")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT req_id, bool_or(slot IN ('en', 'de', 'fr') AND llm = 'missing') AS llm_incomplete FROM ev GROUP BY req_id")
def mandatory_incomplete(spark, d):
    return scoring.overall_incomplete(evals(spark, d), ("en", "de", "fr"))


@query(f"WITH {EV} SELECT req_id, slot, gold = 'missing' AS gold_missing, llm = 'missing' AS llm_missing, (gold = 'missing') = (llm = 'missing') AS match FROM ev")
def slot_match_rows(spark, d):
    return scoring.slot_match(evals(spark, d))


_LANGS = ("en", "de", "fr", "es")


@query(f"WITH {EV} SELECT req_id, " + ", ".join(f"max(CASE WHEN slot = '{s}' THEN CAST(gold = 'missing' AS INT) END) AS gold_{s}, max(CASE WHEN slot = '{s}' THEN CAST(llm = 'missing' AS INT) END) AS llm_{s}, max(CASE WHEN slot = '{s}' THEN CAST((gold = 'missing') = (llm = 'missing') AS INT) END) AS match_{s}" for s in _LANGS) + " FROM ev GROUP BY req_id")
def comparison_rows(spark, d):
    return scoring.comparison(evals(spark, d), _LANGS)


# ---- texts ---------------------------------------------------------------------------------------

NORM = "trim(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '<MISSING_[A-Z_]+>|<NON_ATOMIC>', ' ', 'g')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
TOK = "list_distinct(regexp_extract_all(" + NORM + ", '[a-z0-9]+'))"


@query(f"SELECT conv_id, turn, sha256({NORM.format('text')}) AS normalized_sha256 FROM conversations")
def normalize_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.normalize(F.col("text")), 256).alias("normalized_sha256"))


@query(f"SELECT doc_id, CAST(len({TOK.format('text')}) AS INT) AS n_tokens FROM documents")
def token_set_size(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


def _humans(spark, d):
    """Later turns of each conversation; its first is the machine's version."""
    c = table(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("t0"))
    return c.join(first, "conv_id").where("turn > t0").select(F.col("conv_id").alias("req_id"), F.col("turn").alias("annotator"), "text")


def _machine(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("req_id")).agg(F.min_by("text", "turn").alias("text"))


HUMANS = """mach AS (SELECT conv_id AS req_id, min(turn) AS t0, arg_min(text, turn) AS a FROM conversations GROUP BY conv_id),
hum AS (SELECT c.conv_id AS req_id, c.turn AS annotator, c.text AS b FROM conversations c JOIN mach m ON c.conv_id = m.req_id AND c.turn > m.t0 WHERE trim(coalesce(c.text, '')) <> '')"""
JAC = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / greatest(len(list_distinct(list_concat({0}, {1}))), 1) END"
LH = f"{HUMANS}, lh AS (SELECT m.req_id, h.annotator, m.a, h.b, {TOK.format('m.a')} AS ta, {TOK.format('h.b')} AS tb FROM mach m JOIN hum h USING (req_id)), j AS (SELECT req_id, annotator, {JAC.format('ta', 'tb')} AS jaccard FROM lh)"
HH = f"{HUMANS}, hh AS (SELECT x.req_id, x.annotator AS i, y.annotator AS j, {TOK.format('x.b')} AS ta, {TOK.format('y.b')} AS tb FROM hum x JOIN hum y ON x.req_id = y.req_id AND x.annotator < y.annotator), jj AS (SELECT req_id, i, j, {JAC.format('ta', 'tb')} AS jaccard FROM hh)"
DIST = "count(*) AS n, round(avg(jaccard), 10) AS mean, round(median(jaccard), 10) AS median, round(min(jaccard), 10) AS min, round(max(jaccard), 10) AS max, round(stddev_pop(jaccard), 10) AS std"


def _lh(spark, d):
    return similarity.with_jaccard(similarity.llm_human_pairs(*(similarity.with_tokens(x(spark, d)) for x in (_machine, _humans))))


def _dist(df):
    return similarity.distribution(df, "jaccard").select("n", *[r10(c) for c in ("mean", "median", "min", "max", "std")])


@query(f"WITH {LH} SELECT req_id, annotator, round(jaccard, 10) AS jaccard FROM j")
def token_jaccard_pairs(spark, d):
    return _lh(spark, d).select("req_id", "annotator", r10("jaccard"))


@query(f"WITH {LH} SELECT {DIST} FROM j")
def jaccard_distribution(spark, d):
    return _dist(_lh(spark, d))


@query(f"WITH {HH} SELECT {DIST} FROM jj")
def human_human_distribution(spark, d):
    return _dist(similarity.with_jaccard(similarity.human_pairs(similarity.with_tokens(_humans(spark, d)))))


@query(f"WITH {HH} SELECT req_id, i, j, round(jaccard, 10) AS jaccard FROM jj")
def human_human_pairs(spark, d):
    return similarity.with_jaccard(similarity.human_pairs(similarity.with_tokens(_humans(spark, d)))).select("req_id", "i", "j", r10("jaccard"))


@query(f"WITH {LH} SELECT m.req_id, count(j.annotator) AS n_humans, round(coalesce(avg(jaccard), 0), 10) AS jaccard_mean, round(coalesce(max(jaccard), 0), 10) AS jaccard_max FROM mach m LEFT JOIN j USING (req_id) GROUP BY m.req_id")
def per_requirement_similarity(spark, d):
    return similarity.per_requirement(_machine(spark, d), _lh(spark, d)).select("req_id", "n_humans", r10("jaccard_mean"), r10("jaccard_max"))


@query(f"WITH {HUMANS} SELECT req_id FROM mach WHERE req_id NOT IN (SELECT req_id FROM hum)")
def skipped_without_humans(spark, d):
    h = _humans(spark, d).where(X.blank(F.col("text")) != "").select("req_id")
    return _machine(spark, d).join(h, "req_id", "left_anti").select("req_id")


@query()
def seq_ratio_pairs(spark, d):
    pairs = similarity.llm_human_pairs(_machine(spark, d), _humans(spark, d))
    return similarity.with_seq_ratio(pairs).select("req_id", "annotator", r10("seq_ratio"))


@query()
def seq_ratio_distribution(spark, d):
    pairs = similarity.with_seq_ratio(similarity.llm_human_pairs(_machine(spark, d), _humans(spark, d)))
    return similarity.distribution(pairs, "seq_ratio").select("n", *[r10(c) for c in ("mean", "median", "min", "max", "std")])


# Made conversions: turns with placeholders, marks and answer lines put in by number. One text serves both engines.
MADE = """CASE turn % 5 WHEN 0 THEN '<MISSING_CONDITION> , ,' WHEN 1 THEN '  ; :' WHEN 2 THEN '<MISSING_SCOPE>, ' ELSE '' END
 || CASE WHEN conv_id % 3 = 0 THEN replace(coalesce(text, ''), ' ', ' <MISSING_ACTOR> ') ELSE coalesce(text, '') END
 || CASE (conv_id + turn) % 4 WHEN 0 THEN ' ,; ;<MISSING_ACTION><MISSING_ACTION> .' WHEN 1 THEN ' <NON_ATOMIC>' WHEN 2 THEN ' ,  .' ELSE '' END"""
ANSWER = """coalesce(text, '') || CASE (conv_id + turn) % 5 WHEN 0 THEN chr(10) || 'Final Rimay:' || chr(10) || '**The ' || coalesce(role, '') || ' must act.**' || chr(10) || 'more'
 WHEN 1 THEN chr(10) || 'FINAL: one' || chr(10) || chr(10) || 'final answer: two ' || chr(10) || '* x *' WHEN 2 THEN chr(10) || 'Final:   ' WHEN 3 THEN chr(10) || '**last**' || chr(10) || chr(10) ELSE '' END"""
CONV = f"v AS (SELECT conv_id, turn, {MADE} AS x FROM conversations)"
# the points in SQL without look-ahead: one replacement for each
# A walk over the characters: what stands so far and the next one. Blanks before a mark go, a mark does not follow its
# like, a full stop takes the place of a comma, and of blanks in a row one stays.
_GAP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STEP = f"""CASE WHEN c IN (',', ';', ':') AND ends_with(rtrim(acc, {_GAP}), c) THEN rtrim(acc, {_GAP})
 WHEN c = '.' AND ends_with(rtrim(acc, {_GAP}), ',') THEN left(rtrim(acc, {_GAP}), length(rtrim(acc, {_GAP})) - 1) || c
 WHEN c IN (',', '.', ';', ':', '!', '?') THEN rtrim(acc, {_GAP}) || c
 WHEN c IN (' ', chr(9)) AND right(acc, 1) IN (' ', chr(9)) THEN left(acc, length(acc) - 1) || ' ' ELSE acc || c END"""
_BARE = "regexp_replace(x, '<MISSING_[A-Z_]+>|<NON_ATOMIC>', '', 'g')"
STRIP_SQL = f"rtrim(ltrim(list_reduce([''] || string_split({_BARE}, ''), lambda acc, c: {_STEP}), {_GAP} || ',;:.'), {_GAP})"


def _conv(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(MADE).alias("x"))


@query(f"WITH {CONV} SELECT conv_id, turn, {STRIP_SQL} AS stripped FROM v")
def strip_placeholders(spark, d):
    return _conv(spark, d).select("conv_id", "turn", X.strip_placeholders(F.col("x")).alias("stripped"))


@query(f"WITH {CONV} SELECT conv_id, turn, " + ", ".join(f"CAST((length(x) - length(replace(x, '{p}', ''))) / {len(p)} AS INT) AS n_{s}" for s, p in X.PLACEHOLDERS.items()) + " FROM v")
def placeholder_counts(spark, d):
    return _conv(spark, d).select("conv_id", "turn", *[X.occurrences(F.col("x"), p).alias(f"n_{s}") for s, p in X.PLACEHOLDERS.items()])


@query(f"WITH {CONV} SELECT conv_id, turn, " + ", ".join(f"CASE WHEN contains(x, '{p}') THEN 'missing' ELSE 'filled' END AS {s}" for s, p in X.PLACEHOLDERS.items()) + ", contains(x, '<NON_ATOMIC>') AS non_atomic FROM v")
def derive_slots(spark, d):
    return _conv(spark, d).select("conv_id", "turn", *[X.derive_slot(F.col("x"), s).alias(s) for s in X.SLOTS], X.is_non_atomic(F.col("x")).alias("non_atomic"))


_LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda v: trim(trim(trim(v), '*'))), lambda v: v <> '')"
_ENDS = "greatest(" + ", ".join(f"CASE WHEN contains(lower(s), '{m}') THEN length(s) - instr(reverse(lower(s)), '{m[::-1]}') + 1 ELSE -1 END" for m in X.FINAL_MARKERS) + ")"


@query(f"""WITH v AS (SELECT conv_id, turn, {ANSWER} AS x FROM conversations), s AS (SELECT conv_id, turn, regexp_replace(x, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS s FROM v), e AS (SELECT conv_id, turn, s, {_ENDS} AS e FROM s)
SELECT conv_id, turn, coalesce(CASE WHEN e > 0 THEN ({_LINES.format('substr(s, e + 1)')})[1] END, ({_LINES.format('s')})[-1], s) AS line FROM e""")
def final_line_extract(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.final_line(F.expr(ANSWER)).alias("line"))


# Made extracts: quoted phrases, line breaks, bullets, notes and marks around turns.
EXTRACT = """CASE turn % 4 WHEN 0 THEN '“the main  ' || coalesce(role, '') || '” now , ' WHEN 1 THEN 'Do “open (' ELSE '' END || coalesce(text, '')
 || CASE (conv_id + turn) % 5 WHEN 0 THEN '<lb><bullet>one,<lb><bullet>two;<lb>Note this is it.' WHEN 1 THEN '<lb>To illustrate any thing. locked  in' WHEN 2 THEN ' ,, ,,; and it is locked in-place (''x'')' WHEN 3 THEN '<lb>Note that, it ends ,' ELSE '' END"""
PHRASE = "'[“”][^“”\\n]*[“”]'"


def _let(value: str, name: str, then: str) -> str:
    """SQL of ``then`` with ``name`` for a value that is worked out once."""
    return f"list_transform([{value}], lambda {name}: {then})[1]"


def _at_part(line: str, test: str, then: str) -> str:
    """SQL of a line whose parts <lb> divides: ``then`` of the parts p and the number k of the first one that passes, else the line."""
    first = f"coalesce(list_position(list_transform(p, lambda v, i: i > 1 AND ({test})), true), 0)"
    return _let(f"string_split({line}, '<lb>')", "p", _let(first, "k", f"CASE WHEN k > 0 THEN {then} ELSE array_to_string(p, '<lb>') END"))


def _cleaned(text: str, blanks: str = "[ \\t\\n\\r\\f\\v]", within: str = "[ \\t\\r\\f\\v]") -> str:
    """SQL of the requirement cleaner, written from its rules: phrases in quotes, then marks, then each line by its parts."""
    word = f"regexp_replace(trim(translate(q[2], '“”', '')), '{within}+', '_', 'g')"
    s = _let(f"replace(coalesce({text}, ''), ':', '')", "s", f"array_to_string(list_transform(list_zip(regexp_split_to_array(s, {PHRASE}), regexp_extract_all(s, {PHRASE})), lambda q: q[1] || coalesce({word}, '')), '')")
    # of commas in a row the first of every four stays
    marks = "CASE WHEN c[1] = ',' THEN repeat(',', CAST(ceil(length(c) / 4) AS INT)) ELSE replace(c, ';', '') END"
    s = f"array_to_string(list_transform(regexp_extract_all(translate({s}, '-()''', '_'), ',+|[^,]+'), lambda c: {marks}), '')"
    upto, rest, whole = "array_to_string(p[:k - 1], '<lb>')", "array_to_string(p[k:], '<lb>')", "array_to_string(p, '<lb>')"
    last = "j >= len(ls) - CASE WHEN ls[-1] = '' THEN 1 ELSE 0 END"
    line = _at_part("w", "starts_with(v, 'Note') OR starts_with(v, 'NOTE')", f"CASE WHEN {last} AND length({rest}) > 5 AND regexp_matches(p[-1], '[a-zA-Z0-9.]$') THEN {upto} ELSE {whole} END")
    told = f"substr({rest}, {len('To illustrate') + 2})"
    line = _at_part(line, "starts_with(v, 'To illustrate')", f"CASE WHEN contains({told}, '.') THEN {upto} || string_split({told}, '.')[-1] ELSE {whole} END")
    comma = _let(f"string_split({rest}, ',')", "z", "array_to_string(z[:-2], ',') || z[-1]")
    line = _at_part(line, "starts_with(v, '<bullet>')", f"{upto} || '<lb>' || CASE WHEN contains({rest}, ',') THEN {comma} ELSE {rest} END")
    shown = "CASE WHEN i = 1 THEN v WHEN starts_with(v, '<bullet>') THEN chr(92) || '*' || substr(v, 9) ELSE ', ' || v END"
    line = f"array_to_string(list_transform(string_split({line}, '<lb>'), lambda v, i: {shown}), '')"
    s = _let(f"string_split({s}, chr(10))", "ls", f"array_to_string(list_transform(ls, lambda w, j: {line}), chr(10))")
    # a blank between a word and a comma goes
    joint = "CASE WHEN i = len(z) THEN '' WHEN regexp_matches(v, '[\\p{L}\\p{N}_]$') THEN ',' ELSE ' ,' END"
    s = _let(f"string_split({s}, ' ,')", "z", f"array_to_string(list_transform(z, lambda v, i: v || {joint}), '')")
    s = f"regexp_replace({s}, ', *,', ',', 'g')"
    s = f"regexp_replace({s}, '(lock[\\p{{L}}\\p{{N}}_]+){blanks}{{1,3}}in', '\\1_in', 'g')"
    return f"regexp_replace({s}, '{blanks}{{2,}}', ' ', 'g')"


@query(f"SELECT conv_id, turn, {_cleaned('x')} AS cleaned FROM (SELECT conv_id, turn, {EXTRACT} AS x FROM conversations)")
def preclean_chain(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.preclean(F.expr(EXTRACT)).alias("cleaned"))


@query(f"SELECT conv_id, turn, sha256({_cleaned('text')}) AS cleaned_sha256 FROM conversations")
def preclean_conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.preclean(F.col("text")), 256).alias("cleaned_sha256"))


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace(trim(x), ':([A-Za-z0-9_]+):|;([A-Za-z0-9_]+):', ' \\1\\2 ', 'g'), ' {{2,}}', ' ', 'g') AS cleaned, regexp_matches(x, ':[A-Za-z0-9_]+:|;[A-Za-z0-9_]+:') AS changed FROM (SELECT conv_id, turn, replace(replace(replace(coalesce(text, ''), '(', ''), chr(10), ' '), ' a ', CASE conv_id % 3 WHEN 0 THEN ':a: ' WHEN 1 THEN ' ;a: ' ELSE ' a ' END) AS x FROM conversations)")
def extract_cleaners(spark, d):
    x = F.expr("replace(replace(replace(coalesce(text, ''), '(', ''), chr(10), ' '), ' a ', CASE conv_id % 3 WHEN 0 THEN ':a: ' WHEN 1 THEN ' ;a: ' ELSE ' a ' END)")
    return table(spark, d, "conversations").select("conv_id", "turn", X.clean_description(x).alias("c")).select("conv_id", "turn", F.col("c.text").alias("cleaned"), F.col("c.changed").alias("changed"))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(text, '') || chr(30)) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("hash"))


@query("SELECT page_id, replace(replace(url, '/', '_'), ' ', '_') AS file_id FROM pages")
def safe_file_id(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_id(F.col("url")).alias("file_id"))


FLAG = "CASE event_id % 9 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'Y' WHEN 4 THEN 'truee' WHEN 5 THEN NULL WHEN 6 THEN '' ELSE event_type END"
NUMBER = "CASE event_id % 7 WHEN 0 THEN CAST(user_id AS VARCHAR(20)) WHEN 1 THEN '-' || CAST(user_id AS VARCHAR(20)) || '.9' WHEN 2 THEN ' ' || CAST(user_id AS VARCHAR(20)) || '.7 ' WHEN 3 THEN event_type WHEN 4 THEN NULL WHEN 5 THEN '' ELSE '1e3' END"


@query(f"SELECT event_id, lower(trim(coalesce({FLAG}, ''))) IN ('true', '1', 'yes', 'y') AS flag FROM events")
def bool_parse(spark, d):
    return table(spark, d, "events").select("event_id", X.truthy(F.expr(FLAG)).alias("flag"))


@query(f"SELECT event_id, coalesce(CAST(trunc(TRY_CAST(trim(coalesce({NUMBER}, '')) AS DOUBLE)) AS INT), 0) AS number FROM events")
def safe_int(spark, d):
    return table(spark, d, "events").select("event_id", X.safe_int(F.expr(NUMBER)).alias("number"))


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS text_sha256 FROM pages")
def html_text_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(X.html_to_text(F.col("html")), 256).alias("text_sha256"))


# ---- sources: first and last rows, exclusions ----------------------------------------------------

@query("SELECT conv_id, arg_min(role, turn) AS role, CAST(count(*) AS BIGINT) AS n_annotations FROM conversations GROUP BY conv_id")
def first_row_authoritative(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.count("*").alias("n_annotations"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_record_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exemplar_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exemplar_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100) WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND trim(coalesce(text, '')) <> ''")
def sample_limit_then_skip(spark, d):
    """The sample is cut first, exclusions come after, so fewer rows than the limit remain."""
    head = table(spark, d, "documents").select("doc_id", "text").orderBy("doc_id").limit(100)
    return head.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").where(X.blank(F.col("text")) != "").select("doc_id")


@query("""SELECT (SELECT count(*) FROM labels) AS gold, (SELECT count(*) FROM documents) AS converted,
 (SELECT count(*) FROM labels l JOIN documents d USING (doc_id) WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) AS evaluated,
 (SELECT count(*) FROM labels l JOIN documents d USING (doc_id) WHERE doc_id IN (SELECT item_id FROM benchmark)) AS skipped""")
def corpus_counts(spark, d):
    gold, conv = table(spark, d, "labels").select("doc_id", F.lit(1).alias("g")), table(spark, d, "documents").select("doc_id", F.lit(1).alias("c"))
    ex = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")).distinct().withColumn("e", F.lit(1))
    j = gold.join(conv, "doc_id", "full").join(ex, "doc_id", "left")
    both = F.col("g").isNotNull() & F.col("c").isNotNull()
    return j.agg(F.count("g").alias("gold"), F.count("c").alias("converted"), F.count_if(both & F.col("e").isNull()).alias("evaluated"), F.count_if(both & F.col("e").isNotNull()).alias("skipped"))


# ---- smells --------------------------------------------------------------------------------------

@query("SELECT event_type AS smell, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen")
def smell_frequency(spark, d):
    return smells.frequency(table(spark, d, "events").select(F.col("event_type").alias("smell"), "event_id"), "event_id")


# Made segments: an event is one of its user's segments; its number tells which smells it has.
CELL = "CASE (event_id * 7 + {0}) % 5 WHEN 0 THEN event_type WHEN 1 THEN ' ' ELSE NULL END"
_SEG_SQL = "v AS (SELECT user_id AS req_id, event_id AS segment_id, " + ", ".join(f'{CELL.format(3 * j)} AS "{s}"' for j, s in enumerate(smells.SMELLS)) + ", CASE WHEN event_id % 4 = 0 THEN ' p' || event_type ELSE ' ' END AS pattern FROM events)"


def _segments(spark, d):
    cells = [F.expr(CELL.format(3 * j)).alias(s) for j, s in enumerate(smells.SMELLS)]
    return table(spark, d, "events").select(F.col("user_id").alias("req_id"), F.col("event_id").alias("segment_id"), F.col("event_id").alias("ordinal"), *cells, F.expr("CASE WHEN event_id % 4 = 0 THEN ' p' || event_type ELSE ' ' END").alias("pattern"))


@query(f"WITH {_SEG_SQL} " + " UNION ALL ".join(f"SELECT req_id, segment_id, '{s}' AS smell, trim(\"{s}\") AS value FROM v WHERE trim(coalesce(\"{s}\", '')) <> ''" for s in smells.SMELLS))
def smell_explode(spark, d):
    return smells.fired(_segments(spark, d))


@query(f"WITH {_SEG_SQL} SELECT req_id, bool_or(" + " OR ".join(f"trim(coalesce(\"{s}\", '')) <> ''" for s in smells.SMELLS) + ") AS has_smell FROM v GROUP BY req_id")
def requirements_with_smell(spark, d):
    return smells.with_any(_segments(spark, d))


@query(f"WITH {_SEG_SQL} SELECT req_id, CAST(sum(" + " + ".join(f"CAST(trim(coalesce(\"{s}\", '')) <> '' AS INT)" for s in smells.SMELLS) + ") AS BIGINT) AS n_smells, coalesce(string_agg(trim(pattern), ',' ORDER BY segment_id) FILTER (trim(pattern) <> ''), '') AS patterns FROM v GROUP BY req_id")
def requirement_smells(spark, d):
    return smells.per_requirement(_segments(spark, d)).select("req_id", "n_smells", F.array_join("patterns", ",").alias("patterns"))


@query("""WITH c AS (SELECT user_id, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE count(*) FILTER (event_type = 'error') = 0 END AS passed, count(*) FILTER (event_type = 'error') AS n_smells FROM events GROUP BY user_id)
SELECT count(*) AS n, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed, count(*) FILTER (passed IS NULL) AS n_error, count(*) FILTER (n_smells > 0) AS n_with_smells, count(passed) AS n_scored,
 round(CASE WHEN count(passed) > 0 THEN count(*) FILTER (passed) / count(passed)::DOUBLE ELSE 0.0 END, 10) AS pass_rate FROM c""")
def pass_rate_excluding_errors(spark, d):
    n = F.count_if(F.col("event_type") == "error")
    checks = table(spark, d, "events").groupBy("user_id").agg(F.when(F.count("*") % 7 != 0, n == 0).alias("passed"), n.alias("n_smells"))
    return smells.summary(checks).select("n", "n_passed", "n_failed", "n_error", "n_with_smells", "n_scored", r10("pass_rate"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS overall, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS in_req FROM conversations")
def segment_counters(spark, d):
    return spans.segment_counters(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", ["turn"]).select("conv_id", "turn", F.col("overall").cast("bigint").alias("overall"), F.col("in_req").cast("bigint").alias("in_req"))


# ---- spans ---------------------------------------------------------------------------------------

WORDS = "w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark)"
ISL = "SELECT item_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) AS INT) AS \"end\", count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY item_id ORDER BY pos) AS run FROM {0}) GROUP BY item_id, run"


def _words(spark, d):
    return spans.words_with_positions(table(spark, d, "benchmark"), "item_id", "text")


@query(f"WITH {WORDS}, f AS (SELECT * FROM w WHERE length(word) > 4) {ISL.format('f')}")
def uncovered_word_islands(spark, d):
    return spans.islands(_words(spark, d).where(F.length("word") > 4), "item_id", "pos")




@query("WITH f AS (SELECT conv_id AS item_id, turn AS pos FROM conversations WHERE length(text) > 300) " + ISL.format("f"))
def consecutive_condition_runs(spark, d):
    c = table(spark, d, "conversations").where(F.length("text") > 300).select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"))
    return spans.islands(c, "item_id", "pos").select("item_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n")


def _spans(spark, d):
    w = _words(spark, d).where(F.length("word") >= 4)
    return w.select("item_id", F.col("pos").alias("start"), (F.col("pos") + F.length("word") % 4).alias("end"), F.substring("word", 1, 2).alias("label"))


SPANS = f"{WORDS}, s AS (SELECT item_id, CAST(pos AS INT) AS start, CAST(pos + length(word) % 4 AS INT) AS \"end\", substr(word, 1, 2) AS label FROM w WHERE length(word) >= 4)"


@query(f"WITH {SPANS} SELECT a.item_id, a.start AS a_start, a.\"end\" AS a_end, b.start AS b_start, b.\"end\" AS b_end, b.start < a.start AND b.\"end\" >= a.start AND b.\"end\" <= a.\"end\" AS is_left FROM s a JOIN s b ON a.item_id = b.item_id WHERE (b.start < a.start AND b.\"end\" >= a.start AND b.\"end\" <= a.\"end\") OR (b.start >= a.start AND b.start <= a.\"end\" AND b.\"end\" > a.\"end\")")
def span_overlap_join(spark, d):
    s = _spans(spark, d)
    a, b = s.select("item_id", F.col("start").alias("a_start"), F.col("end").alias("a_end")), s.select("item_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    cols = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    left = spans.overlaps_left(*cols)
    return a.join(b, "item_id").where(left | spans.overlaps_right(*cols)).select("item_id", "a_start", "a_end", "b_start", "b_end", left.alias("is_left"))


@query(f"WITH {SPANS} SELECT item_id, start, \"end\", min(label) AS label FROM s GROUP BY item_id, start, \"end\"")
def span_dedupe(spark, d):
    return spans.dedupe_spans(_spans(spark, d), "item_id")


@query(f"WITH {SPANS} SELECT item_id, start, \"end\", label, CAST(row_number() OVER (PARTITION BY item_id ORDER BY start, \"end\", label) AS INT) AS ordinal FROM s")
def span_order(spark, d):
    return spans.order_spans(_spans(spark, d), "item_id")


@query(f"""WITH {SPANS}, m AS (SELECT *, max("end") OVER (PARTITION BY item_id ORDER BY start, "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN start > before THEN 1 WHEN before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY start, "end", label) AS grp FROM m)
SELECT item_id, min(start) AS start, max("end") AS "end", string_agg(label, ' ' ORDER BY start, "end", label) AS labels FROM g GROUP BY item_id, grp""")
def span_merge(spark, d):
    return spans.merge_spans(_spans(spark, d), "item_id")


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN k BETWEEN 2 AND 50 THEN '2-50' WHEN k BETWEEN 51 AND 100 THEN '51-100' WHEN k BETWEEN 101 AND 150 THEN '101-150' WHEN k > 150 THEN '>150' END AS bucket
 FROM (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda v: v <> '')) AS k FROM documents)) WHERE bucket IS NOT NULL GROUP BY bucket""")
def word_count_buckets(spark, d):
    k = X.word_count(F.col("text"))
    b = F.when(k.between(2, 50), "2-50").when(k.between(51, 100), "51-100").when(k.between(101, 150), "101-150").when(k > 150, ">150")
    return table(spark, d, "documents").select(b.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"{'WITH ' + WORDS}, t AS (SELECT item_id, list(word ORDER BY pos) AS w FROM w GROUP BY item_id), c AS (SELECT item_id, w, list_transform(w[4:6], lambda x: lower(x)) AS c FROM t), s AS (SELECT item_id, list_filter(range(0, len(w) - 2), lambda i: contains(lower(w[i + 1]), c[1]) AND contains(lower(w[i + 2]), c[2]) AND contains(lower(w[i + 3]), c[3])) AS hits FROM c) SELECT item_id, CAST(hits[-1] AS INT) AS start, CAST(hits[-1] + 2 AS INT) AS \"end\" FROM s")
def clause_location(spark, d):
    """Where the fourth to sixth word of a text stand last."""
    w = F.split("text", " ")
    at = spans.clause_span(w, F.array_join(F.slice(w, 4, 3), " "))
    return table(spark, d, "benchmark").select("item_id", at.alias("s")).select("item_id", "s.start", "s.end")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def previous_label(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", spans.previous("role", "conv_id", ["turn"]).alias("before"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'z') > 0 AND (strpos(text, 'q') = 0 OR strpos(text, 'z') < strpos(text, 'q')) THEN strpos(text, 'z') - 1 WHEN strpos(text, 'q') > 0 THEN strpos(text, 'q') - 1 ELSE -1 END AS first FROM documents WHERE text IS NOT NULL")
def least_position(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", spans.least_position(F.instr(t, "z") - 1, F.instr(t, "q") - 1).cast("bigint").alias("first"))


# ---- rules on made rows --------------------------------------------------------------------------

VERB = "CASE event_id % 23 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(("is", "Contains", "receives", "x", " has ", "supports", "processing", "making", "done", "considered", "defaults", "reads", "sends", "raised", "gotten", "accounts", "proposes", "equals", "performed"))) + " WHEN 19 THEN NULL WHEN 20 THEN '' ELSE event_type END"


@query(f"SELECT event_id, CASE WHEN lower(trim(coalesce(v, ''))) IN ({', '.join(repr(s) for s in V.STATE_VERBS)}) THEN 'logicalExpression' WHEN length(trim(coalesce(v, ''))) > 1 THEN 'trigger' ELSE '' END AS kind FROM (SELECT event_id, {VERB} AS v FROM events)")
def condition_kind(spark, d):
    return table(spark, d, "events").select("event_id", V.condition_kind(F.expr(VERB)).alias("kind"))


# the forms among the verbs above whose stems are vague, told without a stemmer
@query(f"SELECT event_id, v IN ('supports', 'processing', 'making', 'done', 'considered', 'defaults', 'reads', 'raised', 'gotten', 'accounts', 'proposes', 'performed') AS vague FROM (SELECT event_id, {VERB} AS v FROM events) WHERE v IS NOT NULL")
def imprecise_verb(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(VERB).alias("v")).where("v IS NOT NULL").select("event_id", V.is_vague(V.stem_udf("v")).alias("vague"))


SHAPES = "v AS (SELECT conv_id, CAST(conv_id % 3 AS INT) AS s, CAST(max(turn) % 3 AS INT) AS c, CAST(count(*) % 4 AS INT) AS r, CAST(conv_id % 4 AS INT) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"
TYPE_SQL = "CASE WHEN r < 1 THEN 'otherType' ELSE concat(CASE WHEN s >= 1 THEN 'scope' ELSE '' END, CASE WHEN c > 1 THEN CASE WHEN s >= 1 THEN 'Mult' ELSE 'mult' END || 'Cond' WHEN c = 1 THEN CASE WHEN s >= 1 THEN 'Cond' ELSE 'cond' END ELSE '' END, CASE WHEN r > 1 THEN CASE WHEN s >= 1 OR c >= 1 THEN 'MultSrs' ELSE 'multSrs' END ELSE CASE WHEN s >= 1 OR c >= 1 THEN 'SysResp' ELSE 'sysResp' END END) END"


def _shapes(spark, d):
    c = table(spark, d, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id")
    return c.agg(F.expr("CAST(conv_id % 3 AS INT)").alias("s"), F.expr("CAST(max(turn) % 3 AS INT)").alias("c"), F.expr("CAST(count(*) % 4 AS INT)").alias("r"), F.expr("CAST(conv_id % 4 AS INT)").alias("t"))


@query(f"WITH {SHAPES} SELECT conv_id, s, c, r, {TYPE_SQL} AS kind FROM v")
def structure_type(spark, d):
    return _shapes(spark, d).select("conv_id", "s", "c", "r", V.structure_type(F.col("s"), F.col("c"), F.col("r")).alias("kind"))


# kinds of conditions: as many as c, the first by t; time conditions: one where t is 3
ONE = "CASE t WHEN 0 THEN 'trigger' WHEN 1 THEN 'logicalExpression' ELSE '' END"
_SINGLE = "CASE WHEN c = 1 AND one = 'trigger' THEN {0} WHEN c = 1 AND one = 'logicalExpression' THEN {1} WHEN c = 1 THEN 11 WHEN times = 1 THEN {2} END"
NUMBER_SQL = f"""CASE WHEN kind IN ('sysResp', 'multSrs') THEN 5 WHEN kind IN ('scopeSysResp', 'scopeMultSrs') THEN 1 WHEN kind IN ('multCondSysResp', 'multCondMultSrs') THEN 10
 WHEN kind IN ('scopeMultCondSysResp', 'scopeMultCondMultSrs') THEN 9 WHEN kind IN ('condSysResp', 'condMultSrs') THEN {_SINGLE.format(7, 6, 8)} WHEN kind IN ('scopeCondSysResp', 'scopeCondMultSrs') THEN {_SINGLE.format(3, 2, 4)}
 WHEN c = 1 AND s > 0 THEN {_SINGLE.format(3, 2, 8)} WHEN c = 1 THEN {_SINGLE.format(7, 6, 8)} WHEN times = 1 THEN 8 WHEN c > 1 AND s > 0 THEN 9 WHEN c > 1 THEN 10 WHEN s > 0 THEN 1 ELSE 5 END"""


@query(f"WITH {SHAPES}, k AS (SELECT *, {TYPE_SQL} AS kind, {ONE} AS one, CAST(t = 3 AS INT) AS times FROM v), n AS (SELECT conv_id, {NUMBER_SQL} AS number FROM k) SELECT conv_id, number, CASE number " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in V.PATTERNS.items()) + " END AS pattern, CASE number " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in V.TEMPLATES.items()) + " ELSE '' END AS template FROM n")
def pattern_recommendation(spark, d):
    df = _shapes(spark, d).withColumns({"kind": V.structure_type(F.col("s"), F.col("c"), F.col("r")), "conditions": F.expr(f"array_repeat({ONE}, c)"), "times": F.expr("CAST(t = 3 AS INT)")})
    n = V.pattern_number(F.col("kind"), F.col("conditions"), F.col("s"), F.col("times"))
    return df.select("conv_id", n.alias("number"), V.pattern_name(n).alias("pattern"), V.pattern_template(n).alias("template"))


LABEL = "CASE (turn * 7 + conv_id * 3) % 11 WHEN 0 THEN 'scope' WHEN 1 THEN 'condition' WHEN 2 THEN 'Sysresp' WHEN 3 THEN ' or' WHEN 4 THEN 'multCondPos' WHEN 5 THEN 'multSrsPos' WHEN 6 THEN 'condCoordAmb' WHEN 7 THEN 'and' WHEN 8 THEN 'conditionS8' ELSE 'notMatch' END"
_WEIGHT = "coalesce(list_sum(list_transform({0}, lambda x: CASE WHEN contains(x, 'multcond') THEN 2 WHEN contains(x, 'cond') THEN 1 ELSE 0 END)), 0)"
RULES_SQL = f"""l AS (SELECT conv_id, list(lower(trim({LABEL})) ORDER BY turn) AS low FROM conversations GROUP BY conv_id),
f AS (SELECT *, coalesce(list_position(list_transform(low, lambda x: contains(x, 'sysresp') OR contains(x, 'srs')), true), 0) AS first FROM l),
n AS (SELECT *, len(list_filter(low, lambda x: contains(x, 'scope'))) AS n_scope, {_WEIGHT.format('CASE WHEN first > 0 THEN low[1:first - 1] ELSE low END')} AS n_cond_before, CASE WHEN first > 0 THEN {_WEIGHT.format('low[first:]')} ELSE 0 END AS n_cond_after,
 coalesce(list_sum(list_transform(low, lambda x: CASE WHEN contains(x, 'multsrs') THEN 2 WHEN contains(x, 'sysresp') OR contains(x, 'srs') THEN 1 ELSE 0 END)), 0) AS n_resp,
 len(list_filter(low, lambda x: contains(x, 'coordamb'))) > 0 OR len(list_filter(range(1, len(low) - 1), lambda i: contains(low[i], 'cond') AND low[i + 1] = 'or' AND contains(low[i + 2], 'cond'))) > 0 AS coordination FROM f)"""


@query(f"WITH {RULES_SQL} SELECT conv_id, CAST(n_scope AS INT) AS n_scope, CAST(n_cond_before AS INT) AS n_cond_before, CAST(n_cond_after AS INT) AS n_cond_after, CAST(n_resp AS INT) AS n_resp, n_resp > 1 AS non_atomic, n_cond_before + n_cond_after + n_scope > 0 AND n_resp = 0 AS incomplete, n_cond_after > 0 AND n_resp > 0 AS incorrect_order, coordination, n_cond_before + n_cond_after = 0 AND n_resp = 0 AS not_requirement FROM n")
def requirement_smell_rules(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr(LABEL).alias("label"))
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "label"))), lambda x: x["label"]).alias("labels"))
    return smells.requirement_rules(g).drop("labels")


_SEGLABELS = ("sysrespIncomplNoModal", "sysrespIncomplNoModalNoVerb", "sysrespIncomplNoVerb", "condPosIncomplNoNoun", "condPosIncomplNoNounNoVerb", "conditionWithSymbol", "conditionS9", "conditionPosS10", "sysrespPassiveSR", "multCondPosAmbVerb", "multCondPosNoVerb", "sysrespPosWithAmbVerb", "condPosPassiveCond", "scope")
SEGLABEL = "CASE event_id % 17 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_SEGLABELS)) + " WHEN 14 THEN NULL ELSE event_type END"


def _among(*names: str) -> str:
    return "coalesce(v IN (" + ", ".join(f"'{n}'" for n in names) + "), false)"


@query(f"""SELECT event_id, v AS label, {_among('condPosIncomplNoNoun', 'condPosIncomplNoNounNoVerb', 'conditionS9', 'conditionPosS10')} AS no_actor_cond, {_among('condPosIncomplNoNounNoVerb', 'conditionWithSymbol', 'conditionPosS10', 'multCondPosNoVerb')} AS no_verb_cond,
 {_among('sysrespIncomplNoModal', 'sysrespIncomplNoModalNoVerb')} AS no_modal_resp, {_among('sysrespIncomplNoVerb', 'sysrespIncomplNoModalNoVerb')} AS no_verb_resp, {_among('condPosPassiveCond')} AS passive_cond, {_among('sysrespPassiveSR')} AS passive_resp,
 {_among('multCondPosAmbVerb')} AS vague_cond, {_among('sysrespPosWithAmbVerb')} AS vague_resp FROM (SELECT event_id, {SEGLABEL} AS v FROM events)""")
def segment_smell_rules(spark, d):
    return smells.segment_rules(table(spark, d, "events").select("event_id", F.expr(SEGLABEL).alias("label")))


# Made trees: a turn's number picks one of four sentences, its role a noun in it. The SQL states each sentence's segments.
_TREES = (
    "(S (SBAR (WHADVP (WRB When)) (S (NP (DT the) (NN @)) (VP (VBZ logs) (PRT (RP in))))) (, ,) (ADVP (RB then)) (NP (DT the) (NN system)) (VP (MD must) (VP (VB send) (NP (DT a) (NN mail)))) (. .))",
    "(S (NP (NN System)) (VP (MD must) (VP (VB support) (NP (DT the) (NN @)))) (SBAR (IN if) (S (NP (NN it)) (VP (VBZ is) (VP (VBN closed))))))",
    "(S (NP (NN @)) (VP (VBZ is) (ADJP (JJ short))))",
    "(S (PP (IN For) (NP (DT each) (NN @))) (, ,) (NP (NN System)) (VP (MD must) (VP (VP (VB act)) (CC and) (VP (VB stop)))) (. .))",
)
# (sentence, k, start, end, label, passive, noverb, acts, verbs, main, modal, text)
_SEGMENTS = (
    (0, 1, 0, 5, "condition", False, False, False, "logs", "logs", False, "When the @ logs in"),
    (0, 2, 5, 7, "notMatch", False, True, False, "", None, False, ", then"),
    (0, 3, 7, 13, "sysresp", False, False, False, "send", "send", True, "the system must send a mail"),
    (0, 4, 13, 14, "notMatch", False, True, False, "", None, False, "."),
    (1, 1, 0, 5, "sysresp", False, False, False, "support", "support", True, "System must support the @"),
    (1, 2, 5, 9, "condition", True, False, False, "is closed", "closed", False, "if it is closed"),
    (2, 1, 0, 3, "notMatch", False, True, True, "is", "is", False, "@ is short"),
    (3, 1, 0, 3, "scope", False, True, False, "", None, False, "For each @"),
    (3, 2, 3, 4, "notMatch", False, True, False, "", None, False, ","),
    (3, 3, 4, 9, "multSrs", False, False, False, "act stop", "act", True, "System must act and stop"),
    (3, 4, 9, 10, "notMatch", False, True, False, "", None, False, "."),
)
TREE = "replace(CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TREES)) + " ELSE '(S (broken' END, '@', role)"
REQ = "CAST(conv_id AS VARCHAR(20)) || '.' || CAST(turn AS VARCHAR(20))"


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"


SENTENCES = f"r AS (SELECT {REQ} AS req_id, (conv_id + turn) % 5 AS s, role FROM conversations), g AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, x)) + ")" for x in _SEGMENTS) + ') t(s, k, "start", "end", label, passive, noverb, acts, verbs, main, modal, text))'


def _trees(spark, d):
    return table(spark, d, "conversations").select(F.expr(REQ).alias("req_id"), F.expr(TREE).alias("tree"))


@query(f'WITH {SENTENCES} SELECT req_id, CAST(k AS INT) AS k, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", label, passive, noverb, acts, verbs, main, modal, replace(text, \'@\', role) AS text FROM r JOIN g USING (s)')
def tree_segments(spark, d):
    return clauses.segment_requirements(_trees(spark, d)).withColumn("verbs", F.array_join("verbs", " "))


# Trees of many shapes: a document's number picks what stands before the main clause, that clause, and what follows it;
# words of the document are its nouns. Every pattern of clauses fits some of them.
_LEADS = (
    "", "(SBAR (WHADVP (WRB When)) (S (NP (DT the) (NN @)) (VP (VBZ logs) (NP (NN page))))) (, ,)", "(SBAR (IN if) (S (NP (NN @)) (VP (VBZ is) (VP (VBN sent) (PP (IN to) (NP (NN %))))))) (, ,)",
    "(SBAR (IN Once) (S (NP (PRP it)) (VP (VBZ has) (VP (VBN been) (VP (VBN read)))))) (, ,)", "(WHADVP (WRB When)) (S (NP (NN @)) (VP (VBZ sends) (NP (NN %)))) (, ,)", "(WRB where) (NP (NN @)) (VP (VBZ holds) (NP (NN %))) (, ,)",
    "(SBAR (IN if) (S (NP (NN @)) (VP (VBZ finds) (SBAR (IN that) (S (NP (NN %)) (VP (VBZ is) (ADJP (JJ low)))))))) (, ,)", "(PP (IN Upon) (NP (NP (NN receipt)) (PP (IN of) (NP (NN @))))) (, ,)", "(IN After) (NP (NP (DT the) (NN @)) (PP (IN of) (NP (NN %)))) (, ,)",
    "(PP (IN After) (NP (DT the) (NN @))) (, ,)", "(PP (IN For) (NP (DT each) (NN @))) (, ,)", "(SBAR (IN while) (S (VP (VBG using) (NP (NN @))))) (, ,)", "(SBAR (WHNP (WP who)) (S (S (NP (NN @)) (VP (VBZ is) (VP (VBN asked)))) (NP (NN %)))) (, ,)",
    "(SBAR (SBAR (IN if) (S (NP (NN @)) (VP (VBZ is) (ADJP (JJ new))))) (CC or) (SBAR (IN if) (S (NP (NN %)) (VP (VBD was) (VP (VBN based) (PP (IN on) (NP (PRP it)))))))) (, ,)",
)
_MAINS = (
    "(NP (NN System)) (VP (MD must) (VP (VB send) (NP (DT a) (NN %))))", "(NP (DT the) (NN %)) (VP (MD must) (VP (VB be) (VP (VBN sent) (PP (IN to) (NP (NN @)))) (PP (IN by) (NP (NN mail)))))",
    "(NP (NN System)) (VP (MD shall) (ADVP (RB then)) (VP (VB show) (NP (NN %)) (SBAR (WHADVP (WRB when)) (S (NP (NN @)) (VP (VBZ asks))))))", "(NP (NN System)) (VP (MD must) (VP (VB store) (NP (NN %)) (PP (IN for) (NP (DT the) (NN @)))))",
    "(NP (NN System)) (VP (MD must) (VP (VB be) (ADJP (JJ able) (S (VP (TO to) (VP (VB read) (NP (NN %))))))))", "(NP (NN System)) (VP (MD must) (VP (VB ask) (S (NP (NN @)) (VP (TO to) (VP (VB wait))))))", "(NP (NN System)) (VP (MD must) (VP (VB check) (SBAR (IN that) (S (NP (NN %)) (VP (VBZ fits))))))",
    "(NP (NN System)) (VP (VBZ sends) (NP (NN %)))", "(NP (NN System)) (VP (MD must) (VP (VP (VB read) (NP (NN %))) (CC and) (VP (VB send) (NP (PRP it)))))", "(NP (NN System)) (VP (MD must) (VB be) (VP (VBN shown) (PP (IN to) (NP (NN @)))))", "(NP (NN System)) (VP (MD must) (VP (VB stop)))",
)
_TAILS = ("(. .)", "(, ,) (ADVP (RB else)) (NP (NN @)) (VP (MD must) (VP (VB keep) (NP (NN %)))) (. .)", "(SBAR (IN if) (S (NP (NN %)) (VP (VBZ has) (NP (NN @))))) (. .)", "", ")")
_PICK = lambda texts, n: "(CASE " + " ".join(f"WHEN {n} = {k} THEN '{t}'" for k, t in enumerate(texts)) + " END)"
_AT = "(doc_id + 2 * n_chars)"
MADE_TREES = f"SELECT CAST(doc_id AS BIGINT) AS req_id, replace(replace('(ROOT (S ' || {_PICK(_LEADS, f'{_AT} % {len(_LEADS)}')} || ' ' || CASE WHEN n_chars % 3 = 0 THEN '(S ' ELSE '' END || {_PICK(_MAINS, f'doc_id % {len(_MAINS)}')} || CASE WHEN n_chars % 3 = 0 THEN ') ' ELSE ' ' END || {_PICK(_TAILS, f'n_chars % {len(_TAILS)}')} || '))', '@', w1), '%', w2) AS tree FROM (SELECT doc_id, n_chars, coalesce(nullif(regexp_extract(text, '[A-Za-z]+', 0), ''), 'x') AS w1, lang AS w2 FROM documents)"


def _made_trees(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("specloom_documents")
    return spark.sql(MADE_TREES.replace("FROM documents", "FROM specloom_documents"))


# The node table in SQL, from brackets: a row per bracket or word in order, depths by running sums, a bracket's end by the
# next one of its depth, parents by the last bracket one level up. Trees whose brackets do not match have no nodes.
NODES = f"""t AS ({MADE_TREES}),
 p AS (SELECT req_id, unnest(regexp_extract_all(tree, '[()]|[^ ()]+')) AS tok, unnest(range(len(regexp_extract_all(tree, '[()]|[^ ()]+')))) AS pos FROM t),
 q AS (SELECT *, lag(tok) OVER w AS before, lead(tok) OVER w AS after, sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth FROM p WINDOW w AS (PARTITION BY req_id ORDER BY pos)),
 ok AS (SELECT req_id FROM q GROUP BY req_id HAVING min(depth) >= 0 AND arg_max(depth, pos) = 0 AND count(*) FILTER (depth = 0) = 1),
 n0 AS (SELECT req_id, pos, tok, depth, CASE WHEN tok = '(' THEN after ELSE tok END AS label, tok NOT IN ('(', ')') AND before <> '(' AS leaf, CASE WHEN tok IN ('(', ')') THEN depth - (tok = '(')::INT ELSE depth END AS level FROM q SEMI JOIN ok USING (req_id)),
 n1 AS (SELECT *, tok = '(' OR leaf AS node, count(*) FILTER (tok = '(' OR leaf) OVER w - 1 AS pre, count(*) FILTER (leaf) OVER w AS words FROM n0 WINDOW w AS (PARTITION BY req_id ORDER BY pos)),
 n2 AS (SELECT *, CASE WHEN tok = '(' THEN lead(pre) OVER w ELSE pre END AS last, CASE WHEN tok = '(' THEN lead(words) OVER w ELSE words END AS e FROM n1 WHERE tok IN ('(', ')') WINDOW w AS (PARTITION BY req_id, level ORDER BY pos)),
 n3 AS (SELECT req_id, pos, pre, last, level, words AS "start", e AS "end", false AS leaf, label FROM n2 WHERE tok = '(' UNION ALL SELECT req_id, pos, pre, pre, level, words - 1, words, true, label FROM n1 WHERE leaf),
 n4 AS (SELECT a.*, coalesce(b.pre, -1) AS parent FROM n3 a LEFT JOIN n3 b ON a.req_id = b.req_id AND b.level = a.level - 1 AND b.pre < a.pre AND b.last >= a.pre),
 nodes AS MATERIALIZED (SELECT n4.*, (SELECT count(*) FROM n3 x WHERE x.req_id = n4.req_id AND x."start" = n4."start" AND x.pre > n4.pre AND x.pre <= n4.last) AS chain FROM n4)"""


@query(f'WITH {NODES} SELECT req_id, CAST(pre AS INT) AS pre, CAST(last AS INT) AS last, CAST(parent AS INT) AS parent, CAST(level AS INT) AS level, CAST(chain AS INT) AS chain, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", leaf, label FROM nodes')
def tree_nodes(spark, d):
    return treebank.node_table(_made_trees(spark, d))


@query(f"WITH {NODES} SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT req_id) AS BIGINT) AS n_trees, CAST(max(last - pre + 1) AS INT) AS largest, CAST(max(level) AS INT) AS deepest FROM nodes WHERE NOT leaf GROUP BY label")
def tree_labels(spark, d):
    """The table function in SQL: how often each label stands, and in how many trees."""
    treebank.register(spark)
    _made_trees(spark, d).createOrReplaceTempView("specloom_trees")
    return spark.sql("SELECT n.label, count(*) AS n, count(DISTINCT t.req_id) AS n_trees, max(n.last - n.pre + 1) AS largest, max(n.level) AS deepest FROM specloom_trees t, LATERAL tree_nodes(t.tree) n WHERE NOT n.leaf GROUP BY n.label")


def _match(name: str) -> str:
    """SQL of one pattern: its matched nodes and where its last part ends."""
    join = lambda a, b, place: f"LEFT JOIN nodes {b} ON {b}.req_id = {a}.req_id AND {b}.pre = {place}"
    after = join("n", "y", "n.last + 1")
    parts, end = {None: ("", "n"), "next": (after, "y"), "next.first": (join("n", "y", "n.last + 2"), "y"), "next.next": (f"{after} {join('y', 'z', 'y.last + 1')}", "z")}[patterns.PARTS.get(name)]
    return f"""SELECT n.req_id, '{name}' AS name, n.pre AS head, n."start" AS s, {end}."end" AS e FROM nodes n {parts} WHERE {patterns.Table().holds(patterns.CLAUSES[name], 'n')}"""


_PASSIVE = " UNION ALL ".join(f"SELECT n.req_id, '{name}' AS name, n.pre AS head FROM (SELECT x.* FROM nodes x SEMI JOIN m ON m.req_id = x.req_id AND m.head = x.pre AND m.name = '{name}') n WHERE {patterns.Table().holds(patterns.PASSIVES[k], 'n')}" for name in patterns.CLAUSES for k in patterns.passives_of(name))
MATCHES = f"WITH {NODES}, m AS MATERIALIZED ({' UNION ALL '.join(map(_match, patterns.CLAUSES))})"


def _matches(spark, d):
    rows = clauses.marked(_made_trees(spark, d))
    strict = F.filter(clauses.found_clauses(), lambda c: c["name"].isin(*patterns.CLAUSES))
    return rows.withColumn("found", strict)


def _rows(found):
    return found.select("req_id", F.explode_outer("found").alias("c")).where("c IS NOT NULL")


@query(f"{MATCHES} SELECT req_id, name, CAST(head AS INT) AS head, CAST(s AS INT) AS start_word, CAST(e AS INT) AS end_word FROM m")
def clause_matches(spark, d):
    return _rows(_matches(spark, d)).select("req_id", "c.name", "c.head", F.col("c.start").alias("start_word"), F.col("c.end").alias("end_word"))


@query(f"{MATCHES} SELECT DISTINCT req_id, name, CAST(head AS INT) AS head FROM ({_PASSIVE})")
def clause_passives(spark, d):
    return _rows(_matches(spark, d)).where("c.passive").select("req_id", "c.name", "c.head")


_TRIMS = " OR ".join(f"m.name = '{k}' AND d.name IN ({', '.join(map(repr, v))})" for k, v in clauses.TRIMS.items() if k in patterns.CLAUSES)


@query(f"""{MATCHES}, cut AS (SELECT m.req_id, m.name, m.head, m.s, coalesce(min(d.s), m.e) AS e FROM m LEFT JOIN m d ON d.req_id = m.req_id AND d.s > m.s AND d.e <= m.e AND ({_TRIMS}) GROUP BY m.req_id, m.name, m.head, m.s, m.e)
 SELECT req_id, name, CAST(head AS INT) AS head, CAST(s AS INT) AS start_word, CAST(e AS INT) AS end_word FROM cut""")
def clause_trim(spark, d):
    return _rows(_matches(spark, d).withColumn("found", clauses.trimmed())).select("req_id", "c.name", "c.head", F.col("c.start").alias("start_word"), F.col("c.end").alias("end_word"))


# (sentence, segment, smell, message) and (sentence, pattern)
_FIRED = (
    (1, 1, "Incorrect order requirement", detector.MESSAGES["Incorrect order requirement"]), (1, 2, "Passive voice", "Passive voice in the condition."), (1, 1, "Not precise verb", "Not precise verb in the system response."),
    (2, 1, "Not requirement", detector.MESSAGES["Not requirement"]), (2, 1, "Incomplete system response", detector.MESSAGES["Incomplete system response"]), (3, 1, "Non-atomic requirement", detector.MESSAGES["Non-atomic requirement"]),
)
_PATTERN = {0: 7, 1: 7, 2: 5, 3: 1}
FIRED = f"{SENTENCES}, x AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, x)) + ")" for x in _FIRED) + ") t(s, k, smell, message))"
_CELLS = ", ".join(f"coalesce((SELECT message FROM x WHERE x.s = j.s AND x.k = j.k AND x.smell = '{s}'), '') AS \"{s}\"" for s in smells.SMELLS)
_BY_S = lambda names: "CASE WHEN j.k > 1 THEN '' ELSE CASE j.s " + " ".join(f"WHEN {s} THEN '{names[n]}'" for s, n in _PATTERN.items()) + " END END"


@query(f"WITH {FIRED}, j AS (SELECT *, row_number() OVER (ORDER BY req_id, k) AS overall FROM r JOIN g USING (s)) SELECT req_id, req_id || '_' || CAST(overall AS VARCHAR) AS segment_id, replace(text, '@', role) AS segment, {_CELLS}, {_BY_S(V.PATTERNS)} AS pattern, {_BY_S(V.TEMPLATES)} AS template, CAST(k AS INT) AS ordinal FROM j")
def smell_report(spark, d):
    return detector.report(_trees(spark, d))


@query(f"WITH {FIRED}, m AS (SELECT DISTINCT req_id, smell FROM r JOIN x USING (s)) SELECT (SELECT count(DISTINCT req_id) FROM r JOIN g USING (s)) AS requirements, (SELECT count(DISTINCT req_id) FROM m) AS with_smells, " + ", ".join(f"(SELECT count(*) FROM m WHERE smell = '{s}') AS \"{s}\"" for s in smells.SMELLS))
def smell_totals(spark, d):
    return detector.totals(detector.report(_trees(spark, d)))


# ---- bundles, prompts and formats ----------------------------------------------------------------

GOLD_SLOT = "CASE (conv_id + {0}) % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'implied' WHEN 2 THEN 'Missing ' ELSE '' END"
LLM_SLOT = "CASE WHEN (conv_id * 3 + {0} * 5) % 4 = 0 THEN 'missing' ELSE 'filled' END"
JUDGED = "q AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), e AS (" + " UNION ALL ".join(f"SELECT conv_id, '{x}' AS slot, lower(trim({GOLD_SLOT.format(k)})) AS gold, {LLM_SLOT.format(k)} AS llm FROM q" for k, x in enumerate(X.SLOTS)) + ")"


def _judged(spark, d):
    ids = table(spark, d, "conversations").select("conv_id").where("conv_id IS NOT NULL").distinct()
    slots = lambda sql: F.struct(*[F.expr(sql.format(k)).alias(x) for k, x in enumerate(X.SLOTS)])
    llm = [F.expr(f"{LLM_SLOT.format(k)} = 'missing'") for k, x in enumerate(X.SLOTS) if x in X.MANDATORY]
    return ids.select("conv_id", slots(GOLD_SLOT).alias("gold_slots"), slots(LLM_SLOT).alias("llm_slots"), F.expr("conv_id % 3 = 0").alias("gold_overall"), (llm[0] | llm[1] | llm[2]).alias("llm_overall"))


@query(f"""WITH {JUDGED}, c AS (SELECT slot, {CELLS} FROM e GROUP BY slot), m AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c), mi AS ({_prf('m')}), ma AS (SELECT avg(f1) AS f1 FROM ({_prf('c')})),
l AS (SELECT count(*) FILTER (gold = 'implied') AS n_implied, count(*) FILTER (gold = 'implied' AND llm <> 'missing') AS implied_filled, count(*) FILTER (gold = 'missing') AS n_missing, count(*) FILTER (gold = 'missing' AND llm = 'missing') AS missing_flagged FROM e),
v AS (SELECT count(*) AS n, avg(CAST((conv_id % 3 = 0) = bad AS INT)) AS agreement FROM (SELECT conv_id, bool_or(slot IN ('actor', 'modalVerb', 'action') AND llm = 'missing') AS bad FROM e GROUP BY conv_id))
SELECT v.n, round(mi.precision, 10) AS micro_precision, round(mi.recall, 10) AS micro_recall, round(mi.f1, 10) AS micro_f1, round(ma.f1, 10) AS macro_f1, n_implied, implied_filled, n_missing, missing_flagged, round(agreement, 10) AS agreement FROM mi, ma, l, v""")
def field_accuracy_bundle(spark, d):
    f = score.field_accuracy(_judged(spark, d)).select("field_accuracy.*")
    r = lambda c, n: F.round(c, 10).alias(n)
    return f.select(
        "n", r(f["micro"]["precision"], "micro_precision"), r(f["micro"]["recall"], "micro_recall"), r(f["micro"]["f1"], "micro_f1"), r(f["macro"]["f1"], "macro_f1"), f["implied_analysis"]["overall"]["n_implied"].alias("n_implied"),
        f["implied_analysis"]["overall"]["llm_filled"].alias("implied_filled"), f["missing_analysis"]["overall"]["n_missing"].alias("n_missing"), f["missing_analysis"]["overall"]["llm_flagged_missing"].alias("missing_flagged"), r(f["overall_verdict"]["agreement_rate"], "agreement"),
    )


@query(f"""WITH {LH}, k AS (SELECT m.req_id, count(h.annotator) AS n FROM mach m LEFT JOIN hum h USING (req_id) GROUP BY m.req_id)
SELECT (SELECT count(*) FROM j) AS n_pairs, (SELECT round(avg(jaccard), 10) FROM j) AS jaccard_mean, count(*) FILTER (n > 0) AS n_evaluated, count(*) FILTER (n = 0) AS n_skipped, coalesce(string_agg(CAST(req_id AS VARCHAR), ',' ORDER BY req_id) FILTER (n = 0), '') AS skipped FROM k""")
def llm_human_bundle(spark, d):
    h = _humans(spark, d).where(X.blank(F.col("text")) != "").groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "text"))).alias("h"))
    rows = _machine(spark, d).join(h, "req_id", "left").select("req_id", F.col("req_id").alias("ordinal"), F.col("text").alias("llm_text"), F.coalesce(F.transform("h", lambda x: x["text"]), F.array().cast("array<string>")).alias("human_texts"))
    rows = rows.withColumns({"check_passed": F.lit(True), "check_smells": F.array().cast("array<struct<segment_id:string,smell:string,value:string>>")})
    x = score.conversion_quality(rows).select("conversion_quality.similarity.llm_vs_human").select("llm_vs_human.*")
    return x.select("n_pairs", F.round("jaccard.mean", 10).alias("jaccard_mean"), "n_evaluated", F.col("n_skipped_no_humans").cast("bigint").alias("n_skipped"), F.array_join(F.transform("skipped_req_ids", lambda v: v.cast("string")), ",").alias("skipped"))


WANTED = "CASE user_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'signup' WHEN 2 THEN 'none' ELSE 'view' END"


@query(f"SELECT user_id, {WANTED} AS req_id, arg_min(event_type, CASE WHEN event_type = {WANTED} THEN 0 ELSE 1000000000000 END + event_id) AS found_id, arg_min(event_id, CASE WHEN event_type = {WANTED} THEN 0 ELSE 1000000000000 END + event_id) AS ordinal FROM events GROUP BY user_id")
def result_or_first(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("req_id"))
    wanted = e.select("call_id").distinct().withColumn("user_id", F.col("call_id")).select("call_id", F.expr(WANTED).alias("req_id"))
    return score.result_or_first(wanted, e).select(F.col("call_id").alias("user_id"), "req_id", "found_id", "ordinal")


NAME = "CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN '-' || source WHEN 2 THEN source || '/x' WHEN 3 THEN '' ELSE NULL END"


@query(f"SELECT doc_id, coalesce(length({NAME}) > 0 AND NOT starts_with({NAME}, '-') AND NOT contains({NAME}, '/'), false) AS ok FROM documents")
def run_name_check(spark, d):
    return table(spark, d, "documents").select("doc_id", score.valid_run_name(F.expr(NAME)).alias("ok"))


@query(f"SELECT conv_id, turn, {_cleaned('x', ' ', ' ')} AS cleaned FROM (SELECT conv_id, turn, {EXTRACT} AS x FROM conversations)")
def older_preclean(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.older_preclean(F.expr(EXTRACT)).alias("cleaned"))


FENCED = "CASE turn % 4 WHEN 0 THEN '```text' || chr(10) || replace(coalesce(text, ''), chr(10), ' ') || chr(10) || '```' WHEN 1 THEN ' ```' || chr(10) || replace(coalesce(text, ''), chr(10), ' ') WHEN 2 THEN coalesce(text, '') || ' ```' ELSE coalesce(text, '') END"


@query("SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN trim(replace(coalesce(text, ''), chr(10), ' ')) WHEN turn % 4 = 2 THEN regexp_replace(text || ' ```', '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') ELSE regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') END AS body FROM conversations")
def fence_strip(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_fences(F.expr(FENCED)).alias("body"))


@query(f"SELECT conv_id, " + ", ".join(f"lower(trim({GOLD_SLOT.format(k)})) AS {x}" for k, x in enumerate(X.SLOTS)) + " FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def slots_to_map(spark, d):
    rows = _judged(spark, d).select("conv_id", *[F.col(f"gold_slots.{x}").alias(f"gold_{x}") for x in X.SLOTS])
    return records.slots_map(rows, "gold_", "m").select("conv_id", *[F.col("m")[x].alias(x) for x in X.SLOTS])


@query("SELECT event_id, printf('%.4f', value) AS four, printf('%.3f', value) AS three, CAST(CAST(floor(100 * (event_id % 97) / 97.0 + 0.5) AS INT) AS VARCHAR) || '%' AS percent FROM events")
def number_formats(spark, d):
    return table(spark, d, "events").select("event_id", X.decimals(F.col("value"), 4).alias("four"), X.decimals(F.col("value"), 3).alias("three"), X.percent(F.expr("(event_id % 97) / 97.0D")).alias("percent"))


@query("SELECT page_id, replace('\"' || replace(coalesce(url, ''), '\"', '') || '</script>\"', '</', '<\\/') AS json FROM pages")
def script_json(spark, d):
    return table(spark, d, "pages").select("page_id", X.script_json(F.expr("'\"' || replace(coalesce(url, ''), '\"', '') || '</script>\"'")).alias("json"))


@query("WITH b AS (SELECT string_agg('Example ' || k || ':' || chr(10) || 'NL: ' || trim(text) || chr(10) || 'Rimay: r' || item_id, chr(10) || chr(10) ORDER BY k) AS block FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) WHERE k <= 3) SELECT conv_id, turn, sha256('{given} ' || block || chr(10) || 'NL: ' || coalesce(text, '') || ' end') AS user_sha256 FROM conversations, b")
def prompt_assembly(spark, d):
    ex = table(spark, d, "benchmark").orderBy("item_id").limit(3).select(F.col("item_id").alias("k"), F.col("text").alias("nl"), F.concat(F.lit("r"), "item_id").alias("rimay"))
    reqs = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("nl_text"))
    out = prompts.build_prompts(reqs, "fsl", "{{given}} {examples_block}\nNL: {nl_text} end", "system", ex)
    return out.select("conv_id", "turn", F.sha2("user", 256).alias("user_sha256"))


# ---- runs ----------------------------------------------------------------------------------------

@query("""SELECT d.source AS run, coalesce(d.lang, 'none') AS strategy, count(*) AS n, count(l.doc_id) AS evaluated, round(coalesce(avg(l.quality), 0), 10) AS pass_rate, round(avg(d.n_chars), 6) AS mean_chars
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def run_overview(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    j = table(spark, d, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("none")).alias("strategy"), "n_chars").join(lab, "doc_id", "left")
    return j.groupBy(F.col("source").alias("run"), "strategy").agg(F.count("*").alias("n"), F.count("quality").alias("evaluated"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 10).alias("pass_rate"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


