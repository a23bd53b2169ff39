"""Column expressions on requirement texts: cleaning, parsing, tokens, placeholders, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The structural slots, the tokens that mark them absent, the marks before an answer, words for true.
SLOTS = ("scope", "condition", "actor", "modalVerb", "action")
MANDATORY = ("actor", "modalVerb", "action")
PLACEHOLDERS = {
    "scope": "<MISSING_SCOPE>",
    "condition": "<MISSING_CONDITION>",
    "actor": "<MISSING_ACTOR>",
    "modalVerb": "<MISSING_MODAL_VERB>",
    "action": "<MISSING_ACTION>",
}
NON_ATOMIC = "<NON_ATOMIC>"
FINAL_MARKERS = ("final rimay:", "final answer:", "rimay output:", "final:")
TRUE_WORDS = ("true", "1", "yes", "y")


def blank(x: Column) -> Column:
    """Null becomes empty; blanks at the ends go."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def truthy(x: Column) -> Column:
    """True for the true words in any case, false for all else, null included."""
    return F.lower(blank(x)).isin(*TRUE_WORDS)


def slot_value(x: Column) -> Column:
    return F.lower(blank(x))


def safe_int(x: Column) -> Column:
    """Truncated number, 0 where it cannot be read."""
    number = blank(x).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number) & (F.abs(number) < 2147483648.0), number).cast("int"), F.lit(0))


def is_missing(x: Column) -> Column:
    return slot_value(x) == "missing"


def normalize(x: Column) -> Column:
    """Placeholders to blanks (they are upper case), lower case, single blanks."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), r"<MISSING_[A-Z_]+>|<NON_ATOMIC>", " ")
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def tokens(x: Column) -> Column:
    """Distinct ASCII letter and digit runs of the normalised text."""
    return F.array_distinct(F.regexp_extract_all(normalize(x), F.lit("([a-z0-9]+)"), 1))


def jaccard_of(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays; two empty ones are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def derive_slot(text: Column, slot: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")).contains(PLACEHOLDERS[slot]), "missing").otherwise("filled")


def occurrences(text: Column, token: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(token), F.lit("")))) / len(token)).cast("int")


def is_non_atomic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).contains(NON_ATOMIC)


def strip_placeholders(x: Column) -> Column:
    """The text without placeholders and the marks they leave behind.

    Blanks before a point go first, so points that belong together then touch: of equal ones the last stays, a comma
    gives way to a full stop, and nothing begins with a point."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), r"<(?:MISSING_[A-Z_]+|NON_ATOMIC)>", "")
    s = F.regexp_replace(s, r"\s+(?=[,.;:!?])", "")
    s = F.regexp_replace(s, r"([,;:])(?=\1)|,(?=\.)", "")
    return blank(F.ltrim(F.regexp_replace(s, r"[ \t]{2,}", " "), F.lit(" \t\n\r\f\x0b,;:.")))


def strip_fences(x: Column) -> Column:
    """Text inside a code fence, without the fence's own line."""
    s = blank(x)
    body = F.when(F.instr(s, "\n") > 0, F.regexp_replace(F.regexp_replace(s, r"^[^\n]*\n", ""), r"```$", "")).otherwise(F.regexp_replace(s, r"(?<=.)```$", ""))
    return blank(F.when(s.startswith("```"), body).otherwise(s))


def _lines(x: Column) -> Column:
    clean = F.transform(F.split(x, r"\r\n|\r|\n"), lambda v: blank(F.regexp_replace(blank(v), r"^\*+|\*+$", "")))
    return F.filter(clean, lambda v: v != "")


def final_line(x: Column) -> Column:
    """First line after the last answer marker, else the last line; the text itself if it has none."""
    s = blank(x)
    low = F.lower(s)
    ends = [F.when(F.instr(low, m) > 0, F.length(low) - F.instr(F.reverse(low), m[::-1]) + 1).otherwise(-1) for m in FINAL_MARKERS]
    end = F.greatest(*ends)
    after, every = _lines(F.substr(s, end + 1)), _lines(s)
    return F.coalesce(F.when(end > 0, F.try_element_at(after, F.lit(1))), F.try_element_at(every, F.lit(-1)), s)


#: Marks of line breaks and bullets in extracted texts, what a bullet becomes, how notes begin.
LINE, BULLET, STAR, NOTES, ILLUSTRATION = "<lb>", "<bullet>", "\\*", ("Note", "NOTE"), "To illustrate"


def _without_last(x: Column, mark: str) -> Column:
    """The text without the last ``mark`` in it."""
    tail = F.substring_index(x, mark, -1)
    return F.when(x.contains(mark), F.concat(F.substr(x, F.lit(1), F.length(x) - F.length(tail) - len(mark)), tail)).otherwise(x)


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _from(parts: Column, k: Column) -> Column:
    return F.array_join(F.slice(parts, k, F.size(parts)), LINE)


def _upto(parts: Column, k: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), k - 1), LINE)


def _at_part(x: Column, test, then) -> Column:
    """``then`` of the parts that LINE divides and the number of the first one after a LINE that passes; else the text."""
    number = lambda parts: F.array_position(F.transform(parts, lambda v, i: (i > 0) & test(v)), True).cast("int")
    return _let(F.split(x, LINE), lambda parts: _let(number(parts), lambda k: F.when(k > 0, then(parts, k)).otherwise(F.array_join(parts, LINE))))


def _parts(x: Column, last: Column) -> Column:
    """One line of text whose parts are divided by LINE: notes and illustrations go, bullets get a star, breaks a comma."""
    # a note runs to the end of the text, if that is a letter, a digit or a full stop
    def note(parts, k):
        return F.when(last & (F.length(_from(parts, k)) > 5) & F.element_at(parts, -1).rlike(r"[a-zA-Z0-9.]$"), _upto(parts, k)).otherwise(F.array_join(parts, LINE))

    # an illustration runs to the last full stop
    def illustration(parts, k):
        rest = F.substr(_from(parts, k), F.lit(len(ILLUSTRATION) + 2))
        return F.when(rest.contains("."), F.concat(_upto(parts, k), F.substring_index(rest, ".", -1))).otherwise(F.array_join(parts, LINE))

    # from the first bullet on the last comma goes
    def bullets(parts, k):
        return F.concat(_upto(parts, k), F.lit(LINE), _let(_from(parts, k), lambda v: _without_last(v, ",")))

    x = _at_part(x, lambda v: v.startswith(NOTES[0]) | v.startswith(NOTES[1]), note)
    x = _at_part(x, lambda v: v.startswith(ILLUSTRATION), illustration)
    x = _at_part(x, lambda v: v.startswith(BULLET), bullets)
    shown = F.transform(F.split(x, LINE), lambda v, i: F.when(i == 0, v).when(v.startswith(BULLET), F.concat(F.lit(STAR), F.substr(v, F.lit(len(BULLET) + 1)))).otherwise(F.concat(F.lit(", "), v)))
    return F.array_join(shown, "")


def _phrases(s: Column, blanks: str) -> Column:
    """Each phrase between two curly quotes of one line as one word; an open quote stays."""
    phrase = "[“”][^“”\n]*[“”]"
    word = lambda q: F.regexp_replace(blank(F.regexp_replace(q, "[“”]", "")), f"{blanks}+", "_")
    around, phrases = F.split(s, phrase, -1), F.regexp_extract_all(s, F.lit(phrase), F.lit(0))
    joined = F.array_join(F.zip_with(around, phrases, lambda a, q: F.concat(a, F.coalesce(word(q), F.lit("")))), "")
    return F.when(s.rlike("[“”]"), joined).otherwise(s)


def _all_lines(s: Column) -> Column:
    lines = lambda v: _let(F.split(v, "\n"), lambda p: F.array_join(F.transform(p, lambda w, i: _parts(w, i >= F.size(p) - F.when(F.element_at(p, -1) == "", 2).otherwise(1))), "\n"))
    return F.when(s.contains(LINE), lines(s)).otherwise(s)


def preclean(x: Column, blanks: str = r"\s") -> Column:
    """The requirement cleaner: quoted phrases become one word, notes go, line breaks become commas.

    ``blanks`` are the characters that runs are made of: all blanks, or " " as the older cleaner has it."""
    s = _let(F.replace(F.coalesce(x, F.lit("")), F.lit(":"), F.lit("")), lambda v: _phrases(v, blanks))
    # commas are joined before semicolons go, so that those between commas part them once more
    s = F.translate(F.regexp_replace(F.translate(s, "-()'", "_"), ",{2,4}", ","), ";", "")
    s = _let(s, _all_lines)
    s = F.regexp_replace(s, r"(?<=[\p{L}\p{N}_]) (?=,)", "")
    s = F.regexp_replace(s, r", *,", ",")
    s = F.regexp_replace(s, f"(lock[\\p{{L}}\\p{{N}}_]+){blanks}{{1,3}}(?=in)", "$1_")
    return F.regexp_replace(s, f"{blanks}{{2,}}", " ")


def older_preclean(x: Column) -> Column:
    """The cleaner of the first tree builder, to which only the blank is a blank."""
    return preclean(x, " ")


# ---- cleaners of texts from word files ------------------------------------------------------------


def _any_of(marks: str, least: int = 1) -> str:
    """Runs of some marks."""
    return f"[{''.join(chr(92) + m if m in '[]^-' + chr(92) else m for m in marks)}]{'+' if least == 1 else f'{{{least},}}'}"


def _word_with(mark: str) -> str:
    """Words that hold a mark."""
    return rf"\S*{mark}\S*"


def _inside(left: str, right: str, least: int, lines: bool) -> str:
    """What stands between two marks with these, up to the first right one, over several lines or within one."""
    return rf"\{left}[^{right}{'' if lines else chr(10) + chr(13)}]{{{least},}}\{right}"


def _sentence(opener: str, without: tuple[str, ...]) -> str:
    """From a word to the next full stop of its line, if none of some words stands between."""
    return rf"\b{opener}\b.?(?:(?!\b(?:{'|'.join(without)})\b)[^.\n\r])*\."


def _to_last_stop(*openers: str, any_case: bool = False) -> str:
    """From a phrase to the last full stop of its line."""
    return rf"{'(?i)' if any_case else ''}\b(?:{'|'.join(openers)})\b.*\."


def _attribute(mark: str) -> str:
    """A word between a mark and a colon."""
    return rf"{mark}(\w+):"


#: What each cleaner looks for and puts in its place. The marks, phrases and lengths, and what replaces them.
CLEANERS: dict[str, tuple[str, str]] = {
    "points_and_commas": (_any_of('",.'), " "),
    "curly_quotes": (_any_of("“”"), " "),
    "double_blanks": (_any_of(" ", 2), " "),
    "windows_path": (_word_with(r"\\"), "file_path"),
    "unix_path": (_word_with("/"), "file_path"),
    "bracketed": (_inside("(", ")", 1, lines=True), " "),
    # a sentence with 'This' that asks for nothing
    "additional_sentence": (_sentence("This", without=("shall", "must")), ""),
    "illustration": (_to_last_stop("To illustrate", any_case=True), ""),
    "example": (_to_last_stop("For example", "Exemple", "Example", any_case=True), ""),
    "note": (_to_last_stop("Notes?"), ""),
    "empty_lines": (_any_of("\n", 2) + "(?=[A-z0-9])", ".<lb>"),
    "last_lines": (_any_of("\n") + r"\z", ""),
    # a full stop after a word of six letters or more and before two of the next
    "sentence_end": (r"(?<=\w{6})\. +(?=\w{2})", ".<period>"),
    "colon_attribute": (_attribute(":"), " $1 "),
    "semicolon_attribute": (_attribute(";"), " $1 "),
    "parenthesis": (_inside("(", ")", 0, lines=False), " "),
}
#: The cleaners that a description passes, in order, and those of them whose finds are reported.
DESCRIPTION = ("colon_attribute", "semicolon_attribute", "parenthesis", "empty_lines", "last_lines", "double_blanks")
TOLD = ("colon_attribute", "semicolon_attribute", "parenthesis")


def clean(x: Column, name: str) -> Column:
    return F.regexp_replace(x, *CLEANERS[name])


def clean_description(x: Column) -> Column:
    """The struct text, changed: a description after its cleaners, and whether one of those in TOLD found something."""
    s, changed = blank(x), F.lit(False)
    for name in DESCRIPTION:
        if name in TOLD:
            changed = changed | s.rlike(CLEANERS[name][0])
        s = clean(s, name)
    return F.struct(s.alias("text"), changed.alias("changed"))


def percent(x: Column) -> Column:
    """A share as whole percent, as the page shows it."""
    return F.concat(F.round(100 * x).cast("int").cast("string"), F.lit("%"))


def decimals(x: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", x)


def script_json(x: Column) -> Column:
    """JSON text that may stand in a script element."""
    return F.replace(x, F.lit("</"), F.lit("<\\/"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a unit separator but the last, closed by a record separator."""
    return F.sha2(F.concat(F.concat_ws("\x1f", *parts), F.lit("\x1e")), 256)


def safe_id(x: Column) -> Column:
    return F.translate(x, "/ ", "__")


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(blank(x), r"\s+"), lambda v: v != ""))


def html_to_text(x: Column) -> Column:
    """Markup of a page to blanks: scripts, styles and comments with contents, then tags."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", " "), r"[ \t\n\r\f]+", " "))
