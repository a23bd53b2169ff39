"""Main text of web pages as the best-scoring contiguous region.

A page is cut into tags and words. Elements that never hold content (menus, forms, footers, scripts, comments and the
like, told by their name, by words of their class, id or role, or as lists of links) are taken out first, so that they
neither end a region nor extend it. Of what is left each word adds a positive weight, each tag a negative one; the weights
come from labelled pages (:func:`fit_weights`). One linear scan (Kadane) finds the contiguous region of the largest sum.

Defined results: null or empty html, or no region of positive sum: empty text. Of regions with equal sums the first,
and of those the longest, is taken. Malformed markup (unclosed elements or quotes) is read as far as it goes; an
unclosed script, style or comment runs to the end of the page. Pages are independent: repeated rows each give their
row, other columns are ignored, an empty table gives none; time is linear in a page's length.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from specloom.llm.common import with_columns_of

# Elements whose contents are never words.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "head", "select", "button", "object", "canvas"}
# Elements that hold no main text.
BOILERPLATE = {"nav", "footer", "header", "aside", "form", "menu", "dialog"} | RAW
# Words of class, id or role that mark such elements.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "banner", "promo", "sponsor", "sponsored", "sidebar", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus", "replies", "cookie", "cookies", "consent", "notice",
    "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "login", "complementary", "contentinfo", "search",
}
# Words that say where or what a part of a page is, and nothing of what it holds.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "col", "column", "container", "content", "css", "element", "first", "fixed", "floating", "global", "group", "holder", "id", "inline", "inner", "is",
    "item", "items", "js", "last", "left", "link", "links", "list", "local", "main", "mobile", "module", "outer", "overlay", "page", "panel", "post", "posts", "primary", "region", "right", "row", "secondary", "section",
    "site", "slot", "sticky", "thread", "top", "unit", "user", "view", "wrap", "wrapper", "zone",
}
# Marks that stay so beside words of articles; with others such a word means a part of the article itself.
STRONG = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "promo", "sponsor", "sponsored", "sidebar", "breadcrumb", "breadcrumbs", "comment", "comments", "discussion", "responses", "disqus", "replies",
    "cookie", "cookies", "consent", "gdpr", "privacy", "popup", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended",
}
BESIDE_STRONG = {"article", "articles", "story", "stories", "reader", "readers", "google", "leaderboard", "policy", "trail", "buttons", "media", "form", "news"}
# A list with so many links at least, most of its words in links, and these short, is a menu.
LIST_LINKS, LINK_SHARE, LINK_WORDS = 4, 0.9, 8
LISTS = ("ul", "ol", "dl")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
# Elements around main text; their tags are weights like all others.
LANDMARKS = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_SIZE = re.compile(r"[0-9]+x[0-9]+")


def marks(value: str) -> bool:
    """Whether a name in an attribute says that its element is boilerplate: it has a word that does, and none of its own."""
    for name in value.lower().split():
        words = _NAME.findall(_SIZE.sub("", name))
        if words == ["sign", "up"] or words == ["log", "in"]:
            return True
        known = MARKS | STRONG
        beside = NEUTRAL | BESIDE_STRONG if not STRONG.isdisjoint(words) else NEUTRAL
        if not known.isdisjoint(words) and all(w in known or w in beside for w in words):
            return True
    return False


def pieces(page: str) -> list[tuple[str, str, bool]]:
    """Tokens of a page in order: (tag key or '', text, inside boilerplate). Tag keys are names, closing ones with '/'."""
    return without_menus(tokens(page))


def without_menus(out: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """Tokens with those of lists that are little but links marked as boilerplate."""
    open_: list[list[int]] = []  # of each open list: its token, words, words in links, links
    lists: list[tuple[int, int]] = []
    in_link = False
    for i, (tag, chunk, bad) in enumerate(out):
        if tag in LISTS:
            open_.append([i, 0, 0, 0])
        elif tag == "a" and not bad:
            in_link = True
            if open_:
                open_[-1][3] += 1
        elif tag == "/a":
            in_link = False
        elif not tag and open_ and not bad:
            n = len(chunk.split())
            open_[-1][1] += n
            open_[-1][2] += n * in_link
        elif tag[:1] == "/" and tag[1:] in LISTS and open_:
            start, words, linked, links = open_.pop()
            if links >= LIST_LINKS and linked >= LINK_SHARE * words and linked <= LINK_WORDS * links:
                lists.append((start, i))
            elif open_:
                for k, v in enumerate((words, linked, links), 1):
                    open_[-1][k] += v
    if not lists:
        return out
    out = list(out)
    done = -1
    for start, end in sorted(lists):  # of lists inside one another the outer one comes first
        for i in range(max(start, done + 1), end + 1):
            out[i] = (*out[i][:2], True)
        done = max(done, end)
    return out


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """Tokens of a page in order, boilerplate told by elements and names."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, bool]] = []
    open_: Counter[str] = Counter()
    at, end, low = 0, len(page), None
    bad = False
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            out.append(("", page[at:], bad))
            break
        if m.start() > at:
            out.append(("", page[at : m.start()], bad))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            out.append((f"/{name}", "", bad))
            # elements left open in it end with it; a closing tag of none that is open says nothing
            while open_[name]:
                last, _ = stack.pop()
                open_[last] -= 1
                bad = stack[-1][1] if stack else False
                if last == name:
                    break
            continue
        attributes = m[3] or m[6] or ""
        marked = name in BOILERPLATE
        if not marked and attributes and name not in ("body", "html", *LANDMARKS):
            for x in _ATTRIBUTE.finditer(attributes):
                marked = marked or marks(x[1] or x[2] or x[3] or "")
        # A heading block of an article is content, not the page's header.
        if name == "header" and any(open_[x] for x in LANDMARKS):
            marked = False
        out.append((name, "", bad))
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
            low = page.lower() if low is None else low
            if len(low) != end:
                low = "".join(c.lower() if c.isascii() else c for c in page)
            k = low.find(f"</{name}", at)
            at = end if k < 0 else k
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            open_["p"] -= 1
        stack.append((name, marked or bad))
        open_[name] += 1
        bad = marked or bad
    return out


def fit_weights(labelled: list[tuple[str, str]], smooth: float = 0.5) -> dict[str, float]:
    """Weights from pages with their main texts.

    A tag's weight is its smoothed log odds of standing inside the main region, held negative: at least -0.05 for tags
    seen inside (so that they never outweigh a word) and at most -25 for tags seen only outside. Words get their log odds
    in the same way, held positive. What boilerplate elements hold is not counted.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page, text in labelled:
        read = pieces(page)
        want = text.split()
        first = last = None
        for i, (tag, chunk, bad) in enumerate(read):
            words = html_lib.unescape(chunk).split() if not tag else []
            if words and not bad and all(w in want for w in words):
                first = max(0, i - 1) if first is None else first  # with the tag that opens its block
                last = i
        for i, (tag, chunk, bad) in enumerate(read):
            if bad and not tag:
                continue
            where = inside if first is not None and first <= i <= last else outside
            if tag:
                where[tag] += 1
            else:
                where["#word"] += len(chunk.split())
    odds = {k: math.log((inside[k] + smooth) / (outside[k] + smooth)) for k in {*inside, *outside}}
    weights = {k: max(-0.05, min(-0.01, v)) if inside[k] else max(-25.0, min(-5.0, 10 * v)) for k, v in odds.items() if k[0] != "#"}
    weights["#word"] = max(1.0, odds.get("#word", 1.0))
    return weights


#: Labelled pages: (html, main text). Written for this module.
LABELLED = [
    (
        "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=ad>buy now</div>"
        "<article><h1>Rain</h1><p>It <b>rained</b> all<br>day.</p><ul><li>one</li></ul><p>It <i>stopped</i> <a href=y>later</a>.</p></article>"
        "<footer>about us</footer></body></html>",
        "Rain It rained all day. one It stopped later .",
    ),
    (
        "<html><body><header><a href=/>Site</a></header><main><h1>Bread</h1><h2>How</h2><p>Mix <em>well</em> and <strong>rest</strong>.</p>"
        "<blockquote><p>Old words</p></blockquote><table><tr><td>flour</td><td>salt</td></tr></table><p>Bake.</p></main>"
        "<aside>more</aside><div id=comments><p>nice</p></div><form><input name=q></form></body></html>",
        "Bread How Mix well and rest . Old words flour salt Bake.",
    ),
    (
        "<html><body><div class=menu><a href=1>a</a></div><div><h2>Sea</h2><p>Cold <span>water</span>.</p><div><p>Deep.</p></div><pre>x</pre><ol><li>two</li></ol>last</div>"
        "<div class=cookie-notice>ok</div></body></html>",
        "Sea Cold water . Deep. x two last",
    ),
]
WEIGHTS = fit_weights(LABELLED)
#: Tags that no labelled page shows.
UNSEEN_TAG = -0.05


def scores(read: list[tuple[str, str, bool]], weights: dict[str, float] = WEIGHTS) -> list[float]:
    """What each token adds to a region: nothing inside boilerplate."""
    word = weights["#word"]
    return [0.0 if bad else weights.get(tag, UNSEEN_TAG) if tag else word * len(chunk.split()) for tag, chunk, bad in read]


def best_region(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region of the largest sum, the first of equals; (0, 0) if none is positive."""
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, v in enumerate(values):
        total += v
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best[0]:
            best = (total, start, i + 1)
    return best[1:]


def extract(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    if not page:
        return ""
    read = pieces(page)
    start, end = best_region(scores(read, weights))
    parts: list[str] = []
    for tag, chunk, bad in read[start:end]:
        if tag:
            if tag.lstrip("/") not in INLINE:
                parts.append(" ")
        elif not bad:
            parts.append(html_lib.unescape(chunk))
    return " ".join("".join(parts).split())


def extract_pages(pages: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = with_columns_of(pages, "page_id", "url", "html")
    ids = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {ids}, url string, text string, n_chars bigint")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
