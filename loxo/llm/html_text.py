"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path
(``body/article/p``; class and id words are part of a label, so
``div.sidebar`` and ``div.story`` are different paths).  Per path the page's
text length, punctuation, link text and number of blocks are added up; two
features, text per block and punctuation per block, are discounted by the
share of link text, smoothed along the order in which the paths' blocks occur
(a path is averaged with its neighbours), fused by their product, and paths
above a share of the page's mean are content.

Labels bound the choice.  Blocks under labels that name something other than
the article (nav, header, footer, aside, form, script, "advert", "cookie",
"comments", ...) take no part.  Where a page marks an article (article, main,
or such a class or role) and most of the chosen text lies in it, the article's
blocks are the content, short or long, as a heading or a one-word paragraph
belongs to it, and others aren't.  Else headings go with the content they
precede.

Defined cases: null html is empty; pages without text give an empty text;
unclosed tags, stray ends, broken entities and truncated pages are read as
browsers do; whole pages are read, whatever their length; repeated rows are
treated one by one; columns pass through, except that result columns replace
those of their name.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul head".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content isn't text of the page.
HIDDEN = frozenset("script style noscript template iframe object svg canvas math audio video select option datalist head title textarea".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
ASIDE = frozenset("nav header footer aside form menu button dialog fieldset label legend input".split())
#: Words of class, id or role that name something other than the article.
NAMED = re.compile(
    r"(?:^|[\W_])(?:ad|ads|advert\w*|banner|breadcrumbs?|byline-ads|comments?|comment-?list|cookies?|consent|copyright|disqus|footer|gdpr|header|hidden|login|masthead|menu|modal|nav\w*|newsletter|notice|notices|"
    r"overlay|pagination|pager|popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|site-?footer|site-?header|skip|social|sponsor\w*|subscribe|subscription|teaser|toolbar|topbar|widget)(?:$|[\W_])"
)
ARTICLE = frozenset({"article", "main"})
ARTICLE_NAMED = re.compile(r"(?:^|[\W_])(?:article(?:-?body)?|post-?(?:body|content)?|entry(?:-?content)?|story(?:-?body)?|main-?content)(?:$|[\W_])")
#: A tag of one of the first names ends an open one of the second set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u span sub sup mark abbr cite q".split())
#: Tags that leave an open head open; any other start tag, and text, ends it.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: Tags that end an open svg or math; inside the second set they don't.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN, HTML_WITHIN = frozenset({"svg", "math"}), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Tags that end an open select, and those that end one within a table.
ENDS_SELECT, TABLE = frozenset({"select", "input", "textarea"}), frozenset("caption table tbody td tfoot th thead tr".split())
STAY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:![^>]*|\?[^>]*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、]")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: str
    text: str
    linked: int
    aside: bool
    article: bool
    heading: bool


def _label(name: str, attrs: str) -> tuple[str, bool, bool]:
    """The tag's label, whether it names something aside, and whether it marks the article."""
    words, aside, article = [], name in ASIDE, name in ARTICLE
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                words.append(value)
                if name not in ("body", "html"):
                    aside |= bool(NAMED.search(value)) or (key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"))
                    article |= bool(ARTICLE_NAMED.search(value)) or (key == "role" and value in ("article", "main"))
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                aside = True
    return (name + "." + " ".join(words) if words else name), aside, article and not aside


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order."""
    stack: list[tuple[str, str, bool, bool]] = []  # name, label, aside, article
    out: list[Block] = []
    pieces: list[str] = []
    linked = hidden = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(map(html.unescape, pieces))).strip()
            pieces.clear()
            if text:
                names = [s[0] for s in stack]
                out.append(Block("/".join(s[1] for s in stack if s[0] not in FORMATS), text, min(linked, len(text)), any(s[2] for s in stack), any(s[3] for s in stack), bool(HEADINGS.intersection(names))))
        linked = 0

    def close(upto: int) -> None:
        nonlocal hidden
        if any(s[0] in BLOCK for s in stack[upto:]):
            flush()
        hidden -= sum(s[0] in HIDDEN for s in stack[upto:])
        del stack[upto:]

    def close_open(names: frozenset[str], unless: frozenset[str]) -> None:
        """Closes the outermost open element of names that has none of unless within it."""
        at = len(stack)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in unless:
                break
            if stack[i][0] in names:
                at = i
        if at < len(stack):
            close(at)

    def leave_head() -> None:
        close_open(frozenset({"head"}), frozenset({"template"}))

    def text(t: str) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and t.strip(" \t\n\f\r"):
            leave_head()
        if t and not hidden:
            pieces.append(t)
            if any(s[0] == "a" for s in stack):
                linked += len(t)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in ("body", "html", "br"):
                leave_head()
            if name == "p" and not any(s[0] == "p" for s in stack):
                flush()
            elif name == "br":
                text(" ")
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if name in FORMATS and stack[i][0] in BLOCK:
                        break
            continue
        if hidden:
            if name not in IN_HEAD:
                leave_head()
            if name in ENDS_FOREIGN:
                close_open(FOREIGN, HTML_WITHIN)
            if name in ENDS_SELECT or name in TABLE and any(s[0] == "table" for s in stack):
                close_open(frozenset({"select"}), frozenset({"template", "table"}))
        if name == "br":
            text(" ")
            continue
        if name in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDS[name]:
                    close(i)
                    break
                if stack[i][0] in STAY.get(name, ()):
                    break
        if name in BLOCK:
            flush()
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW and name not in FORMATS:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(page, at)
            at = end.start() if end else n
            if name in HIDDEN:
                stop = page.find(">", at)
                at = n if stop < 0 else stop + 1
                continue
        label, aside, article = _label(name, m[3])
        stack.append((name, label, aside, article))
        hidden += name in HIDDEN
    flush()
    return out


def content_paths(blocks: list[Block], share: float = 0.5) -> set[str]:
    """Paths whose smoothed, fused ratios exceed ``share`` of the page's mean, weighted by text."""
    order: dict[str, list[float]] = {}
    for b in blocks:
        t = order.setdefault(b.path, [0, 0, 0, 0])
        t[0] += len(b.text)
        t[1] += len(_MARKS.findall(b.text))
        t[2] += b.linked
        t[3] += 1
    paths = list(order)
    if not paths:
        return set()
    rows = [order[p] for p in paths]
    plain = [1 - link / length for length, _, link, _ in rows]
    ratios = [(length / n * q, (marks + 0.5) / n * q) for (length, marks, _, n), q in zip(rows, plain, strict=True)]

    def smooth(x: list[float]) -> list[float]:
        return [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, len(x) - 1)]) / 4 for i in range(len(x))]

    alone = [(a * b) ** 0.5 for a, b in ratios]
    fused = [(a * b) ** 0.5 for a, b in zip(smooth([r[0] for r in ratios]), smooth([r[1] for r in ratios]), strict=True)]
    weight = sum(r[0] for r in rows)
    mean = sum(f * r[0] for f, r in zip(fused, rows, strict=True)) / weight
    return {p for p, f, a, q in zip(paths, fused, alone, plain, strict=True) if f > share * mean and a > 0.6 * share * mean and q > 0.5}


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by line feeds."""
    own = [b for b in blocks_of(page or "") if not b.aside]
    paths = content_paths(own)
    keep = [b.path in paths for b in own]
    for i in range(len(own) - 2, -1, -1):
        keep[i] = keep[i] or (own[i].heading and keep[i + 1])
    # An article that holds most of what the ratios chose bounds it, and all of it is content.
    chosen = sum(len(b.text) for b, k in zip(own, keep, strict=True) if k)
    if 2 * sum(len(b.text) for b, k in zip(own, keep, strict=True) if k and b.article) >= max(chosen, 1):
        keep = [b.article for b in own]
    return "\n".join(b.text for b, k in zip(own, keep, strict=True) if k)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text (string) and n_chars (long); one pass, no exchange."""

    @F.pandas_udf("string")
    def texts(series: pd.Series) -> pd.Series:
        return series.map(main_text)

    df = pages.drop(*[c for c in pages.columns if c.lower() in {"text", "n_chars"} - {column.lower()}])
    return df.withColumn("text", texts(F.coalesce(F.col(f"`{column}`"), F.lit("")))).withColumn("n_chars", F.length("text").cast("long"))
