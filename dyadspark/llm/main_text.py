"""The main text of web pages by two passes over their blocks.

Pass one decides what it can from a block's share of links, its length and its density of stop
words; where a page is in a language without a list, sentence ends stand for stop words. What
elements and classes say is one more signal: menus, adverts, comments and the like are boilerplate
whatever they hold; in an article nothing is boilerplate for a lack of stop words. Short or
ambiguous blocks are left open, and in pass two take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is never page text.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "canvas", "math", "noembed", "noframes", "xmp"}
DROPPED = RAW | {"head", "select", "button", "datalist", "option"}
#: Elements of boilerplate, whatever they hold; then one that is so unless it holds the page's text.
FRAME = {"nav", "header", "footer", "aside", "menu", "dialog", "fieldset"}
WRAPPER = {"form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id or role that mark boilerplate, whatever it holds.
_HARD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|breadcrumbs?|cookies?|consent|gdpr|popup|comments?|commentlist|respond|replies|disqus|related|newsletter|subscribe|signup|login|pagination|pager|contentinfo|complementary|navigation)(?=$|[\s_-])",
    re.I,
)
#: Words that mark it, unless the element holds the page's text or, within an article, prose.
_SOFT = re.compile(
    r"(?:^|[\s_-])(?:promo\w*|banner|nav\w*|menu\w*|header|masthead|footer|foot|sidebar\w*|aside|widget\w*|notices?|alerts?|modal|overlay|reviews?|recommend\w*|copyright|legal|disclaimer|toolbar|dialog)(?=$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|disqus)(?=$|[\s_-])", re.I)
#: Words that mark boilerplate at the end of a class word or before these others; before any other, they say what a text is about.
_TOPIC_HINT = re.compile(
    r"(?:^|[\s_-])(?:(?:share|sharing|social|search|tags?)(?:[_-]+(?:links?|lists?|clouds?|box|bar|buttons?|btns?|icons?|form|field|input|wrap|wrapper|container|area|block|section|panel|toggle|share|sharing|follow|counts?|counter|tools|items?|group|row|labels?|titles?|media|networks?)){0,3}|"
    r"social(?:links?|media|icons?|bar|share|sharing|buttons?)|search(?:box|form|bar|field|input|wrap))$",
    re.I,
)
#: A class word that names a text's category or tag, unless it ends in what an element is.
_TOPIC = re.compile(r"(?:category|tag)-(?!(?:.*[_-])?(?:nav|navigation|menu|sidebar|widget|breadcrumbs?|banner|header|footer)$)", re.I)
#: Such a word of a class says what a page has, not what the element is.
_ABOUT = re.compile(r"(?:has|no|with|without|is|layout)[-_]", re.I)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A tag whose quotes don't pair up ends at the next bracket. Nothing is tried twice, so that broken pages take linear time.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|[^>]*+(?:>|\Z))""", re.S)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\u2026\u061f\u06d4\u0964](?:\s|$|[\"'\u201d\u00bb)])|[\u3002\uff01\uff1f]")
#: Scripts written without spaces, in which a sign says about as much as a few letters.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
#: Frequent function words of ten languages.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be this by from or at an not have has which a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des et en un une du que qui dans est pour pas au sur par plus ne se ce avec son il "
    "el los las y del que en un una por con para se es al lo como su no más o "
    "di che è il per non sono della gli alla dei nel "
    "do da os não uma com em dos ao mais foi "
    "het een van op te dat zijn voor niet aan "
    "och att som på av med till inte om ett "
    "w na i nie się jest że z przez "
    "и в на не что с по как это из он".split()
)
#: A page's language is one of these if so many of its words are such.
LISTED = 0.1


def hinted(value: str, in_article: bool) -> int:
    """What a class, id or role marks: 2 boilerplate, 1 boilerplate unless it holds the page's text, 0 nothing. Within an article, a header is the article's own."""
    worst = 0
    for word in value.split():
        if _ABOUT.match(word):
            continue
        if _TOPIC.match(word):
            worst = max(worst, int(bool(_TOPIC_HINT.match(word))))
        elif _HARD.search(word):
            return 2
        elif found := _TOPIC_HINT.search(word) or _SOFT.search(word):
            if not (in_article and "header" in found[0].lower()):
                worst = 1
    return worst


@dataclass
class Block:
    """text; linked: its characters in links; framed: 0 no, 1 by a word within an article that may hold prose, 2 surely boilerplate."""

    text: str
    linked: int
    framed: int = 0
    in_article: bool = False
    heading: bool = False
    wrapper: int = 0


def blocks(html: str) -> list[Block]:
    """The blocks of a page in its order, whitespace already folded; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, bool, bool, int]]] = []
    framed, article, dropped, wrapper, heading = 0, False, False, 0, False
    parents = [0]  # of each wrapper, an element that is boilerplate unless it holds the page's text
    depth_link, parts, linked = 0, [], 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, min(linked, len(text)), framed, article, heading, wrapper))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if depth_link:
                linked += len(_SPACE.sub(" ", text).strip())

    at, end = 0, len(html)
    while at < end:
        match = _TAG.search(html, at)
        if not match:
            add(html[at:])
            break
        add(html[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if name in BLOCK:
                flush()
            if name == "a":
                depth_link = max(0, depth_link - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    framed, article, dropped, wrapper = stack[k][1]
                    del stack[k:]
                    heading = any(s[0] in HEADINGS for s in stack[-3:])
                    break
                if stack[k][0] in BLOCK and name not in BLOCK:
                    break
            continue
        if name == "br":
            add("\n")
            continue
        if name in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                framed, article, dropped, wrapper = stack.pop()[1]
            depth_link = 0
        attributes = match[3] or ""
        closed = name in VOID or attributes.rstrip().endswith("/")
        if name in RAW and not closed:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if closed:
            continue
        if name == "a":
            depth_link += 1
        if name in BLOCK or name in DROPPED or name in FRAME or attributes:
            stack.append((name, (framed, article, dropped, wrapper)))
            if name in DROPPED:
                dropped = True
            hint = 2 if name in FRAME and not (name == "header" and article) else int(name in WRAPPER)
            if attributes and name not in {"html", "body", "a"} and not dropped:
                for key, *values in _ATTR.findall(attributes):
                    value, key = "".join(values), key.lower()
                    if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                        dropped = True
                    elif key in {"class", "id", "role"}:
                        hint = max(hint, hinted(value, article) if name not in ARTICLE else 2 * bool(_COMMENT.search(value)))
            if hint == 2 or hint == 1 and article:
                framed = max(framed, 2 if name in WRAPPER else hint)
            elif hint:
                parents.append(wrapper)
                wrapper = len(parents) - 1
            if name in ARTICLE and framed < 2:
                article = True
            heading = name in HEADINGS
    flush()
    return _frame_wrapped(out, parents)


def _frame_wrapped(found: list[Block], parents: list[int]) -> list[Block]:
    """Wrappers frame their blocks, but for those that hold most of the page's text (of its articles' text, if it has any)."""
    if len(parents) > 1:
        counted = [b for b in found if b.framed < 2 and 2 * b.linked <= len(b.text)]
        counted = [b for b in counted if b.in_article] or counted
        inside = [0] * len(parents)
        for b in counted:
            inside[b.wrapper] += len(b.text)
        total = sum(inside)
        for w in range(len(parents) - 1, 0, -1):
            inside[parents[w]] += inside[w]
        frames = [False] * len(parents)
        for w in range(1, len(parents)):
            frames[w] = frames[parents[w]] or 2 * inside[w] <= total
        for b in found:
            if frames[b.wrapper]:
                b.framed = 2
    return found


def stop_density(text: str) -> tuple[int, int]:
    """Stop words, and all words of a text."""
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(found: list[Block], short: int = 70, long: int = 200, stop_low: float = 0.15, stop_high: float = 0.3, link_share: float = 0.5) -> list[tuple[bool | None, str]]:
    """A label (True for text, False for boilerplate, None for open) and the rule that gave it, block by block."""
    free = [b.framed < 2 and b.linked <= link_share * len(b.text) for b in found]
    counts = [stop_density(b.text) if b.framed < 2 else (0, 0) for b in found]
    stops, words = (sum(c[k] for c, own in zip(counts, free, strict=True) if own) for k in (0, 1))
    listed = stops >= LISTED * max(1, words)
    own = sum(len(b.text) for b, good in zip(found, free, strict=True) if good and b.in_article)
    # a page whose article holds most of its text has no text elsewhere
    only_article = 2 * own > sum(len(b.text) for b, good in zip(found, free, strict=True) if good)
    labels: list[tuple[bool | None, str]] = []
    for b, good, (n_stop, n_words) in zip(found, free, counts, strict=True):
        length, density = len(b.text), n_stop / max(1, n_words)
        dense = listed and (density >= stop_high or (length >= long and density >= stop_low))
        sentence = not listed and length + 2 * len(_DENSE.findall(b.text)) >= short and bool(_SENTENCE.search(b.text))
        if b.linked > 0.9 * length:
            labels.append((False, "links"))
        elif b.framed == 2:
            labels.append((False, "tag"))
        elif not good and not (b.in_article and length >= short and density >= stop_low):
            labels.append((False, "links"))
        elif b.heading:
            labels.append((None, "heading"))
        elif only_article and not b.in_article:
            labels.append((False, "tag"))
        elif sentence and good:
            labels.append((True, "length"))
        elif length < short:
            outside = not b.in_article and (b.linked or "\u00a9" in b.text)
            labels.append((False, "links" if b.linked else "length") if outside else (False, "tag") if b.framed else (None, "short"))
        elif dense and good:
            labels.append((True, "density"))
        elif b.framed:
            labels.append((False, "tag"))
        elif listed and density < stop_low and b.linked and not b.in_article:
            labels.append((False, "density"))
        else:
            labels.append((None, "ambiguous"))
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label that the nearest decided blocks on both sides agree on.

    Where they differ, the nearer one counts, and at equal distance text does; headings look at what
    follows them. Blocks of an article look at those of articles only, and are text if none is
    decided. Where no block of the page is text by pass one, the open ones are, if any but headings.
    """
    if True not in labels:
        some = any(label is None and not b.heading for b, label in zip(found, labels, strict=True))
        return [label is None and some for label in labels]
    n = len(labels)
    before: list[list[tuple[int, bool] | None]] = [[], []]
    last: list[tuple[int, bool] | None] = [None, None]
    for k, label in enumerate(labels):
        for side in (0, 1) if found[k].in_article else (0,):
            last[side] = (k, label) if label is not None else last[side]
        before[0].append(last[0])
        before[1].append(last[1])
    out = [False] * n
    after: list[tuple[int, bool] | None] = [None, None]
    for k in range(n - 1, -1, -1):
        label = labels[k]
        if label is not None:
            out[k] = label
            after[0] = (k, label)
            if found[k].in_article:
                after[1] = (k, label)
            continue
        side = int(found[k].in_article)
        prior, then = before[side][k], after[side]
        if found[k].heading and then:
            out[k] = then[1]
        elif prior and then and prior[1] != then[1]:
            out[k] = prior[1] if k - prior[0] < then[0] - k else then[1] if k - prior[0] > then[0] - k else True
        elif prior or then:
            out[k] = (prior or then)[1]
        else:
            out[k] = bool(side)
    return out


def main_text(html: str | None) -> str:
    """The blocks of text, joined by line ends; empty for null."""
    found = blocks(html or "")
    labels = [label for label, _ in first_pass(found)]
    return "\n".join(b.text for b, good in zip(found, second_pass(found, labels), strict=True) if good)


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, text and n_chars (code points), one row per row.

    Null and empty pages, and those without text, give an empty text; an empty table gives no rows.
    Pages are read whole, in time linear in their length; rows that repeat a page_id or a whole page
    are told apart by nothing and each give a row. Columns that are not in keep are ignored, also if
    they are named as the result's are.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    chosen = pages.select(F.col(html_col).cast("string").alias("__html"), *keep)
    return chosen.mapInArrow(rows, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
