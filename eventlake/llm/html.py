"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line's length counts the text that is neither in a link
nor in a part of the page that is boilerplate by its element or by its class, id or role. Lengths are summed over sliding
windows of lines. A stretch of windows above the dive threshold is text if one of them reaches the surge threshold, and
its lines are kept; of several such stretches those of any real weight beside the largest are kept. Where article and main
elements hold most of the page's text, their lines weigh more and their links count; text outside still counts, and
elsewhere these elements mean nothing. Lines of length 0 between surge and dive are no text and go, but for paragraphs that
are links as a whole. A name of several words is boilerplate only where all its words are, or mean nothing of their own, and
never above the only article of a page; the header of an article belongs to it.

Defined results: a null or empty html has an empty text; broken, unclosed or cut off markup is read as far as it goes;
null ids and repeated rows are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Elements of the HTML standard by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template textarea title select option svg math iframe object canvas audio video map datalist head".split())
ASIDE = frozenset("nav header footer aside form menu dialog button search".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_BREAKS = frozenset("br td th".split())
WHOLE = frozenset("html body article main".split())
#: Words of class, id, role and aria-label that mark boilerplate.
BOILERPLATE = frozenset("ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promoted promotion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright legal disclaimer skip feedback rating reviews hidden complementary contentinfo search dialog outbrain taboola".split())
WINDOW = 3
#: Characters in a window that begin a stretch, or this part of the page's largest window where that is less; and the part of them under which it ends.
SURGE, SURGE_PART, DIVE_PART = 86, 0.5, 0.125
#: Weight of a character in an article or main element that holds most of the text.
MARKED = 10
#: A stretch is kept if its weight is this part of the largest one's length.
SHARE = 0.1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*+)(?:>|\Z)", re.S)
_MARK = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words that stand beside those without a meaning of their own.
NEUTRAL = frozenset("site page main top bottom left right side global primary secondary block box list item items area section wrapper wrap container inner outer slot unit bar links link buttons button icons icon group panel post posts article articles entry form text title content header head by more see also the to of and for wp js app ui col row grid desktop mobile sticky fixed small large default".split())


def marked(attributes: str) -> bool:
    """Whether an element's attributes say that it isn't main text: a name all of whose words are of boilerplate or neutral."""
    for name, a, b, c in _MARK.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            continue
        for token in value.split():
            words = {w.lower() for w in _WORD.findall(token)}
            if words & BOILERPLATE and words <= BOILERPLATE | NEUTRAL:
                return True
    return False


def lines(html: str) -> tuple[list[str], list[int], list[int], list[bool], list[bool]]:
    """The page's lines: text, length, length with the links of article and main elements, whether it stands in one, and
    whether it is a paragraph of nothing but links."""
    text, length, whole, inside, links = [], [], [], [], []
    words: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, boilerplate from here, article from here, named before
    opened: Counter = Counter()
    good, more, linked, quiet, named, core, block = 0, 0, 0, 0, 0, 0, ""  # quiet: by element, named: by class, id or role
    small = html.lower()
    alone = small.count("<article") <= 1 and small.count("<main") <= 1  # else articles may be teasers

    def close() -> None:
        nonlocal good, more
        joined = " ".join(unescape("".join(words)).split()) if words else ""
        if joined:
            text.append(joined)
            length.append(len(joined) if good else 0)
            whole.append(len(joined) if good or more else 0)
            inside.append(core > 0)
            links.append(block == "p" and not good)
        words.clear()
        good = more = 0

    def say(piece: str) -> None:
        nonlocal good, more
        if piece:
            if quiet or named:
                return
            words.append(piece)
            if not piece.isspace():
                if not linked:
                    good += len(piece.strip())
                elif core:
                    more += len(piece.strip())

    def leave(element: str) -> None:
        nonlocal quiet, named, core, linked
        if not opened[element]:
            return
        while stack:
            name, silent, article, before = stack.pop()
            opened[name] -= 1
            quiet -= silent
            core -= article
            linked -= name == "a"
            named = before
            if name == element:
                break

    at, n = 0, len(html)
    for m in iter(lambda: _TOKEN.search(html, at), None):
        say(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                close()
                block = ""
            leave(name)
            continue
        if name in BLOCKS or name in SILENT:
            close()
            block = name
        elif name in INLINE_BREAKS:
            say(" ")
        if name == "p" or name in BLOCKS and name[0] == "h" and name[1:].isdigit():
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "u", "span", "font", "small", "a") and opened["p"]:
                leave(stack[-1][0])
        elif name == "li" and any(s[0] == "li" for s in stack[-3:]):
            leave("li")
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name not in VOID and not m[3].endswith("/"):
            article = name in ("article", "main")
            core += article
            before, silent = named, name in SILENT or name in ASIDE and not (name == "header" and opened["article"] + opened["main"])
            if article and alone:
                named = 0  # no name above the page's article makes it boilerplate
            elif not silent and name not in WHOLE and marked(m[3]):
                named += 1
            quiet += silent
            linked += name == "a"
            opened[name] += 1
            stack.append((name, silent, article, before))
    say(html[at:])
    close()
    return text, length, whole, inside, links


def stretches(weight: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, end) of the stretches of windows above the dive threshold that reach the surge threshold, without the
    lines of length 0 at their ends."""
    if not weight.any():
        return []
    sums = np.convolve(weight, np.ones(window, np.int64))  # sums[i]: the window whose last line is i
    surge = min(SURGE, SURGE_PART * sums.max())
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (sums > DIVE_PART * surge).astype(np.int8), [0]])))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if sums[a:b].max() >= surge:
            first = max(0, a - window + 1, out[-1][1] if out else 0)  # lines between two stretches are the earlier one's
            full = np.flatnonzero(weight[first:b]) + first
            if len(full):
                out.append((int(full[0]), int(full[-1]) + 1))
    return out


def main_text(html: str | None, window: int = WINDOW, share: float = SHARE) -> str:
    if not html:
        return ""
    text, *columns = lines(html)
    length, whole, inside, links = (np.array(c, np.int64) for c in columns)
    plain = length if length.any() else whole
    weight = length
    if 2 * (plain * inside).sum() > plain.sum():
        length = whole
        weight = length * np.where(inside, MARKED, 1)
    found = stretches(weight, window)
    most = max((length[a:b].sum() for a, b in found), default=0)
    return "\n".join(text[i] for a, b in found if weight[a:b].sum() >= share * most for i in range(a, b) if length[i] or links[i])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(h) for h in batch["html"].to_pylist()]
        return pa.record_batch([batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_texts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), one, "page_id long, url string, text string, n_chars long", "html")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
