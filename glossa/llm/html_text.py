"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; what stands in menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
(by element, role, class or id) leaves an empty line.  Text lengths are summed over
sliding windows of BLOCK lines; text surges where a sum passes the threshold and dives
where it falls to zero, and the lines between are kept, with the unlinked short lines
that adjoin a surge from above.  Where no sum of a page passes it, its fullest place surges.

An article or main element is a certain prior for its own lines, each element by itself: what stands in it
and is not marked is kept, linked or not, and windows do not run over its edges; on the lines outside it the
windows decide as on a page without one, but for the fullest place.  Inside it a header is the article's
own, and an id only marks reader comments; an id never marks a heading.  In a part that is left
out an element is no prior: not among reader comments, and not where that part is closed further on; where it
is not closed (or is a form, which may stand around a whole page), the article or main ends it.

A class or id marks a part only if all its words are such marks or plain words of layout:
'cookie-banner' and 'sidebar-left' do, 'social-science' and 'with-sidebar' do not.

Defined results: a null or empty page, and one without main text, give an empty text;
a page cut off anywhere is read as far as it goes (an unfinished tag is dropped); a page
of any length or depth is read whole, in time linear in both; repeated rows are extracted
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .textkit import pieces

BLOCK, SURGE, LINKED = 3, 80, 0.6

_TAG = re.compile(r"""<(?:!--(?P<comment>)|[!?][^>]*>|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>)""")
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*)>")
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe svg math object".split())
_DROPPED = set("head nav header footer aside form menu dialog button select option datalist fieldset label noscript canvas audio video".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of class names and ids that mark what is not the article, and reader comments.
_HINTS = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars side aside menu menus nav navbar navigation navi breadcrumb breadcrumbs footer footnav header masthead topbar
share sharing social related recommended teaser teasers widget widgets toolbar search login pagination pager skip disclaimer""".split())
_COMMENTS = set("comment comments commentlist disqus reply replies respond".split())
#: Words that may stand beside them without changing what they mark.
_LAYOUT = set("""area article bar bars block blocks blog body bottom box boxes button buttons col column container content cont entry fixed float footer global group holder icons inner item items
left links list lists main middle mobile module outer page pane panel post posts primary reader region right row secondary section site slot sticky text thread top unit user wrap wrapper zone""".split())
#: Elements whose end tag is taken at its word; others only where their page has as many end tags as start tags.
_CLOSING = ("aside", "nav", "footer", "header", "section")
_MARKS = re.compile(rf"""<!--.*?(?:-->|\Z)|<({"|".join(sorted(_RAW))})(?=[\s/>]).*?(?:</\1|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?:(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)""", re.I | re.S)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _marks(value: str) -> int:
    """2 if a class or id marks reader comments, 1 if another part beside the article, else 0."""
    found = 0
    for token in value.split():
        words = [w.lower() for w in _SPLIT.split(token) if w and not w.isdigit() and len(w) > 1]
        hints = [w for w in words if w in _HINTS or w in _COMMENTS]
        if hints and all(w in _LAYOUT for w in words if w not in hints):
            found = max(found, 2 if any(w in _COMMENTS for w in hints) else 1)
    return found


def _unwanted(name: str, attrs: str, inside: bool) -> int:
    """As `_marks`, for an element; an article or main is only left out as a reader comment."""
    found = int(name in _DROPPED and not (inside and name == "header"))
    if not attrs or name in ("html", "body"):
        return found
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "class":
            found = max(found, _marks(value))
        elif key == "id" and name not in _HEADINGS:
            mark = _marks(value)
            found = max(found, mark if mark == 2 or not inside else 0)
        elif key == "role" and value.lower() in _ROLES:
            found = max(found, 1)
    return found if name not in ("article", "main") or found == 2 else 0


def _closed(page: str) -> set[int]:
    """Where the elements start whose end tag can be told."""
    opened: dict[str, list[int]] = {}
    pairs: dict[str, list[int]] = {}
    stray = set()
    for m in _MARKS.finditer(page):
        name = (m["name"] or "").lower()
        if not m["end"]:
            opened.setdefault(name, []).append(m.start())
        elif opened.get(name):
            pairs.setdefault(name, []).append(opened[name].pop())
        else:
            stray.add(name)
    return {at for name, starts in pairs.items() if name in _CLOSING or name not in stray and not opened[name] for at in starts}


class _Lines:
    """Lines of a page: text, characters within links, and whether it stands in the article or main part."""

    def __init__(self, page: str, closing: bool = True):
        self.lines: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.linked = self.anchor = self.drops = self.comments = self.inside = 0
        self.stack: list[tuple[str, int, int]] = []
        self.open: Counter[str] = Counter()
        self.page, self.closed = page, None if closing else set()
        self.read(page)
        self.flush()

    def flush(self, empty: bool = False) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.linked, self.inside > 0))
        if empty and not self.inside:
            self.lines.append(("", 0, False))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.drops:
            t = unescape(raw) if "&" in raw else raw
            self.parts.append(t)
            if self.anchor:
                self.linked += len(t.strip())

    def push(self, name: str, drop: int, at: int) -> None:
        if drop and not self.drops and (name in _BLOCKS or name in _DROPPED):
            self.flush(empty=True)
        self.stack.append((name, drop, at))
        self.open[name] += 1
        self.drops += drop > 0
        self.comments += drop == 2
        self.inside += name in ("article", "main")

    def pop(self) -> None:
        name, drop, _ = self.stack.pop()
        if name in _BLOCKS:
            self.flush()
        self.open[name] -= 1
        self.drops -= drop > 0
        self.comments -= drop == 2
        self.inside -= name in ("article", "main")

    def close(self, name: str, upto: tuple[str, ...] = ()) -> None:
        if not self.open[name]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in upto:
                return

    def apart(self) -> bool:
        """Whether what is open here and left out is closed further on."""
        if self.closed is None:
            self.closed = _closed(self.page)
        return any(drop and n != "form" and at in self.closed for n, drop, at in self.stack)

    def start(self, name: str, attrs: str, at: int) -> None:
        if name in ("article", "main") and self.drops and not self.inside and not self.comments and not self.apart():
            while self.drops:  # what is open was not closed, or stands around the whole page
                self.pop()
        if name in _BLOCKS:
            self.flush()
            self.close("p", ("td", "th", "li", "button", "article", "main", "section", "div", "blockquote"))
            if name in ("li", "dt", "dd", "tr", "td", "th"):
                self.close(name, ("ul", "ol", "dl", "table") if name in ("li", "dt", "dd", "tr") else ("tr", "table"))
        if name == "a":
            self.anchor = 1
        if name in ("br", "wbr"):
            self.text(" ")
        if name in _VOID:
            return
        drop = _unwanted(name, attrs, self.inside > 0)
        if name in _BLOCKS or drop or self.drops:
            self.push(name, drop, at)

    def read(self, page: str) -> None:
        at, low = 0, None
        while True:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            self.text(page[at:lt])
            after = page[lt + 1 : lt + 2]
            if not (after.isascii() and after.isalpha() or after in ("/", "!", "?")) or not after:
                if after:
                    self.text("<")
                at = lt + 1
                continue
            m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
            if m is None:
                gt = page.find(">", lt)
                if gt < 0:
                    return  # cut off within a tag
                at = gt + 1
                continue
            if m.re is _TAG and m["comment"] is not None:
                stop = page.find("-->", lt + 4)
                at = len(page) if stop < 0 else stop + 3
                continue
            at = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["end"]:
                if name == "a":
                    self.anchor = 0
                if name == "p" and not self.open["p"]:
                    self.flush()
                self.close(name)
            elif name in _RAW:
                low = page.lower() if low is None else low
                stop = (low if len(low) == len(page) else page).find(f"</{name}", at)
                at = len(page) if stop < 0 else stop
                if name in _BLOCKS:
                    self.flush()
            elif not m["attrs"].endswith("/") or name in _VOID or name in _BLOCKS:
                self.start(name, m["attrs"], lt)


def window_sums(sizes: list[int]) -> list[int]:
    """Sum of each line and the BLOCK - 1 after it."""
    upto = [0, *accumulate(sizes)]
    return [upto[min(i + BLOCK, len(sizes))] - upto[i] for i in range(len(sizes))]


def between_surge_and_dive(sizes: list[int], surge: int) -> list[bool]:
    """Which lines of a run are kept: from where a window's sum passes `surge` to where it is zero, and those with text right above."""
    sums, kept = window_sums(sizes), [False] * len(sizes)
    i = done = 0
    while i < len(sizes):
        if sums[i] > surge:
            j = i
            while j > done and sizes[j - 1]:
                j -= 1
            while j < len(sizes) and sums[j] > 0:
                kept[j] = sizes[j] > 0
                j += 1
            i = done = j
        i += 1
    return kept


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by blank lines."""
    if not page:
        return ""
    lines = _Lines(page).lines
    if not any(t for t, _, _ in lines):
        lines = _Lines(page, closing=False).lines  # all of it stood in a part to be left out
    runs = [(inside, [(t, linked) for t, linked, _ in run]) for inside, run in groupby(lines, lambda x: x[2])]
    sizes = [[0 if inside or linked >= LINKED * len(t) else len(t) for t, linked in run] for inside, run in runs]
    surge = SURGE
    if not any(inside for inside, _ in runs):
        surge = max(0, min(SURGE, max((x for own in sizes for x in window_sums(own)), default=0) - 1))
    out: list[str] = []
    for (inside, run), own in zip(runs, sizes, strict=True):
        keep = [inside] * len(run) if inside else between_surge_and_dive(own, surge)
        out += [t for (t, _), k in zip(run, keep, strict=True) if k and t]
    return "\n\n".join(out)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = b.column("html").to_pylist()
        for lo, hi in pieces(pages):
            texts = [main_text(p) for p in pages[lo:hi]]
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages`."""
    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
