"""Main text of web pages as the maximum-scoring contiguous run of tokens: words score positive and tags negative.

Weights are learnt from labelled pages, those that mark their content with an article or main element; the mark is not
looked at when a page is scored.  A word weighs the log odds, by the element around it, of being content, and a tag the
log odds of its name; words stay positive and tags negative.  To a word's weight comes that of the landmarks (nav,
footer, ...) and of the class, id and role words of the elements around it, also learnt, or else a default; a word that
weighs less than nothing with them ends a run sooner or later, and is not given out if the run goes on behind it.  What
one such element takes from a run is bounded, and nothing if it stands in running text, behind a paragraph in the same
element, so that an advert between two parts of an article does not part them.  One linear scan finds the best run; its
text is given block by block.  What a browser never shows as text (scripts, styles,
hidden elements) and controls of forms are no tokens.

White space inside a block becomes one space, inline tags join what stands around them, a line break or a table cell
is white space, and blocks are joined by an empty line.

Defined cases: a null or empty page, and one without any positive word, has an empty text; markup that is cut off or
never closed is read to the end, and a quote that is never closed does not count as one; equal runs go to the first; with
no labelled page default weights hold; repeated rows are each read; other columns are not read; an empty table gives no
row; time is linear in the page, whatever its markup, and memory a few times its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: Labelled pages that weights are learnt from, at most, and class, id and role words that get a weight of their own.
SAMPLE = 1000
HINTS = 5000

#: Element names of HTML by their role here.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
SPACE = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
NEVER = frozenset("form script style noscript iframe template textarea title head menu button select svg canvas object audio video dialog".split())
CONTENT = frozenset("article main".split())
LANDMARKS = frozenset("nav footer aside header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related recommended share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())
#: Open elements that a start tag of a block, or of the same kind, ends.
_ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_INLINE = frozenset("p a b i em strong span u small big code q s sub sup font tt cite abbr label mark".split())

_PLAIN = frozenset("h1 h2 h3 h4 h5 h6 br pre blockquote li".split())
#: Elements of running text.
_RUNNING = frozenset("p pre blockquote".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: The rest of a tag.  A quote only counts right after an equals sign, and if another one follows.  Nothing is tried twice.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>?""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|aria-hidden|hidden)(?![^\s=/>])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Default weights of landmarks and of class, id and role words that name what is not content; the second where other
#: words stand beside them.
LANDMARK = {"nav": -4.0, "footer": -4.0, "aside": -4.0, "header": -0.5}
HINT, MIXED_HINT = -4.0, -0.9
#: What one element that is not content takes from a run at most.
MOST_LOST = 40.0


def attributes(tag: str) -> tuple[bool, tuple[tuple[str, ...], ...]]:
    """Of a start tag: whether its element is hidden, and the words of its class, id and role, each value by itself."""
    values = []
    for key, value in _ATTRIBUTE.findall(tag):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
            return True, ()
        if key in ("class", "id"):
            values += [tuple(_WORDS.findall(_CAMEL.sub("-", x).lower())) for x in value.split()]
        elif key == "role" and value.lower() in ROLES:
            values.append(("role " + value.lower(),))
    return False, tuple(v for v in values if v)


@dataclass(slots=True)
class Token:
    text: str  # empty for a tag
    name: str  # the tag's, or that of the element around the text
    around: int  # the number of the place in `Page.places`
    breaks: int = 0  # of a tag: 2 a block's edge, 1 white space


@dataclass
class Page:
    tokens: list[Token]
    #: What stands around texts: the place outside of it, the landmark or "", the words of its attributes, whether it is
    #: marked as content, and whether it stands in running text.  Place 0 is the page.
    places: list[tuple[int, str, tuple[tuple[str, ...], ...], bool, bool]]


def parsed(page: str) -> Page:
    """Text runs and tags of a page; no tokens come from elements whose text is never content."""
    out: list[Token] = []
    places: list[tuple[int, str, tuple[tuple[str, ...], ...], bool, bool]] = [(-1, "", (), False, False)]
    stack: list[list] = []  # open elements: name, place, whether they are left out, whether a paragraph is among them
    opened: Counter = Counter()
    at, n, lowered = 0, len(page), ""

    def add(text: str) -> None:
        if text and not (stack and stack[-1][2]):
            out.append(Token(text, stack[-1][0] if stack else "", stack[-1][1] if stack else 0))

    def close() -> None:
        opened[stack.pop()[0]] -= 1

    while at < n:
        begin = page.find("<", at)
        m = _NAME.match(page, begin + 1) if begin >= 0 else None
        while begin >= 0 and not m and page[begin + 1 : begin + 2] not in ("!", "?"):
            begin = page.find("<", begin + 1)
            m = _NAME.match(page, begin + 1) if begin >= 0 else None
        if begin < 0:
            add(page[at:])
            break
        add(page[at:begin])
        if not m:
            mark = "-->" if page.startswith("<!--", begin) else "]]>" if page.startswith("<![CDATA[", begin) else ">"
            end = page.find(mark, begin + (4 if mark == "-->" else 2))
            at = n if end < 0 else end + len(mark)
            continue
        name = m[1].lower()
        at = _REST.match(page, m.end()).end()
        place = stack[-1][1] if stack else 0
        if page[begin + 1] == "/":
            if opened[name]:
                while stack[-1][0] != name:
                    close()
                left_out = stack[-1][2]
                close()
            else:
                left_out = bool(stack) and stack[-1][2]
        else:
            if name in BLOCK:
                while stack and stack[-1][0] in _INLINE:
                    close()
            while stack and stack[-1][0] in _ENDED.get(name, ()):
                close()
            _, place, left_out, running = stack[-1] if stack else ("", 0, False, False)
            if name in _RUNNING and stack:
                stack[-1][3] = True
            tag = page[m.end() : at]
            hidden, words = attributes(tag) if not left_out and name not in ("html", "body") and len(tag) > 3 else (False, ())
            left_out = left_out or hidden or name in NEVER
            if name not in VOID and not (tag.endswith("/>") and name not in BLOCK and name not in RAW):
                if words or name in LANDMARKS or name in CONTENT:
                    places.append((place, name if name in LANDMARKS else "", words, name in CONTENT or places[place][3], running))
                    place = len(places) - 1
                stack.append([name, place, left_out, False])
                opened[name] += 1
        if not left_out:
            out.append(Token("", name, place, 2 if name in BLOCK else 1 if name in SPACE else 0))
        elif out and name in BLOCK:
            out.append(Token("", "", place, 2))  # what is left out still parts blocks
        if name in RAW and stack and stack[-1][0] == name and page[begin + 1] != "/":
            lowered = lowered or page.lower()
            end = lowered.find(f"</{name}", at) if len(lowered) == n else page.find(f"</{name}", at)
            at = n if end < 0 else end
    return Page(out, places)


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    hints: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    tag: float = -0.4
    plain: float = -0.05  # a tag that is usual in running text

    def of_place(self, landmark: str, values: tuple[tuple[str, ...], ...]) -> float:
        """What a landmark and the words of attributes add to the words below."""
        total = 0.0
        if landmark:
            total += self.hints.get(landmark, LANDMARK[landmark])
        for value in values:
            known = [self.hints[x] for x in value if x in self.hints]
            noise = sum(x.startswith("role ") or x in NOISE for x in value)
            if known:
                total += sum(known) / len(value)
            elif noise:
                total += HINT if noise == len(value) else MIXED_HINT
        return total

    def of_tag(self, name: str) -> float:
        return self.tags.get(name, self.plain if name in _INLINE or name in _PLAIN else self.tag if name else 0.0)

    def of_places(self, page: Page) -> list[float]:
        out: list[float] = []
        for outer, landmark, values, *_ in page.places:
            out.append((out[outer] if outer >= 0 else 0.0) + self.of_place(landmark, values))
        return out


def count(page: str) -> Counter:
    """Of a labelled page: words by surrounding element and by landmarks and attribute words, and tags, inside and
    outside of content.  Inside of content, what default weights would leave out is not counted."""
    out: Counter = Counter()
    p = parsed(page)
    usual = Weights().of_places(p)
    around: list[frozenset[str]] = []
    for outer, landmark, values, *_ in p.places:
        own = {x for v in values for x in v} | ({landmark} if landmark else set())
        around.append((around[outer] if outer >= 0 else frozenset()) | own)
    good = False
    for t in p.tokens:
        if t.text:
            n = len(t.text.split())
            good = p.places[t.around][3]
            if n and not (good and usual[t.around] <= HINT):
                out["word", t.name, good] += n
                for x in around[t.around]:
                    out["hint", x, good] += n
        elif t.name and t.name not in CONTENT:
            out["tag", t.name, good] += 1
    return out


def weights(counts: dict[tuple[str, str, bool], int]) -> Weights:
    w = Weights()
    for kind, table, low, high in (("word", w.words, 0.1, 3.0), ("tag", w.tags, -3.0, -0.05), ("hint", w.hints, -6.0, 1.0)):
        total = {g: 1 + sum(n for (k, _, good), n in counts.items() if k == ("word" if kind == "hint" else kind) and good == g) for g in (True, False)}
        for name in sorted({x for k, x, _ in counts if k == kind}):
            a, b = ((counts.get((kind, name, g), 0) + 1) / total[g] for g in (True, False))
            odds = math.log(a / b)
            if kind == "hint" and odds < 0:
                odds -= 3.0  # as heavy as the heaviest word
            table[name] = min(high, max(low, odds + 1 if kind == "word" else (odds - 3) / 4 if kind == "tag" else odds))
    return w


def extract(page: str | None, w: Weights) -> str:
    """The text of the best run."""
    p = parsed(page or "")
    added = w.of_places(p)
    best, best_run, total, start = 0.0, (0, 0), 0.0, 0
    lost: dict[int, float] = {}
    outermost: list[int] = []  # of each place, the outermost one that takes from words
    for k, (outer, *_) in enumerate(p.places):
        above = outermost[outer] if outer >= 0 else -1
        outermost.append(above if above >= 0 else k if added[k] < 0 else -1)
    scores: list[float] = []
    for i, t in enumerate(p.tokens):
        score = w.words.get(t.name, w.word) + added[t.around] if t.text else w.of_tag(t.name)
        scores.append(score)
        if t.text:
            score *= len(t.text.split())
        of = outermost[t.around]
        if score < 0 and of >= 0:
            score = 0.0 if p.places[of][4] else max(score, -MOST_LOST - lost.get(of, 0.0))
            lost[of] = lost.get(of, 0.0) + score
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_run = total, (start, i + 1)
    blocks: list[list[str]] = [[]]
    for i in range(*best_run):
        t = p.tokens[i]
        if t.text:
            if scores[i] >= 0:
                blocks[-1].append(t.text)
        elif t.breaks == 2:
            blocks.append([])
        elif t.breaks == 1:
            blocks[-1].append(" ")
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from the labelled pages of smallest hashes."""
    labelled = pages.filter(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(html_col).alias("html"))
    most = labelled.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if most is None:
        return Weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count(page or ""))
        known = BLOCK | SPACE | VOID | NEVER | _INLINE | {""}
        kept: Counter = Counter()
        for (kind, name, good), n in total.items():
            kept[kind, name if name in known or kind == "hint" and len(name) <= 30 else "other", good] += n
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*((k, x, g, n) for (k, x, g), n in kept.items()), strict=True)], names=["kind", "name", "good", "n"])

    found = labelled.filter(F.col("h") <= most).select("html").mapInArrow(lean(run), "kind string, name string, good boolean, n long")
    summed = found.groupBy("kind", "name").agg(*[F.sum(F.when(F.col("good") == g, F.col("n")).otherwise(0)).alias(f"n{int(g)}") for g in (False, True)])
    most_used = summed.orderBy(F.desc(F.col("kind") != "hint"), F.desc(F.col("n0") + F.col("n1")), "name").limit(HINTS)
    return weights({(r[0], r[1], good): n for r in most_used.collect() for good, n in ((False, r[2]), (True, r[3])) if n})


def main_text(pages: DataFrame, w: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, held.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(lean(run), "id long, url string, text string, n_chars long")
