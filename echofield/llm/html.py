"""Main text of web pages by maximum-scoring subsequence.

A page is a row of words and tags.  Words score by the place they stand in
(positive where labelled pages have their article), tags score below zero.
One linear scan finds the contiguous run with the largest total, and the words
of that run, without places that score below zero, are the main text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by role, and name parts of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
HIDDEN = frozenset("script style noscript template svg math iframe object canvas textarea select".split())
FURNITURE = frozenset("head title nav aside footer header form button menu dialog".split())
NOISE = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies disqus footer header login menu modal nav navbar navigation newsletter notice pager pagination popup promo "
    "related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words that only say where or how large a piece of the page is.
PLACE = frozenset(
    "area bar block bottom box button buttons container fixed footer global group inner item items left link links list "
    "main mobile outer page panel post primary reader right secondary section side site sticky text top user wrap "
    "wrapper".split()
)
# Block elements of the standard; a text in any other element counts as one in a div.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
LABEL = frozenset(["article"])
WHOLE = frozenset(["html", "body", "main"])
PARTED = frozenset("p li tr td th dt dd option".split())  # one of these ends another of its name

PRIOR = 20.0
TAG_COST = 0.05

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
# The rest of a well-formed tag; possessive, so that it never reads a character twice.
_REST = re.compile(r"""[^>"'=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++)[^>"'=]*+)*+>""")
_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*([\"'])")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z]+")


def _tag_end(page: str, at: int, gone: set[str]) -> int:
    """Where the ``>`` of a tag is, from behind its name; -1 if it has none.

    Quotes count only right after an equals sign, and one that is never closed
    is a letter like others.  ``gone`` remembers what does not occur any more.
    """
    if m := _REST.match(page, at):
        return m.end() - 1
    while True:
        stop = _STOP.search(page, at)
        if not stop:
            return -1
        if stop[0] == ">":
            return stop.start()
        at = stop.end()
        quote = _QUOTE.match(page, at)
        if quote and quote[1] not in gone:
            close = page.find(quote[1], quote.end())
            if close < 0:
                gone.add(quote[1])
            else:
                at = close + 1


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of what is no text; comments and the like have no name.

    An element of HIDDEN is one piece up to its end tag.  A tag without an end
    is text, and so is everything behind it.  Every character is read a fixed
    number of times, whatever the page.
    """
    gone: set[str] = set()
    at = page.find("<")
    while at >= 0:
        end, name, closing, rest = -1, "", False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            if page.startswith("<![CDATA[", at) and "]]>" not in gone:
                end = page.find("]]>", at) + 3
                if end == 2:
                    gone.add("]]>")
                    end = -1
            if end < 0:
                end = page.find(">", at) + 1
                if not end:
                    return
        elif m := _NAME.match(page, at):
            close = _tag_end(page, m.end(), gone)
            if close < 0:
                return
            end, name, closing, rest = close + 1, m[2].lower(), bool(m[1]), page[m.end():close]
            if name in HIDDEN and not closing and not (name in ("svg", "math") and rest.endswith("/")):
                last = _CLOSERS[name].search(page, end)
                end = last.end() if last else len(page)
        if end < 0:
            at = page.find("<", at + 1)
            continue
        yield at, end, name, closing, rest
        at = page.find("<", end)


def _named_noise(value: str) -> str | None:
    """The first noise word of a class or id that says nothing but that and its place: not of "share-price"."""
    for token in value.split():
        parts = [p for p in _PARTS.split(_HUMPS.sub("-", token).lower()) if p]
        if all(p in NOISE or p in PLACE for p in parts):
            for p in parts:
                if p in NOISE:
                    return p
    return None


def _furniture(name: str, rest: str, labelled: bool) -> str | None:
    """The feature of an element that frames its page rather than telling something, if it is one.

    The header of an article belongs to it.
    """
    if name in FURNITURE and not (name == "header" and labelled):
        return name
    if name in WHOLE or "=" not in rest:
        return None
    for m in _ATTRIBUTE.finditer(rest):
        if m[1].lower() in ("class", "id", "role"):
            part = _named_noise(m[2] or m[3] or m[4] or "")
            if part:
                return f".{part}"
    return None


class _Page:
    """The texts and tags of a page in order, and the tree of the furniture around them.

    ``rows`` are (kind, value, inside a label, place in ``frames``); ``frames`` are
    (feature, place of the frame around it), outer ones first; ``mains`` are the
    places where an article or main element opens.
    """

    def __init__(self, page: str) -> None:
        self.rows: list[tuple[str, str, bool, int]] = []
        self.frames: list[tuple[str, int]] = []
        self.mains: list[int] = []
        stack: list[tuple[str, str, int]] = []  # name, nearest block, frame
        still: Counter[str] = Counter()
        labels = last = 0

        def drop(depth: int) -> None:
            nonlocal labels
            for name, _, _ in stack[depth:]:
                still[name] -= 1
                labels -= name in LABEL
            del stack[depth:]

        for start, end, name, closing, rest in _tags(page):
            block, frame = stack[-1][1:] if stack else ("", -1)
            if start > last:
                self.rows.append((block, page[last:start], labels > 0, frame))
            last = end
            if not name:
                continue
            self.rows.append((f"<{name}", "" if name in INLINE else name, labels > 0, frame))
            if closing:
                if still[name]:
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    drop(depth)
                continue
            if name in LABEL or name == "main":
                self.mains.append(frame)
            if name in HIDDEN or name in VOID:
                continue
            if name in PARTED and still[name]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        drop(depth)
                        break
                    if stack[depth][0] not in INLINE and stack[depth][0] != "p":
                        break
                block, frame = stack[-1][1:] if stack else ("", -1)
            feature = _furniture(name, rest, labels > 0)
            if feature:
                self.frames.append((feature, frame))
                frame = len(self.frames) - 1
            if name not in INLINE:
                block = name if name in BLOCKS else "div"
            stack.append((name, block, frame))
            still[name] += 1
            labels += name in LABEL
        if last < len(page):
            self.rows.append((stack[-1][1] if stack else "", page[last:], labels > 0, stack[-1][2] if stack else -1))

    def outermost(self, counts) -> list[str | None]:
        """Per frame the outermost feature around and including it among those that count."""
        found: list[str | None] = []
        for i, (feature, around) in enumerate(self.frames):
            above = found[around] if around >= 0 else None
            found.append(above or (feature if counts(i, feature) else None))
        return found

    def holding(self, places: list[int]) -> set[int]:
        """The frames that hold every one of these places."""
        held = [0] * len(self.frames)
        for at in places:
            if at >= 0:
                held[at] += 1
        for i in range(len(held) - 1, -1, -1):
            if self.frames[i][1] >= 0:
                held[self.frames[i][1]] += held[i]
        return {i for i, n in enumerate(held) if n == len(places)} if places else set()

    def wrappers(self, weights: dict[str, float]) -> set[int]:
        """The elements named like furniture that hold every article and main element, or the whole best run without such names."""
        if not any(feature.startswith(".") for feature, _ in self.frames):
            return set()
        plain = self.outermost(lambda i, feature: not feature.startswith("."))
        scores = []
        for kind, value, _, frame in self.rows:
            if kind.startswith("<"):
                scores.append(-TAG_COST)
            else:
                kind = (plain[frame] if frame >= 0 else None) or kind
                scores.append(len(value.split()) * weights.get(kind, _weight(kind)))
        start, end = _best_run(scores)
        run = [row[3] for row, score in zip(self.rows[start:end], scores[start:end]) if score > 0]
        held = self.holding(self.mains) | self.holding(run)
        return {i for i in held if self.frames[i][0].startswith(".")}


def pieces(page: str, weights: dict[str, float] | None = None) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, inside): the texts and tags of a page in order.

    kind is the place of a text (its nearest block element, or the outermost
    piece of furniture around it) or ``<name`` for a tag; value is the raw text,
    or the tag's name where it parts blocks.  inside says whether a labelling
    element is open.  An element that wraps the page's content is no furniture,
    whatever its class, id or role says.
    """
    read = _Page(page)
    wrappers = read.wrappers(weights or {})
    outer = read.outermost(lambda i, feature: i not in wrappers)
    for kind, value, inside, frame in read.rows:
        yield kind if kind.startswith("<") else (outer[frame] if frame >= 0 else None) or kind, value, inside


def _best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest total."""
    best = total = 0.0
    first = start = end = 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, start, end = total, first, i + 1
    return start, end


def learn(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Weights between -1 and 1 of places, from all pages that label their article with an element.

    The weight is tanh of half the log-odds that a word of the place lies inside
    the label.  Furniture starts out as outside, everything else as inside, with
    PRIOR words each.  There are no more places than names in the lists above.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, beyond = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page and "<article" in page.lower():
                    for kind, value, inside in pieces(page):
                        if not kind.startswith("<"):
                            (within if inside else beyond)[kind] += len(value.split())
        names = sorted(set(within) | set(beyond))
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([within[n] for n in names], pa.int64()),
            pa.array([beyond[n] for n in names], pa.int64()),
        ], ["kind", "within", "beyond"])

    counted = pages.select(F.col(html).alias("html")).mapInArrow(count, "kind string, within bigint, beyond bigint")
    total = counted.groupBy("kind").agg(F.sum("within").alias("within"), F.sum("beyond").alias("beyond"))
    return {r["kind"]: _weight(r["kind"], r["within"], r["beyond"]) for r in total.collect()}


def _framed(kind: str) -> bool:
    return kind in FURNITURE or kind.startswith(".")


def _weight(kind: str, within: float = 0, beyond: float = 0) -> float:
    framed = _framed(kind)
    odds = math.log((within + 1 + PRIOR * (not framed)) / (beyond + 1 + PRIOR * framed))
    return math.tanh(odds / 2)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The words of the best-scoring run of a page, blocks joined by one blank; empty if no word scores.

    Furniture inside a labelled article is left out but does not count against
    it, so that an advert never ends the run.
    """
    if not page:
        return ""
    run: list[tuple[str, str, float]] = []
    for kind, value, inside in pieces(page, weights):
        if kind.startswith("<"):
            run.append((kind, value, -TAG_COST))
        else:
            told = entities.unescape(value)
            score = len(told.split()) * weights.get(kind, _weight(kind))
            run.append((kind, told, max(score, 0.0) if inside and _framed(kind) else score))
    start, end = _best_run([score for _, _, score in run])
    blocks, open_block = [], []
    for kind, value, score in run[start:end]:
        if not kind.startswith("<"):
            if score > 0 or (not value.strip() and weights.get(kind, _weight(kind)) > 0):
                open_block.append(value)
        elif value:
            blocks.append("".join(open_block))
            open_block = []
    blocks.append("".join(open_block))
    return " ".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(pages: DataFrame, weights: dict[str, float], html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without its markup column, with the main text; a null page has an empty text."""
    kept = [c for c in pages.columns if c not in (html, name)]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).alias("_page"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column("_page").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, name]
            )

    schema = rows.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(name)).schema
    return rows.mapInArrow(read, schema)
