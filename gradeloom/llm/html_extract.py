"""Main text of web pages as the maximum-scoring stretch of words.

A page is a sequence of word runs and tags. Words score positive and tags negative, with
weights learned from labelled pages (those whose article is marked up as one): the log ratio
of how often a kind of token stands inside and outside of articles. A single linear scan
finds the contiguous stretch with the highest sum, which is the article: crossing into a
menu or footer costs more than the words there bring. Elements that are no running text by
their name, class or role (forms, asides, adverts, notices, reader comments) are left out
of the stretch even where they stand inside of it.

Two passes over the pages, one for the counts (a table of a few hundred rows, whatever the
input) and one for the texts; neither shuffles pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the end of a tag; no character can be read in two ways, and nothing is tried twice.
ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Elements whose content is no markup, and what closes them.
RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in "script style textarea title iframe noembed noframes xmp".split()}
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never running text.
DROPPED = frozenset("head nav menu aside footer form button select option fieldset dialog noscript template svg canvas object audio video".split())
#: Classes, ids and roles, or their leading parts, that name something else than running text.
OTHER_PART = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login footer comment comments disqus discussion "
    "respond responses replies related recommended share sharing social widget toolbar pagination pager search complementary contentinfo masthead skip".split()
)
OTHER_WHOLE = frozenset("header site-header page-header top-header hidden".split())
#: Tags that get weights of their own; others share one.
KNOWN = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead pre blockquote figure figcaption header hgroup address br hr img center details summary a".split()
) | INLINE | DROPPED
OTHER_START = ("advert", "comment", "cookie", "sidebar", "newsletter", "sponsor", "breadcrumb")
#: A word counts 1 at most; a tag costs up to this many words, this much per unit of its log ratio and this much at least; words of an unseen place.
TAG_BOUND, TAG_SCALE, TAG_COST, NEW_WORD = 40.0, 8.0, 0.05, 0.5
#: Elements that end an open paragraph.
_ENDS_P = KNOWN - INLINE - frozenset(["br", "img", "option"])


def _named_other(tag: str, attributes: str) -> bool:
    """Whether class, id or role say that an element is no running text; of an article only that it is a comment."""
    if tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        for name in value.split():
            if tag == "article":
                if name.startswith("comment"):
                    return True
            elif name in OTHER_WHOLE or name.startswith(OTHER_START) or re.split(r"[-_]+", name.lstrip("-_"))[0] in OTHER_PART:
                return True
    return False


#: Decimal references with more digits than a code point can have, and leading zeros, which int() would choke on.
HUGE_REFERENCE = re.compile(r"&#0*+[0-9]{8,}+;?")
LEADING_ZEROS = re.compile(r"&#0{2,}+")


def pieces(page: str):
    """(place, text, closing, name, attributes) of every run of text and every tag, in one pass over the page.

    For text the last three are None. Comments, declarations and raw elements are left out.
    A tag ends at the first ``>`` outside of quotes; where quotes never close, it ends at the
    first ``>``, and so do all tags behind it. Without any ``>`` behind it a tag is text.
    """
    at, quoted = 0, True
    last_end = page.rfind(">")
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            yield at, page[at:start], None, None, None
            at = start
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        head = TAG_NAME.match(page, at) if at < last_end else None
        if head is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
            else:
                yield at, "<", None, None, None
                at += 1
            continue
        rest = ATTRIBUTES.match(page, head.end()) if quoted else None
        if rest:
            attributes, end = rest[1], rest.end()
        else:
            quoted = False
            end = page.find(">", head.end()) + 1
            if not end:
                yield at, "<", None, None, None
                at += 1
                continue
            attributes = page[head.end() : end - 1]
        raw = RAW.get(head[2].lower()) if not head[1] else None
        if raw:
            close = raw.search(page, end)
            at = close.end() if close else len(page)
            continue
        yield at, None, bool(head[1]), head[2].lower(), attributes
        at = end


def tokens(page: str, around: frozenset[int] = frozenset()):
    """(kind, count, text, inside): ``kind`` names what is weighed, ``text`` is None in elements to leave out.

    Words have the kind ``w:`` and the innermost block around them, tags ``t:`` and their
    name. ``inside`` tells whether an ``article`` element is open. An element with an
    ``article`` or ``main`` in it is never left out for its class, id or role; the tags at
    the places ``around`` are known to be such.
    """
    # name, left out, innermost block, whether the innermost element that is not inline is a paragraph
    stack: list[tuple[str, bool, str, bool]] = []
    opened: Counter[str] = Counter()
    named: list[tuple[int, int]] = []  # depth and place of open elements left out for their class, id or role
    wrong: set[int] = set()
    out = []
    dropped = articles = 0

    def pop():
        nonlocal dropped, articles
        name, off, _, _ = stack.pop()
        opened[name] -= 1
        if named and named[-1][0] == len(stack):
            named.pop()
        dropped -= off
        articles -= name == "article"

    for place, text, closing, name, attributes in pieces(page):
        if text is not None:
            words = len(text.split())
            block = stack[-1][2] if stack else "none"
            out.append(("w:dropped" if dropped else f"w:{block}", words, None if dropped else text, articles > 0))
            continue
        kind = "t:" + (name if name in KNOWN else "other")
        gap = "" if name in INLINE else " "
        if closing:
            inside = articles > 1 or (articles == 1 and name != "article")
            left_out = dropped
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            out.append(("t:dropped" if left_out else kind, 1, None if left_out else gap, inside))
            continue
        if name in _ENDS_P and stack and stack[-1][3]:
            while stack[-1][0] != "p":
                pop()
            pop()
        if name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop()
        off = name in DROPPED or (name == "header" and not articles)
        other = not off and place not in around and _named_other(name, attributes)
        off |= other
        if named and not off and name in ("article", "main"):
            wrong.update(at for _, at in named)
        out.append(("t:dropped" if dropped or off else kind, 1, None if dropped or off else gap, articles > 0))
        if name not in VOID and not attributes.endswith("/"):
            if other:
                named.append((len(stack), place))
            inline = name in INLINE
            block = (name if name in KNOWN else "other") if not inline or name == "a" else stack[-1][2] if stack else "none"
            stack.append((name, off, block, stack[-1][3] if inline and stack else name == "p"))
            opened[name] += 1
            dropped += off
            articles += name == "article"
    return tokens(page, around | wrong) if wrong else out


def counts(page: str) -> dict[str, list[int]]:
    """How many tokens of each kind a labelled page has inside and outside of its article; empty without one."""
    found: dict[str, list[int]] = {}
    labelled = False
    for kind, n, _, inside in tokens(page):
        labelled |= inside
        found.setdefault(kind, [0, 0])[0 if inside else 1] += n
    return found if labelled else {}


def weights(totals: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log ratios of the shares a kind has inside and outside; tags always cost something."""
    out = {}
    for letter in ("w", "t"):
        kinds = {k: v for k, v in totals.items() if k[0] == letter}
        inside, outside = (sum(v[i] for v in kinds.values()) + 1 for i in (0, 1))
        for kind, (a, b) in kinds.items():
            ratio = math.log((a + 0.5) / inside) - math.log((b + 0.5) / outside)
            out[kind] = max(-1.0, min(1.0, ratio)) if letter == "w" else max(-TAG_BOUND, min(-TAG_COST, TAG_SCALE * ratio))
    # what is left out anyway neither argues for a stretch nor ends it
    return out | {"w:dropped": -TAG_COST, "t:dropped": -TAG_COST}


def main_text(page: str | None, learned: dict[str, float]) -> str:
    """The text of the best stretch, blocks joined by one space; empty if no words score."""
    found = tokens(page or "")
    best, best_from, best_to = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, (kind, n, _, _) in enumerate(found):
        if total <= 0:
            total, begin = 0.0, i
        total += n * learned.get(kind, NEW_WORD if kind[0] == "w" else -TAG_COST)
        if total > best:
            best, best_from, best_to = total, begin, i + 1
    text = "".join(t or " " * (t is None) for _, _, t, _ in found[best_from:best_to])
    return " ".join(html.unescape(LEADING_ZEROS.sub("&#0", HUGE_REFERENCE.sub("\ufffd", text))).split())


def learn(pages: DataFrame, html_column: str = "html") -> dict[str, float]:
    """Weights from all labelled pages of a table."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            total: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                for kind, (a, b) in counts(page or "").items():
                    own = total.setdefault(kind, [0, 0])
                    own[0] += a
                    own[1] += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())],
                names=["kind", "inside", "outside"],
            )

    rows = pages.select(html_column).mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside"), F.sum("outside"))
    return weights({kind: (a, b) for kind, a, b in rows.collect()})  # a row for each kind in KNOWN at most


def extract(pages: DataFrame, learned: dict[str, float] | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` of every row of ``pages``.

    Null and empty pages, and pages without any word, have an empty text. Equal rows give
    equal rows. Where no page is labelled, words count 0.5 and tags cost a little, so the
    stretch spans the page and only what is left out by name is missing. Other columns are
    not read.
    """
    learned = learn(pages, html_column) if learned is None else learned

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page, learned) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_column, url_column, "text", "n_chars"]
            )

    kinds = dict(pages.dtypes)
    return pages.select(id_column, url_column, html_column).mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{url_column}` {kinds[url_column]}, text string, n_chars long")
