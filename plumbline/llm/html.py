"""Main text of web pages by site style trees.

All pages of a host are merged into one tree of styles: a style node is an element's tag and classes
below its parent's style node. Over the pages that have a node, its presentation (the sequence of
its children) and its content (its text) have an entropy: menus, notices and footers look and read
the same on every page, so theirs is low. A branch in which no node is important is cut from every
page of the host. What an element says about itself is prior knowledge: ``nav``, ``form``, class
``ad`` and the like have no importance. ``article`` and ``main`` are worth PRIOR_PAGES pages of
evidence: that what lies inside is important, and that what stands beside one is not. A branch inside
goes only if the articles differ where it does not, so copies of an article keep their text, and a
title is as important as its article.

Class names, ids and ``form`` are weaker than the other names: what a branch holds can overrule them
(``overruled``), so an article in a ``page with-sidebar`` or in a page-wide form is not lost.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import landed, pieces

#: Pages of a host that must have a node before it can be found unimportant, and the least importance.
LEAST_PAGES, LEAST_IMPORTANCE = 5, 0.2
#: Pages of evidence that an article or main element counts for.
PRIOR_PAGES = 10
#: Characters outside links that make a branch inside an article prose, whatever a compound name like ``related-work`` says.
PROSE = 200
#: What an element's names say: nothing, that it may hold no text of the author's, that it holds none.
NOTHING, MAYBE, SURELY = range(3)
#: Where a node stands: on a page without an article, beside one, or inside one.
ALONE, BESIDE, INSIDE = range(3)

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html dd dt li tbody td tfoot th thead tr legend".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
NO_TEXT = frozenset(
    "nav footer aside form button select option input label fieldset legend menu dialog head script style noscript template "
    "textarea iframe object svg math canvas audio video title".split()
)
NO_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe popup modal overlay sidebar widget widgets related recommended recommendations share sharing social "
    "menu nav navbar navigation breadcrumb breadcrumbs masthead comment comments disqus replies respond pagination pager login "
    "signup signin searchform toolbar footer".split()
)
# Of these names, what only a title or the page's only article overrules: adverts, consent, reader comments.
FIRM_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr newsletter popup "
    "modal overlay comment comments disqus replies respond".split()
)
FIELDS = frozenset("form button select label textarea fieldset".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass(slots=True)
class Element:
    tag: str
    path: int  # the style node
    silent: bool  # an element whose text is never the author's, or inside one
    inside: bool  # of an article or main element
    article: Element | None  # the outermost such element
    title: bool  # an h1, or inside one
    styles: list  # child styles, for the statistics
    words: list  # own text, for the statistics
    up: tuple  # style nodes above
    number: int = 0  # in the order of start tags
    hard: bool = False  # silent whatever it holds
    link: bool = False  # an anchor, or inside one
    soft: Element | None = None  # the outermost element around that only its names silence
    names: tuple = ()  # of such an element: the words of its names, compounds as they stand
    nested: bool = False  # of such an element: inside an article


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), references.unescape(a or b or c))
    return out


def own_names(tag: str, known: dict[str, str]) -> list[str]:
    """The class names and the id that count: of an article its classes, of main and body none."""
    if tag in ("html", "body", "main", "article"):
        text = known.get("class", "") if tag == "article" else ""
    else:
        text = f"{known.get('class', '')} {known.get('id', '')}"
    return text.lower().split()


def says_noise(tag: str, known: dict[str, str], inside: bool) -> int:
    """What an element's own names tell: NOTHING, MAYBE or SURELY noise."""
    if tag in NO_TEXT and tag != "form" or tag == "header" and not inside:
        return SURELY
    if known:
        if "hidden" in known or known.get("aria-hidden") == "true" or known.get("role", "") in NO_TEXT_ROLES:
            return SURELY
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", known.get("style", "")):
            return SURELY
    if tag == "form" or any(part in NO_TEXT_NAMES for name in own_names(tag, known) for part in re.split(r"[_-]+", name)):
        return MAYBE
    return NOTHING


def walk(page: str, trusted: frozenset[int] = frozenset()) -> Iterator[tuple[str, Element, str]]:
    """The page's events in order: (open | close | text | break, element, text), tags balanced.

    ``trusted`` holds the numbers of elements whose names don't silence them.

    End tags that HTML lets authors leave out are added, those without a start are skipped, and an
    unfinished last tag ends the page.
    """
    root = Element("", 0, False, False, None, False, [], [], ())
    stack = [root]
    count = 0

    def close(n: int) -> Iterator[tuple[str, Element, str]]:
        while len(stack) > n:
            yield "close", stack.pop(), ""

    def opened(tag: str, known: dict[str, str]) -> Element:
        nonlocal count
        count += 1
        top = stack[-1]
        style = f"{tag}.{known.get('class', '')}"
        path = xxhash.xxh3_64_intdigest(style, seed=top.path) >> 3
        top.styles.append(style)
        inside = top.inside or tag in ("article", "main") or known.get("role") == "main"
        noise = says_noise(tag, known, top.inside)
        # HTML has no form inside a form.
        if noise == MAYBE and (count in trusted or tag == "form" and any(e.tag == "form" and not e.silent for e in stack)):
            noise = NOTHING
        silent = top.silent or noise > NOTHING
        new = Element(tag, path, silent, inside and not silent, None, top.title or tag == "h1", [], [], (*top.up, top.path))
        new.article = top.article or (new if new.inside else None)
        new.number, new.hard, new.link, new.soft = count, top.hard or noise == SURELY, top.link or tag == "a", top.soft
        if noise == MAYBE and not top.silent:
            new.soft, new.names, new.nested = new, tuple(own_names(tag, known)), top.inside
        return new

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:  # inside raw text
            continue
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if place:
                yield from close(place)
            continue
        if not page.endswith(">", m.start(), at):
            break
        if tag in CLOSES_P:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", "td", "th", "table")), 0)
            if place and stack[place].tag == "p":
                yield from close(place)
        if tag in SIBLINGS:
            ends, bounds = SIBLINGS[tag]
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends | bounds), 0)
            while place and stack[place].tag in ends:
                yield from close(place)
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends | bounds), 0)
        text = m[3] if m[2] else m[6]
        element = opened(tag, attributes(text) if text and not text.isspace() else {})
        if tag in VOID:
            yield "break", stack[-1], " " if tag == "br" else ""
            continue
        yield "open", element, ""
        if text and text.endswith("/") and tag in ("svg", "math"):
            yield "close", element, ""
            continue
        stack.append(element)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
    else:
        if at < len(page) and not re.match(r"<[a-zA-Z/!?]", page[at : at + 2]):
            yield "text", stack[-1], page[at:]
    yield from close(1)


@dataclass(slots=True)
class Branch:
    """What an outermost element that its names silence holds."""

    root: Element
    prose: int = 0  # characters outside links
    linked: int = 0
    articles: int = 0
    titled: bool = False  # an h1 or main element
    fields: bool = False


def overruled(events: list[tuple[str, Element, str]]) -> set[int]:
    """The numbers of elements whose names are overruled by what they hold.

    One with more prose than the page would keep without it, if it holds the title, a main element or the page's only
    article, or if nothing else is kept and its name is not firm. And one inside an article with a compound name
    that is not firm, if it holds PROSE characters, hardly a link and no form field.
    """
    branches: dict[int, Branch] = {}
    articles = inside = alone = 0
    article_kept = False
    for kind, e, text in events:
        branch = branches.setdefault(e.soft.number, Branch(e.soft)) if e.soft and not e.hard else None
        if kind == "open":
            articles += e.tag == "article"
            article_kept = article_kept or e.inside
            if branch:
                branch.articles += e.tag == "article"
                branch.titled = branch.titled or e.tag in ("h1", "main")
            if e.soft and e.soft.number in branches and e.tag in FIELDS:
                branches[e.soft.number].fields = True
        elif kind == "text" and not text.isspace():
            size = len(" ".join(text.split()))
            if branch:
                branch.prose, branch.linked = branch.prose + size * (not e.link), branch.linked + size * e.link
            elif not e.silent:
                inside, alone = inside + size * e.inside, alone + size
    kept = inside if article_kept else alone
    out = set()
    for number, b in branches.items():
        parts = {part for name in b.root.names for part in re.split(r"[_-]+", name)}
        firm = bool(parts & FIRM_NAMES)
        more = b.prose > kept and (b.titled or b.articles == articles == 1 or kept == 0 and not firm)
        compound = b.root.tag != "form" and not any(name in NO_TEXT_NAMES for name in b.root.names)
        told = b.root.nested and compound and not firm and not b.fields and b.prose >= PROSE and b.linked * 10 <= b.prose
        if more or told:
            out.add(number)
    return out


def events_of(page: str) -> list[tuple[str, Element, str]]:
    """The events of ``walk``, names that the text overrules left aside, from the outside in."""
    trusted: frozenset[int] = frozenset()
    while True:
        events = list(walk(page, trusted))
        more = overruled(events)
        if not more:
            return events
        trusted |= more


def mark(path: int, place: int) -> int:
    """A style node at a place (ALONE, BESIDE or INSIDE) as one number."""
    return path << 2 | place


def has_article(events: list[tuple[str, Element, str]]) -> bool:
    return any(kind == "open" and e.inside for kind, e, _ in events)


def main_text(page: str, told: frozenset[int] = frozenset()) -> str:
    """The text of all branches of a page that its names leave and that are important.

    ``told`` holds the marks for which the host's pages tell against the prior: nodes to cut on pages
    without an article and inside articles, and nodes to keep beside one. An article of which nothing
    would be left stays whole.
    """
    events = events_of(page)
    outside = BESIDE if has_article(events) else ALONE
    blocks: list[str] = []
    pieces_: list[str] = []
    closed = 0  # open elements that are cut
    lost = left = False  # text of an article

    def flush():
        text = " ".join(references.unescape("".join(pieces_)).split())
        if text:
            blocks.append(text)
        pieces_.clear()

    for kind, e, text in events:
        if kind == "text":
            if not e.silent:
                stays = not closed and (e.inside or outside == ALONE or mark(e.path, BESIDE) in told)
                if stays:
                    pieces_.append(text)
                if e.inside and not text.isspace():
                    lost, left = lost or not stays, left or stays
        elif kind == "break":
            pieces_.append(text)
        else:
            if e.tag in BLOCKS:
                flush()
            if (e.inside or outside == ALONE) and mark(e.path, INSIDE if e.inside else ALONE) in told:
                closed += 1 if kind == "open" else -1
    flush()
    if lost and not left:
        return main_text(page, frozenset(m for m in told if m & 3 != INSIDE))
    return "\n".join(blocks)


def style_counts(page: str) -> Iterator[tuple[int, int, int, tuple, int, int]]:
    """(style node, place, node of its article, nodes above, hash of its child styles, hash of its text).

    The text of an outermost article is all that is inside it; a title has 0 as the node of its article.
    """
    events = events_of(page)
    outside = BESIDE if has_article(events) else ALONE
    for kind, e, text in events:
        if kind == "text":
            e.words.append(text)
            if e.inside and e.article is not e:
                e.article.words.append(text)
        elif kind == "close":
            # A style that comes many times in a row is one.
            runs = [s for i, s in enumerate(e.styles) if not i or e.styles[i - 1] != s]
            words = " ".join("".join(e.words).split())
            place, article = (INSIDE, 0 if e.title else e.article.path) if e.inside else (outside, 0)
            content = xxhash.xxh3_64_intdigest(words) >> 1 if words else 0
            yield e.path, place, article, e.up, xxhash.xxh3_64_intdigest("\n".join(runs)) >> 1, content


def host_of(url: str) -> F.Column:
    found = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(found, r"^www\.", "")


COUNTS = "host string, path long, place int, article long, up array<long>, kind int, value long, n long"


def told_branches(pages: DataFrame) -> DataFrame:
    """host and told: the marks by which the host's pages tell against the prior, of hosts that have any.

    The importance measured of a node seen on m pages is the greater of the entropies (base m) of its
    presentation and its content; on fewer than LEAST_PAGES pages nothing is told. Beside an article
    only the content counts, and the prior weighs PRIOR_PAGES pages of importance 0; inside, of 1.
    Counts are combined per batch and before the shuffle, so a host with a third of all pages is no
    hot spot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts: Counter = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, place, article, up, style, words in style_counts(page or ""):
                    counts[host, path, place, article, up, 0, style] += 1
                    counts[host, path, place, article, up, 1, words] += 1
            names = ["host", "path", "place", "article", "up", "kind", "value"]
            columns = list(zip(*counts, strict=True)) if counts else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()]
            arrays = [pa.array(list(map(list, c)) if n == "up" else list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(counts.values()), pa.int64())], [*names, "n"])

    node = ["host", "path", "place"]
    counted = pages.select("host", "html").mapInArrow(run, COUNTS).groupBy(*node, "kind", "value")
    about = [F.min("up").alias("up"), F.min("article").alias("article")]
    values = counted.agg(F.sum("n").alias("n"), *about)
    kinds = values.groupBy(*node, "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), *about)
    entropy = (F.log("m") - F.col("s") / F.col("m")) / F.log("m")
    measured = landed(
        kinds.withColumn("e", F.when(F.col("m") < LEAST_PAGES, 1.0).otherwise(entropy))
        .groupBy(*node)
        .agg(F.max("m").alias("m"), F.max("e").alias("e"), F.max(F.when(F.col("kind") == 1, F.col("e"))).alias("content"), *about),
        "style-nodes",
    )
    # What an article repeats is only known to be no part of it if the articles differ.
    differ = (
        measured.where((F.col("place") == INSIDE) & (F.col("path") == F.col("article")) & (F.col("m") >= LEAST_PAGES))
        .where(F.col("e") >= LEAST_IMPORTANCE)
        .select("host", "article", F.lit(True).alias("differs"))
    )
    prior = F.col("m") / (F.col("m") + PRIOR_PAGES)
    inside = (F.col("e") * prior + 1 - prior >= LEAST_IMPORTANCE) | F.col("differs").isNull()
    beside = (F.col("m") >= LEAST_PAGES) & (F.col("content") * prior >= LEAST_IMPORTANCE)
    important = (
        F.when(F.col("place") == INSIDE, inside).when(F.col("place") == BESIDE, beside).otherwise(F.col("e") >= LEAST_IMPORTANCE)
    )
    nodes = landed(measured.join(differ, ["host", "article"], "left").withColumn("important", important), "importance")
    needed = nodes.where("important").select("host", "place", F.explode(F.concat(F.array("path"), "up")).alias("path")).distinct()
    cut = nodes.where(F.col("place") != BESIDE).join(needed, node, "left_anti")
    told = cut.select(*node).union(nodes.where((F.col("place") == BESIDE) & F.col("important")).select(*node))
    marks = F.shiftleft("path", 2).bitwiseOR(F.col("place").cast("long"))
    return told.groupBy("host").agg(F.array_sort(F.collect_set(marks)).alias("told"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page has an empty text; a null url counts as a host of its own kind. Every row
    gives a row, repeated ones too, and an empty table gives none. Texts are whole. Other columns are
    not read.
    """
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("host", host_of("url"))
    # The list of a host is short, and the table of lists as a rule small; Spark decides how to join.
    joined = read.join(landed(told_branches(read), "branches"), "host", "left").select("page_id", "url", "html", "told")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            told = batch.column(3).to_pylist()
            texts = [main_text(h or "", frozenset(t or ())) for h, t in zip(batch.column(2).to_pylist(), told, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    out = joined.mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
