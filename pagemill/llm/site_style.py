"""Main text of web pages by site style trees.

The DOMs of a host are merged into one tree of element paths. Every element that holds text is in it, menus and adverts
too, and has an importance between 0 and 1 from two entropies: of its presentation (the child sequences it has on the
host's pages) and of the content of its whole branch (the self-information of its blocks: a text on all pages says nothing, one of
two equally frequent texts one bit). Entropies are turned into effective numbers, so an importance depends on the shares of
pages and never on how many pages a host has. A page loses its branches of low importance times prior.

The prior of an element is what its tag, role and class say: menus, headers, footers, sidebars, notices, adverts, forms and comments are
low enough to go by themselves if their name says nothing else. Names that say something else too (`related-work`, `share-price`) and
doubtful ones leave it to the tree; headings and table rows of an article are spared. What a page shows overrules a name: an
element that holds the page's main text is no menu whatever it is called, and a form with much text to few inputs is no form.
A path's prior is the mean over its pages, and its importance is drawn to `UNJUDGED` by as much as two more pages would, so few pages say little.
Of what is left, the article is the text.

Pages are parsed once, in linear time, into blocks and element paths; the rest is Spark: tree nodes are counted by (host, path,
feature) with partial sums, so a host with a third of all pages is no task of its own, and equal pages of a host count
once. Only the low paths go back to the pages, in a join that Spark makes a broadcast only if their written size is below its
threshold.

Defined results: a null or empty page has an empty text; pages with a null url are judged by priors alone; a page that ends early is read as far as it goes, up to a
tag it breaks off in; elements nested deeper than `DEPTH` are read as siblings at that depth; text is never dropped for length.
Repeated rows get equal texts; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

#: The importance of what nothing is known of, and how many pages' say it has beside those after the first.
UNJUDGED = 0.5
SAY = 2
LOW_IMPORTANCE = 0.2
#: Weight of content beside presentation.
DAMPING = 0.9
NAMED, DOUBTFUL, UNSURE, NEUTRAL = 0.1, 0.25, 0.5, 1.0
#: Shares of a page's main text with which an element wraps it: beside a main or article element, and under a page's title.
WRAPS, WRAPS_ALL = 0.5, 0.9
#: Characters of text to an input, above which a form holds a page and not a question.
FORM_TEXT = 100
DEPTH = 256
#: Tags of a page with an unclosed quote, after which all its tags are taken to end at their first `>`.
BROKEN_TAGS = 64
#: Pages parsed into one Arrow batch.
PAGES = 256

# Elements by their role in HTML.
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCKS - {"html", "body"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tbody", "thead", "tr"}, "tfoot": {"tbody", "tr"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("nav footer aside menu dialog search head button fieldset".split())
RAW_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title".split())
SPARED_TAGS = frozenset("h1 h2 h3 h4 h5 h6 tr caption dt figcaption".split())
PROSE_TAGS = frozenset("p pre blockquote".split())
INPUTS = frozenset("input select textarea".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "masthead topbar siteheader pageheader footer sitefooter pagefooter sidebar aside cookie cookies consent gdpr notice notices notification alert popup newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus search "
    "pagination pager skip paywall".split()
)
# Names that also stand on what holds text, so that the tree decides.
DOUBTFUL_NAMES = frozenset("widget widgets toolbar banner overlay modal disclaimer copyright form header".split())
# Words that say no more of an element than where it is or what it is made of.
PLAIN_NAMES = frozenset(
    "box block list listing item items section area wrapper wrap container holder bar row col column panel inner outer body content main top bottom left right page site global post posts article articles entry entries "
    "link links button buttons icon icons group region unit module slot card cards header title heading label text primary secondary first second mobile desktop sticky fixed message form field input the my us our js "
    "social media stories story news reader user users thread count toggle tool tools wp id".split()
)
MODIFIERS = frozenset("no has with without is show hide enable disable".split())
#: Elements that hold the page or its text whatever their class says.
WHOLE = frozenset("html body main".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
OUTSIDE, PROSE, MAIN, ARTICLE = range(4)


@dataclass
class Element:
    """An open element: its place among the page's paths, the zone it lies in, and a running digest of its children."""

    tag: str
    at: int
    zone: int
    children: int = 0
    last: str = ""


@dataclass
class Page:
    """A parsed page: element paths with the paths down to them and their priors (none where spared), blocks (place among the
    paths, zone, text), styles (path, style), kinds (tag and zone of each path), and which paths are titles or forms with how many inputs."""

    place: dict[int, int] = field(default_factory=dict)
    paths: list[int] = field(default_factory=list)
    above: list[tuple[int, ...]] = field(default_factory=list)
    priors: list[float | None] = field(default_factory=list)
    blocks: list[tuple[int, int, str]] = field(default_factory=list)
    styles: set[tuple[int, int]] = field(default_factory=set)
    kinds: list[tuple[str, int]] = field(default_factory=list)
    titles: set[int] = field(default_factory=set)
    inputs: dict[int, int] = field(default_factory=dict)


@lru_cache(200_000)
def _digest(above: int, label: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{above}>{label}") - 2**63


def _prior_of(token: str) -> float:
    """What a class or id says of an element by all of its words, unless it only says what the page has or lacks beside
    it (has-sidebar, no-comments)."""
    parts = set(NAME.findall(token))
    if not parts or token.split("-")[0] in MODIFIERS or not parts & (DROPPED_NAMES | DOUBTFUL_NAMES):
        return NEUTRAL
    if parts - DROPPED_NAMES - DOUBTFUL_NAMES - PLAIN_NAMES:
        return UNSURE
    return NAMED if parts & DROPPED_NAMES else DOUBTFUL


@lru_cache(50_000)
def _label(tag: str, attributes: str) -> tuple[str, float, bool]:
    """(tag with the words of its class and id, prior, whether its role is main)."""
    prior = NAMED if tag in DROPPED_TAGS else NEUTRAL
    if "=" not in attributes:
        return tag, prior, False
    words: list[str] = []
    main = False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            prior = min(prior, NAMED if value.strip() in DROPPED_ROLES else NEUTRAL)
            main |= value.strip() == "main"
            words.append(f"role-{value.strip()}")
            continue
        for token in value.split():
            words.append(re.sub(r"\d+", "", token))
            if tag not in WHOLE:
                prior = min(prior, _prior_of(token))
    return ".".join([tag, *sorted(words)]), prior, main


def parse(html: str | None) -> Page:
    """The blocks of a page in order, and the element paths they lie in."""
    html = html or ""
    page = Page(paths=[0], above=[()], priors=[None], kinds=[("", OUTSIDE)])
    stack = [Element("", 0, OUTSIDE)]
    buffer: list[str] = []
    at, open_p, patience = 0, 0, BROKEN_TAGS

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                page.blocks.append((top.at, PROSE if top.zone == OUTSIDE and top.tag in PROSE_TAGS else top.zone, text))

    def close(depth: int) -> None:
        nonlocal open_p
        flush()
        while len(stack) > depth:
            done = stack.pop()
            open_p -= done.tag == "p"
            if done.children:
                page.styles.add((page.paths[done.at], done.children))

    def deepest(tags) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in tags), 0)

    def enter(tag: str, attributes: str) -> None:
        nonlocal open_p
        parent = stack[-1]
        label, prior, main = _label(tag, attributes)
        if tag == "header" and parent.zone != ARTICLE:
            prior = NAMED
        zone = ARTICLE if tag == "article" else MAIN if (tag == "main" or main) and parent.zone != ARTICLE else parent.zone
        path = _digest(page.paths[parent.at], label)
        if label != parent.last:
            parent.last, parent.children = label, _digest(parent.children, label)
        if (place := page.place.get(path)) is None:
            place = page.place[path] = len(page.paths)
            page.paths.append(path)
            page.above.append((*page.above[parent.at], path))
            page.kinds.append((tag, zone))
            if tag == "h1":
                page.titles.add(place)
            page.priors.append(None if prior == NEUTRAL and (tag in WHOLE or tag in SPARED_TAGS and zone == ARTICLE) else prior)
        open_p += tag == "p"
        stack.append(Element(tag, place, zone))

    while True:
        start = html.find("<", at)
        if start < 0:
            buffer.append(html[at:])
            break
        mark = html[start + 1 : start + 2]
        if not (mark.isascii() and mark.isalpha() or mark in ("/", "!", "?")) or not mark:
            buffer.append(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            buffer.append(html[at:start])
        if mark in "!?" or mark == "/" and not html[start + 2 : start + 3].isalpha():
            ending = "-->" if html.startswith("<!--", start) else ">"
            end = html.find(ending, start + 2)
            if end < 0:
                break
            at = end + len(ending)
            continue
        token = TAG.match(html, start) if patience else None
        if token is None:
            patience -= patience > 0
            token = LOOSE_TAG.match(html, start)
            if token is None:
                break
        at = token.end()
        slash, tag, attributes = token[1], token[2].lower(), token[3]
        if tag in INPUTS and not slash and "hidden" not in attributes and (depth := deepest(("form",))):
            page.inputs[stack[depth].at] = page.inputs.get(stack[depth].at, 0) + 1
        if tag in RAW_TAGS:
            if not slash and not (tag in ("svg", "math") and attributes.endswith("/")):
                end = RAW_ENDS[tag].search(html, at)
                if end is None:
                    break
                at = end.start()
            continue
        if tag in ("br", "td", "th"):
            buffer.append(" ")
        if tag not in BLOCKS and tag not in DROPPED_TAGS:
            continue
        if slash:
            depth = deepest((tag,))
            close(depth) if depth else flush()
            continue
        if tag == "body":
            close(deepest(("head",)) or len(stack))
        elif tag in CLOSES_P and open_p:
            close(deepest(("p",)))
        elif tag in IMPLIED:
            depth = deepest(SCOPES[tag] | IMPLIED[tag])
            if depth and stack[depth].tag in IMPLIED[tag]:
                close(depth)
        flush()
        if tag in VOID:
            continue
        if len(stack) > DEPTH:
            close(DEPTH)
        enter(tag, attributes)
    close(1)
    _weigh(page)
    return page


def _weigh(page: Page) -> None:
    """Priors by what the page shows: forms by their text and inputs, and neutral ones for elements that hold the main text."""
    zoned = any(zone in (ARTICLE, MAIN) for _, zone, _ in page.blocks)
    all_text, main_text, titled = {}, {}, set()
    for at, zone, text in page.blocks:
        for path in page.above[at]:
            place = page.place[path]
            all_text[place] = all_text.get(place, 0) + len(text)
            if not zoned or zone in (ARTICLE, MAIN):
                main_text[place] = main_text.get(place, 0) + len(text)
            if at in page.titles:
                titled.add(place)
    whole = sum(len(text) for _, zone, text in page.blocks if not zoned or zone in (ARTICLE, MAIN))
    for i, (tag, zone) in enumerate(page.kinds):
        if tag == "form" and page.priors[i] is not None and all_text.get(i, 0) <= FORM_TEXT * (page.inputs.get(i, 0) + 1):
            page.priors[i] = min(page.priors[i], NAMED)
        elif page.priors[i] not in (None, NEUTRAL) and tag not in DROPPED_TAGS and whole:
            share = main_text.get(i, 0) / whole
            if zoned and zone == OUTSIDE and share > WRAPS or share >= WRAPS_ALL and (zoned or i in titled):
                page.priors[i] = NEUTRAL


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(pages: DataFrame, *carried: Column, url: str = "url", html: str = "html") -> DataFrame:
    """`row` (the carried columns), site (a digest of the host, null for none), page (a digest of the html), and what `parse` finds:
    paths (path, above, prior) of elements that hold text, blocks (path, zone, text) and styles (path, style)."""
    import pyarrow as pa

    names = [f"carried_{i}" for i in range(len(carried))]
    row = F.struct(*[c.alias(n) for c, n in zip(carried, names, strict=True)], F.lit(True).alias("there"))
    named = pages.select(row.alias("row"), F.when(host(F.col(url)) != "", F.xxhash64(host(F.col(url)))).alias("site"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))
    kept = named.select("row", "site", "page").schema
    schema = f"row {kept['row'].dataType.simpleString()}, site bigint, page bigint, paths array<struct<path: bigint, above: array<bigint>, prior: double>>, blocks array<struct<path: bigint, zone: int, text: string>>, styles array<struct<path: bigint, style: bigint>>"

    def lists(sizes: list[int], values) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)

    def chains(found: list[tuple[int, ...]]) -> pa.ListArray:
        return lists([len(c) for c in found], pa.array([p for c in found for p in c], pa.int64()))

    def built(html: list[str | None]) -> list[pa.Array]:
        told = [parse(h) for h in html]
        held = [[i for i in range(1, len(p.paths)) if i in used] for p, used in ((p, {p.place[x] for at, *_ in p.blocks for x in p.above[at]}) for p in told)]
        paths = pa.StructArray.from_arrays([
            pa.array([p.paths[i] for p, own in zip(told, held, strict=True) for i in own], pa.int64()), chains([p.above[i] for p, own in zip(told, held, strict=True) for i in own]),
            pa.array([p.priors[i] for p, own in zip(told, held, strict=True) for i in own], pa.float64()),
        ], ["path", "above", "prior"])
        blocks = pa.StructArray.from_arrays([
            pa.array([p.paths[at] for p in told for at, *_ in p.blocks], pa.int64()), pa.array([zone for p in told for _, zone, _ in p.blocks], pa.int32()), pa.array([text for p in told for *_, text in p.blocks], pa.string()),
        ], ["path", "zone", "text"])
        styles = pa.StructArray.from_arrays([pa.array([s[k] for p in told for s in sorted(p.styles)], pa.int64()) for k in (0, 1)], ["path", "style"])
        return [lists([len(own) for own in held], paths), lists([len(p.blocks) for p in told], blocks), lists([len(p.styles) for p in told], styles)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                own = [part.column(n) for n in ("row", "site", "page")]
                yield pa.RecordBatch.from_arrays([*own, *built(part.column("html").to_pylist())], ["row", "site", "page", "paths", "blocks", "styles"])

    return named.mapInArrow(run, schema)


def style_tree(told: DataFrame) -> DataFrame:
    """The merged trees of parsed pages: (site, path, n_pages, presentation, content, importance, prior), a row for each element path
    of a host that holds text.

    With c of the m pages of a path holding a block, the block has the self-information ln(m / c). Content is one less the
    inverse exponential of its mean over the blocks of the branch, presentation the same of the entropy of the path's styles.
    """
    seen = told.where("site is not null")
    feature = lambda kind, path, what: F.struct(F.lit(kind).alias("kind"), path.alias("path"), what.alias("feature"))
    features = F.concat(
        F.transform("paths", lambda p: feature("page", p["path"], F.coalesce((p["prior"] * 1000).cast("long"), F.lit(-1).cast("long")))),
        F.transform("blocks", lambda b: feature("text", b["path"], F.xxhash64(b["text"]))),
        F.transform("styles", lambda s: feature("style", s["path"], s["style"])),
    )
    rows = seen.select("site", "page", F.explode(features).alias("f")).select("site", "page", "f.*").distinct()
    counted = rows.groupBy("site", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    spread = counted.groupBy("site", "path").agg(
        F.sum(F.when(F.col("kind") == "page", F.col("c"))).alias("m"),
        (F.sum(F.when((F.col("kind") == "page") & (F.col("feature") >= 0), F.col("c") * F.col("feature"))) / F.sum(F.when((F.col("kind") == "page") & (F.col("feature") >= 0), F.col("c"))) / 1000).alias("prior"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).alias(name) for kind, name, value in (("text", "blocks", F.col("c")), ("text", "block_sum", F.col("c") * F.ln("c")), ("style", "styles", F.col("c")), ("style", "style_sum", F.col("c") * F.ln("c")))],
    ).where("m is not null")
    chains = seen.select("site", F.explode("paths").alias("p")).groupBy("site", F.col("p.path").alias("path")).agg(F.first("p.above").alias("above"))
    known = spread.join(chains, ["site", "path"])
    own = known.where("blocks > 0").select("site", "blocks", (F.col("blocks") * F.ln("m") - F.col("block_sum")).alias("information"), F.explode("above").alias("path"))
    branches = own.groupBy("site", "path").agg(F.sum("blocks").alias("held"), F.sum("information").alias("information"))
    presentation = F.when(F.col("styles") > 0, 1 - F.exp(F.col("style_sum") / F.col("styles") - F.ln("styles"))).otherwise(F.lit(0.0))
    content = 1 - F.exp(-F.col("information") / F.col("held"))
    both = known.join(branches, ["site", "path"]).select("site", "path", F.col("m").alias("n_pages"), presentation.alias("presentation"), content.alias("content"), "prior")
    return both.withColumn("importance", (1 - DAMPING) * F.col("presentation") + DAMPING * F.col("content"))


def low_branches(tree: DataFrame, low: float = LOW_IMPORTANCE, say: float = SAY) -> DataFrame:
    """(site, low): the paths of each host's tree whose importance times prior is below `low`."""
    more = F.col("n_pages") - 1
    importance = (more * F.col("importance") + say * UNJUDGED) / (more + say)
    return tree.where(importance * F.col("prior") < low).groupBy("site").agg(F.collect_set("path").alias("low"))


def main_text(blocks: Column) -> Column:
    """The article of kept blocks, one block a line: article elements unless the rest of the main element, or failing one
    the prose of the page, is longer."""
    of = lambda *zones: F.array_join(F.transform(F.filter(blocks, lambda b: b["zone"].isin(*zones)), lambda b: b["text"]), "\n")
    article, main, prose = of(ARTICLE), of(MAIN), of(PROSE)
    rest = F.when(main != "", main).otherwise(prose)
    return F.when((article != "") & (F.length(article) >= F.length(rest)), article).when(main != "", of(MAIN, ARTICLE)).otherwise(of(OUTSIDE, PROSE, ARTICLE))


def extract(pages: DataFrame, *carried: Column, url: str = "url", html: str = "html", low: float = LOW_IMPORTANCE, say: float = SAY) -> DataFrame:
    """`carried` columns and the main text of every page."""
    told = stored(parsed(pages, *carried, url=url, html=html))
    noise = stored(low_branches(style_tree(told), low, say))
    judged = told.join(noise, "site", "left")
    # Without a host there is no tree, and every importance is that of what is not judged.
    untold = F.transform(F.filter("paths", lambda p: p["prior"] * UNJUDGED < low), lambda p: p["path"])
    out = F.when(F.col("site").isNull(), untold).otherwise(F.coalesce("low", F.array().cast("array<bigint>")))
    gone = F.transform(F.filter("paths", lambda p: F.arrays_overlap(p["above"], F.col("out"))), lambda p: p["path"])
    cut = judged.withColumn("out", out).withColumn("gone", gone)
    kept = F.filter("blocks", lambda b: ~F.array_contains("gone", b["path"]))
    return cut.select("row", kept.alias("kept")).select(*[F.col(f"row.carried_{i}") for i in range(len(carried))], main_text(F.col("kept")).alias("text"))
