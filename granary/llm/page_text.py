"""Main text of web pages by host-wide consensus on the container's path."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import quoted, ready_workers, rows_of, stored, to_batches

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN = frozenset(
    "head title script style noscript template iframe noembed noframes object svg math canvas audio video map "
    "input button select textarea label fieldset option datalist dialog nav aside footer menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: What may stand in a head; anything else ends one that is still open.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
#: The page itself is the outermost container, so text outside a body counts too.
ROOT = "page"
CONTAINERS = frozenset(f"article main section div td body center blockquote {ROOT}".split())
SEMANTIC = frozenset("article main".split())
# An open p is closed by these, an open element of the key by its values.
CLOSES_P = BLOCKS - frozenset("html body".split()) - frozenset("tbody td tfoot th thead tr".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
# Words of class, id and role names that mark what isn't the article.
NOISE = frozenset(
    "ad ads advert advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist disqus "
    "consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion related recommended respond rail reader replies reply share sharing sidebar "
    "sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert alerts "
    "complementary contentinfo search login".split()
)
KEEP = frozenset("article content main post entry story body text".split())
#: First words of names that tell of the layout, as in "has-sidebar", and last ones
#: that tell of its state, as in "comments-open".
LAYOUT = frozenset("has with no without".split())
STATES = frozenset("open opened closed enabled disabled on off".split())
#: Noise only outside an article, and never on a heading or beside an article word.
HEADERS = frozenset("header masthead".split())
HEADED = frozenset("article entry post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own rules hold inside: a slash closes a tag, a title is no page title.
FOREIGN = frozenset("svg math".split())
#: Open elements at most; a deeper one takes the innermost one's place.
DEPTH = 256
#: A form with at least this share of a page's characters is around the page.
FORM_SHARE = 0.75

#: Blocks that are parts of an article wherever they stand beside its text.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup blockquote figure figcaption p pre dl ul ol table".split())
# A container beside the text is a part of the article from so many
# characters and such a share of the text on, in a body from a larger share; text
# is taken in if so much of it is article text.
PART_CHARS, PART, PAGE_PART, PART_SHARE = 80, 0.05, 0.25, 0.66

_MARK = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_STEP = re.compile(r"""=\s*["']|>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Element:
    """An element of a page; its path has the block elements around it."""

    tag: str
    path: str
    hidden: bool
    parent: Element | None
    link: bool = False
    #: Named by a noise word and an article word: no part of a container around it.
    mixed: bool = False
    #: The outermost form around it, and whether it is in or is svg or math.
    form: Element | None = None
    foreign: bool = False


@dataclass
class Page:
    """The visible blocks of a page in order, each with the element it is in, and
    the characters of each that are in links."""

    blocks: list[tuple[Element, str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        found.setdefault(name.lower(), html.unescape(value).lower())
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes without digits, so numbered classes are one path."""
    classes = sorted({re.sub(r"[0-9]+", "", c).strip("-_") for c in attributes.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


def _noisy(tag: str, attributes: dict[str, str], parent: Element | None) -> bool:
    if tag in HIDDEN:
        return True
    names, noise, comments, headed = _names(tag, attributes, parent)
    if tag == "header" and not headed and not _inside(parent, SEMANTIC):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if tag in ("body", "html"):
        return False
    return comments or noise and not _mixed(tag, attributes, parent)


def _mixed(tag: str, attributes: dict[str, str], parent: Element | None) -> bool:
    names, noise, _, _ = _names(tag, attributes, parent)
    return noise and tag in BLOCKS and tag not in ("body", "html") and (tag in SEMANTIC or bool(names & KEEP))


def _names(tag: str, attributes: dict[str, str], parent: Element | None) -> tuple[set[str], bool, bool, bool]:
    """Words of an element's names; whether a name has one of noise, one of reader
    comments, and an article word beside a header word, as "entry-header" has."""
    names, noise, comments, headed = set(), False, False, False
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").split():
            words = set(found := _WORDS.findall(name))
            names |= words
            if not found or found[0] in LAYOUT or len(found) > 1 and found[-1] in STATES:
                continue
            title = bool(words & HEADERS and words & HEADED)
            headed |= title
            if title or words & HEADERS and (tag in HEADINGS or _inside(parent, SEMANTIC)):
                words -= HEADERS
            noise |= not NOISE.isdisjoint(words)
            comments |= not words.isdisjoint(("comment", "comments"))
    return names, noise, comments, headed


def _inside(element: Element | None, tags: frozenset[str]) -> bool:
    while element is not None:
        if element.tag in tags:
            return True
        element = element.parent
    return False


class Tags:
    """The tags of a page one after the other, in time linear in its length.

    Quotes count behind an equals sign only. A quote that nothing closes ends with
    its tag; once quotes have hidden the end of all tags that follow, they no
    longer count. What follows the opening of a tag without an end is no text.
    """

    def __init__(self, source: str):
        self.source = source
        self.missing: set[str] = set()
        self.quotes = True

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag; the
        name is empty for comments and declarations, None means no further tag."""
        found = _MARK.search(self.source, at)
        if not found:
            return None
        if not found[2]:
            mark = "-->" if found[0] == "<!--" else ">"
            end = self.source.find(mark, found.end())
            return found.start(), end + len(mark) if end >= 0 else len(self.source), False, "", ""
        end = self._end(found.end())
        if end < 0:
            return found.start(), len(self.source), False, "", ""
        return found.start(), end + 1, bool(found[1]), found[2].lower(), self.source[found.end() : end]

    def _end(self, begin: int) -> int:
        at = begin
        while self.quotes:
            step = _TAG_STEP.search(self.source, at)
            if not step:
                self.quotes = False
                break
            if step[0] == ">":
                return step.start()
            mark = step[0][-1]
            close = -1 if mark in self.missing else self.source.find(mark, step.end())
            if close < 0:
                self.missing.add(mark)
                at = step.end()
            else:
                at = close + 1
        return self.source.find(">", begin)


def parse(source: str) -> Page:
    """Blocks of visible text of a page, however badly its tags are closed."""
    root = Element(ROOT, ROOT, False, None)
    page = Page()
    stack = [root]
    text: list[str] = []
    linked = 0
    tags = Tags(source)
    paths: dict[str, str] = {}

    def add(part: str) -> None:
        nonlocal linked
        text.append(part)
        linked += len(part) * stack[-1].link

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                owner = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
                page.blocks.append((owner, block))
                page.linked.append(linked)
            linked = 0

    def pop(tags: frozenset[str], stops: frozenset[str] = CONTAINERS) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in tags:
                flush()
                del stack[at:]
                return
            if stack[at].tag in stops and stack[at].tag not in tags:
                return

    at = 0
    while at < len(source):
        found = tags.after(at)
        if found is None:
            if not stack[-1].hidden or stack[-1].tag == "head":
                add(source[at:])
            break
        start, end, closing, tag, raw = found
        if stack[-1].tag == "head" and source[at:start].strip():
            stack.pop()
        hidden = stack[-1].hidden
        if not hidden and start > at:
            add(source[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag in BLOCKS and not hidden:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in BLOCKS and not hidden:
                        flush()
                    del stack[k:]
                    break
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
            hidden = stack[-1].hidden
        if tag == "br" or tag == "wbr":
            if not hidden:
                text.append(" " if tag == "br" else "")
            continue
        attributes = _attributes(raw)
        if tag in BLOCKS and not hidden:
            flush()
        if tag in CLOSES_P:
            pop(frozenset(["p"]))
        if tag in CLOSES:
            pop(CLOSES[tag], CONTAINERS | {"ul", "ol", "dl", "table"})
        hidden = stack[-1].hidden
        if tag in VOID:
            continue
        if len(stack) > DEPTH:
            if stack[-1].tag in BLOCKS:
                flush()
            stack.pop()
        parent = stack[-1]
        step = _step(tag, attributes) if tag in BLOCKS else ""
        path = f"{parent.path}>{step}" if step else parent.path
        path = paths.setdefault(path, path)
        element = Element(tag, path, hidden or _noisy(tag, attributes, parent), parent, tag == "a" or parent.link)
        element.mixed = not element.hidden and _mixed(tag, attributes, parent)
        element.form = parent.form or (element if tag == "form" else None)
        element.foreign = parent.foreign or tag in FOREIGN
        empty = raw.rstrip().endswith("/") and (element.foreign or tag not in BLOCKS and tag not in RAW)
        if not empty:
            stack.append(element)
        if tag in RAW and not element.foreign:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = close.start() if close else len(source)
    flush()
    return _without_forms(page)


def _without_forms(page: Page) -> Page:
    """The page without the text of its forms, but for one around the page."""
    sizes: dict[int, int] = {}
    for element, block in page.blocks:
        key = id(element.form) if element.form else 0
        sizes[key] = sizes.get(key, 0) + len(block)
    least = FORM_SHARE * sum(sizes.values())
    kept = [k for k, (e, _) in enumerate(page.blocks) if not e.form or sizes[id(e.form)] >= least]
    return Page([page.blocks[k] for k in kept], [page.linked[k] for k in kept])


def score(page: Page) -> dict[str, float]:
    """Score of each candidate path: a block's characters count fully for the
    container around its paragraph and half for the next one out, but not for one
    around an element that is named as noise."""
    totals: dict[str, float] = {}
    for element, block in page.blocks:
        weight, outer = float(len(block)), element
        while outer is not None and weight >= len(block) / 2:
            if outer.tag in CONTAINERS:
                totals[outer.path] = totals.get(outer.path, 0.0) + weight
                weight /= 2
            if outer.mixed:
                break
            outer = outer.parent
    return totals


def best_path(page: Page) -> str | None:
    """The page's own choice: its best-scored container, or the nearest article or
    main element around it, or else the container around all parts of an article.
    Equal scores go to the smaller path."""
    totals = score(page)
    if not totals:
        return None
    best = min(totals, key=lambda p: (-totals[p], p))
    steps = best.split(">")
    for k in range(len(steps), 0, -1):
        if steps[k - 1].split(".")[0] in SEMANTIC:
            return ">".join(steps[:k])
    return climbed(page, best)


def climbed(page: Page, best: str) -> str:
    """The outermost container whose text beside ``best`` is mostly article text.

    Goes outwards while at least ``PART_SHARE`` of the characters that a container
    adds are in headings, paragraphs, quotes and the like directly in it, or in
    other containers that are long, no lists of links and large beside the text
    so far; directly in a body, where a site's own boxes are, much larger.
    """
    chains = []
    for element, _ in page.blocks:
        chain, outer = [], element
        while outer is not None:
            if outer.tag in BLOCKS or outer.tag == ROOT:
                chain.append(outer)
            outer = None if outer.mixed else outer.parent
        chains.append(chain)
    inside = [any(e.path == best for e in chain) for chain in chains]
    around = next(chain for chain, within in zip(chains, inside) if within)
    size = sum(len(block) for (_, block), within in zip(page.blocks, inside) if within)
    at = next(k for k, e in enumerate(around) if e.path == best)
    for outer in around[at + 1 :]:
        if outer.tag not in CONTAINERS or all(inside):
            continue
        branches: dict[int, list] = {}
        for k, chain in enumerate(chains):
            if not inside[k] and (depth := next((d for d, e in enumerate(chain) if e.path == outer.path), None)) is not None:
                branch = chain[depth - 1] if depth else None
                found = branches.setdefault(id(branch), [branch, 0, 0, []])
                found[1] += len(page.blocks[k][1])
                found[2] += page.linked[k]
                found[3].append(k)
        added = sum(b[1] for b in branches.values())
        if not added:
            continue
        least = max(PART_CHARS, size * (PAGE_PART if outer.tag in ("body", ROOT) else PART))
        good = sum(
            n for branch, n, links, _ in branches.values()
            if links <= n / 3 and (branch is None or branch.tag in PARTS or branch.tag in CONTAINERS and n >= least)
        )
        if good < PART_SHARE * added:
            break
        best, size = outer.path, size + added
        for *_, blocks in branches.values():
            for k in blocks:
                inside[k] = True
    return best


def text_under(page: Page, path: str | None) -> str:
    """Blocks inside all elements of the path, in page order, without those in
    further elements that are named as noise."""
    if path is None:
        return ""
    inside: dict[int, bool] = {}

    def within(element: Element | None) -> bool:
        if element is None:
            return False
        known = inside.get(id(element))
        if known is None:
            known = inside[id(element)] = element.path == path or not element.mixed and within(element.parent)
        return known

    return "\n\n".join(block for element, block in page.blocks if within(element))


_VOTES = pa.schema([("host", pa.string()), ("vote", pa.string()), ("path", pa.string()), ("chars", pa.int64())])
_TEXTS = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()),
        ("own", pa.string()), ("own_text", pa.string()),
    ]
)


def _vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def votes() -> Iterator[tuple]:
        for host, source in rows_of(batches):
            page = parse(source or "")
            vote = best_path(page)
            if vote is not None:
                yield host, vote, vote, len(text_under(page, vote))
                for path in score(page):
                    if path != vote and not vote.startswith(f"{path}>"):
                        yield host, vote, path, 0

    return to_batches(votes(), _VOTES)


def _extract(batches: Iterable[pa.RecordBatch], other_layout: float) -> Iterator[pa.RecordBatch]:
    def texts() -> Iterator[tuple]:
        for page_id, url, host, source, path in rows_of(batches):
            page = parse(source or "")
            own = best_path(page)
            text, other = text_under(page, path), text_under(page, own)
            if text and other_layout * len(text) < len(other):
                yield page_id, url, host, text, own, other
            else:
                yield page_id, url, host, text or other, None, None

    return to_batches(texts(), _TEXTS, 512)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty if there is none; never fails."""
    return F.coalesce(
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")
    )


def host_votes(pages: DataFrame) -> DataFrame:
    """``host, vote, path, votes, chars``: what the pages of a vote have.

    The rows whose path is the vote count it; the others are containers of text
    on pages with that vote, outside of it. Counted in each task first, so a host
    with a third of all pages is a few rows.
    """
    ready_workers(pages.sparkSession)
    votes = pages.select(host_of(quoted("url").cast("string")).alias("host"), quoted("html").cast("string").alias("html"))
    return votes.mapInArrow(_vote, "host string, vote string, path string, chars bigint").groupBy(
        "host", "vote", "path"
    ).agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))


def winners(counted: DataFrame) -> DataFrame:
    rank = F.struct(-F.col("votes"), -F.col("chars"), F.col("path"))
    best = counted.where("path = vote").groupBy("host").agg(F.min(rank).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: the path with most pages' votes per host.

    Equal votes go to the path with more text, then to the smaller one.
    """
    return winners(host_votes(pages))


def page_texts(pages: DataFrame, other_layout: float = 2.0) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Each page is read by its host's path; a page without such an element falls
    back on its own best container, and so does a page of another layout: one
    whose own container has over ``other_layout`` times the text and isn't among
    what the host's other pages have beside their articles. A form's text counts
    only where one form holds ``FORM_SHARE`` of a page's characters. Menus, headers, footers,
    sidebars, notices, adverts, forms, comments, scripts and styles are left out;
    character references are decoded, white space inside a block is one space,
    blocks are joined by two line feeds. A null or empty html, or one without
    text, gives an empty text; a null or odd url counts as the host ''. Repeated
    rows come back repeated, an empty table gives no rows, other columns are
    ignored.
    """
    counted = stored(host_votes(pages), "host-votes")
    paths = stored(winners(counted), "host-paths")
    beside = stored(
        counted.where("path <> vote").join(paths.withColumnRenamed("path", "vote"), ["host", "vote"])
        .select("host", F.col("path").alias("own"), F.lit(True).alias("beside")),
        "beside",
    )
    rows = pages.select(
        quoted("page_id").cast("long").alias("page_id"),
        quoted("url").cast("string").alias("url"),
        quoted("html").cast("string").alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    read = (
        rows.join(paths, "host", "left")
        .select("page_id", "url", "host", "html", "path")
        .mapInArrow(lambda b: _extract(b, other_layout), "page_id bigint, url string, host string, text string, own string, own_text string")
    )
    alone = F.concat(F.lit("\n"), F.xxhash64("page_id", "url").cast("string"))  # no path has a line feed
    text = F.when(F.col("own_text").isNotNull() & F.col("beside").isNull(), F.col("own_text")).otherwise(F.col("text"))
    return (
        read.withColumn("own", F.coalesce("own", alone)).join(beside, ["host", "own"], "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.char_length("text").cast("bigint"))
    )
