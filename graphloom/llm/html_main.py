"""Main text of web pages, with site templates removed.

Element subtrees are hashed in every page, bottom up, and counted per host in Spark, over different
pages: copies of one page count once. Subtrees that recur across many pages of a host are its template
and are deleted. So are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, by their tags or by a word of their class, id or role that names them whole
(``sidebar``, ``site-footer``, ``comment-list``; not ``with-sidebar`` or ``share-price``). What is left
of the article (``article``, else ``main``, else ``body``) is its main text.

Prose inside an article (paragraphs, headings, lists, tables and the like) is never a template, nor is
a subtree with a quarter or more of an article's text, or most of a page's that has no article. Where
names of classes would leave nothing, they are not heeded.

Null or empty html gives the empty text. A page without a host has the empty host. Markup may be
unclosed, ill nested and of any depth. Repeated pages are extracted one by one, ties can't arise, and
null keys stay null. Columns other than key, url and html are ignored, whatever their names. A page is
held by one task, however long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import require, stored

#: A subtree is a template if so many different pages of the host, and so large a share of them, have it.
#: The share also bounds a host's templates: at most 1 / MIN_SHARE times a page's subtrees.
MIN_PAGES, MIN_SHARE = 8, 0.05
#: The share of an article's text, or of a page's without article, from which a subtree is no template.
MOST_OF_ARTICLE, MOST_OF_PAGE = 0.25, 0.8
#: Hashes of templates up to which they are broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

# Element kinds of the HTML standard, and names that sites use for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table ul ol dl".split())
PARTS = frozenset("caption dd dt legend li option tbody td tfoot th thead tr".split())
DROPPED = frozenset("applet aside audio button datalist dialog embed fieldset footer form frame frameset head header iframe input menu nav noscript optgroup option script select style svg template textarea title video".split())
NAMES = frozenset("ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended related replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
UNSURE = frozenset("banner header related search share social".split())  # what prose of an article may be called as well
HOLDERS = frozenset("area bar block bottom box btn button buttons container content form group holder icons inner item items left link links list message msg notice outer overlay panel posts right row section slot thread top unit wrap wrapper zone".split())
SITE = frozenset("bottom global main mobile page post primary secondary site top user reader".split())
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"tbody", "tr", "td", "th"}),
}
ENDS_P = BLOCKS - frozenset("body caption head html legend option tbody td tfoot th thead title tr".split())
_P = frozenset({"p"})
SCOPES = frozenset("article body div html main section table td th ul ol dl aside nav header footer form blockquote".split())

# A token ends where the standard's tokeniser ends it: a quotation mark opens a value only straight after an equals
# sign. Nothing is read twice (no quantifier gives back), so the time is linear in the page. A quoted value that
# never ends is taken for names.
_ATTRIBUTE = r"[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:{_ATTRIBUTE})*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|<|[^<]++", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CUT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


class Element:
    """``size`` counts the characters of text outside dropped elements; ``digest`` stands for the whole subtree."""

    __slots__ = ("tag", "start", "children", "named", "holds_main", "size", "digest")

    def __init__(self, tag: str, start: str, named: int) -> None:
        self.tag, self.start, self.children, self.named, self.holds_main, self.size, self.digest = tag, start, [], named, False, 0, b""

    def finish(self) -> None:
        """Size and digest, from those of the children."""
        told = hashlib.blake2b(" ".join(self.start.split()).encode("utf-8", "surrogatepass"), digest_size=8)
        for child in self.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                self.size += len(text)
                told.update(b"\0" + text.encode("utf-8", "surrogatepass") if text else b"")
            else:
                self.size += 0 if child.tag in DROPPED else child.size
                told.update(b"\1" + child.digest)
        self.digest = told.digest()

    @property
    def number(self) -> int:
        return int.from_bytes(self.digest, "little", signed=True)


def names_furniture(token: str) -> bool:
    """Whether one word of a class, id or role names page furniture as a whole."""
    parts = [p.lower() for p in _CUT.split(token) if p]
    if len(parts) == 1:
        return parts[0] in NAMES
    if len(parts) != 2:
        return False
    first, last = parts
    return first in NAMES and (last in HOLDERS or last in NAMES or last.isdigit()) or last in NAMES and first in SITE


def _is_named(attributes: str) -> int:
    """2 if a name tells furniture, 1 if only names do that prose may have as well, else 0."""
    if "=" not in attributes:
        return 0
    told = 0
    for m in _NAMED.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").split():
            if names_furniture(word):
                told = max(told, 1 if word.lower() in UNSURE else 2)
    return told


def parse(page: str) -> Element:
    """The tree of a page: children are elements and texts; unclosed elements end with their parent."""
    root = Element("#root", "", 0)
    stack, at, size = [root], 0, len(page)
    depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
    scopes: list[int] = []  # depths of those that hold off end tags of others

    def close(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            depths[element.tag].pop()
            if element.tag in SCOPES:
                scopes.pop()
            element.finish()

    def open_(element: Element) -> None:
        depths[element.tag].append(len(stack))
        if element.tag in SCOPES:
            scopes.append(len(stack))
        stack.append(element)

    def barrier(passed: frozenset[str]) -> int:
        """Depth of the innermost scope that is none of these."""
        return next((d for d in reversed(scopes) if stack[d].tag not in passed), 0)

    while at < size:
        m = _TOKEN.match(page, at)
        start, at = at, m.end()
        tag = m[2]
        if tag is None:
            if page[start] != "<" or at - start == 1:
                stack[-1].children.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if depths[tag] and (tag in BLOCKS or depths[tag][-1] >= (scopes[-1] if scopes else 0)):
                close(depths[tag][-1])
            continue
        closing = CLOSES.get(tag) or (_P if tag in ENDS_P else None)
        if closing:
            once = closing is _P or tag in ("li", "option", "dt", "dd", "td", "th")
            while (depth := max((depths[x][-1] for x in closing if depths[x]), default=0)) > barrier(closing):
                close(depth)
                if once:
                    break
        element = Element(tag, m[0], 0 if tag in ("html", "body", "main") else _is_named(m[3]))
        stack[-1].children.append(element)
        if tag in ("article", "main"):
            for above in reversed(stack):
                if above.holds_main:
                    break
                above.holds_main = True
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else size])
            at = end.start() if end else size
            open_(element)
        elif tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            element.finish()
        else:
            open_(element)
    close(1)
    root.finish()
    return root


def _may_recur(element: Element, inside: int, whole: int) -> bool:
    """Whether a subtree can be a template; ``inside``: size of the article around it, if any, ``whole``: of the page."""
    if element.holds_main or element.tag not in BLOCKS or element.tag in PARTS or element.tag in ("html", "head", "body", "article", "main"):
        return False
    if inside:
        return element.tag not in PROSE and element.size < MOST_OF_ARTICLE * inside
    return element.size < MOST_OF_PAGE * whole


def candidates(page: str) -> set[int]:
    """Hashes of the subtrees that can be a template of the site."""
    out: set[int] = set()
    root = parse(page)
    waiting = [(root, 0)]
    while waiting:
        element, inside = waiting.pop()
        for child in element.children:
            if not isinstance(child, str) and child.tag not in DROPPED:
                if _may_recur(child, inside, root.size):
                    out.add(child.number)
                waiting.append((child, child.size if child.tag in ("article", "main") and not inside else inside))
    return out


def main_text(page: str | None, templates: set[int]) -> str:
    """Blocks of the article in page order, two line feeds between them."""
    if not page:
        return ""
    root = parse(page)
    return _text(root, templates, True) or _text(root, templates, False)


def _text(root: Element, templates: set[int], by_name: bool) -> str:
    def dropped(e: Element, inside: int) -> bool:
        if e.tag in DROPPED and not e.holds_main:
            return True
        if by_name and e.named > (1 if inside and e.tag in PROSE else 0) and not e.holds_main:
            return True
        return bool(templates) and _may_recur(e, inside, root.size) and e.number in templates

    def regions(tag: str) -> list[Element]:
        """The outermost elements of this kind."""
        out, waiting = [], [root]
        while waiting:
            element = waiting.pop()
            if element.tag == tag:
                out.append(element)
            else:
                waiting += [c for c in reversed(element.children) if not isinstance(c, str) and not dropped(c, 0)]
        return out

    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(words)).split()):
            blocks.append(text)
        words.clear()

    for region in regions("article") or regions("main") or [root]:
        inside = 0 if region is root else region.size
        path = [(region, iter(region.children))]
        while path:
            element, children = path[-1]
            child = next(children, None)
            if child is None:
                path.pop()
                if element.tag in BLOCKS:
                    flush()
            elif isinstance(child, str):
                words.append(child)
            elif child.tag == "br":
                words.append(" ")
            elif not dropped(child, inside):
                if child.tag in BLOCKS:
                    flush()
                path.append((child, iter(child.children)))
        flush()
    return "\n\n".join(blocks)


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def site_templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, hashes of the subtrees that recur across its different pages; a stored table."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(candidates(t)) for t in texts])

    hosts = pages.select(host_of(url).alias("host"), F.coalesce(F.col(page), F.lit("")).alias("page"))
    # The null hash counts the pages themselves, in the same aggregation.
    seen = hosts.select("host", F.xxhash64("page").alias("of"), F.explode(F.array_append(hashed("page"), F.lit(None).cast("long"))).alias("hash"))
    counted = seen.distinct().groupBy("host", "hash").count()
    often = stored(counted.filter(F.col("hash").isNull() | (F.col("count") >= MIN_PAGES)), "recurring-subtrees")
    pages_of = often.filter(F.col("hash").isNull()).select("host", F.col("count").alias("pages"))
    templates = often.filter(F.col("hash").isNotNull()).join(pages_of, "host").filter(F.col("count") >= MIN_SHARE * F.col("pages"))
    return stored(templates.groupBy("host").agg(F.collect_list("hash").alias("templates")), "site-templates")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row."""
    require(pages, (key, url, page))

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, templates in batches:
            yield pd.Series([main_text(t, set() if h is None else set(h)) for t, h in zip(texts, templates, strict=True)], dtype=object)

    templates = site_templates(pages, url, page).withColumnRenamed("host", "_host")
    hashes = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0))).first()[0]
    rows = pages.select(key, url, page, host_of(url).alias("_host"))
    # Beyond the bound both sides are plain exchanges, so Spark splits a hot host.
    joined = rows.join(F.broadcast(templates) if hashes <= MOST_BROADCAST else templates, "_host", "left")
    out = joined.select(key, url, extracted(F.col(page), F.col("templates")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
