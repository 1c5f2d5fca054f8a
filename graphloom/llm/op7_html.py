"""HTML main-text extraction with site template removal.

Pages are parsed in tasks, in linear time. Every container's subtree is hashed from its name, class, id and the
hashes of what it holds, in two forms: with its text, and by form alone. Spark counts both per host over the
distinct article texts around them, and subtrees that recur in many such contexts are deleted as templates: by
their text anywhere, and by form alone only outside the article, where text may vary from page to page. Copies of
an article are one context, whatever number or token their pages carry outside its text. Paragraphs, headings,
cells and items are never templates by themselves, so passages that articles share stay, and no subtree goes that
holds most of its page's text.

Hosts with few pages give no counts. For them the fixed rules remain: elements that are no article text by
their name or role, and those whose class or id consists of words for such parts alone.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, table
from graphloom.llm.op2_urls import split_url

#: A subtree is a template if it stands in so many distinct texts of a host.
LEAST_PAGES = 8
#: Templates are broadcast up to so many rows, which are bounded in bytes, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
#: The article or main elements of a page are its text if they hold at least this share of what is no chrome.
ROOT_SHARE = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose text is never article text and doesn't even count for templates.
SILENT = RAW | frozenset("head noscript template button select option label svg canvas object audio video datalist map".split())
#: Blocks that are never article text by their name.
CHROME = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROOTS = frozenset(("article", "main"))
CONTAINERS = BLOCKS - ROOTS - frozenset("html body p h1 h2 h3 h4 h5 h6 hr li td th tr dt dd".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
#: An open element of these kinds hides those outside it from CLOSES.
SCOPES = frozenset("ul ol dl table article section main body div blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words for parts that are no article text, and words that may stand beside them in a class or id.
PARTS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond replies disqus breadcrumb breadcrumbs pagination pager toolbar widget disclaimer skip".split()
)
BESIDE = frozenset("main site page top bottom left right primary secondary global box bar list area wrap wrapper container block item section inner outer links form thread slot unit".split())
WORDS = re.compile(r"[-_]+")
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def is_part(value: str) -> bool:
    """Whether a class or id has a name that consists of words of PARTS and BESIDE alone, of one of PARTS at least."""
    for name in value.lower().split():
        words = WORDS.split(name.strip("-_"))
        if not PARTS.isdisjoint(words) and all(w in PARTS or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "big", signed=True)


class Element:
    """An open element: its name, identity, whether its text is silent, chrome or in a root, its first block, and
    the hashes of what it holds so far."""

    __slots__ = ("chrome", "first", "form", "name", "part", "rooted", "silent", "text")

    def __init__(self, name: str, identity: bytes, silent: bool, chrome: bool, rooted: bool, part: bool, first: int):
        self.name, self.silent, self.chrome, self.rooted, self.part, self.first = name, silent, chrome, rooted, part, first
        self.text, self.form = hashlib.blake2b(identity, digest_size=8), hashlib.blake2b(b"form:" + identity, digest_size=8)

    def hold(self, text: bytes, form: bytes) -> None:
        self.text.update(text)
        self.form.update(form)


class Page:
    """Text blocks of a page in order, and the containers above them.

    blocks: texts. chrome, rooted: per block, whether a fixed rule by name or role excludes it, and whether it
    stands in an article or main element. parts: (first block, end block, has a root) of elements that are no
    article text by class or id. subtrees: (hash with text, hash of the form, first block, end block, in a root)
    of every container with text, children before parents."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.chrome: list[bool] = []
        self.rooted: list[bool] = []
        self.parts: list[tuple[int, int, bool]] = []
        self.subtrees: list[tuple[int, int, int, int, bool]] = []
        self._roots: list[int] = []
        self._text: list[str] = []
        self._open = [Element("", b"", False, False, False, False, 0)]
        self._names: Counter[str] = Counter()
        self._parse(source)

    def _flush(self) -> None:
        if self._text:
            if block := " ".join("".join(self._text).split()):
                top = self._open[-1]
                self.blocks.append(block)
                self.chrome.append(top.chrome)
                self.rooted.append(top.rooted)
                top.hold(block.encode("utf-8", "replace") + b"\0", b"#")
            self._text = []

    def _close(self) -> None:
        top = self._open[-1]
        if top.name in BLOCKS:
            self._flush()
        self._open.pop()
        self._names[top.name] -= 1
        text, form = top.text.digest(), top.form.digest()
        self._open[-1].hold(text, form)
        if top.silent or len(self.blocks) == top.first:
            return
        if top.name in CONTAINERS:
            self.subtrees.append((int.from_bytes(text, "big", signed=True), int.from_bytes(form, "big", signed=True), top.first, len(self.blocks), top.rooted))
        if top.part:
            self.parts.append((top.first, len(self.blocks), bool(self._roots) and self._roots[-1] >= top.first and not top.rooted))

    def _parse(self, source: str) -> None:
        at, stack, balanced = 0, self._open, True
        while True:
            lt = source.find("<", at)
            end = len(source) if lt < 0 else lt
            if end > at and not stack[-1].silent:
                run = source[at:end]
                self._text.append(html.unescape(run) if "&" in run else run)
            if lt < 0:
                break
            if m := TAG.match(source, lt + 1):
                inside = INSIDE.match(source, m.end()) if balanced else None
                close = inside.end() if inside else source.find(">", m.end())
                if inside and close == len(source):  # a quote without an end: take the tag up to the next >
                    balanced, close = False, source.find(">", m.end())
                if close < 0:
                    break
                at = close + 1
                at = self._tag(m[2].lower(), bool(m[1]), source[m.end() : close], source, at)
            elif source.startswith(("<!", "<?", "</"), lt):
                mark, stop = ("<!--", "-->") if source.startswith("<!--", lt) else ("<![CDATA[", "]]>") if source.startswith("<![CDATA[", lt) else ("<!", ">")
                close = source.find(stop, lt + len(mark))
                at = len(source) if close < 0 else close + len(stop)
            else:
                if not stack[-1].silent:
                    self._text.append("<")
                at = lt + 1
        while len(stack) > 1:
            self._close()
        self._flush()

    def _tag(self, tag: str, closing: bool, attributes: str, source: str, at: int) -> int:
        """Take a tag; returns where the text goes on."""
        stack = self._open
        if closing:
            if tag != "br" and self._names[tag] > 0:
                while stack[-1].name != tag:
                    self._close()
                self._close()
            return at
        if tag in BLOCKS:
            if self._names["p"] > 0 or any(self._names[x] > 0 for x in CLOSES.get(tag, ())):
                self._imply(tag)
            if not stack[-1].silent:
                self._flush()
        top = stack[-1]
        if tag in VOID:
            if tag == "br" and not top.silent:
                self._text.append(" ")
            return at
        if attributes.endswith("/") and tag in ("svg", "math"):
            return at
        found = {n.lower(): a or b or c for n, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        keeps = tag in ("html", "body") or tag in ROOTS and not top.rooted
        silent = top.silent or tag in SILENT
        chrome = top.chrome or tag in CHROME or not keeps and found.get("role", "").strip().lower() in ROLES
        rooted = top.rooted
        if tag in ROOTS and not silent and not chrome:
            rooted = True
            self._roots.append(len(self.blocks))
        part = not keeps and (is_part(found.get("class", "")) or is_part(found.get("id", "")))
        silent = silent or part and tag not in BLOCKS  # within a block, a part has no block of its own
        identity = "\0".join((tag, found.get("class", ""), found.get("id", ""))).encode("utf-8", "replace")
        stack.append(Element(tag, identity, silent, chrome, rooted, part, len(self.blocks)))
        self._names[tag] += 1
        if tag in RAW:
            end = RAW_END[tag].search(source, at)
            return end.start() if end else len(source)
        return at

    def _imply(self, tag: str) -> None:
        """Close what an opening block ends without an end tag: an open paragraph, a list item, a cell."""
        ends = CLOSES.get(tag, ())
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i].name
            if name == "p" or name in ends:
                while len(self._open) > i:
                    self._close()
                if name != "p" and self._open[i - 1].name not in ends or not any(self._names[x] > 0 for x in ("p", *ends)):
                    break
            elif name in SCOPES:
                break

    def _sizes(self, alive: list[bool]) -> list[int]:
        return [0, *itertools.accumulate(len(b) * keep for b, keep in zip(self.blocks, alive, strict=True))]

    def article(self) -> list[bool]:
        """Per block, whether it is in the article by the fixed rules: no chrome, no part by class or id (unless a
        root stands in it, or all text of the page does), and in a root if the page has one with enough text."""
        plain = [not c for c in self.chrome]
        alive = list(plain)
        for first, end, has_root in self.parts:
            if not has_root:
                alive[first:end] = [False] * (end - first)
        if not any(alive):
            alive = plain
        inside = [a and r for a, r in zip(alive, self.rooted, strict=True)]
        return inside if self._sizes(inside)[-1] > ROOT_SHARE * self._sizes(alive)[-1] else alive

    def contexts(self) -> set[tuple[int, int]]:
        """(hash of a subtree, hash of the article's text outside it): of its text, and of the form of those outside
        the article."""
        sums, article = [0], self.article()
        for block, inside in zip(self.blocks, article, strict=True):
            sums.append(sums[-1] + (digest(block.encode("utf-8", "replace")) if inside else 0))
        wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
        found = set()
        for text, form, first, end, rooted in self.subtrees:
            around = wrap(sums[-1] - sums[end] + sums[first])
            found.add((text, around))
            if self._roots and not rooted and not any(article[first:end]):
                found.add((form, around))
        return found

    def kept(self, templates: frozenset[int] | set[int] = frozenset()) -> tuple[list[bool], list[bool]]:
        """Per block, whether a template holds it, and whether it is main text: in the article and in no template.
        A subtree with more than half of the article's text is no template."""
        alive = self.article()
        sizes, gone = self._sizes(alive), [False] * len(self.blocks)
        for text, form, first, end, rooted in self.subtrees:
            outside = bool(self._roots) and not rooted and sizes[end] == sizes[first]
            if (text in templates or outside and form in templates) and 2 * (sizes[end] - sizes[first]) <= sizes[-1]:
                gone[first:end] = [True] * (end - first)
        return gone, [a and not g for a, g in zip(alive, gone, strict=True)]

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        return "\n".join(b for b, keep in zip(self.blocks, self.kept(templates)[1], strict=True) if keep)


def subtree_rows(pages: DataFrame) -> DataFrame:
    """host, subtree, context: distinct pairs of a page's containers and the texts around them, as hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, found, around = [], [], []
            for host, source in zip(b.column("host"), b.column("html"), strict=True):
                pairs = Page(source.as_py()).contexts()
                hosts += [host.as_py()] * len(pairs)
                found += [p[0] for p in pairs]
                around += [p[1] for p in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(around, pa.int64())], ["host", "subtree", "context"])

    return pages.select("host", "html").mapInArrow(work, "host string, subtree long, context long")


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, subtree of every template of `pages` (host, html without nulls). Pages with equal text around a subtree
    count once, so that copies of an article make no template; counts are summed up before each shuffle, so a
    host with a third of all pages isn't gathered anywhere. No pages give no templates."""
    seen = subtree_rows(pages).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") >= least_pages).select("host", "subtree")


def with_templates(pages: DataFrame, least_pages: int) -> DataFrame:
    """page_id, url, html (null: empty), templates (hashes of its host) of every page. The templates are written
    first: up to BROADCAST_ROWS of them are broadcast, and more are joined by shuffle, in which a host with a
    third of all pages is a skewed key that AQE splits."""
    host, _ = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    templates = cut(site_templates(rows, least_pages))
    per_host = cut(templates.groupBy("host").agg(F.collect_list("subtree").alias("templates")))
    if templates.count() <= BROADCAST_ROWS:
        per_host = F.broadcast(per_host)
    return rows.join(per_host, "host", "left").select("page_id", "url", "html", "templates")


def extract_pages(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A null or empty html has an empty text. A null url, or one without '://', belongs to the empty host.
    Repeated rows get equal results. Pages of any length and depth are parsed whole. An empty table gives an empty
    result; other columns are ignored. If article or main elements hold enough of a page's text, other text goes.
    A tag that never ends, to the end of the page, goes with what is behind it; a quote that never closes ends
    with its tag."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(s.as_py()).text(frozenset(t.as_py() or ())) for s, t in zip(b.column("html"), b.column("templates"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_templates(pages, least_pages).mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")


def template_shares(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, n_blocks, n_template (blocks that templates hold), n_template_only (those of them that the fixed
    rules alone would keep) for every row: what the removal of templates does. Rows as in extract_pages()."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for s, t in zip(b.column("html"), b.column("templates"), strict=True):
                page = Page(s.as_py())
                gone, _ = page.kept(frozenset(t.as_py() or ()))
                found.append((len(gone), sum(gone), sum(g and a for g, a in zip(gone, page.article(), strict=True))))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], ["page_id", "n_blocks", "n_template", "n_template_only"])

    return with_templates(pages, least_pages).mapInArrow(work, f"page_id {kind}, n_blocks long, n_template long, n_template_only long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
