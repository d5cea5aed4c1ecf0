"""Operator 6: main text of web pages by site style trees.

Each page's elements are taken as styled nodes: tag with class and role, named by their path from the root. The pages of one host make
up a site style tree: for each path, over the host's distinct pages, the entropy of the content below it (which texts, how often) and of its
presentation (which sequences of children, how often), each divided by the logarithm of the number of pages. The larger one is the
path's importance: 0 if all pages show the same, 1 if all differ. Branches of importance under IMPORTANCE on at least MIN_PAGES distinct pages
are cut from every page of the host; inside what a page marks as its article or main part, only where the page shows what COMMON_SHARE of
the pages show there, never all of it, and its h1 only with a branch around it. A branch is all that lies under one path, so repeated text in a paragraph like those of the article stays. Boilerplate whose text changes from page to page looks important to entropy, so nodes whose tag or
class says what they are (menus, adverts, footers, forms, comments ...) have no importance to begin with; where a page marks an article or a
main part, only that counts.

The tree is an aggregation by (host, path): a hot host is counted with partial sums, and copies of a page count once. The cut paths go
to all tasks if there are at most BROADCAST_PATHS, else they meet the pages in a join.

Results: null or empty html gives an empty text; a null url belongs to no site. Repeated rows get equal results; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, saved, tidy

IMPORTANCE = 0.2
MIN_PAGES = 8
COMMON_SHARE = 0.05
BROADCAST_PATHS = 50_000
MAX_DEPTH = 256
"""Elements nested deeper are taken as siblings at this depth."""
ARTICLE_SHARE = 0.25
"""What a page marks as article or main part is the main text if it holds so much of the text outside boilerplate; less is a teaser beside it."""
MAX_PATH = 400
"""Longer paths are named by their hash, so that a broadcast of BROADCAST_PATHS stays under 30 MB."""

# Element names of HTML and words that name boilerplate.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea noscript iframe noembed noframes xmp title".split())
_NEVER = frozenset("head nav aside footer form script style textarea noscript iframe noembed noframes xmp title template button select option datalist dialog menu svg canvas object audio video map input label fieldset".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising advertisements sponsor sponsored sponsors promo promos promotion banner banners menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars rail footer footers masthead comment comments commentlist disqus reply replies respond reader cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets search login toolbar pagination pager skip".split())
_OUTER = frozenset("header topbar top".split())
_LOOSE_P = frozenset("p li dt dd tr td th option".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)""", re.S)
_quoted_rest = re.compile(r"""((?:[^'">]|"[^"]*"|'[^']*')*+)>""")
_plain_rest = re.compile(r"([^>]*)>")
_attr = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_word = re.compile(r"[a-z0-9]+")
_host = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")

_styles: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def _style(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """(name of the styled node, boilerplate, boilerplate outside an article, marks the main part)."""
    got = _styles.get((tag, attrs))
    if got is None:
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attr.finditer(attrs)} if attrs else {}
        label = " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label"))
        words = set(_word.findall(_camel.sub(" ", label).lower()))
        name = ".".join([tag, *sorted(a.get("class", "").split()), *([a["role"]] if "role" in a else [])])
        hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)", _attr.sub(lambda m: m[1] + "=", attrs)) is not None if attrs else False
        main = tag in ("article", "main") or a.get("role") in ("main", "article")
        never = tag in _NEVER or hidden or bool(words & _NAMES) and tag not in ("html", "body") or a.get("role") in ("complementary", "contentinfo", "search")
        got = (name, never, tag == "header" or bool(words & _OUTER) and tag not in ("html", "body"), main)
        if len(_styles) > 20_000:
            _styles.clear()
        _styles[tag, attrs] = got
    return got


def blocks(page: str) -> Iterator[tuple[list, str]]:
    """(stack, text) of each block in page order. The stack lists the open nodes: (tag, path, boilerplate, in article, child names, in a block of boilerplate).

    Text of boilerplate inside a line of a block that is none (a button, a script, an advert's span) is left out of the block. Time is linear in
    the page: a quote that is never closed makes tags end at the next > from there on, and nesting has MAX_DEPTH levels.
    """
    stack: list[tuple] = [("", "", False, False, [], False)]
    text: list[str] = []
    at, end, rest = 0, len(page), _quoted_rest

    def add(piece: str) -> None:
        if piece and (stack[-1][5] or not stack[-1][2]):
            text.append(piece)

    def flush():
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        return joined

    while at < end:
        m = _token.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        attrs = rest.match(page, at)
        if attrs is None:
            rest = _plain_rest
            attrs = rest.match(page, at)
        if attrs is None:  # no tag ends any more
            add(page[m.start() :])
            break
        at, attrs = attrs.end(), attrs[1]
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCKS and (out := flush()):
                yield stack, out
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in _BLOCKS and any(x[0] in _BLOCKS for x in stack[i + 1 :]):
                        break
                    del stack[i:]
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _BLOCKS:
            if out := flush():
                yield stack, out
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][0]
                if open_tag == tag and tag in _LOOSE_P or open_tag == "p":
                    del stack[i:]
                    break
                if open_tag in _BLOCKS and open_tag not in _LOOSE_P:
                    break
        name, never, outer, main = _style(tag, attrs)
        top = stack[-1]
        if tag in _BLOCKS or never:
            top[4].append(name)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCKS:
            continue
        if len(stack) > MAX_DEPTH:
            stack.pop()
            top = stack[-1]
        path = f"{top[1]}/{name}"
        if len(path) > MAX_PATH:
            path = xxhash.xxh128_hexdigest(path)
        inner = top[3] or main
        no = top[2] or never or outer and not inner
        stack.append((tag, path, no, inner and not never, [], no if tag in _BLOCKS else top[5]))
        if tag in _RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
    if out := flush():
        yield stack, out


def _main(found: list[tuple[tuple, str]]) -> list[tuple[tuple, str]]:
    """Blocks outside boilerplate; only those of an article or main part if they hold ARTICLE_SHARE of them."""
    kept = [x for x in found if not x[0][-1][2]]
    inside = [x for x in kept if x[0][-1][3]]
    return inside if inside and sum(len(t) for _, t in inside) >= ARTICLE_SHARE * sum(len(t) for _, t in kept) else kept


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _host_of(url: str | None) -> str | None:
    m = _host.match(url) if url else None
    return m[1].lower() if m else None


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and path: host, path, page (hash of its main text), hashes of the content and of the child names below the path."""
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = _host_of(url)
            if host is None or not page:
                continue
            content: dict[str, list[str]] = {}
            children: dict[str, list] = {}
            found = []
            for stack, text in blocks(page):
                found.append((tuple(stack), text))
                for node in stack[1:]:
                    content.setdefault(node[1], []).append(text)
                    children.setdefault(node[1], node[4])
            page_hash = _hash("\n".join(t for _, t in _main(found)))
            rows += [(host, p, page_hash, _hash("\n".join(t)), _hash("\n".join(children[p]))) for p, t in content.items()]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["host", "path", "page", "content", "children"])


def _counts(pages: DataFrame) -> DataFrame:
    """host, path, kind (c content, s children), hash v and the number c of the host's distinct pages that show it."""
    arrow_limits(pages.sparkSession)
    nodes = pages.select("url", "html").mapInArrow(tidy(_nodes), "host string, path string, page long, content long, children long")
    once = nodes.groupBy("host", "path", "page").agg(F.min("content").alias("content"), F.min("children").alias("children"))
    kinds = F.inline(F.array(F.struct(F.lit("c").alias("kind"), F.col("content").alias("v")), F.struct(F.lit("s").alias("kind"), F.col("children").alias("v"))))
    return saved(once.select("host", "path", kinds).groupBy("host", "path", "kind", "v").agg(F.count("*").alias("c")))


def style_tree(counts: DataFrame) -> DataFrame:
    """host, path, n_pages, content_importance, style_importance, importance of every node of every site."""
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    both = sums.groupBy("host", "path").agg(F.max("m").alias("n_pages"), F.max(F.when(F.col("kind") == "c", entropy)).alias("content_importance"), F.max(F.when(F.col("kind") == "s", entropy)).alias("style_importance"))
    return both.withColumn("importance", F.greatest("content_importance", "style_importance"))


def _cut(pages: DataFrame) -> DataFrame:
    """host, path and common (hashes of the contents that COMMON_SHARE of the pages show) of the branches to cut."""
    counts = _counts(pages)
    cut = saved(style_tree(counts).where((F.col("n_pages") >= MIN_PAGES) & (F.col("importance") < IMPORTANCE)).select("host", "path", "n_pages"))
    shown = counts.where("kind = 'c' and c >= 2").join(cut, ["host", "path"]).where(F.col("c") >= COMMON_SHARE * F.col("n_pages"))
    common = shown.groupBy("host", "path").agg(F.collect_set("v").alias("common"))
    return saved(cut.drop("n_pages").join(common, ["host", "path"], "left"))


def _text(page: str, gone: dict[str, frozenset]) -> str:
    found = [(tuple(stack), text) for stack, text in blocks(page)]
    kept = _main(found)
    content: dict[str, list[str]] = {}
    for stack, text in found if gone else []:
        for node in stack[1:]:
            if node[1] in gone:
                content.setdefault(node[1], []).append(text)
    repeats = {p for p, t in content.items() if _hash("\n".join(t)) in gone[p]}
    left = [text for stack, text in kept if not any(n[1] in repeats and n[0] != "h1" if stack[-1][3] else n[1] in content for n in stack)]
    return "\n\n".join(left if left or not any(stack[-1][3] for stack, _ in kept) else [text for _, text in kept])


def _extractor(cut: dict[str, dict[str, frozenset]] | None) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                gone = cut.get(_host_of(url) or "", {}) if cut is not None else {x["path"]: frozenset(x["common"] or ()) for x in batch.column(3)[i].as_py() or ()}
                texts.append(_text(page or "", gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    arrow_limits(pages.sparkSession)
    cut = _cut(pages)
    rows = pages.select("page_id", "url", "html")
    by_host = None
    if cut.count() <= BROADCAST_PATHS:
        by_host = {}
        for r in cut.collect():
            by_host.setdefault(r.host, {})[r.path] = frozenset(r.common or ())
    else:
        host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        rows = rows.withColumn("host", host).join(saved(cut.groupBy("host").agg(F.collect_list(F.struct("path", "common")).alias("gone"))), "host", "left").select("page_id", "url", "html", "gone")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_extractor(by_host)), f"page_id {kind}, url string, text string, n_chars long")
