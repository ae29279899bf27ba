"""Main text of web pages by site template removal.

A page is parsed into blocks of text, and every element subtree is hashed and knows the blocks it spans. Spark
counts per host on how many distinct pages each hash occurs; subtrees that recur across many pages of
their host are deleted, wherever they stand. How many is many depends on what a subtree is: a link list is
template on a small share of the pages, other text only on half of them, and text that the page marks as
its article only where nearly every page has it, since a passage may well stand in several articles. What tags
and class names mark as boilerplate goes too, recurring or not. The article tag is the tie-break at the
end: it decides what is left if it holds a fair share of that.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtscope.session import fresh_path, stored

#: Element names by what they mean for the text.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select head".split()) | RAW
ARTICLE = frozenset("article main".split())
WHOLE = ARTICLE | {"html", "body"}  # never boilerplate by a class name
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
HINTS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr header masthead menu nav navbar navigation newsletter notice pagination pager popup modal promo related share sharing sidebar "
    "replies reply signup social sponsor sponsored subscribe toolbar widget".split()
)
#: An article element so named is a pointer to another page, unless it holds most of the text.
TEASERS = frozenset("card preview promo related teaser".split())

#: Parts of a class name that may stand beside a hint word, as in comment-list.
BESIDE = frozenset("area bar bottom box container inner left links list right site top wrap wrapper".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


def _hinted(token: str) -> bool:
    """Whether a class, id or role as a whole names boilerplate: hint words, and words that go with them."""
    parts = set(re.split("[-_]+", token)) - {""}
    return not HINTS.isdisjoint(parts) and parts <= HINTS | BESIDE


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(whether class, id or role name boilerplate, whether the element is hidden, whether they name a teaser)."""
    named = hidden = teaser = False
    for m in _ATTR.finditer(attributes or ""):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            words = value.split()
            named = named or any(map(_hinted, words))
            teaser = teaser or any(not TEASERS.isdisjoint(re.split("[-_]+", w)) for w in words)
        hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(_NO_DISPLAY.search(value))
    return named, hidden, teaser


OUTSIDE, INSIDE, LINKS = range(3)  # kinds of subtrees, the last two bits of their hashes


class _Element:
    __slots__ = ("name", "drop", "article", "parts", "links", "chars", "first", "named")

    def __init__(self, name: str, drop: bool, article: bool, first: int, named: bool = False):
        self.name, self.drop, self.article, self.first, self.named = name, drop, article, first, named
        self.parts: list[str] = []  # what the subtree's hash is made of
        self.links = self.chars = 0


def parse(page: str | None) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(blocks, subtrees, named) of a page.

    Blocks are (text, whether in an article) of what no element name marks as boilerplate. Subtrees that may be template, boilerplate
    included, are (hash, first block, block behind the last); the hash's last two bits tell the kind. ``named``
    are the spans of blocks that a class, id or role marks as boilerplate.
    """
    page = page or ""
    root = _Element("#root", False, False, 0)
    stack, blocks, text = [root], [], []
    closed: list[tuple[int, int, int, int]] = []
    marked: list[tuple[int, int, int]] = []
    open_names: dict[str, int] = {}

    def flush() -> None:
        whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if whole:
            top = stack[-1]
            top.parts.append(whole)
            top.chars += len(whole)
            if not top.drop:
                blocks.append((whole, top.article))

    def close() -> None:
        e = stack.pop()
        open_names[e.name] -= 1
        up = stack[-1]
        digest = xxhash.xxh64_intdigest("\x1f".join([e.name, *e.parts])) >> 1
        up.parts.append(f"{digest:x}")
        up.chars += e.chars
        up.links += e.links
        if e.chars and e.name not in ("html", "body"):
            kind = LINKS if e.links > 1 and e.links * 60 > e.chars else INSIDE if e.article else OUTSIDE
            closed.append((digest & ~3 | kind, e.first, len(blocks), e.chars))
            if e.named and e.first < len(blocks):
                marked.append((e.first, len(blocks), e.chars))

    def opened(names: tuple[str, ...]) -> bool:
        return any(open_names.get(x) for x in names)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in INLINE:
            if name == "a" and not m[1]:
                stack[-1].links += 1
            if not (m[1] or not m[3]) and any(_marks(m[3])[:2]):
                flush()
                at = _inline_end(page, name, at)
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
            continue
        flush()
        if m[1]:
            if open_names.get(name):
                while stack[-1].name != name:
                    close()
                close()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or n) if end else n
            continue
        if name in CLOSES_P and stack[-1].name == "p":
            close()
        elif name in SIBLINGS and opened(SIBLINGS[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in SCOPE[name]:
                    break
                if stack[k].name in SIBLINGS[name]:
                    while len(stack) > k:
                        close()
                    break
        top = stack[-1]
        named, hidden, teaser = _marks(m[3])
        drop = top.drop or name in BOILERPLATE and not (name == "header" and top.article) or hidden
        stack.append(_Element(name, drop, top.article or name in ARTICLE, len(blocks), teaser if name in ARTICLE else named and name not in WHOLE))
        open_names[name] = open_names.get(name, 0) + 1
        if m[3].endswith("/") and name not in ARTICLE and name not in BOILERPLATE:
            close()
    flush()
    while len(stack) > 1:
        close()
    # what holds most of a page is its content
    subtrees = [(h, first, last) for h, first, last, chars in closed if 2 * chars <= root.chars]
    articles = [0, *accumulate(int(a) for _, a in blocks)]
    beside = lambda first, last: articles[last] == articles[first] and articles[-1] > 0  # noqa: E731  the article is elsewhere
    return blocks, subtrees, [(first, last) for first, last, chars in marked if 2 * chars <= root.chars or beside(first, last)]


def _inline_end(page: str, name: str, at: int) -> int:
    """Place behind the closing tag of an inline element whose content begins at ``at``; nested ones of its name count."""
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if tag[1] else 1
        if not depth:
            return tag.end()
    return at


def uncovered(n: int, spans: list[tuple[int, int]]) -> list[bool]:
    """Which of n blocks no span holds."""
    change = [0] * (n + 1)
    for first, last in spans:
        change[first] += 1
        change[last] -= 1
    return [held == 0 for held in accumulate(change[:n])]


def chosen(blocks: list[tuple[str, bool]], kept: list[bool]) -> str:
    """The blocks that are left, joined: those of articles if they hold at least a third as much as the others, else the others."""
    left = [b for b, k in zip(blocks, kept, strict=True) if k]
    inside = sum(len(t) for t, article in left if article)
    outside = sum(len(t) for t, article in left if not article)
    article = inside * 3 >= outside and inside > 0
    return " ".join(t for t, a in left if a == article)


PARSED = "page_id long, url string, host string, texts array<string>, articles array<boolean>, hashes array<long>, firsts array<int>, lasts array<int>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, texts, articles, hashes, firsts, lasts) of (page_id, url, host, html): the blocks that are
    not marked as boilerplate, and the subtrees with the blocks they span."""
    kinds = {"texts": pa.string(), "articles": pa.bool_(), "hashes": pa.int64(), "firsts": pa.int32(), "lasts": pa.int32()}
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), *((c, pa.list_(t)) for c, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    blocks, subtrees, named = parse(r["html"])
                    kept = uncovered(len(blocks), named)
                    place = [0, *accumulate(map(int, kept))]  # of a block among those that are kept
                    rows.append(
                        {c: r[c] for c in ("page_id", "url", "host")}
                        | {"texts": [t for (t, _), k in zip(blocks, kept, strict=True) if k], "articles": [a for (_, a), k in zip(blocks, kept, strict=True) if k]}
                        | {"hashes": [x[0] for x in subtrees], "firsts": [place[x[1]] for x in subtrees], "lasts": [place[x[2]] for x in subtrees]}
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.mapInArrow(run, PARSED)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: Of a host's distinct pages, the least number and share that make a subtree template, by kind.
TEMPLATE = {OUTSIDE: (5, 0.5), INSIDE: (10, 0.8), LINKS: (5, 0.02)}


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template: dict[int, tuple[int, float]] | None = None) -> DataFrame:
    """One row per row of pages: (page_id, url, text, n_chars, n_removed).

    A subtree is template if its hash stands on at least the number and share of the host's distinct pages that
    ``template`` gives for its kind; so a host has at most 1 / share times the subtrees of a page as template, however
    many pages it has. Pages of a host with the same text count as one. ``n_removed`` counts the page's
    subtrees that are template. Null or empty html gives an empty text; a null url is a host of its own;
    repeated rows are repeated. Other columns are not read.
    """
    rules = template or TEMPLATE
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")
    )
    path = fresh_path(pages.sparkSession, "html-blocks")
    parsed_pages(rows).write.option("compression", "zstd").parquet(path)
    parsed = pages.sparkSession.read.parquet(path)
    # copies of a page say nothing about its template: pages of one host with the same blocks count once
    distinct = F.array_distinct("hashes")
    single = parsed.groupBy("host", F.xxhash64("texts").alias("content")).agg(F.max(distinct).alias("hashes"))
    sizes = single.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = single.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    kind = F.col("hash").bitwiseAND(3)
    least, share = (F.element_at(F.create_map(*[F.lit(x) for k, v in rules.items() for x in (k, v[i])]), kind.cast("int")) for i in range(2))
    many = counts.where(F.col("n") >= least).join(sizes, "host").where(F.col("n") >= share * F.col("pages"))

    # a short row per host: where all of them are small enough for Spark to broadcast, no page moves
    by_host = many.groupBy("host").agg(F.collect_list("hash").alias("template"))
    marked = parsed.join(stored(by_host, "html-template"), "host", "left").drop("host")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_removed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for r in batch.drop_columns(["page_id", "url"]).to_pylist():
                gone = set(r["template"] or ())
                hit = [(a, b) for h, a, b in zip(r["hashes"], r["firsts"], r["lasts"], strict=True) if h in gone]
                blocks = list(zip(r["texts"], r["articles"], strict=True))
                texts.append(chosen(blocks, uncovered(len(blocks), hit)))
                removed.append(len(gone.intersection(r["hashes"])))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], schema=schema)

    done = marked.mapInArrow(run, "page_id long, url string, text string, n_removed int")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
