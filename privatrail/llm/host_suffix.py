"""Main text of web pages by structure and by a suffix array of each host's pages.

A page is read as blocks in three zones: the main container (`article`, `main`), boilerplate by its element, class or
role, and the open rest. The blocks outside the main container, of all pages of a host, are laid end to end as tokens.
A suffix array, cut at RUN tokens, shows the runs that come back on at least PAGES distinct pages; open blocks that such
runs cover are boilerplate, unique ones stay, on pages with a main container too. A block of fewer than RUN tokens is
filled up to a run, which comes back only where the whole block does. Inside the main container repetition is no reason
to drop a block: hosts publish one article under several addresses, and an article's sentences may return in another.
Class names that sections of an article bear as well (`related-work`) open a zone there that repetition judges.

A host's pages are dealt over groups of about GROUP_PAGES by a hash, so a host with a third of all pages is many groups.
Where there is more than one, each group's suffix array gives its runs, by a 64-bit hash, with the number of their pages;
the sum over the groups says which runs the host repeats, and each group judges its blocks by these. Only blocks outside
the main container are shuffled; texts of pages with open blocks are joined to what was found, all others are map-only.

Defined cases: null or empty html has the empty text; markup that never ends (comments, scripts) runs to the end of the
page; a page without container, boilerplate and repetition keeps all its blocks; rows that repeat are pages each; urls
that are null or have no host share one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.llm.common import cut

RUN = 8
PAGES = 3
COVERED = 0.8
GROUP_PAGES = 512
MAIN, OPEN, BOILERPLATE = 0, 1, 2
FILL = 1

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"\w+")

RAW = {"script", "style", "template", "textarea", "title", "iframe", "noembed", "noframes", "canvas", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "label", "fieldset"}
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Elements that may stay open; the rest of the block elements ends with the next one.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "html", "body", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}
ENDED_BY = {("li", "li"), ("dt", "dd"), ("dd", "dt"), ("dt", "dt"), ("dd", "dd"), ("tr", "tr")}
SPACED = {"br", "td", "th", "img", "input"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "reply", "replies", "disqus",
    "share", "sharing", "social", "related", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "pagination", "pager",
    "login", "signup", "search", "widget", "toolbar", "masthead",
}
#: Names that count by themselves only; as a part of another name they leave it to repetition.
VAGUE = {"notice", "search", "related", "menu", "social", "banner", "share", "sharing", "reply", "replies", "promo", "widget", "subscription", "consent"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


def _judged(tag: str, attributes: str, inside_main: bool) -> int | None:
    """The zone that an element opens, None for its parent's."""
    found = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    whole = {name for key in ("class", "id") for name in found.get(key, "").split()}
    parts = {part for name in whole for part in re.split("[_-]+", name)}
    if tag in SKIPPED or found.get("role") in ROLES or (tag == "header" and not inside_main):
        return BOILERPLATE
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return BOILERPLATE
    if tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody":
        return BOILERPLATE if parts & {"comment", "comments", "ad", "advert"} or whole & {"reply", "related"} else MAIN
    if tag not in ("html", "body"):
        if parts & (NAMES - VAGUE) or whole & VAGUE or ("header" in parts and not inside_main):
            return BOILERPLATE
        if parts & VAGUE:
            return OPEN
    return None


class _Scanner:
    """Tags of a page from front to back, in time linear in its length: nothing is read twice but, once a page, the rest
    of it behind an attribute whose quotes do not close. From there on quotes do not count."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end_of_tag(self, at: int) -> int:
        """Where the tag whose attributes begin here ends, -1 if it does not."""
        begin = at
        while self.quotes:
            m = _STOP.search(self.page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.page.find(">", begin)

    def next_mark(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, closing, attributes) of the next mark; the tag is empty for comments and declarations, and the
        end -1 where one never ends. None where no mark follows."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else -1, "", False, ""
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                return (start, end + 1, "", False, "") if end >= 0 else None
            m = _NAME.match(page, start)
            if m is not None:
                end = self.end_of_tag(m.end())
                return (start, end + 1, m[1].lower(), page[start + 1] == "/", page[m.end() : end]) if end >= 0 else None
            at = start + 1

    def end_of_raw(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup, -1 if there is none."""
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        return self.page.find(">", m.end()) + 1 or -1 if m is not None else -1


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in their order; references decoded, white space made single."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    depth: Counter[str] = Counter()  # open elements by tag
    zone, at = OPEN, 0
    scanner = _Scanner(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((zone, text))

    def leave(tag: str) -> None:
        """Close elements up to and including the innermost of this tag."""
        nonlocal zone
        while True:
            last, _ = stack.pop()
            depth[last] -= 1
            if last == tag:
                break
        zone = stack[-1][1] if stack else OPEN

    while True:
        mark = scanner.next_mark(at)
        if mark is None:
            held.append(page[at:])
            break
        start, end, tag, closing, attributes = mark
        held.append(page[at:start])
        if end < 0:
            break
        at = end
        if not tag:
            continue
        if tag in RAW and not closing:
            at = scanner.end_of_raw(tag, at)
            if at < 0:
                break
            continue
        if tag in SPACED:
            held.append(" ")
        if not closing and stack and ((stack[-1][0], tag) in ENDED_BY or (stack[-1][0] == "p" and tag in BLOCK_TAGS)):
            flush()  # an open paragraph or item ends where the next block begins
            leave(stack[-1][0])
        opens = None if closing or tag in VOID else _judged(tag, attributes, zone == MAIN)
        if tag in BLOCK_TAGS or opens is not None:
            flush()
        if tag in VOID or (tag in LOOSE and opens is None):
            if closing and depth[tag]:
                flush()
                leave(tag)
            continue
        if not closing:
            if (tag in BLOCK_TAGS or opens is not None):
                if zone == BOILERPLATE:
                    opens = BOILERPLATE
                stack.append((tag, zone if opens is None else opens))
                depth[tag] += 1
                zone = stack[-1][1]
        elif depth[tag]:
            flush()
            leave(tag)
    flush()
    return out


def _suffixes(texts: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The tokens of all blocks end to end, the page and block of each, the rank of the suffix that begins there, and the
    words. Token 1 fills a short block up to a run; one below 0 ends a block and is another for each, so that no run
    crosses blocks."""
    words: dict[str, int] = {}
    stream, page_of, block_of = [], [], []
    n = 0
    for p, page in enumerate(texts):
        for text in page:
            tokens = [words.setdefault(w, len(words) + 2) for w in _WORD.findall(text.lower())]
            tokens += [FILL] * (run - len(tokens))
            stream += [*tokens, -1 - n]
            page_of += [p] * (len(tokens) + 1)
            block_of += [n] * len(tokens) + [-1]
            n += 1
    tokens = np.array(stream, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    # suffix ranks by doubling, cut at `run` tokens: equal ranks are suffixes with as long a common prefix
    width = 1
    while width < run and len(rank) > width:
        step = min(width, run - width)
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)
        width += step
    return tokens, np.array(page_of, np.int64), np.array(block_of, np.int64), rank, list(words)


def _spread(page: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The number of distinct pages of each rank."""
    order = np.lexsort([page, rank])
    sorted_rank, sorted_page = rank[order], page[order]
    new = np.concatenate([[True], (sorted_rank[1:] != sorted_rank[:-1]) | (sorted_page[1:] != sorted_page[:-1])])
    return np.bincount(sorted_rank[new], minlength=int(rank.max()) + 1)


def _run_hashes(tokens: np.ndarray, words: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a run begins that ends within its block, and the hash of the run's words, the same in all groups."""
    if len(tokens) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.array([0, 1, *(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words)], np.uint64)[np.maximum(tokens, 0)]
    n = len(tokens) - run + 1
    h, inside = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + of[k : k + n]
        h ^= h >> np.uint64(29)
        inside &= tokens[k : k + n] >= 0
    at = np.flatnonzero(inside)
    return at, h[at].view(np.int64)


def runs(texts: list[list[str]], run: int = RUN, pages: int = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of these pages and the number of pages that hold it, up to `pages`."""
    tokens, page, _, rank, words = _suffixes(texts, run)
    at, h = _run_hashes(tokens, words, run)
    if not len(at):
        return h, at
    held, first = np.unique(rank[at], return_index=True)
    return h[first], np.minimum(_spread(page, rank)[held], pages)


def repeated(texts: list[list[str]], run: int = RUN, pages: int = PAGES, known: np.ndarray | None = None) -> list[list[bool]]:
    """Which blocks of which page are covered by runs of tokens found on at least `pages` distinct pages, or, if these are
    given, by runs whose hash is among the known."""
    n = sum(map(len, texts))
    if not n:
        return [[] for _ in texts]
    tokens, page, block, rank, words = _suffixes(texts, run)
    if known is None:
        # a suffix that reaches the end of its block within the run is another than all others
        starts = np.flatnonzero(_spread(page, rank)[rank] >= pages)
    else:
        at, h = _run_hashes(tokens, words, run)
        starts = at[np.isin(h, known)]
    mark = np.zeros(len(rank) + run + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + run, -1)
    covered = np.cumsum(mark)[: len(rank)] > 0
    inner = (block >= 0) & (tokens > FILL)  # what fills a block up says nothing of it
    hits = np.bincount(block[inner & covered], minlength=n)
    sizes = np.bincount(block[inner], minlength=n)
    bare = hits >= COVERED * np.maximum(sizes, 1)
    out, k = [], 0
    for texts_ in texts:
        out.append(bare[k : k + len(texts_)].tolist())
        k += len(texts_)
    return out


def _zones(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 1024):
            batch = whole.slice(a, 1024)
            texts, open_at, outside = [], [], []
            for page in batch.column(batch.schema.names.index("__html")).to_pylist():
                found = blocks(page)
                kept = [(z, t) for z, t in found if z != BOILERPLATE]
                texts.append([t for _, t in kept])
                open_at.append([i for i, (z, _) in enumerate(kept) if z == OPEN])
                outside.append([t for z, t in found if z != MAIN])
            columns = [batch.column(batch.schema.names.index(c)) for c in keep]
            columns += [pa.array(texts, pa.list_(pa.string())), pa.array(open_at, pa.list_(pa.int32())), pa.array(outside, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__texts", "__open", "__outside"])


def _judged_pages(table: pa.Table, known: np.ndarray | None) -> pa.Table:
    ids, rows = table.column("__id").to_pylist(), table.column("__row").to_pylist()
    outside, opens = table.column("outside").to_pylist(), table.column("opens").to_pylist()
    found = repeated(outside, known=known) if any(opens) else [[False] * len(x) for x in outside]
    out = [(i, r, sorted({t for t, bare in zip(texts, flags, strict=True) if bare})) for i, r, texts, flags, has in zip(ids, rows, outside, found, opens, strict=True) if has]
    return pa.table({
        "__id": pa.array([x[0] for x in out], pa.int64()), "__row": pa.array([x[1] for x in out], pa.int64()), "bare": pa.array([x[2] for x in out], pa.list_(pa.string())),
    })


def _host_group(table: pa.Table) -> pa.Table:
    """The open blocks that the host repeats, of a host that is one group."""
    return _judged_pages(table, None)


def _group_runs(table: pa.Table) -> pa.Table:
    """The runs of one group of a host's pages."""
    hashes, pages = runs(table.column("outside").to_pylist())
    same = lambda c: pa.array([table.column(c)[0].as_py()] * len(hashes), table.schema.field(c).type)
    return pa.table({"__host": same("__host"), "__salt": same("__salt"), "hash": pa.array(hashes, pa.int64()), "pages": pa.array(pages, pa.int64())})


def _group_of_many(table: pa.Table, known: pa.Table) -> pa.Table:
    """The open blocks that the host repeats, of a group that is given the runs its host repeats."""
    return _judged_pages(table, known.column("hash").to_numpy())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """pages without `source`, with `text`: the blocks of the main text joined by two line feeds."""
    rest = [c for c in pages.columns if c not in (source, "text")]
    named = pages.select(
        *[F.col(f"`{c}`").alias(f"x_{c}") for c in rest],
        F.col(source).alias("__html"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("__id"),
        F.xxhash64(F.col(source), F.col(url)).alias("__row"),
        F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")).alias("__host"),
    )
    keep = [*[f"x_{c}" for c in rest], "__id", "__row", "__host"]
    types = ", ".join(f"`{c}` {named.schema[c].dataType.simpleString()}" for c in keep)
    # parsed once: the blocks are read by three steps
    parsed = cut(named.mapInArrow(lambda b: _zones(b, keep), f"{types}, __texts array<string>, __open array<int>, __outside array<string>"))
    hosts = parsed.groupBy("__host").agg(F.ceil(F.count(F.lit(1)) / GROUP_PAGES).alias("many"), F.max(F.size("__open")).alias("most"))
    # a host without open blocks has nothing to judge; one row a host meets its pages in as many groups as it fills
    hosts = hosts.where("most > 0").select("__host", "many")
    dealt = parsed.select("__id", "__row", "__host", F.col("__outside").alias("outside"), (F.size("__open") > 0).alias("opens")).join(hosts, "__host")
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64("__id", "__row"), F.col("many"))).select("__host", "__salt", "__id", "__row", "outside", "opens", "many")
    dealt = dealt.repartition("__host", "__salt")  # not by host alone, as the join may leave it
    found = "__id long, __row long, bare array<string>"
    bare = dealt.where("many = 1").drop("many").groupBy("__host", "__salt").applyInArrow(_host_group, found)
    large = cut(dealt.where("many > 1").drop("many"))
    held = cut(large.groupBy("__host", "__salt").applyInArrow(_group_runs, "__host string, __salt long, hash long, pages long"))
    common = cut(held.groupBy("__host", "hash").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("__host", "hash"))
    known = held.join(common, ["__host", "hash"]).select("__host", "__salt", "hash")
    bare = bare.unionByName(large.groupBy("__host", "__salt").cogroup(known.groupBy("__host", "__salt")).applyInArrow(_group_of_many, found))
    out = [F.col(f"`x_{c}`") for c in rest]
    settled = parsed.where(F.size("__open") == 0).select(*out, F.array_join("__texts", "\n\n").alias("text"))
    # repeated rows have equal blocks and fall into one group
    bare = bare.groupBy("__id", "__row").agg(F.first("bare").alias("__bare"))
    kept = F.filter("__texts", lambda t, i: ~(F.array_contains("__open", i) & F.array_contains("__bare", t)))
    judged = parsed.where(F.size("__open") > 0).join(bare, ["__id", "__row"]).select(*out, F.array_join(kept, "\n\n").alias("text"))
    return settled.unionByName(judged).select(*[F.col(f"`x_{c}`").alias(c) for c in rest], "text")
