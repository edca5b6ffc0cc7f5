"""HTML extraction: page structure, and passages repeated over the pages of a host.

A page becomes blocks of text in page order (block tags part them, character
references are decoded, white space becomes single spaces). Scripts, styles,
comments and the like are no text. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are told by their tags, roles and classes (a
class or id counts if all its parts are words of furniture: ``cookie-notice``, not
``has-sidebar``); what stands in ``article`` elements, or in ``main`` if the articles
hold less than half as much text, is the page's declared text. Classes do not make
furniture of html, body, main or an outer article, nor of what holds the page's largest
article or main if that has at least as much text as the rest; a form that holds half of the
page's text is none either.

Menus and notices that carry no such mark are found by repetition over all pages
of a host. The tokens of a page's blocks outside declared text are one stream; a
run of ``MIN_RUN`` tokens that occurs in two distinct streams of the host is
boilerplate (pages with equal streams count as one). In pages without declared
text the tokens so covered are removed and the unique runs of each block stay; but a
stretch of ``COPIED_RUN`` tokens or more that makes half of such a page's text is a
copied body and stays too, with what is repeated right beside it.
Of declared text, whole blocks of ``MIN_RUN`` tokens or more are removed that stand in
``DECLARED_PAGES`` distinct declared texts of the host, unless such blocks hold half of
the page's declared tokens or more: then the article itself is a copy, and is
kept whole. Runs inside a declared block are kept, since an article may quote another.

In Spark, each run and declared block is a 64-bit digest with its host. The
distinct streams per digest are counted by partial aggregation, so a hot host
spreads over all tasks and a hot run collapses before the shuffle; the
repeated digests are joined with the pages' digests, and each page gets back those of
its own. Nothing depends on how the rows are partitioned. The input is read three times
and must be the same rows each time. ``extract`` is the same for pages in memory, with a
suffix array in place of the digests.

Edge cases: null and empty html give an empty text; a null url, or one
without a host, is of the host ''. Null ids pass through; rows that repeat
a page are equal streams, so they do not make each other boilerplate. Unclosed
elements end with the page; a tag cut off at the end of the page is dropped.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import SLICE_BYTES, cut, fresh, map_in_arrow, mix, quoted, text_slices, word_hashes

MIN_RUN = 8
#: Distinct declared texts that a declared block must stand in to be boilerplate.
DECLARED_PAGES = 3
#: A repeated stretch of undeclared text of so many tokens that is half of the page's is a copied body.
COPIED_RUN = 100

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"""
    r"""|<[!?][^>]*+(?:>|\Z)|<[/a-zA-Z][^>]*+\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "xmp"}
HIDDEN = {"head", "noscript", "template", "svg", "math", "canvas", "object", "video", "audio", "datalist"}
#: Elements and roles of page furniture.
FURNITURE = {"nav", "aside", "footer", "form", "menu", "button", "select", "dialog", "fieldset", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
#: Words of classes and ids of page furniture.
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
    "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer",
    "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "reply", "replies", "respond", "disqus", "widget", "toolbar", "pagination", "pager", "copyright",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
#: Elements that end when the next block begins.
LOOSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
TEXT, FURNISHED, DECLARED = 0, 1, 2


def _furnishes(token: str) -> bool:
    parts = re.findall(r"[a-z0-9]+", token)
    return bool(parts) and all(x in WORDS for x in parts)


def _marks(tag: str, attributes: str, regions: dict[str, int]) -> str | None:
    """What an element is by its tag and attributes: hidden, furniture, form or words
    (furniture by a form tag or by classes), article, main or None."""
    inside = regions["article"] + regions["main"] > 0
    if tag in HIDDEN:
        return "hidden"
    found = {}
    if tag != "form" and (tag in FURNITURE or (tag == "header" and not inside)):
        return "furniture"
    if attributes and not attributes.isspace():
        found = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            return "hidden"
    if tag == "form" or found.get("role") == "form":
        return "form"
    if found.get("role") in ROLES:
        return "furniture"
    if found.get("role") == "main":
        return "main"
    # an article in an article is a comment or a card, as its classes say
    if found and not (tag in ("html", "body", "main") or (tag == "article" and not regions["article"])):
        tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
        if any(map(_furnishes, tokens)) or ("header" in tokens and not inside):
            return "words"
    return tag if tag in ("article", "main") else None


def blocks(page: str) -> tuple[list[tuple[str, int]], str]:
    """The page's blocks as (text, kind) and where its declared text stands:
    article, main or page."""
    out: list[tuple[str, tuple[int, ...], bool, bool, int]] = []  # text, furniture around, in article, in main, outermost region
    stack: list[tuple[str, str | None]] = []
    hidden = outermost = 0
    furniture: list[int] = []  # open elements, by their places in furnished
    furnished: list[str] = []
    around: list[tuple[int, ...]] = [()]  # of each outermost region, the furniture it stands in
    regions = {"article": 0, "main": 0}
    parts: list[str] = []

    def close() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, tuple(furniture), regions["article"] > 0, regions["main"] > 0, outermost))
            parts.clear()

    def count(mark: str | None, by: int) -> None:
        nonlocal hidden, outermost
        if mark == "hidden":
            hidden += by
        elif mark in ("furniture", "form", "words"):
            if by > 0:
                furniture.append(len(furnished))
                furnished.append(mark)
            else:
                furniture.pop()
        elif mark:
            if by > 0 and not outermost:
                outermost = len(around)
                around.append(tuple(furniture))
            regions[mark] += by
            if not regions["article"] + regions["main"]:
                outermost = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            count(stack.pop()[1], -1)

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            if not hidden:
                parts.append(page[at:])
            break
        if m.start() > at and not hidden:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end tag does not close a block
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in BLOCKS and stack and stack[-1][0] in LOOSE:
            pop(len(stack) - 1)
        attributes = m[3] or m[6] or ""
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        mark = _marks(tag, attributes, regions)
        if mark is not None and tag not in BLOCKS:
            close()  # an inline element with a mark is a block of its own
        if mark is not None or tag in BLOCKS:
            stack.append((tag, mark))
            count(mark, 1)
    close()
    lifted = _lifted(out, furnished, around)
    plain = [set(own) <= lifted for _, own, _, _, _ in out]
    in_article = sum(len(b[0]) for b, ok in zip(out, plain, strict=True) if ok and b[2])
    in_main = sum(len(b[0]) for b, ok in zip(out, plain, strict=True) if ok and b[3])
    place = "page" if not in_article + in_main else "article" if 2 * in_article >= in_main else "main"
    at_place = [place == "article" and b[2] or place == "main" and b[3] for b in out]
    kinds = [FURNISHED if not ok else DECLARED if here else TEXT for ok, here in zip(plain, at_place, strict=True)]
    return [(b[0], kind) for b, kind in zip(out, kinds, strict=True)], place


def _lifted(out: list[tuple[str, tuple[int, ...], bool, bool, int]], furnished: list[str], around: list[tuple[int, ...]]) -> set[int]:
    """The elements marked by a form tag or by classes that are no furniture, as
    they hold the page's text."""
    lifted: set[int] = set()
    if not furnished:
        return lifted
    forms = {i for i, mark in enumerate(furnished) if mark == "form"}
    sizes: dict[int, int] = {}
    total = 0
    for text, own, _, _, _ in out:
        if set(own) <= forms:
            total += len(text)
            for i in own:
                sizes[i] = sizes.get(i, 0) + len(text)
    lifted |= {i for i, n in sizes.items() if 2 * n >= total}
    held = [0] * len(around)
    rest = 0
    for text, own, _, _, region in out:
        if region and set(own) <= set(around[region]) | lifted:
            held[region] += len(text)
        if set(own) <= lifted:
            rest += len(text)
    held = [n if all(furnished[i] != "furniture" for i in own) else 0 for n, own in zip(held, around, strict=True)]
    largest = max(range(len(held)), key=held.__getitem__)
    if not set(around[largest]) <= lifted and held[largest] >= rest:
        lifted |= set(around[largest])
    return lifted


def repeated(keys: np.ndarray, pages: np.ndarray, streams: np.ndarray, at_least: int = MIN_RUN) -> np.ndarray:
    """Which tokens are covered by a substring of ``at_least`` tokens that
    occurs in streams of distinct pages. ``keys``: the token streams, one
    after another; ``pages``: the stream that each token is of; ``streams``:
    for each stream its name, equal for equal streams."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, dtype=bool)
    last = np.searchsorted(pages, pages, side="right")
    # suffixes sorted by their first at_least tokens or more, by prefix doubling
    _, rank = np.unique(keys, return_inverse=True)
    rank = rank.astype(np.int64)
    levels, h = [rank], 1
    longest = int(np.diff(np.flatnonzero(np.append(np.append(True, pages[1:] != pages[:-1]), True))).max())
    while h < longest:
        ahead = np.arange(n) + h
        nxt = np.where(ahead < last, rank[np.minimum(ahead, n - 1)] + 1, 0)
        _, new = np.unique(rank * (n + 2) + nxt, return_inverse=True)
        h *= 2
        rank = new.astype(np.int64)
        levels.append(rank)
        if len(np.unique(rank)) == n:
            break
    order = np.lexsort((streams[pages], rank))
    # longest common prefix of neighbours, and the pages an interval spans: a
    # suffix is repeated on another page as far as the nearest neighbour of another one
    own = streams[pages[order]]
    shared = np.zeros(n, dtype=np.int64)
    common = np.zeros(n, dtype=np.int64)  # of order[i] with order[i + 1]
    a, b = order[:-1], order[1:]
    length = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x + (1 << k) <= last[a]) & (y + (1 << k) <= last[b])
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        length += np.where(ok & (levels[k][x] == levels[k][y]), 1 << k, 0)
    common[:-1] = length
    # cut the order where the common prefix is too short: inside a run all agree
    # on at_least tokens; runs that hold two streams are repeated on distinct pages
    run = np.cumsum(np.append(True, length < at_least)) - 1
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
    several = (low != high)[run]
    shared[order] = np.where(several, at_least, 0)
    edge = np.zeros(n + 1, dtype=np.int64)
    hit = np.flatnonzero(shared)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + at_least, -1)
    return np.cumsum(edge[:-1]) > 0


def _stream(found: list[tuple[str, int]]) -> list[str]:
    """The tokens of a page's blocks outside declared text."""
    return [w for text, kind in found if kind != DECLARED for w in text.split(" ")]


def _declared(found: list[tuple[str, int]]) -> list[str]:
    return [text for text, kind in found if kind == DECLARED]


def _long(block: str) -> bool:
    return block.count(" ") + 1 >= MIN_RUN


def _without_copies(boiler: np.ndarray, size: int) -> np.ndarray:
    """The mask of a stream without copied bodies: stretches that are too long
    for a menu or notice and make half of the page's text."""
    edge = np.diff(np.concatenate([[0], boiler.astype(np.int8), [0]]))
    out = boiler.copy()
    for start, stop in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if stop - start >= COPIED_RUN and 2 * (stop - start) >= size:
            out[start:stop] = False
    return out


def _kept(found: list[tuple[str, int]], place: str, boiler: np.ndarray, common: set[str]) -> tuple[str, str, int]:
    """(text, where it stood, tokens found to be boilerplate) of a page, from the
    mask of its stream and its declared blocks that are common."""
    sizes = [(t in common, t.count(" ") + 1) for t in _declared(found)]
    copied = 2 * sum(n for hit, n in sizes if hit) >= sum(n for _, n in sizes)
    if place == "page":
        boiler = _without_copies(boiler, sum(t.count(" ") + 1 for t, kind in found if kind == TEXT))
    kept, lost, at = [], 0, 0
    for text, kind in found:
        n = text.count(" ") + 1
        if kind == DECLARED:
            if text in common and not copied:
                lost += n
            else:
                kept.append(text)
            continue
        mask = boiler[at : at + n]
        at += n
        lost += int(mask.sum())
        if kind == TEXT and place == "page" and not mask.all():
            kept.append(text if not mask.any() else " ".join(w for w, m in zip(text.split(" "), mask, strict=True) if not m))
    return "\n".join(kept), place, lost


def extract(pages: list[str | None]) -> list[tuple[str, str, int]]:
    """(text, where it stood, tokens found to be boilerplate) of each page of
    one host."""
    parsed = [blocks(p) if p else ([], "page") for p in pages]
    words: list[str] = []
    owner: list[int] = []
    names: dict[tuple, int] = {}
    streams = np.zeros(len(pages), dtype=np.int64)
    texts: dict[str, set[tuple]] = {}
    for i, (found, _) in enumerate(parsed):
        mine = _stream(found)
        streams[i] = names.setdefault(tuple(mine), len(names))
        words.extend(mine)
        owner.extend([i] * len(mine))
        declared = tuple(_declared(found))
        for block in filter(_long, declared):
            texts.setdefault(block, set()).add(declared)
    coded = pa.array(words, pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False) if words else np.zeros(0)
    boiler = repeated(coded.astype(np.int64), np.array(owner, dtype=np.int64), streams)
    common = {block for block, own in texts.items() if len(own) >= DECLARED_PAGES}
    out, at = [], 0
    for found, place in parsed:
        n = len(_stream(found))
        out.append(_kept(found, place, boiler[at : at + n], common))
        at += n
    return out


def digests(parsed: list[tuple[list[tuple[str, int]], str]], hosts: list[str]):
    """For pages of any hosts: per page the digest of its stream, of its declared
    text, of every run (one per token that starts one) and of every long declared block
    (by its text). Digests of runs and blocks hold the host."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    streams = [_stream(found) for found, _ in parsed]
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    words = pa.array([w for s in streams for w in s], pa.string())
    hashes = word_hashes(words) if len(words) else np.zeros(0, dtype=np.uint64)
    n = max(len(hashes) - MIN_RUN + 1, 0)
    runs = mix(np.repeat(np.array([digest(h) for h in hosts], dtype=np.uint64), sizes)[:n])
    for j in range(MIN_RUN):
        runs = mix(runs ^ hashes[j : j + n])
    out, at = [], 0
    for i, (found, _) in enumerate(parsed):
        own = runs[at : at + max(int(sizes[i]) - MIN_RUN + 1, 0)].view(np.int64)
        at += int(sizes[i])
        declared = _declared(found)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        long = {b: signed(digest(f"{hosts[i]}\0{b}")) for b in filter(_long, declared)}
        out.append((signed(digest(" ".join(streams[i]))), signed(digest("\n".join(declared))), own, long))
    return out


def _parsed(batches):
    """(batch, parsed pages, digests) of slices of batches with host__ and body__."""
    for batch in text_slices(batches, "body__"):
        parsed = [blocks(p) if p else ([], "page") for p in batch.column("body__").to_pylist()]
        yield batch, parsed, digests(parsed, batch.column("host__").to_pylist())


def repeated_digests(source: DataFrame) -> DataFrame:
    """Per page__ of ``source`` (page__, host__, body__) the digests of its runs
    and declared blocks that are repeated on its host."""
    named = T.StructType([T.StructField(c, T.LongType()) for c in ("digest", "block", "stream")])

    def name(batches):
        for batch, _, found in _parsed(batches):
            parts = [[np.zeros(0, dtype=np.int64)] * 3]
            for stream, declared, runs, long in found:
                runs = np.unique(runs)
                parts.append([runs, np.zeros(len(runs), dtype=np.int64), np.full(len(runs), stream)])
                own = np.array(sorted(set(long.values())), dtype=np.int64)
                parts.append([own, np.full(len(own), declared), np.full(len(own), declared)])
            digest, block, stream = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(block), pa.array(stream)], names=named.names)

    def place(batches):
        for batch, _, found in _parsed(batches):
            own = [np.unique(np.concatenate([runs, np.fromiter(long.values(), np.int64, len(long))])) for _, _, runs, long in found]
            page = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in own])
            digest = np.concatenate([np.zeros(0, dtype=np.int64), *own])
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(digest)], names=["page__", "digest"])

    # runs: a group per digest; blocks: one per digest and declared text, counted after
    met = map_in_arrow(source, name, named).groupBy("digest", "block").agg(F.min("stream").alias("low"), F.max("stream").alias("high"))
    some = met.where((F.col("block") != 0) | (F.col("low") != F.col("high"))).groupBy("digest").agg(
        F.count_if(F.col("block") != 0).alias("texts"), F.count_if(F.col("block") == 0).alias("runs")
    )
    often = cut(some.where((F.col("texts") >= DECLARED_PAGES) | (F.col("runs") > 0)).select("digest"), "repeated")
    places = map_in_arrow(source, place, T.StructType([T.StructField(c, T.LongType()) for c in ("page__", "digest")]))
    return cut(places.join(often, "digest").groupBy("page__").agg(F.collect_set("digest").alias("digests__")), "places")


def _packed(pages: DataFrame) -> DataFrame:
    """The pages with their html compressed, to be shuffled."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "body__" else f.dataType) for f in pages.schema.fields])

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            column = batch.schema.get_field_index("body__")
            body = [None if v is None else pack(v) for v in batch.column(column).cast(pa.binary()).to_pylist()]
            columns = [pa.array(body, pa.binary()) if i == column else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_in_arrow(pages, run, schema)


def _unpacked(batches):
    """Batches with their html as text again, in slices of about the usual size."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in text_slices(batches, "body__", SLICE_BYTES // 8):
        column = batch.schema.get_field_index("body__")
        body = [None if v is None else unpack(v) for v in batch.column(column).to_pylist()]
        columns = [pa.array(body, pa.binary()).cast(pa.string()) if i == column else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def extract_text(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns but the html, or those in ``keep``) plus text,
    n_chars, place (article, main or page) and n_boilerplate."""
    keep = [c for c in df.columns if c != html] if keep is None else keep
    names = [fresh(df.select(*[quoted(c) for c in keep]), c) for c in ("text", "n_chars", "place", "n_boilerplate")]
    site = F.lower(F.regexp_extract(F.coalesce(quoted(url), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    page = F.xxhash64(site, quoted(html))  # equal pages of a host get the same answer
    parts = [page.alias("page__"), site.alias("host__"), quoted(html).alias("body__")]
    kept = F.struct(*[quoted(c) for c in keep]).alias("kept__")
    places = repeated_digests(df.select(*parts))
    # one way of joining at every size: pages are spread by their key, their html packed
    packed = _packed(df.select(kept, *parts))
    source = packed.join(places.hint("merge"), "page__", "left").select("kept__", "digests__", "host__", "body__")
    made = [(names[0], T.StringType()), (names[1], T.LongType()), (names[2], T.StringType()), (names[3], T.LongType())]
    schema = T.StructType([source.schema["kept__"], *[T.StructField(n, t) for n, t in made]])

    def run(batches):
        for batch, parsed, found in _parsed(_unpacked(batches)):
            out = []
            for (own, place), (_, _, runs, long), often in zip(parsed, found, batch.column(1), strict=True):
                hits = often.values.to_numpy() if often.is_valid else np.zeros(0, dtype=np.int64)
                size = len(_stream(own))
                edge = np.zeros(size + 1, dtype=np.int64)
                starts = np.flatnonzero(np.isin(runs, hits))
                edge[starts] += 1
                edge[starts + MIN_RUN] -= 1
                common = {b for b, d in long.items() if d in set(hits.tolist())}
                out.append(_kept(own, place, np.cumsum(edge[:-1]) > 0, common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _, _ in out], pa.string()), pa.array([len(t) for t, _, _ in out], pa.int64()),
                 pa.array([p for _, p, _ in out], pa.string()), pa.array([n for _, _, n in out], pa.int64())],
                names=schema.names,
            )

    done = map_in_arrow(source, run, schema)
    return done.select(*[F.col("kept__").getField(c).alias(c) for c in keep], *[quoted(n) for n in names])
