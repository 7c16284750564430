"""Main text of web pages: marked articles, and what a host repeats cut out of them by suffix arrays.

Markup is read with a stack of open elements. Where a page marks its article (``article``,
``main``, a role or a usual class), the blocks inside it are its token stream; elsewhere all its blocks are. The streams of all
pages of a host go through suffix arrays, those with a marked article by themselves:

* equal streams of a host count as one page, so a republished text is no boilerplate;
* the streams are dealt to arrays of some ``ARRAY`` pages. Suffixes, cut at ``WINDOW`` tokens and at the end of their block, are sorted by prefix
  doubling; neighbours of equal rank share that many tokens. A string on more than ``SHARE`` of all streams is on more than that of those in some
  array, so the strings that are there in an array are all candidates there can be;
* candidates are looked up in every stream and counted over the whole host. Strings on more than ``SHARE`` of its streams are boilerplate, if it has at
  least ``PAGES`` of them, or ``ARTICLES`` where articles are marked: there markup guards the text. Runs they cover are cut, the rest of a block stays.

Blocks are joined in page order by an empty line, white space inside a block becomes one space,
character references are decoded. Null and empty pages give an empty text, and so do pages that hold nothing of their own. Rows that repeat a page
are extracted separately, and do not count as distinct pages. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packstat.llm.common import prefix_sums, stretch_hash, word_hashes
from packstat.llm.urls import parts
from packstat.session import checkpoint

#: Tokens of a string that counts as repeated, and the share of a host's pages that it must exceed.
WINDOW, SHARE = 8, 2 / 3
#: Pages a string must occur on where nothing is marked, and inside marked articles.
PAGES, ARTICLES = 2, 10
#: Pages of a suffix array.
ARRAY = 512

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
_DROP = set("nav footer aside form button select dialog menu object canvas audio video label fieldset head datalist option optgroup".split())
_HEADING = set("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _HEADING | set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
#: What an opening tag closes without saying so, and what stops the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class and id that mark what is no article.
_NOISE = set("""nav navbar navigation menu menus submenu breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside rail notice notices
 alert banner cookie cookies consent gdpr ad ads adv advert adverts advertisement advertising advertorial adsense adslot promo promos promotion
 sponsor sponsored sponsors comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe
 subscription signup login popup modal overlay widget widgets toolbar pagination pager tags skip form search print hidden""".split())
_NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that mark the article where no element does.
_MAIN = set("""article post entry story content main articlebody article-body article-content post-body post-content entry-content main-content
 page-content story-body content-body""".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


#: Drawings and formulas, and the tags that end one which is not closed.
_FOREIGN = {"svg", "math"}
_BREAKOUT = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|dl|table|blockquote|pre|article|section|main|header|footer|nav|aside|body)(?=[\s/>])", re.I)


class _Element:
    __slots__ = ("tag", "drop", "kind", "header", "mark")

    def __init__(self, tag: str, drop: bool, kind: int, header: bool, mark: int):
        self.tag, self.drop, self.kind, self.header, self.mark = tag, drop, kind, header, mark


def _attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(said)}


def _judge(tag: str, said: str, within: int) -> tuple[bool, int]:
    """(is it dropped, what it marks: 3 article, 2 main, 1 a usual class, 0 nothing)."""
    drop, kind = tag in _DROP or tag in _RAW or tag in _FOREIGN, {"article": 3, "main": 2}.get(tag, 0)
    if said.strip():
        at = _attributes(said)
        names = f"{at.get('class', '')} {at.get('id', '')}".lower()
        exact = {w for w in names.split() if not w.startswith(("no-", "has-", "with-", "without-"))}
        # what is marked as the article, or lies in it, is noise only if a whole name says so
        words = exact if kind or within or exact & _MAIN else set(re.split(r"[^a-z0-9]+", " ".join(exact)))
        role = at.get("role", "").lower()
        drop |= role in _NOISE_ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
        drop |= bool(words & _NOISE) and tag not in ("html", "body", "main")
        if not kind and (role == "main" or at.get("itemprop", "").lower() == "articlebody"):
            kind = 2
        if not kind and tag in ("div", "section", "td") and exact & _MAIN:
            kind = 1
    return drop or tag == "article" and within == 3, kind


def blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of the main text, and whether the page marks it."""
    found: list[tuple[int, int, bool, str]] = []  # kind, marked element, first heading, text
    stack: list[_Element] = [_Element("", False, 0, False, 0)]
    marks = 0
    text: list[str] = []

    def flush() -> None:
        if text:
            top = stack[-1]
            if not top.drop and (said := " ".join(html.unescape("".join(text)).split())):
                found.append((top.kind, top.mark, any(e.tag == "h1" for e in stack), said))
            text.clear()

    def close(index: int) -> None:
        if any(e.tag in _BLOCK for e in stack[index:]) or stack[index].drop != stack[index - 1].drop:
            flush()
        del stack[index:]

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at: m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if i:
                close(i)
            elif tag in _BLOCK or tag == "br":
                text.append(" ")
            continue
        if tag in _BLOCK:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if i and not any(e.tag in ("td", "th", "table", "button", "object") for e in stack[i:]):
                close(i)
            ends, stops = _CLOSES.get(tag, (set(), set()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in ends:
                    close(i)
            if tag in _HEADING and stack[-1].tag in _HEADING:
                close(len(stack) - 1)
            flush()
        if tag in _VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        top = stack[-1]
        drop, kind = _judge(tag, m[3], top.kind)
        if tag in _FOREIGN:
            at = _after_foreign(page, tag, m[3], at)
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        header = top.header or tag == "header"
        # of a header only the headings of an article stay
        hidden = top.drop and not (top.header and top.tag != "" and tag in _HEADING and top.kind and not _held(stack)) or drop or tag == "header"
        if hidden and not top.drop:
            flush()
        if tag not in _BLOCK and not hidden:
            stack.append(_Element(tag, False, top.kind, header, top.mark))
            continue
        if hidden != top.drop or kind:
            flush()
        marks += kind > top.kind
        stack.append(_Element(tag, hidden, max(top.kind, kind), header, marks if kind > top.kind else top.mark))
    if at < len(page):
        text.append(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", page[at:]))
    flush()
    return _main(found)


def _main(found: list[tuple[int, int, bool, str]]) -> tuple[list[str], bool]:
    """The blocks of the highest kind of which an element holds as much text as any less marked one has besides, and all higher kinds."""
    own: dict[tuple[int, int], int] = {}
    for kind, mark, _, said in found:
        own[kind, mark] = own.get((kind, mark), 0) + len(said)
    best = 0
    for kind in sorted({k for k, _ in own if k}, reverse=True):
        best = kind
        if max(n for (k, _), n in own.items() if k == kind) >= max((n for (k, _), n in own.items() if 0 < k < kind), default=0):
            break
    first = next((i for i, f in enumerate(found) if f[0] >= best), 0)
    # the title may stand in the marked element around the article
    titled = any(f[0] >= best and f[2] for f in found)
    return [f[3] for i, f in enumerate(found) if f[0] >= best or i < first and f[0] and f[2] and not titled], best > 0


def _after_foreign(page: str, tag: str, said: str, at: int) -> int:
    """Where the page goes on after a drawing or formula, which may be empty or never closed."""
    if said.rstrip().endswith("/"):
        return at
    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    until = end.start() if end else len(page)
    out = None if re.compile("<(?:foreignobject|annotation-xml|desc)", re.I).search(page, at, until) else _BREAKOUT.search(page, at, until)
    return out.start() if out else end.end() if end else at


def _held(stack: list[_Element]) -> bool:
    """Whether something above the header already drops what is inside."""
    first = next(i for i, e in enumerate(stack) if e.header)
    return stack[first - 1].drop


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            done = [blocks(page or "") for page in part.column("html").to_pylist()]
            raw = ["\n\n".join(b).encode() for b, _ in done]
            stream = [xxhash.xxh3_64_intdigest(x) - 2**63 if x else None for x in raw]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array([pack.compress(x) for x in raw], pa.binary()),
                                              pa.array(stream, pa.int64()), pa.array([m for _, m in done], pa.bool_())], ["page_id", "url", "host", "packed", "stream", "marked"])


def _tokens(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hashes of the tokens of the blocks of some texts; each block's first token and length, its text, and its number there."""
    said = [x.split(b"\n\n") if x else [] for x in raw]
    every = [b for x in said for b in x]
    h, first, *_ = word_hashes(np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *map(len, every)]))
    return h, first[:-1], np.diff(first), np.repeat(np.arange(len(raw)), [len(x) for x in said]), np.concatenate([np.arange(len(x)) for x in said]) if said else first[:0]


def _starts(length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all blocks: (block, first token in it). Those of less than ``window`` tokens are left out, but for whole blocks."""
    many = np.where(length > 0, np.maximum(1, length - window + 1), 0)
    block = np.repeat(np.arange(len(length)), many)
    return block, np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)


def suffix_ranks(h: np.ndarray, first: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """The rank of each suffix of ``_starts`` among all, cut at ``window`` tokens and at the end of its block; equal ones share theirs."""
    # behind each block stand as many empty places as a suffix may reach over
    padded = np.zeros(len(h) + window * len(length), np.int64)
    at = np.cumsum(length + window) - length - window
    inside = np.repeat(at - first, length) + np.arange(len(h))
    padded[inside] = np.unique(h, return_inverse=True)[1] + 1
    rank, step = padded, 1

    def behind(shift: int) -> np.ndarray:
        after = np.zeros_like(rank)
        after[:len(rank) - shift] = rank[shift:]
        return np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]

    while 2 * step <= window:
        rank, step = behind(step), 2 * step
    if step < window:
        rank = behind(window - step)
    block, start = _starts(length, window)
    return rank[at[block] + start]


def _frequent(window: int, share: float):
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """Streams of one array after the other, each there once; they come sorted."""
        held: list[dict] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in batch.slice(i, 256).to_pylist():
                    if held and any(row[k] != held[0][k] for k in ("host", "marked", "salt")):
                        yield held
                        held = []
                    if not held or row["stream"] != held[-1]["stream"]:
                        held.append(row)
        if held:
            yield held

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings on more than ``share`` of the streams of a suffix array."""
        unpack = zstandard.ZstdDecompressor()
        for rows in arrays(batches):
            h, first, length, page, _ = _tokens([unpack.decompress(r["packed"]) for r in rows])
            rank = suffix_ranks(h, first, length, window)
            block, start = _starts(length, window)
            order = np.lexsort((page[block], rank))
            rank, owner = rank[order], page[block][order]
            opens = np.concatenate([[True], rank[1:] != rank[:-1]])[: len(rank)]
            at = np.flatnonzero(opens)
            # neighbours in the array that share the whole string; a page counts once
            fresh = opens | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(rank)]
            pages = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else at
            chosen = order[at[pages > share * len(rows)]]
            width = np.minimum(window, length[block[chosen]])
            begin = first[block[chosen]] + start[chosen]
            gram = stretch_hash(prefix_sums(h), begin, begin + width).view(np.int64) if len(chosen) else np.zeros(0, np.int64)
            m = len(gram)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["host"]] * m, pa.string()), pa.array([rows[0]["marked"]] * m, pa.bool_()), pa.array(gram), pa.array(width.astype(np.int32))],
                                             ["host", "marked", "gram", "width"])
    return frequent


def _places(window: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the candidates of its host stand in each stream."""
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    h, first, length, _, number = _tokens([unpack.decompress(row["packed"])])
                    block, start = _starts(length, window)
                    width = np.minimum(window, length[block])
                    begin = first[block] + start
                    gram = stretch_hash(prefix_sums(h), begin, begin + width).view(np.int64)
                    on = np.isin(gram, np.array([c["gram"] for c in row["candidates"]], np.int64))
                    m = int(on.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[k]] * m, t) for k, t in (("row", pa.int64()), ("host", pa.string()), ("marked", pa.bool_()), ("page", pa.string()), ("stream", pa.int64()))]
                        + [pa.array(gram[on]), pa.array(width[on].astype(np.int32)), pa.array(number[block[on]].astype(np.int32)), pa.array(start[on].astype(np.int32))],
                        ["row", "host", "marked", "page", "stream", "gram", "width", "block", "start"])
    return places


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the runs that repeated strings cover."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part, out = batch.slice(i, 512), []
            for packed, spans in zip(part.column("packed").to_pylist(), part.column("spans").to_pylist(), strict=True):
                text = unpack.decompress(packed)
                if spans:
                    words = [b.split() for b in text.split(b"\n\n")]
                    stay = [np.ones(len(w), bool) for w in words]
                    for s in spans:
                        stay[s["block"]][s["start"]: s["start"] + s["width"]] = False
                    # blocks of which nothing goes stay as they are
                    left = [b if k.all() else b" ".join(w[j] for j in np.flatnonzero(k)) for b, w, k in zip(text.split(b"\n\n"), words, stay, strict=True)]
                    text = b"\n\n".join(b for b in left if b)
                out.append(text.decode())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), part.column("marked")], ["page_id", "url", "text", "marked"])


def extract(pages: DataFrame, window: int = WINDOW, least: int = PAGES, share: float = SHARE, articles: int = ARTICLES) -> DataFrame:
    """page_id, url, text, n_chars, marked."""
    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "url", parts(F.col("url"))[0].alias("host"), "html").mapInArrow(
        _extract, f"page_id {kind}, url string, host string, packed binary, stream long, marked boolean")
    found = checkpoint(found.withColumn("row", F.monotonically_increasing_id()))
    streams = found.filter("stream IS NOT NULL").select("row", "host", "marked", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "stream", "packed")
    enough = F.when(F.col("marked"), F.lit(articles)).otherwise(F.lit(least))
    each = streams.groupBy("host", "marked", "stream").agg(F.lit(1).alias("_one")).groupBy("host", "marked").agg(F.count("*").alias("_streams"))
    sizes = checkpoint(each.filter(F.col("_streams") >= enough).select(F.col("host").alias("_host"), F.col("marked").alias("_marked"), "_streams"))
    same = (F.col("host") == F.col("_host")) & (F.col("marked") == F.col("_marked"))
    dealt = streams.join(sizes, same).select("host", "marked", F.pmod(F.xxhash64("stream"), F.ceil(F.col("_streams") / ARRAY)).alias("salt"), "stream", "packed")
    dealt = dealt.repartition("host", "marked", "salt").sortWithinPartitions("host", "marked", "salt", "stream")
    candidates = dealt.mapInArrow(_frequent(window, share), "host string, marked boolean, gram long, width int").distinct()
    candidates = checkpoint(candidates.groupBy(F.col("host").alias("_host"), F.col("marked").alias("_marked")).agg(F.collect_list(F.struct("gram", "width")).alias("candidates")))
    places = checkpoint(streams.join(candidates, same).select("row", "host", "marked", "page", "stream", "packed", "candidates").mapInArrow(
        _places(window), "row long, host string, marked boolean, page string, stream long, gram long, width int, block int, start int"))
    counts = places.groupBy("host", "marked", "gram", "width").agg(F.count_distinct("stream").alias("_on"), F.count_distinct("page").alias("_pages"))
    often = counts.join(sizes, same).filter((F.col("_on") > F.lit(share) * F.col("_streams")) & (F.least("_on", "_pages") >= enough))
    often = checkpoint(often.select("_host", "_marked", F.col("gram").alias("_gram"), F.col("width").alias("_width")))
    there = same & (F.col("gram") == F.col("_gram")) & (F.col("width") == F.col("_width"))
    spans = places.join(often, there).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("block", "start", "width")).alias("spans"))
    whole = found.join(spans, F.col("row") == F.col("_row"), "left").select("page_id", "url", "packed", "marked", "spans")
    text = whole.mapInArrow(_rest, f"page_id {kind}, url string, text string, marked boolean")
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "marked")
