"""Main text of web pages, with site templates removed.

Each page is read once: a small scanner walks its tags and gives the text blocks of the main region (all articles, or else main, or else what is named as content, or else the body), and hashes the subtree of each container from its texts
and children. Spark counts subtree hashes per host over all pages: what recurs on MANY pages of a host is its template, and the blocks under it are deleted. Pages are told apart by their longest block, so that copies of an article
under many addresses, edited or not, aren't taken for a template.

Menus, headers, footers, sidebars, forms, scripts and the like are left out by their tags and roles. Class names and ids are weaker evidence: one that is wholly the name of an advert, a comment list or a menu counts everywhere;
one that only has such a word in it (share-price, notices-of-intent) counts outside of the main region, and inside only where blocks so named recur on MANY pages of the host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, slices

#: A subtree, or a name, belongs to a host's template from so many different pages on.
MANY = 5

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
DROPPED = frozenset("head script style noscript template iframe noframes noembed xmp title nav footer aside form fieldset button select datalist textarea dialog menu svg math object canvas audio video map".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header html li main menu nav ol section table tbody td tfoot th thead tr ul dialog details".split())
#: Containers that a template may be made of; plain paragraphs and headings are never one.
TEMPLATES = frozenset("aside div dl figure footer form header menu nav ol section table ul".split())
#: An opening tag ends open ones of these names, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
_MARKED = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|nav\w*|menus?|sidebar\w*|masthead|footer|comments?|disqus|sharing|share|social|related|recommend\w*|newsletter|subscribe|subscription|popup|modal|overlay|breadcrumbs?|pagination|pager|widget|toolbar|login|signup|skip-link)(?:$|[-_\s])", re.IGNORECASE)
#: Class names and ids that mean nothing else.
_CERTAIN = frozenset("ad ads advert adverts advertisement advertisements adsbygoogle ad-slot sponsored comment comments comment-list comment-section disqus_thread nav navbar navigation menu sidebar breadcrumb breadcrumbs pagination cookie-banner cookie-notice newsletter newsletter-signup popup modal share-buttons social-share related-posts skip-link site-header site-footer".split())
_HEADER = re.compile(r"(?:^|[-_\s])header(?:$|[-_\s])", re.IGNORECASE)
_CONTENT = re.compile(r"(?:^|\s)(?:article(?:-?(?:body|content|text))?|(?:post|entry|page|main)-?(?:content|body|text)|content|story(?:-?body)?)(?:$|\s)", re.IGNORECASE)
_UNMARKED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())


def _digest(parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """One page read: blocks of text, and spans of them that containers cover, each with its digest (of texts and children) and, if its name is weak evidence, its shape (of the name)."""

    def __init__(self, source: str):
        # blocks: [text parts, rank of the region, number of the region]
        self.blocks: list[list] = []
        self.regions = 0
        # open elements: [tag, dropped, rank, region, parts, first block, shape, whether it began a region]
        self.open: list[list] = []
        self.places: dict[str, list[int]] = {}  # of open elements by name
        self.containers: list[int] = []
        self.digests: set[int] = set()
        self.shapes: set[int] = set()
        self.covers: list[tuple[int, int, int, int | None, int]] = []  # digest, first and last block, shape, rank
        self.fresh = True
        at, top = 0, len(source)
        while at < top:
            m = _TAG.search(source, at)
            self.text(source[at : m.start() if m else top])
            if not m:
                break
            at = m.end()
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                self.close(name)
            else:
                self.begin(name, rest or "")
                if name in RAW:  # its content isn't markup
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                    if name in ("textarea", "title"):
                        self.text(source[at : end.start() if end else top])
                    self.close(name)
                    at = end.end() if end else top
        while self.open:
            self.pop()

    def text(self, raw: str) -> None:
        if not raw:
            return
        dropped, rank, region = self.open[-1][1:4] if self.open else (False, 0, 0)
        plain = html.unescape(raw)
        if self.open:
            self.open[-1][4].append(" ".join(plain.split()))
        if dropped:
            return
        if self.fresh or not self.blocks or self.blocks[-1][2] != region:
            self.blocks.append([[], rank, region])
            self.fresh = False
        self.blocks[-1][0].append(plain)

    def _last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def begin(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self.fresh = True
            ends = ENDS.get(name, set())
            while True:  # end what this tag ends, up to the nearest container
                last = max(map(self._last, ends), default=-1)
                if name not in ("td", "th", "tr", "option"):
                    last = max(last, self._last("p"))
                if last < 0 or self.containers and last < self.containers[-1]:
                    break
                while len(self.open) > last:
                    self.pop()
                if name != "tr":
                    break
        if name == "br":
            self.text(" ")
        if name in VOID or rest.endswith("/") and name not in BLOCKS and name not in RAW:
            return
        _, dropped, rank, region, *_ = self.open[-1] if self.open else ("", False, 0, 0)
        marks = [x for g in _NAMES.findall(rest) for x in g if x] if rest else []
        roles = {w.lower() for x in marks for w in x.split()}
        shape, began = None, False
        if not dropped and name not in _UNMARKED:
            dropped = name in DROPPED or bool(roles & _ROLES) or bool(roles & _CERTAIN) or rank < 2 and (name == "header" or any(map(_HEADER.search, marks)))
            if not dropped and any(map(_MARKED.search, marks)):
                dropped = rank == 0
                shape = _digest([name, *sorted(re.sub("[0-9]+", "0", w) for w in roles)])
        elif name in DROPPED:
            dropped = True
        if not dropped:
            own = 3 if name == "article" or "article" in roles else 2 if name == "main" or "main" in roles else 1 if name in ("div", "section", "td") and any(map(_CONTENT.search, marks)) else 0
            if own > rank:
                self.regions += 1
                rank, region, began = own, self.regions, True
                self.fresh = True
        place = len(self.open)
        self.open.append([name, dropped, rank, region, [name], len(self.blocks), shape, began])
        self.places.setdefault(name, []).append(place)
        if name in CONTAINERS:
            self.containers.append(place)

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.fresh = True
        last = self._last(name)
        if last < 0 or name not in CONTAINERS and self.containers and last < self.containers[-1]:
            return
        while len(self.open) > last:
            self.pop()

    def pop(self) -> None:
        name, dropped, rank, region, parts, first, shape, began = self.open.pop()
        self.places[name].pop()
        if name in CONTAINERS:
            self.containers.pop()
        if self.open:
            digest = _digest(parts)
            self.open[-1][4].append(f"{digest:x}")
            if name in TEMPLATES and len(parts) > 1:
                self.digests.add(digest)
                if shape is not None:
                    self.shapes.add(shape)
                if not dropped and not began and len(self.blocks) > first:
                    self.covers.append((digest, first, len(self.blocks), shape, rank))
        if name in BLOCKS:
            self.fresh = True

    def main(self) -> tuple[list[str], list[tuple[int, int, int, int | None]]]:
        """The blocks of the best rank (all articles, else all of main, else all named as content, else the body), and what covers them: digest, first and last of these blocks, and shape."""
        lines = [" ".join("".join(b[0]).split()) for b in self.blocks]
        best = max((b[1] for b, line in zip(self.blocks, lines, strict=True) if line), default=0)
        chosen = [bool(line) and b[1] == best for b, line in zip(self.blocks, lines, strict=True)]
        before = [0]
        for c in chosen:
            before.append(before[-1] + c)
        covers = [(digest, before[first], before[last], shape) for digest, first, last, shape, rank in self.covers if rank == best and before[last] > before[first]]
        return [line for line, c in zip(lines, chosen, strict=True) if c], covers

    def main_text(self) -> str:
        return "\n".join(self.main()[0])


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without port or user; empty if there is none."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_COVER = pa.struct([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def extract(pages: DataFrame, many: int = MANY) -> DataFrame:
    """page_id, url, text and n_chars (code points of text), a row for each row of pages.

    A null or empty html has no text. Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. Null urls share one host. Repeated rows, and pages with the same longest block, count
    once in the search for templates; each gets its row. A page without other text than its template becomes empty. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 1 << 20):
                hosts, bodies, blocks, keys, covers = [], [], [], [], []
                for source, url in zip(batch.column("html"), batch.column("url"), strict=True):
                    page = Page(source.as_py() or "")
                    lines, over = page.main()
                    hosts.append(host_of(url.as_py()))
                    bodies.append(_digest([max(lines, key=len, default="")]))
                    blocks.append(lines)
                    keys.append(sorted(page.digests | page.shapes))
                    covers.append([{"key": k, "first": a, "last": b} for digest, a, b, shape in over for k in (digest, shape) if k is not None])
                columns = [batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(covers, pa.list_(_COVER))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "body", "blocks", "keys", "covers"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = rows.mapInArrow(run, "page_id long, url string, host string, body long, blocks array<string>, keys array<long>, covers array<struct<key:long,first:int,last:int>>")
    # equal pages need the same deletions, so what tells rows apart is what they hold
    once = settle(read.withColumn("page", F.xxhash64("host", "blocks", F.transform("covers", lambda c: c["key"]))))
    met = once.select("host", "body", F.explode("keys").alias("key"))
    template = settle(met.groupBy("host", "key").agg(F.countDistinct("body").alias("n")).where(F.col("n") >= many).select("host", "key"))
    inside = once.select("host", "page", F.explode("covers").alias("c")).select("host", "page", "c.*").distinct()
    gone = settle(inside.join(template, ["host", "key"]).groupBy("page").agg(F.collect_set(F.struct("first", "last")).alias("gone")))
    left = F.filter("blocks", lambda _, i: ~F.exists("gone", lambda g: (g["first"] <= i) & (i < g["last"])))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(left), "\n")
    return once.join(gone, "page", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
