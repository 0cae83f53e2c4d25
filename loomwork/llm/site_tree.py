"""Main texts of web pages by site style trees.

The pages of a host are merged into one tree (Yi, Liu and Li, "Eliminating noisy information in web pages"): an element is known by the labels on
its way from the root, a label is a tag with its classes and id, digits folded. Of m pages of the host that have an element,

* its presentation importance is the entropy, to the base m, of the sequences of children that pages give it: 0 where all pages look alike;
* the importance of a content of it, the text of a block, is one less the entropy of that text over the pages: 0 where it stands on all m, 1 where on one.
  An element's content importance is the mean of its contents.
* its composite importance is its content importance if it has no children, and else mixes its presentation importance with the mean of its children's:
  the more presentations there are (l), the more it trusts them, by 1 - DECAY**l. It is worked out along the page's own branch.

A page loses the branches whose composite importance is under BRANCH, and single blocks whose content importance is under CONTENT. Elements that
fewer than PAGES pages of the host have are all important. Pages of one host with one text count once, so that copies of an article do not turn
it into a template. The tree alone can't tell an advert with a new text on every page from an article, so elements whose tag, role, class or id names
a menu, header, footer, sidebar, notice, advert, form, reader comment or script have no importance from the start, nor have hidden ones. An article's own
element stays, and it stays whole where the tree would take more than half of its text. If a page has article or main elements left, their blocks
are its text; else all blocks are, without those that are mostly links.

``extract`` gives page_id, url, text, n_blocks (of the text) and n_removed (blocks that the tree took). Blocks are the texts between the bounds of block elements, cells and
list items included; character references are decoded, white space in a block is one space (a line break element too), blocks are joined by one line feed.

In the cluster: pages give their elements' features; these are counted by (element, feature), which combines before it shuffles, then by element. Pages are dealt to buckets
of about ``bucket_bytes``, and the figures of an element go to each bucket that has it, where pages meet them in order: no broadcast, no host in
one task. A page is read twice; the same rows must come each time.

Nulls: a null html is an empty page, with an empty text; a null or relative url has no host, so its page is a site by itself. Repeated rows each give a row and count
once in the tree. Broken markup (missing ends, cut-off tags, stray signs) is read as browsers do, as far as texts go. Very long and deep pages take memory in proportion to themselves.
Ties: an importance equal to its bound stays. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.textkit import ship, sub_batches

#: Least pages of an element, least importance of a branch and of a block, trust in presentations.
PAGES, BRANCH, CONTENT, DECAY = 4, 0.2, 0.05, 0.9
#: Least share of an article's text that the tree must leave, and the share of link text that makes a block a menu where no article is marked.
LEAVES, LINKS = 0.5, 0.6
SALTS = 61

# Names of HTML elements by what they do, and words that name noise in roles, classes and ids.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu head fieldset".split())
#: Noise that stands within a line of text and does not part it.
NOISE_IN_LINE = frozenset("button select option optgroup datalist svg canvas audio video object applet map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img meter progress slot input picture".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt body html".split()
)
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("table td th caption button object".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar toolbar masthead footer sidebar aside rail widget widgets "
    "ad ads adbox adslot adsense adsbygoogle adunit adwrap advert adverts advertisement advertising advertorial banner promo promotion promoted sponsor sponsored outbrain taboola "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "comment comments commentlist disqus replies respond share sharing social related recommended form search login".split()
)
ARTICLE = frozenset(("article", "main"))

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|(!--)|[!?/][^>]*>)")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class _Labels(dict):
    """(tag, attributes) -> label, whether words name noise, whether a header, whether hidden, whether an article; remembered while few."""

    def __missing__(self, key: tuple[str, str]) -> tuple[str, bool, bool, bool, bool]:
        if len(self) > 20_000:
            self.clear()
        tag, text = key
        got = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}
        names = f"{got.get('class', '')} {got.get('id', '')}"
        words = {w.lower() for w in _WORDS.findall(names)}
        role = got.get("role", "").strip().lower()
        noise = bool(words & NOISE_WORDS) or role in NOISE_ROLES
        hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(got.get("style", "")))
        article = tag in ARTICLE or role in ARTICLE or got.get("itemprop", "").lower() == "articlebody"
        header = tag == "header" or "header" in words
        out = self[key] = (_DIGITS.sub("0", " ".join([tag, *sorted(names.split())])), noise, header, hidden, article)
        return out


_LABELS = _Labels()


class Page:
    """Elements in page order (parent, label, tag, what they are) and blocks of text (element, text, characters in links)."""

    def __init__(self, html: str) -> None:
        self.parent: list[int] = [-1]
        self.label: list[str] = [""]
        self.tag: list[str] = [""]
        #: Noise by tag or hidden, noise by names, a header, an article's element.
        self.dead, self.named, self.header, self.article = [False], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)
        self._settle_names()

    def _read(self, html: str) -> None:
        open_: list[int] = [0]
        held: list[str] = []
        linked, in_link = 0, False
        #: Inline elements that say they are noise: their tags and the elements open around them.
        muted: list[tuple[str, int]] = []

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((open_[-1], text, linked))
                held.clear()
            linked = 0

        def close_to(k: int) -> None:
            flush()
            del open_[k:]
            while muted and muted[-1][1] > k:
                muted.pop()

        def find(names, barrier=frozenset(), outermost: bool = False) -> int:
            """The place of an open element with one of the names, not looking beyond a barrier; 0 if there is none."""
            found = 0
            for k in range(len(open_) - 1, 0, -1):
                tag = self.tag[open_[k]]
                if tag in names:
                    found = k
                    if not outermost:
                        break
                if tag in barrier:
                    break
            return found

        def say(text: str) -> None:
            nonlocal linked
            if muted:
                return
            if "&" in text:
                text = unescape(text)
            held.append(text)
            if in_link:
                linked += len(text)

        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                tail = html[at:]
                cut = _CUT_OFF.search(tail)
                say(tail[: cut.start()] if cut else tail)
                break
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            if m[7]:  # a comment
                if html.startswith((">", "->"), at):
                    at = html.index(">", at) + 1
                else:
                    end = _COMMENT_END.search(html, at)
                    at = end.end() if end else n
                continue
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag == "a":
                    in_link = False
                if tag in INLINE or tag in NOISE_IN_LINE:
                    at_ = next((i for i in range(len(muted) - 1, -1, -1) if muted[i][0] == tag), None)
                    if at_ is not None:
                        del muted[at_:]
                    continue
                if tag == "br":
                    held.append(" ")
                elif tag in HEADINGS:
                    if k := find(HEADINGS):
                        close_to(k)
                elif k := find((tag,), ("article", "main", "body") if tag in ("p", "li", "dt", "dd") else ()):
                    close_to(k)
                elif not (muted and muted[-1][0] in NOISE_IN_LINE):
                    flush()
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                # What is left out does not part the text around it.
                at = html.find(">", end.end()) + 1 if end else n
                if not at:
                    break
                continue
            if tag in INLINE or tag in NOISE_IN_LINE:
                if tag == "a":
                    in_link = True
                if tag not in VOID:
                    _, noise, _, hidden, _ = _LABELS[tag, rest] if rest else ("", False, False, False, False)
                    if noise or hidden or tag in NOISE_IN_LINE or (muted and muted[-1][0] == tag):
                        muted.append((tag, len(open_)))
                continue
            if muted and muted[-1][0] in NOISE_IN_LINE:
                # What stands in a button or a drawing is no part of the page's structure.
                continue
            if tag in CLOSES_P and (k := find(("p",), SCOPE)):
                close_to(k)
            if tag in HEADINGS and self.tag[open_[-1]] in HEADINGS:
                close_to(len(open_) - 1)
            if tag in CLOSED_BY and (k := find(CLOSED_BY[tag], LISTS, outermost=True)):
                close_to(k)
            if tag in ("html", "body") and any(self.tag[i] == tag for i in open_):
                continue
            flush()
            if tag == "body" and (k := find(("head",))):
                close_to(k)
            if tag in VOID:
                continue
            label, noise, header, hidden, article = _LABELS[tag, rest]
            self._push(open_, tag, label, bool(muted) or hidden or tag in NOISE_TAGS, noise, header, article)
        flush()

    def _push(self, open_: list[int], tag: str, label: str, dead: bool, named: bool, header: bool, article: bool) -> None:
        up = open_[-1]
        self.parent.append(up)
        self.label.append(label)
        self.tag.append(tag)
        self.dead.append(self.dead[up] or dead)
        self.named.append(named)
        self.header.append(header)
        self.article.append(article)
        open_.append(len(self.parent) - 1)

    def _settle_names(self) -> None:
        """Names count as noise, but for those of elements around all that is left of the article, and of a header within an article."""
        n = len(self.parent)
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.article[i]

        def marked() -> list[bool]:
            out = [False] * n
            for i in range(1, n):
                own = (self.named[i] or (self.header[i] and not inside[self.parent[i]])) and self.tag[i] not in ("html", "body")
                out[i] = self.dead[i] or out[self.parent[i]] or own
            return out

        out = marked()
        articles = [i for i in range(1, n) if self.article[i] and not self.dead[i]]
        if articles and all(out[i] for i in articles):
            for i in articles:
                if not self.named[i]:
                    while i > 0:
                        self.named[i] = self.header[i] = False
                        i = self.parent[i]
            out = marked()
        self.dead = out
        #: Whether an element is an article's or has one below that is left.
        self.holds = [a and not d for a, d in zip(self.article, out, strict=True)]
        for i in range(n - 1, 0, -1):
            if self.holds[i]:
                self.holds[self.parent[i]] = True
        self.inside = inside
        self.blocks = [b for b in self.blocks if not out[b[0]]]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            if not out[i]:
                self.children[self.parent[i]].append(i)

    def keys(self, host: str) -> list[int]:
        """An element's key: its labels from the host on."""
        out = [_key(0, host)] * len(self.parent)
        for i in range(1, len(self.parent)):
            out[i] = _key(out[self.parent[i]], self.label[i])
        return out


def _key(above: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), above)


def content_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(_DIGITS.sub("0", text.lower()).encode("utf-8", "surrogatepass"), 1)


def features(page: Page, keys: list[int]) -> set[tuple[int, int, int]]:
    """(element, kind, feature): that the page has it (0), the children it gives it (1), its contents (2)."""
    out = set()
    for i in range(1, len(keys)):
        if not page.dead[i]:
            out.add((keys[i], 0, 0))
            out.add((keys[i], 1, xxhash.xxh64_intdigest("\n".join([page.label[c] for c in page.children[i]]).encode("utf-8", "surrogatepass"))))
    for i, text, _ in page.blocks:
        out.add((keys[i], 2, content_hash(text)))
    return out


def main_text(page: Page, keys: list[int], figures: dict[int, tuple[float, int, float]], noisy: set[tuple[int, int]]) -> tuple[list[str], int]:
    """The blocks of the main text, and how many the tree took. ``figures`` has (presentation, l, content) of elements that enough pages have."""
    n = len(keys)
    owns = [False] * n
    for i, _, _ in page.blocks:
        owns[i] = True
    worth, gone = [1.0] * n, [False] * n
    if figures:
        for i in range(n - 1, 0, -1):
            known = figures.get(keys[i])
            if known is None or page.dead[i]:
                continue
            presentation, styles, content = known
            parts = [worth[c] for c in page.children[i]] + ([content] if owns[i] else [])
            if page.children[i]:
                trust = DECAY**styles
                worth[i] = (1 - trust) * presentation + trust * sum(parts) / len(parts)
            elif owns[i]:
                worth[i] = content
        for i in range(1, n):
            gone[i] = gone[page.parent[i]] or (worth[i] < BRANCH and not page.holds[i] and page.tag[i] not in ("html", "body"))
    has_article = page.holds[0]
    blocks = [b for b in page.blocks if page.inside[b[0]]] if has_article else [b for b in page.blocks if b[2] <= LINKS * len(b[1])]
    kept = [b for b in blocks if not gone[b[0]] and (keys[b[0]], content_hash(b[1])) not in noisy] if figures else blocks
    if has_article and sum(len(b[1]) for b in kept) < LEAVES * sum(len(b[1]) for b in blocks):
        kept = blocks
    return [b[1] for b in kept], len(blocks) - len(kept)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, as compressed bytes: pages are most of what is shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    for b in sub_batches(batches, 4 << 20):
        pressed = [None if t is None else press.compress(t.encode()) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pressed, pa.binary())], names=b.schema.names)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, url, html) -> (bucket, page, features) of the pages that have a host; equal pages of a batch once a bucket."""
    for b in sub_batches(batches, 4 << 20):
        buckets, pages, ends, rows, seen = [], [], [0], [], set()
        for bucket, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            host = host_of(url)
            if not host or not html:
                continue
            page = Page(html)
            sign = xxhash.xxh64_intdigest("\n".join([host, *(t for _, t, _ in page.blocks)]).encode("utf-8", "surrogatepass"))
            if (bucket, sign) in seen:
                continue
            seen.add((bucket, sign))
            buckets.append(bucket)
            pages.append(_signed(sign))
            rows += features(page, page.keys(host))
            ends.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        parts = [pa.array(np.array(columns[0], np.uint64).view(np.int64)), pa.array(columns[1], pa.int8()), pa.array(np.array(columns[2], np.uint64).view(np.int64))]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["element", "kind", "feature"]))
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(pages, pa.int64()), listed], names=["bucket", "page", "features"])


def tree(pages: DataFrame) -> DataFrame:
    """element, presentation, styles, content, noisy: the figures of each element that enough pages have, and the contents of it that fall under CONTENT.

    Their number is bounded: each stands on nearly all pages of the element, m to the power of 1 - CONTENT of them at least.
    """
    once = pages.select("page", "features").dropDuplicates(["page"]).select(F.inline("features"))
    counted = once.groupBy("element", "kind", "feature").agg(F.count("*").alias("c"))
    c = F.col("c").cast("double")

    def of(kind: int, value) -> F.Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    sums = counted.groupBy("element").agg(
        of(0, F.col("c")).alias("m"), of(1, c).alias("shown"), of(1, c * F.log(c)).alias("shown_log"), of(1, F.lit(1)).alias("styles"), of(2, F.log(c)).alias("said_log"), of(2, F.lit(1)).alias("said")
    ).filter(F.col("m") >= PAGES)
    base = F.log(F.col("m").cast("double"))
    figures = sums.select(
        "element", "m", ((F.log("shown") - F.col("shown_log") / F.col("shown")) / base).alias("presentation"), F.col("styles").cast("long").alias("styles"),
        F.coalesce(1 - F.col("said_log") / F.col("said") / base, F.lit(1.0)).alias("content"),
    )
    # Contents that so many pages have can only be of elements with PAGES pages.
    often = counted.filter((F.col("kind") == 2) & (F.col("c") >= math.floor(PAGES ** (1 - CONTENT))))
    noisy = often.join(figures.select("element", "m"), "element").filter(F.log(c) > (1 - CONTENT) * F.log(F.col("m").cast("double")))
    return figures.drop("m").join(noisy.groupBy("element").agg(F.collect_list("feature").alias("noisy")), "element", "left")


_OUT = "page_id long, url string, text string, n_blocks long, n_removed long"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (bucket, is_page, page_id, url, html, element, presentation, styles, content, noisy) in order of the first two."""
    now, figures, noisy, unpress = None, {}, set(), zstandard.ZstdDecompressor()
    for whole in batches:
        flag, bucket = whole.column(1).to_numpy(zero_copy_only=False), whole.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (flag[1:] != flag[:-1])) + 1).tolist(), len(bucket)]
        for p, q in zip(bounds, bounds[1:], strict=False):
            if p == q:
                continue
            part = whole.slice(p, q - p)
            if bucket[p] != now:
                now, figures, noisy = bucket[p], {}, set()
            if not flag[p]:
                for element, presentation, styles, content, said in zip(*(part.column(k).to_pylist() for k in range(5, 10)), strict=True):
                    key = element & 0xFFFFFFFFFFFFFFFF
                    figures[key] = (presentation, styles, content)
                    noisy.update((key, f & 0xFFFFFFFFFFFFFFFF) for f in said or ())
                continue
            for b in sub_batches(iter([part]), 4 << 20):
                texts, sizes, removed = [], [], []
                for url, html in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    page = Page(unpress.decompress(html).decode() if html else "")
                    host = host_of(url)
                    blocks, n = main_text(page, page.keys(host), figures if host else {}, noisy)
                    texts.append("\n".join(blocks))
                    sizes.append(len(blocks))
                    removed.append(n)
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["page_id", "url", "text", "n_blocks", "n_removed"])


def extract(df: DataFrame, *, bucket_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_blocks, n_removed of every row (see the module)."""
    spark = ship(df.sparkSession)
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    # Rows that are equal part by the partition that they are read in.
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    pages = pages.withColumn("bucket", F.pmod(F.xxhash64("html", "url", "page_id", salt), F.lit(parts)))
    rows = pages.select("bucket", "url", "html").mapInArrow(_features, "bucket long, page long, features array<struct<element: long, kind: byte, feature: long>>")
    blank = F.lit(None)
    needed = rows.select("bucket", F.explode(F.transform("features", lambda f: f["element"])).alias("element")).distinct()
    known = needed.join(tree(rows), "element").select(
        "bucket", F.lit(False).alias("is_page"), blank.cast("long").alias("page_id"), blank.cast("string").alias("url"), blank.cast("binary").alias("html"), "element", "presentation", "styles", "content", "noisy"
    )
    pressed = pages.select("bucket", "page_id", "url", "html").mapInArrow(_pressed, "bucket long, page_id long, url string, html binary")
    told = pressed.select(
        "bucket", F.lit(True).alias("is_page"), "page_id", "url", "html", blank.cast("long").alias("element"), blank.cast("double").alias("presentation"), blank.cast("long").alias("styles"), blank.cast("double").alias("content"), blank.cast("array<long>").alias("noisy")
    )
    return known.unionByName(told).repartition(parts, "bucket").sortWithinPartitions("bucket", "is_page").mapInArrow(_extracted, _OUT)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_removed")
