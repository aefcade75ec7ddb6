"""Main text of web pages by template deduction over pages of one host.

Pages are cut into tokens: elements by their path (tags, classes and ids, as a running hash) and
blocks of text within them. The occurrence vector of a token says how often each page of its host
has it; tokens with equal vectors form an equivalence class. Vectors are never gathered: a sum of
hashes of (page, count) stands for one, so classes come from one partial aggregate over (host,
token). Classes that are frequent (elements on ``SHARE`` of the host's pages, texts on
``TEXT_SHARE``) and large (two tokens) are read on the pages a second time: valid are those whose
tokens come in the same order on every page and whose runs lie within a gap of another class,
never across it. Valid classes, nested in one another, are the host's template; what lies between
its tokens are slots.

The same reading sums the text of the slots below each element of the template, over all of the
host's pages. The region of the main text is an element of the template: ``article`` or ``main``
where the template has one (of several, the one that comes once a page, then the one with the
most text), else the element reached from the root by going down to the child with more than half
of the text, as long as no headline and no text outside of child elements is left behind. A page's text are the slots inside that
region. A region that is template altogether (copies of one article on most pages of a host) stays
whole. Where a host has fewer than ``LEAST_PAGES`` different pages, or a page lacks its host's region,
the region is chosen in the same way among the page's own elements.

Within the region, elements go that are no article by their tag or role (``nav``, ``aside``,
``footer``, forms, ...) or by a whole name in ``NAMES``, unless they hold an article themselves; and
lists of nothing but links outside of an article. These are hints only: they choose no region.

Templates are sent to the executors as a whole only if their measured size is below
``BROADCAST_BYTES``, else they are joined by host and a salt.

Defined cases: null html is empty and gives an empty text; a null ``url`` or one without a host
makes a host of its own; equal rows get equal values; an empty table gives an empty result; other
columns are ignored; nesting of any depth costs memory and time in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Least share of a host's pages of a template's elements and texts, and least number of pages.
SHARE, TEXT_SHARE, LEAST_PAGES = 0.4, 0.9, 3
#: Least number of tokens of a class.
LARGE = 2
BROADCAST_BYTES = 16 << 20
#: Parts that a host's pages are dealt into where templates are joined.
SALTS = 16

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?:^|\s)(hidden)(?=[\s=/]|$)""", re.I)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head nav footer aside form script style noscript template button select option textarea iframe svg canvas object audio video menu dialog title".split())
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Whole classes and ids of what is no article.
NAMES = set("ad ads advert advertisement sponsored sidebar breadcrumb breadcrumbs pagination cookie-notice cookie-banner newsletter".split())
READERS = {"comment", "comments", "comment-list", "commentlist", "replies"}
CONTAINERS = {"html", "body", "div", "section", "center", "table", "tbody", "tr", "td", "form"}
LISTS = {"ul", "ol", "dl", "table"}
#: Elements that end an open one of their group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = {"article", "main", "section", "div", "table", "ul", "ol", "dl", "body", "html", "button", "td", "th", "blockquote", "form", "nav", "aside", "footer", "header"}
#: Kinds of elements that the choice of a region asks for.
PLAIN, CONTAINER, ARTICLE, HEADLINE = range(4)

_KEYS: dict[tuple[int, str], int] = {}


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _path(above: int, step: str) -> int:
    """Hash of a path from the hash of the path above it."""
    got = _KEYS.get((above, step))
    if got is None:
        if len(_KEYS) > 200_000:
            _KEYS.clear()
        got = _KEYS[above, step] = _hash(f"{above}/{step}")
    return got


def token_of(path: int, text: str) -> int:
    """The token of a block of text."""
    return _hash(f"{path}\n{text}")


class Element:
    __slots__ = ("tag", "key", "above", "inline", "kind", "gone", "reader", "holds", "link", "article", "text", "own", "linked", "blocks", "dropped")

    def __init__(self, tag: str, attributes: str, above: Element | None):
        names: list[str] = []
        role, gone = "", tag in DROPPED
        for name, a, b, c, hidden in _NAMES.findall(attributes) if attributes else ():
            value = a or b or c
            name = name.lower()
            if hidden:
                gone = True
            elif name == "style":
                gone |= "display:none" in value.replace(" ", "").lower()
            elif name == "role":
                role = value.lower()
            else:
                names += value.lower().split()
        main = tag in ("article", "main") or role == "main"
        self.reader = not READERS.isdisjoint(names)
        if tag not in ("html", "body", "main"):
            gone |= self.reader or role in DROPPED_ROLES or not NAMES.isdisjoint(names)
        self.article = above is not None and above.article
        gone |= tag == "header" and not self.article and (above is None or above.tag in ("html", "body"))
        self.kind = ARTICLE if main and not gone else HEADLINE if tag == "h1" else CONTAINER if tag in CONTAINERS else PLAIN
        self.tag, self.above, self.gone, self.inline = tag, above, gone, tag in INLINE
        self.link = tag == "a" or (above is not None and above.link)
        self.article |= self.kind == ARTICLE
        self.holds = False  # an article
        if self.kind == ARTICLE:
            up = above
            while up is not None and not up.holds:
                up.holds = True
                up = up.above
        step = tag if not names else tag + "." + re.sub(r"\d+", "0", " ".join(names))
        self.key = _path(above.key if above else 0, step)
        self.text = self.own = self.linked = self.blocks = 0
        self.dropped = False


class Page:
    """Elements, blocks (element, text, characters in links) and tokens of a page, in order."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.found: list[tuple[Element | None, str, int]] = []
        self.events: list[tuple[Element | None, str | None]] = []
        self._read(html)
        for e in self.elements:
            up = e.above
            # What holds an article is no form, sidebar or advert, whatever it is called; readers' words are.
            e.dropped = (up is not None and up.dropped) or (e.gone and not (e.holds and not e.reader))
        for e, text, links in self.found:
            if e is not None:
                e.text += len(text)
                e.own += len(text) - links
                e.linked += links
                e.blocks += 1
        for e in reversed(self.elements):
            if e.above is not None and not e.dropped:
                e.above.text += e.text
                e.above.linked += e.linked
                e.above.blocks += e.blocks
        for e in self.elements:
            if e.tag in LISTS and not e.article and e.blocks > 2 and 10 * e.linked >= 9 * e.text:
                e.gone = True
            e.dropped |= (e.above is not None and e.above.dropped) or (e.gone and not (e.holds and not e.reader))

    def _read(self, html: str) -> None:
        stack: list[Element] = []
        text: list[str] = []
        links = 0
        skip = ""

        def end() -> None:
            nonlocal links
            if text:
                block = " ".join("".join(text).split())
                if block:
                    top = next((e for e in reversed(stack) if not e.inline), stack[-1] if stack else None)
                    self.found.append((top, block, links))
                    self.events.append((top, block))
                text.clear()
            links = 0

        def say(part: str) -> None:
            nonlocal links
            if part:
                part = unescape(part)
                text.append(part)
                if stack and stack[-1].link:
                    links += len(part)

        pos, size = 0, len(html)
        while pos < size:
            if skip:
                m = re.compile(rf"</{skip}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, pos)
                if not m:
                    break
                pos, skip = m.end(), ""
                continue
            m = _TAG.search(html, pos)
            if not m:
                say(html[pos:])
                break
            say(html[pos : m.start()])
            pos = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "br":
                    text.append(" ")
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)
                if tag not in INLINE:
                    end()
                if at >= 0 and not (tag in INLINE | {"p"} and any(e.tag in ("article", "main", "td", "table") for e in stack[at + 1 :])):
                    if any(not e.inline for e in stack[at:]):
                        end()
                    del stack[at:]
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag not in INLINE:
                end()
            shut = ("p",) if tag in CLOSES_P else CLOSES.get(tag, ())
            if shut:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in shut:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPES and stack[i].tag not in shut and not (tag in ("td", "th", "tr") and stack[i].tag in ("div",)):
                        break
            if tag in VOID:
                continue
            if tag in RAW:
                skip = tag
                continue
            if not (m[3] or "").endswith("/") or tag not in ("svg", "path"):
                e = Element(tag, m[3] or "", stack[-1] if stack else None)
                stack.append(e)
                self.elements.append(e)
                if not e.inline:
                    self.events.append((e, None))
        end()

    def tokens(self) -> list[tuple[int, bool]]:
        """(token, whether it is a text) of what isn't dropped, in order."""
        return [(e.key, False) if text is None else (token_of(e.key if e else 0, text), True) for e, text in self.events if e is None or not e.dropped]

    def outline(self, wanted=None) -> dict[int, list]:
        """Elements by key: [key of the next one above, kind, number, characters outside of links, pages, such characters of its own]; of ``wanted`` keys, or all."""
        out: dict[int, list] = {}
        near: dict[int, int | None] = {}
        for e in self.elements:
            up = near.get(id(e.above)) if e.above is not None else None
            if not e.inline and not e.dropped and (wanted is None or e.key in wanted):
                row = out.setdefault(e.key, [up, e.kind, 0, 0, 1, 0])
                row[2] += 1
                row[3] += e.text - e.linked
                row[5] += e.own
                up = e.key
            near[id(e)] = up
        return out

    def slots(self, region: int | None, template: frozenset[int]) -> list[str]:
        """Texts inside the region (null: the page) that the template doesn't have; all of them if it has all."""
        inside: dict[int, bool] = {}
        if region is not None:
            for e in self.elements:
                inside[id(e)] = e.key == region or (e.above is not None and inside[id(e.above)])
        own = [(e, text) for e, text, _ in self.found if (e is None or not e.dropped) and (region is None or (e is not None and inside[id(e)]))]
        left = [text for e, text in own if not template or token_of(e.key if e else 0, text) not in template]
        return left or [text for _, text in own]


def region_of(outline: dict[int, list]) -> int | None:
    """Key of the element that holds the main text; null for all of the page."""
    def above(k: int) -> int | None:
        return outline[k][0] if outline[k][0] in outline else None

    covered: dict[int, bool] = {}
    for k in outline:  # those above come first
        chain = []
        while k is not None and k not in covered:
            chain.append(k)
            k = above(k)
        for x in reversed(chain):
            up = above(x)
            covered[x] = up is not None and (covered[up] or outline[up][1] == ARTICLE)
    articles = [k for k, row in outline.items() if row[1] == ARTICLE and row[3] > 0 and not covered[k]]
    if articles:
        return max(articles, key=lambda k: (outline[k][2] <= outline[k][4], outline[k][3], k))
    kids: dict[int | None, list[int]] = {}
    for k in outline:
        kids.setdefault(above(k), []).append(k)
    now, whole = None, sum(outline[k][3] for k in kids.get(None, ()))
    while True:
        best = max((k for k in kids.get(now, ()) if outline[k][1] == CONTAINER), key=lambda k: (outline[k][3], k), default=None)
        headline = any(outline[k][1] == HEADLINE and outline[k][3] > 0 for k in kids.get(now, ()))
        if best is None or headline or 2 * outline[best][3] <= whole or (now is not None and outline[now][5] > 0):
            return now
        now, whole = best, outline[best][3]


def host_of(url):
    """Lower-case host of a URL column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of ``pages`` (host, html) with their number on each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, html in zip(b["host"], b["html"]):
                page = _hash(html or "")
                rows += [(host, t, is_text, n, page) for (t, is_text), n in Counter(Page(html or "").tokens()).items()]
            yield pd.DataFrame(rows, columns=["host", "token", "is_text", "n", "page"])

    return pages.select("host", "html").mapInPandas(run, "host string, token long, is_text boolean, n int, page long")


def shapes(order: list[int], classes: dict[int, int], sizes: Counter) -> dict[int, tuple[tuple[int, ...], bool]]:
    """By class on a page: the order of its tokens, and whether that and the nesting hold throughout."""
    runs: dict[int, list[int]] = {}
    bad: set[int] = set()
    open_: list[list[int]] = []  # class, tokens seen
    for t in order:
        c = classes.get(t)
        if c is None:
            continue
        runs.setdefault(c, []).append(t)
        at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == c), -1)
        if at < 0:
            open_.append([c, 0])
        else:
            bad.update(x for x, _ in open_[at + 1 :])  # runs across a token of c
            del open_[at + 1 :]
        open_[-1][1] += 1
        if open_[-1][1] == sizes[c]:
            open_.pop()
    out = {}
    for c, ts in runs.items():
        k = sizes[c]
        one = ts[:k]
        out[c] = tuple(one), c not in bad and len(set(one)) == k and ts == one * (len(ts) // k)
    return out


def by_host(pages: DataFrame, made: DataFrame, column: str, item: int, use, schema: str) -> DataFrame:
    """``pages`` through ``use(row batch, list of each row's host's value)``; ``made`` is (host, ``column``), with items of so many bytes.

    A host's value is turned into Python objects once a task, not for each page.
    """
    size = made.agg(F.coalesce(F.sum(item * F.size(column) + F.length("host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r[column] for r in made.select("host", column).collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield use(b, [sent.value.get(h) for h in b["host"]])

        return pages.mapInPandas(run, schema)
    salted = made.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    joined = pages.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"], "left").drop("__salt")

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield use(b, list(b[column]))

    return joined.mapInPandas(run_joined, schema)


def templates(pages: DataFrame, share: float = SHARE, text_share: float = TEXT_SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, template): the key of each host's region (0: none), then the tokens of its valid classes.

    Copies of a page count once. A template holds at most (tokens of a page) / ``share`` tokens.
    """
    distinct = pages.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    # A sum of hashes stands for a token's vector; equal rows of copies are merged before it.
    vectors = (
        tokens(pages)
        .groupBy("host", "token", "page")
        .agg(F.max("n").alias("n"), F.first("is_text").alias("is_text"))
        .groupBy("host", "token")
        .agg(F.count("*").alias("support"), F.first("is_text").alias("is_text"), F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"))
    )
    enough = F.col("support") >= F.col("pages") * F.when(F.col("is_text"), text_share).otherwise(share)
    frequent = vectors.join(distinct, "host").where((F.col("support") >= least) & enough)
    frequent = cut(frequent.select("host", "token", "pages", F.xxhash64("vector", "support").alias("class")))
    large = frequent.groupBy("host", "class").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE)
    known = cut(frequent.join(large, ["host", "class"]).groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("known")))

    def use(b: pd.DataFrame, of_host: list) -> pd.DataFrame:
        seen: set[tuple] = set()
        sums: dict[tuple, list[int]] = {}
        ready: dict[str, tuple[dict[int, int], Counter]] = {}
        for host, html, items in zip(b["host"], b["html"], of_host):
            if items is None:
                continue
            if host not in ready:
                classes = {x["token"]: x["class"] for x in items}
                ready[host] = classes, Counter(classes.values())
            classes, sizes = ready[host]
            page = Page(html or "")
            for c, (shape, ok) in shapes([t for t, _ in page.tokens()], classes, sizes).items():
                seen.add((host, c, _hash(repr(shape)), ok))
            for key, (up, kind, *counts) in page.outline(classes).items():
                row = sums.setdefault((host, key, up, kind), [0, 0, 0, 0])
                for i, x in enumerate(counts):
                    row[i] += x
        rows = [(h, c, shape, ok, *[None] * 7) for h, c, shape, ok in seen]
        rows += [(h, None, None, None, key, up, kind, *row) for (h, key, up, kind), row in sums.items()]
        out = pd.DataFrame(rows, columns=["host", "class", "shape", "ok", "token", "up", "kind", "n", "chars", "on", "own"], dtype=object)
        for c in ("class", "shape", "token", "up", "kind", "n", "chars", "on", "own"):
            out[c] = out[c].astype("Int64")
        return out

    schema = "host string, class long, shape long, ok boolean, token long, up long, kind long, n long, chars long, on long, own long"
    read = cut(by_host(pages.select("host", "html"), known, "known", 16, use, schema))
    valid = read.where("class is not null").groupBy("host", "class").agg(F.min("shape").alias("a"), F.max("shape").alias("b"), F.min("ok").alias("ok")).where("ok and a = b").select("host", "class")
    template = frequent.join(valid, ["host", "class"]).select("host", "token")
    sums = read.where("token is not null").groupBy("host", "token").agg(F.min("up").alias("up"), F.min("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("n", "chars", "on", "own")])
    # An element above that isn't valid is passed over when the region is chosen.
    whole = template.join(sums, ["host", "token"], "left").groupBy("host").agg(F.collect_list(F.struct("token", "up", "kind", "n", "chars", "on", "own")).alias("template"))
    passed = sums.join(template, ["host", "token"], "left_anti").groupBy("host").agg(F.collect_list(F.struct("token", "up")).alias("passed"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, items, skipped in zip(b["host"], b["template"], b["passed"]):
                over = {x["token"]: x["up"] for x in (skipped if skipped is not None else ())}
                outline: dict[int, list] = {}
                for x in items:
                    if x["kind"] is not None and not pd.isna(x["kind"]):
                        up, steps = x["up"], 0
                        while up is not None and up in over and steps <= len(over):
                            up, steps = over[up], steps + 1
                        outline[x["token"]] = [up, x["kind"], x["n"], x["chars"], x["on"], x["own"]]
                tokens_ = sorted(x["token"] for x in items)
                rows.append((host, [region_of(outline) or 0, *tokens_]))
            yield pd.DataFrame(rows, columns=["host", "template"])

    return whole.join(passed, "host", "left").mapInPandas(choose, "host string, template array<long>")


def main_text(html: str, template: frozenset[int] = frozenset(), region: int | None = None) -> str:
    page = Page(html)
    if region is None or not any(e.key == region and not e.dropped for e in page.elements):
        region = region_of(page.outline())
    return " ".join(page.slots(region, template))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    made = cut(templates(own))

    def use(b: pd.DataFrame, of_host: list) -> pd.DataFrame:
        ready: dict[str, tuple[frozenset[int], int | None]] = {}
        text = []
        for host, html, items in zip(b["host"], b["html"], of_host):
            if host not in ready:
                ready[host] = (frozenset(), None) if items is None else (frozenset(map(int, items[1:])), int(items[0]) or None)
            text.append(main_text(html, *ready[host]))
        return pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return by_host(own, made, "template", 8, use, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
