"""Main text of web pages by equivalence-class template deduction.

A token is a tag at its place (the path of its elements) or a block of text at its place. Over the pages of a host every
token has an occurrence vector: how often it stands on each page. Tokens with equal vectors form a class. A class is
valid if it has a tag, and if its outermost tags all lie in one other class: so valid classes nest and make the host's
template. A text of a valid class that lies below one of the class's tags belongs to the template, if most of the
characters of that tag's slot do. What remains in the slots is the page's own text.

Of that, menus, site headers, footers, asides, forms and what calls itself an advert, notice or comment go by element or
name, and slots outside of articles whose remaining text is mostly links. Names count as whole words of a class, id or
role, on elements that aren't leaves; a named element that holds a headline, an article or half of the page's text is
the text's container and stays, unless it's named after comments. Where ``article`` and ``main`` hold at least half of
what remains on the host, the text is theirs, and repeated lines in them stay.

Scale: vectors are kept as two sums of 32-bit hashes of (page, count), so a host's vectors are partial sums on the map
side and a shuffle of a row for each token. Only tokens on ``LEAST_SHARE`` of the host's pages go into its model, and
tokens times pages can't exceed all tokens, so a model has at most the tokens of an average page over that share,
however many pages the host has. Models are joined to the pages by host (Spark broadcasts them if they are small, else
it splits skewed hosts). Pages are parsed twice, which is cheaper than shuffling their parsed form.

Null and empty pages have no text. Hosts with fewer than ``LEAST_PAGES`` different pages, and those whose pages share
``MOST_FIXED`` of their characters (copies of each other), have no template: the page decides alone. Null or odd URLs
share the host "". Repeated rows are extracted one by one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .spark_util import map_rows, small_batches, stored
from .url_filter import host_of

# HTML elements by what they mean for the main text.
RAW = "script style noscript template iframe textarea select title"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mroot mrow msqrt mstyle msub msubsup msup mtext nobr q rp rt ruby s samp semantics small span strike strong sub sup svg time tt u var"
LEAVES = "p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption address"
OUTSIDE = "head nav footer aside form button dialog menu fieldset datalist"
# Words of class, id and role that name zones outside the article; and those that may stand beside them.
ZONES = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert warning disclaimer "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside comment comments reply replies respond discussion disqus share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login footer masthead header topbar toolbar pagination pager widget widgets popup modal overlay search searchbox tags toc "
    "complementary contentinfo dialog"
)
COMMENTS = "comment comments reply replies respond discussion disqus"
NEUTRAL = "area bar block bottom box container group inner item items left links list outer panel posts right row section site text thread top wrap wrapper"
RAW_SET, VOID_SET, INLINE_SET, LEAF_SET, OUTSIDE_SET, ZONE_SET, COMMENT_SET, NEUTRAL_SET = (frozenset(x.split()) for x in (RAW, VOID, INLINE, LEAVES, OUTSIDE, ZONES, COMMENTS, NEUTRAL))
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'])*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PARTS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
#: These close an open one of their kind, up to the element that holds them.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: The different pages from which on a host has a template, and a token can be part of it.
LEAST_PAGES = 3
#: The share of a host's pages that a token of its model stands on.
LEAST_SHARE = 0.2
#: The share of a host's characters in its template from which on its pages are copies of each other.
MOST_FIXED = 0.9
#: Kinds of tokens; the page as a whole, and all its articles, have a row as well.
PAGE, ARTICLES, TAG, TEXT = 0, 1, 2, 3


def hashed(name: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name, seed) >> 1


def _names(attributes: str) -> tuple[str, bool, bool, bool]:
    """The first class or id without digits; whether a name is of a zone outside the article, of comments, of the main one."""
    label, outside, comments, main = "", False, False, False
    for kind, *values in NAMES.findall(attributes) if "=" in attributes else ():
        value = next((v for v in values if v), "")
        for name in value.split():
            parts = {w.lower() for w in NAME_PARTS.findall(name)}
            zones = parts & ZONE_SET
            if zones and parts <= ZONE_SET | NEUTRAL_SET:
                outside, comments = True, comments or bool(zones & COMMENT_SET)
        main = main or (kind.lower() == "role" and value.lower() == "main")
        label = label or "." + DIGITS.sub("", (value.split() or [""])[0])
    return label, outside, comments, main


class Page:
    """The blocks of text and the tags of one page.

    ``blocks``: (place, text, characters in links, inside an article, outside by element or name). ``tags``: by place,
    the place around it, how often it stands, and the characters and linked ones of all text in it. A place is a hash of
    the elements down to it, so it is as long for deep pages as for flat ones.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[int, str, int, bool, bool]] = []
        self.tags: dict[int, list[int]] = {}
        # Zones by name, in order: the zone around it, named after comments, holds a headline or an article.
        self.zones: list[tuple[int, bool]] = [(0, False)]
        self.holders: set[int] = set()
        self.headed = False  # has a headline or an article, by which its containers are known
        self._parse(page)
        self._settle()

    def _parse(self, page: str) -> None:
        blocks, tags, zones = self.blocks, self.tags, self.zones
        # Element, place, outside by element, inside an article, innermost zone, and how often each unnamed kind stands in it.
        stack: list[tuple[str, int, bool, bool, int, dict[str, int]]] = [("", 0, False, False, 0, {})]
        opened: dict[str, int] = {}
        parts: list[str] = []
        links = linked = at = 0

        def text(raw: str) -> None:
            nonlocal linked
            if raw:
                value = entities.unescape(raw) if "&" in raw else raw
                parts.append(value)
                if links:
                    linked += len(value)

        def flush() -> None:
            nonlocal linked
            if parts:
                if joined := " ".join("".join(parts).split()):
                    _, place, outside, inside, zone, _ = stack[-1]
                    blocks.append((place, joined, min(linked, len(joined)), inside, outside, zone))
                parts.clear()
            linked = 0

        def drop(k: int) -> None:
            for x in stack[k:]:
                opened[x[0]] -= 1
            del stack[k:]

        for m in TOKEN.finditer(page):
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            closing, tag = m[2], m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in VOID_SET:
                if tag == "br":
                    text(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in INLINE_SET:
                if tag == "a":
                    links = max(0, links - 1) if closing else links + 1
                continue
            flush()
            if closing:
                if opened.get(tag):
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    drop(k)
                continue
            if stack[-1][0] == "p":
                drop(len(stack) - 1)
            links = 0
            if tag in SIBLINGS:
                own, holders = SIBLINGS[tag]
                own = own.split()
                if any(opened.get(x) for x in own):
                    k = len(stack) - 1
                    while k > 0 and stack[k][0] not in holders and stack[k][0] not in own:
                        k -= 1
                    if k and stack[k][0] in own:
                        drop(k)
            label, named, comments, main = _names(m[4])
            _, around, outside, inside, zone, numbers = stack[-1]
            if not label and tag not in LEAF_SET:
                numbers[tag] = numbers.get(tag, 0) + 1
                label = f"[{numbers[tag]}]"
            place = hashed(f"{tag}{label}", around)
            article = main or tag in ("article", "main")
            named = named and not main and tag not in LEAF_SET and tag not in ("body", "html", "main") and (tag != "article" or comments)
            if tag == "h1" or article and not named:
                self._hold(zone, tag != "article")
            if named:
                zones.append((zone, comments))
                zone = len(zones) - 1
            outside = outside or tag in OUTSIDE_SET or tag == "header" and not inside
            tags.setdefault(place, [around, 0, 0, 0])[1] += 1
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, place, outside, inside or article and not named, zone, {}))
        if at < len(page):
            text(page[at:])
        flush()

    def _hold(self, zone: int, strong: bool) -> None:
        """The zones around a headline or article are its containers; comments are not by an article alone."""
        self.headed = True
        while zone and zone not in self.holders and (strong or not self.zones[zone][1]):
            self.holders.add(zone)
            zone = self.zones[zone][0]

    def _settle(self) -> None:
        """Which zones are containers; and the characters in each tag."""
        zones, held = self.zones, [0] * len(self.zones)
        total = 0
        for place, text, linked, _, outside, zone in self.blocks:
            if place in self.tags:
                self.tags[place][2] += len(text)
                self.tags[place][3] += linked
            if not outside:
                held[zone] += len(text) - linked
                total += len(text) - linked
        for place in reversed(self.tags):  # a tag comes after the one around it
            around, _, chars, linked = self.tags[place]
            if around in self.tags:
                self.tags[around][2] += chars
                self.tags[around][3] += linked
        if len(zones) > 1:
            for zone in range(len(zones) - 1, 0, -1):
                held[zones[zone][0]] += held[zone]
            stays = [True] * len(zones)
            for zone in range(1, len(zones)):
                around, comments = zones[zone]
                stays[zone] = stays[around] and (zone in self.holders or not self.headed and not comments and held[zone] > 0 and 2 * held[zone] >= total)
            self.blocks = [(p, t, n, i, o or not stays[z]) for p, t, n, i, o, z in self.blocks]
        else:
            self.blocks = [b[:5] for b in self.blocks]


def mostly_links(chars: int, linked: int) -> bool:
    return 2 * linked > chars


def chosen_text(page: Page, fixed: set[int], lists: dict[int, bool], articles: bool | None) -> str:
    """What remains of a page without the template's texts, in page order.

    ``lists``: of the places that the host decides, whether they are mostly links. ``articles``: whether the host's text
    is in its articles; None: the page decides alone.
    """
    left = [b for b in page.blocks if not b[4] and (b[3] or not fixed or hashed(b[1], b[0]) not in fixed)]
    own = sum(len(t) - n for _, t, n, inside, _ in left if inside)
    if articles is None or articles and not own:
        articles = own > 0 and 2 * own >= sum(len(t) - n for _, t, n, _, _ in left)
    if articles:
        return "\n\n".join(b[1] for b in left if b[3])
    slots: dict[int, list[int]] = {}
    for place, text, linked, inside, _ in left:
        if not inside and place not in lists:
            slot = slots.setdefault(place, [0, 0])
            slot[0] += len(text)
            slot[1] += linked
    own_lists = {place for place, slot in slots.items() if mostly_links(*slot)}
    return "\n\n".join(t for place, t, _, inside, _ in left if inside or not lists.get(place, place in own_lists))


STATS = "host string, token bigint, around bigint, kind int, pages bigint, low bigint, high bigint, contents bigint, chars bigint, linked bigint"


def token_table(pages: DataFrame) -> DataFrame:
    """For each host and token: the place around it, its kind, on how many pages, its vector, and the characters in it.

    ``contents`` has a bit for the hash of each page that the token stands on, so its bits are a lower bound of the
    number of different pages.
    """
    small_batches(pages.sparkSession)
    schema = StructType.fromDDL(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: dict[tuple[str, int], list[int]] = {}

            def add(host: str, token: int, around: int, kind: int, seed: int, count: int, bit: int, chars: int, linked: int, table=table) -> None:
                row = table.setdefault((host, token), [around, kind, 0, 0, 0, 0, 0, 0])
                vector = hashed(str(count), seed)
                row[2] += 1
                row[3] += vector & 0xFFFFFFFF
                row[4] += vector >> 31
                row[5] |= bit
                row[6] += chars
                row[7] += linked

            for host, seed, content, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, seed, bit = Page(html or ""), seed % (1 << 63), 1 << content % 63
                total, own, texts = [0, 0], [0, 0], {}
                for place, text, linked, inside, outside in page.blocks:
                    for sums in (total, own) if inside and not outside else (total,) if not outside else ():
                        sums[0] += len(text)
                        sums[1] += linked
                    slot = texts.setdefault(hashed(text, place), [place, 0, 0, 0, outside, inside])
                    slot[1] += 1
                    slot[2] += len(text)
                    slot[3] += linked
                add(host, PAGE, 0, PAGE, seed, 1, bit, *total)
                add(host, ARTICLES, 0, ARTICLES, seed, 1, bit, *own)
                for place, (around, count, chars, linked) in page.tags.items():
                    add(host, place, around, TAG, seed, count, bit, chars, linked)
                for token, (place, count, chars, linked, outside, inside) in texts.items():
                    add(host, token, place, TEXT + outside + 2 * inside, seed, count, bit, chars, linked)
            columns = [*zip(*table), *zip(*table.values())] or [[] for _ in schema]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=schema.names)

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", html).alias("seed"), F.pmod(F.xxhash64(html), F.lit(63)).alias("content"), html.alias("html"))
    sums = [F.sum(c).alias(c) for c in ("pages", "low", "high")] + [F.bit_or("contents").alias("contents")] + [F.sum(c).alias(c) for c in ("chars", "linked")]
    return own.mapInArrow(run, schema).groupBy("host", "token").agg(F.max("around").alias("around"), F.max("kind").alias("kind"), *sums)


def deduced(tokens: list[dict]) -> tuple[list[int], list[int], list[int], bool | None, list[list[int]]]:
    """Of a host's tokens: fixed texts, places that are mostly links, places that aren't, whether the text is in articles, and the valid classes."""
    page = next((t for t in tokens if t["kind"] == PAGE), None)
    articles = next((t for t in tokens if t["kind"] == ARTICLES), None)
    if page is None or int(page["contents"]).bit_count() < LEAST_PAGES:
        return [], [], [], None, []
    tags = {t["token"]: t for t in tokens if t["kind"] == TAG}
    texts = [t for t in tokens if t["kind"] >= TEXT]
    vector = {token: (t["low"], t["high"]) for token, t in tags.items()}
    classes: dict[tuple[int, int], list[int]] = {}
    for token, v in vector.items():
        classes.setdefault(v, []).append(token)

    def above(place: int, of: tuple[int, int] | None, other: tuple[int, int] | None = None) -> int:
        """The nearest tag from a place upwards that is in one class, or that isn't in another; 0 if there is none."""
        while place in tags and (vector[place] != of if of else vector[place] == other):
            place = tags[place]["around"]
        return place if place in tags else 0

    # A class nests if the outermost of its tags lie in one and the same class.
    nests = {}
    for v, members in classes.items():
        tops = [m for m in members if not above(tags[m]["around"], v)]
        nests[v] = len({vector.get(above(tags[m]["around"], None, v)) for m in tops}) == 1
    # The slot of a tag: what stands in it, but not in deeper tags of its class.
    slot_chars = {token: t["chars"] for token, t in tags.items()}
    for token in tags:
        outer = above(tags[token]["around"], vector[token])
        if outer:
            slot_chars[outer] -= tags[token]["chars"]
    held: dict[int, list[dict]] = {}
    for t in texts:
        v = (t["low"], t["high"])
        slot = above(t["around"], v) if nests.get(v) and int(t["contents"]).bit_count() >= LEAST_PAGES else 0
        if slot:
            held.setdefault(slot, []).append(t)
    fixed = [t for slot, own in held.items() if 2 * sum(t["chars"] for t in own) >= slot_chars[slot] for t in own]
    inside = [t["kind"] - TEXT >= 2 for t in fixed]
    outside = [(t["kind"] - TEXT) % 2 == 1 for t in fixed]
    shown = sum(t["chars"] for t, o in zip(fixed, outside, strict=True) if not o)
    if shown > MOST_FIXED * page["chars"]:
        return [], [], [], None, [sorted(m) for v, m in classes.items() if nests[v]]
    gone = [t for t, i, o in zip(fixed, inside, outside, strict=True) if not i and not o]
    remains = page["chars"] - page["linked"] - sum(t["chars"] - t["linked"] for t in gone)
    own = articles["chars"] - articles["linked"]
    direct = {token: [t["chars"], t["linked"]] for token, t in tags.items()}
    for token, t in tags.items():
        if t["around"] in direct:
            direct[t["around"]][0] -= t["chars"]
            direct[t["around"]][1] -= t["linked"]
    for t in fixed:
        if t["around"] in direct:
            direct[t["around"]][0] -= t["chars"]
            direct[t["around"]][1] -= t["linked"]
    lists = [token for token, x in direct.items() if mostly_links(*x)]
    return sorted(t["token"] for t in fixed), sorted(lists), sorted(direct.keys() - set(lists)), own > 0 and 2 * own >= remains, [sorted(m) for v, m in classes.items() if nests[v]]


def templates(pages: DataFrame) -> DataFrame:
    """For each host: its fixed texts, its places that are mostly links (``lists``) or not (``slots``), whether its text is in articles, and its valid classes."""
    tokens = token_table(pages)
    common = stored(tokens.filter((F.col("pages") >= LEAST_PAGES) | (F.col("kind") <= ARTICLES)), "page-tokens")
    hosts = common.filter(F.col("kind") == PAGE).select("host", F.col("pages").alias("host_pages"))
    kept = common.join(hosts, "host").filter((F.col("kind") <= ARTICLES) | (F.col("pages") >= LEAST_SHARE * F.col("host_pages")))
    fields = [f.name for f in StructType.fromDDL(STATS)][1:]
    own = kept.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("tokens"))  # bounded by a page's tokens, see above
    schema = "fixed array<bigint>, lists array<bigint>, slots array<bigint>, articles boolean, classes array<array<bigint>>"
    return stored(map_rows(own, ["host"], ["tokens"], schema, lambda: deduced), "templates")


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    models = templates(pages).select(F.col("host").alias("model_host"), "fixed", "lists", "slots", "articles")
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("page_host"))
    joined = own.join(models, F.col("page_host") == F.col("model_host"), "left")

    def factory():
        def kernel(html, fixed, lists, slots, articles):
            page = Page(html.decode() if html else "")
            text = chosen_text(page, set(fixed or ()), dict.fromkeys(lists or (), True) | dict.fromkeys(slots or (), False), articles)
            return text, len(text)

        return kernel

    return map_rows(joined, ["page_id", "url"], ["html", "fixed", "lists", "slots", "articles"], "text string, n_chars bigint", factory)
