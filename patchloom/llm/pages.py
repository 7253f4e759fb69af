"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that they hold at any depth less its links and junk; the best one votes,
with its generalised path of tags and classes (digits taken out), for its host. Votes are summed in Spark, and every page
is extracted again from all elements on its host's winning path, on the next one that it has, or else from its own best.

The text is that of the container without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
markup and reader comments; white space runs and block ends become one space. Null or empty html gives an empty text; a
null url is the host ''. Repeated rows are extracted each. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, slices

MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Fixed sets of element names.
RAW = frozenset("script style title textarea noscript template xmp iframe svg math select object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var ins del big strike wbr ruby rt rp".split())
JUNK_TAGS = frozenset("nav footer aside button dialog menu head fieldset audio video map".split())
CONTAINERS = frozenset("body article main section div td center".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element of the first set ends an open one of the second, up to the given list or table.
IMPLIED = {"li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset(["tr", "table"])), "th": (frozenset("td th".split()), frozenset(["tr", "table"]))}
END_OF = {tag: re.compile(rf"</{tag}(?![a-zA-Z0-9:-])", re.I) for tag in RAW}
#: Words that name what is never the text, and words that name what isn't unless it holds nearly all of the text.
NEVER = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription signup comment comments commentlist disqus respond replies".split())
SELDOM = frozenset("banner notice alert overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommend recommended recommendations footer masthead siteheader pageheader topbar widget widgets toolbar pagination pager skiplink tags tagcloud login search".split())
#: Words before such a word that say what else a page has: no-sidebar, with-menu.
MODIFIERS = frozenset("with without no not non has have hide hidden is show below above after before".split())
#: Two words that are one of the above together.
TOGETHER = frozenset([("side", "bar"), ("site", "header"), ("page", "header"), ("skip", "link"), ("tag", "cloud"), ("comment", "list"), ("sign", "up")])
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
JUNK_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
SPLIT = 1.25  # share of text over the best container inside that an outer one needs
MOST = 4  # times the text outside of it that an element with a SELDOM name must hold to be no junk


@lru_cache(50_000)
def named_junk(name: str) -> int:
    """What one class or id says: 2 for what is never the text, 1 for what seldom is, 0 for any other.

    The first or last of its words decides, unless a modifier stands before."""
    words = [w.lower() for w in PART.findall(name)]
    if not words or not MODIFIERS.isdisjoint(words[:-1]):
        return 0
    ends = [words[0], words[-1]] + ["".join(two) for two in (tuple(words[:2]), tuple(words[-2:])) if two in TOGETHER]
    return 2 if not NEVER.isdisjoint(ends) else int(not SELDOM.isdisjoint(ends))


class Page:
    """A parsed page: for each element its parent, tag, name for paths and whether it is junk, and the text pieces.

    The source is read once from its start to its end; what is open is known by tag, so no end tag searches for it."""

    def __init__(self, source: str):
        self.parent, self.tag, self.name = [-1], ["#"], ["#"]
        self.depth, self.within, self.hard, self.soft = [0], [False], [False], [0]
        self.text: list[tuple[int, str, bool]] = []  # element, text (" " at a block's end), in a link
        self.stack, self.open, self.blocks, self.containers = [0], {}, [0], [0]
        at, in_link, quotes, length = 0, False, True, len(source)
        while at < length:
            m = MARKUP.search(source, at)
            if not m:
                self._add(source[at:], in_link)
                break
            if m.start() > at:
                self._add(source[at : m.start()], in_link)
            if m[0] == "<!--":
                end = source.find("-->", m.end())
                at = end + 3 if end >= 0 else length
                continue
            if m[0] in ("<!", "<?"):
                at = source.find(">", m.end()) + 1 or length
                continue
            closing, start = m[0][1] == "/", m.end() - 1
            name = NAME.match(source, start)
            tag, end = name[0].lower(), name.end()
            found = ATTRIBUTES.match(source, end) if quotes and not closing else None
            if found:
                at = found.end()
            else:  # a quote that never ends: from here on quotes are as any other character
                quotes = quotes and closing
                at = source.find(">", end) + 1 or length
            attributes = source[end : at - 1]
            if tag not in INLINE:
                self.text.append((self.stack[-1], " ", False))
            if closing:
                own = self.open.get(tag)
                if own and (tag not in INLINE or own[-1] > self.blocks[-1]):
                    self._pop(own[-1])
                if tag == "a":
                    in_link = False
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    m = END_OF[tag].search(source, at)
                    at = (source.find(">", m.end()) + 1 or length) if m else length
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                self._close(("p",), ())
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
            if tag == "a":
                in_link = True
            if not attributes.endswith("/"):
                self._push(tag, attributes)
        self.junk = self._junk()

    def _add(self, text: str, in_link: bool) -> None:
        self.text.append((self.stack[-1], text, in_link))

    def _pop(self, place: int) -> None:
        """Closes all elements from a place on the stack on."""
        while len(self.stack) > place:
            i = len(self.stack) - 1
            self.open[self.tag[self.stack.pop()]].pop()
            for kept in (self.blocks, self.containers):
                if kept[-1] == i:
                    kept.pop()

    def _close(self, tags, until) -> None:
        last = lambda names: max((self.open[t][-1] for t in names if self.open.get(t)), default=0)
        place = last(tags)
        if place and place > max(last(until), self.containers[-1] if self.tag[self.stack[self.containers[-1]]] not in tags else 0):
            self._pop(place)

    def _push(self, tag: str, attributes: str) -> None:
        names, role, hidden = [], "", False
        if attributes:
            for a in ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    names += value.split()
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or value.lower() == "true":
                    hidden = True
        up, place = self.stack[-1], len(self.stack)
        said = max(map(named_junk, names), default=0)
        if tag in ("body", "html", "article", "main"):
            said = 2 if said == 2 and any("comment" in n.lower() for n in names) else 0
        hard = tag in JUNK_TAGS or role in JUNK_ROLE or hidden or said == 2 or tag == "header" and not self.within[up]
        self.parent.append(up)
        self.tag.append(tag)
        self.name.append(".".join([tag, *sorted({re.sub(r"[\d/]+", "", n) for n in names} - {""})]))
        self.depth.append(self.depth[up] + 1)
        self.within.append(self.within[up] or tag in ("article", "main"))
        self.hard.append(hard or self.hard[up])
        self.soft.append(int(said == 1) or 2 * (tag == "form"))
        self.stack.append(len(self.tag) - 1)
        self.open.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
        if tag in CONTAINERS:
            self.containers.append(place)

    def _junk(self) -> list[bool]:
        """Whether each element is junk: by its own nature or by a name, unless it holds nearly all of what is left."""
        if not any(self.soft):
            return self.hard
        size = len(self.tag)
        prose, clean, story = [0] * size, [0] * size, [False] * size
        named = [False] * size
        for i in range(1, size):
            named[i] = self.soft[i] > 0 or named[self.parent[i]]
        for node, text, link in self.text:
            if not self.hard[node] and not link:
                n = len(text.strip())
                prose[node] += n
                clean[node] += n * (not named[node])
        articles = 0  # text in articles that nothing calls junk
        for i in range(size - 1, 0, -1):
            up = self.parent[i]
            prose[up] += prose[i]
            clean[up] += clean[i]
            story[up] = story[up] or story[i] or self.tag[i] in ("p", "article", "main", "h1")
            if self.tag[i] in ("article", "main") and not named[i] and not self.hard[i]:
                articles += clean[i]
        out = [False] * size
        for i in range(1, size):
            own = self.soft[i] and (articles or prose[i] <= MOST * clean[0] or self.soft[i] == 2 and not story[i])
            out[i] = bool(self.hard[i] or own or out[self.parent[i]])
        return out

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.name[node])
            node = self.parent[node]
        return "/".join(reversed(out))

    def best(self) -> tuple[int, float]:
        """The best container and its score: the text that it holds at any depth less its links and half of its junk.

        An outer container wins only if it holds at least SPLIT times the text of the best one in it."""
        size = len(self.tag)
        total, junk = [0.0] * size, [0.0] * size
        for node, text, link in self.text:
            n = len(text.strip())
            if self.junk[node]:
                junk[node] += n
            else:
                total[node] += -n if link else n
        has = [t != 0 for t in total]
        for i in range(size - 1, 0, -1):
            up = self.parent[i]
            total[up] += total[i]
            junk[up] += junk[i]
            has[up] = has[up] or has[i]
        if not has[0]:
            return 0, 0.0
        bonus = {"article": 1.5, "main": 1.3}
        score = [t - j / 2 for t, j in zip(total, junk, strict=True)]
        best = [-1] * size  # the best container at or below an element
        worth = lambda i: score[i] * bonus.get(self.tag[i], 1.0) if score[i] > 0 else score[i]
        for i in range(size - 1, -1, -1):
            if has[i] and (i == 0 or self.tag[i] in CONTAINERS and not self.junk[i]) and (best[i] < 0 or worth(i) >= SPLIT * worth(best[i])):
                best[i] = i
            if i and best[i] >= 0:
                up = self.parent[i]
                if best[up] < 0 or worth(best[i]) >= worth(best[up]):
                    best[up] = best[i]
        node = best[0]
        value, up = score[node], node
        while up > 0:
            if self.tag[up] in ("article", "main") and not self.junk[up]:
                node = up
                break
            up = self.parent[up]
        return node, value

    def find(self, path: str) -> list[int]:
        """The elements on a path, in page order, that aren't junk."""
        names = path.split("/")
        on, out = [False] * len(self.tag), []
        on[0] = True
        for i in range(1, len(self.tag)):
            d = self.depth[i]
            if d <= len(names) and on[self.parent[i]] and self.name[i] == names[d - 1]:
                on[i] = True
                if d == len(names) and not self.junk[i]:
                    out.append(i)
        return out

    def extract(self, *nodes: int) -> str:
        """The text of elements that aren't in each other, in page order."""
        inside = [False] * len(self.tag)
        for i in nodes:
            inside[i] = True
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
        text = "".join(t for i, t, _ in self.text if inside[i] and not self.junk[i])
        return " ".join(html.unescape(text).split())


def host_of():
    """The host of a url column, lower-cased, without scheme, user and port; '' for none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """pages -> host, path, votes, score; summed by host and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total: dict[tuple[str, str], list[float]] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                node, score = page.best()
                if score > 0:
                    t = total.setdefault((host, page.path(node)), [0, 0.0])
                    t[0] += 1
                    t[1] += score
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([int(v[0]) for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.float64())], ["host", "path", "votes", "score"])

    got = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, path string, votes long, score double")
    return got.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def extract_pages(pages: DataFrame, keep: int = 3, broadcast_hosts: int = 100_000) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars.

    keep: paths tried for each host, most votes first. broadcast_hosts: with more hosts than this, winning paths are
    joined by host instead of broadcast."""
    spark = pages.sparkSession
    stash = Stash(spark, "pages")
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path"))
    top = votes(pages).withColumn("rank", rank).where(F.col("rank") <= keep)
    winners = stash.put(top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths")), "winners")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host_of().alias("host"))
    shared = None
    if winners.count() <= broadcast_hosts:
        shared = spark.sparkContext.broadcast({r.host: r.paths for r in winners.collect()})
        rows = rows.withColumn("paths", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for source, host, paths in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                page = Page(source or "")
                nodes = next((n for p in (shared.value.get(host) if shared else paths) or () if (n := page.find(p))), None)
                out.append(page.extract(*(nodes or [page.best()[0]])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")
