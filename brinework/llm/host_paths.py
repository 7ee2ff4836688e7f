"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text of their paragraphs without links. Its best container votes, by its generalised
tag-class path, in the page's host, or what is around it where it is only a part of the article. The blocks of the page vote by
their paths too: whether they are lists of links, whether they are threads of readers (like children that each name an author),
and with a hash of their text, for a block that says the same on different pages of its host is no part of an article, whatever
its class. Spark sums the votes (partial sums first, so a host with a third of the pages is no hot group) and takes each host's
winning path and the paths that it leaves out. Pages are then extracted from the elements at their host's path, or from their own
best container where the page has no such element or these hold less than half of its text, without what the host leaves out.
Where the host has no say (no host, or a path on less than a twentieth of its pages) the page's own votes hold.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.llm import common

#: Winning paths of up to so many bytes in all go to all tasks; more are joined by host.
BROADCAST_BYTES = 8 << 20

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^\"'>]*")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp"}
_OUT = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video"}
_HOLDS = {"body", "article", "main", "section", "div", "td", "html"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Open elements that the start of these closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that can be left out by votes.
_BLOCKS = {"aside", "details", "dl", "div", "figure", "header", "ol", "section", "table", "ul"}
#: Words in a class or id that name what is not the article, whatever stands beside them.
_BOILER = re.compile(
    r"ads|adv|advert\w*|adsense|breadcrumbs?|comments?|commentlist|cookies?|disqus|footer|gdpr|masthead|menubar|modal|navbar|navigation|newsletter|notification"
    r"|pagination|pager|popup|promo\w*|sidebar|signin|signup|social|sponsor\w*|subscribe|subscription|topbar"
)
#: Words that do so alone or beside one another, those above and words of layout: "related-posts", but not "related-work".
_MAYBE = re.compile(r"ad|banner|consent|login|menu|nav|notices?|overlay|recommend\w*|related|replies|respond|search|share|sharing|skip|toolbar|widgets?")
_LAYOUT = set("area articles bar block body bottom box button buttons container content form group head header icons inner item items left link links list main mobile outer page panel post posts primary right row secondary section site sticky stories title top wrap wrapper".split())
#: Words at the beginning of a class that tell of something else: of the layout around, or of what an article is about.
_TELLS = {"cat", "category", "has", "no", "tag", "with", "without"}
_AUTHOR = {"author", "avatar", "commenter", "gravatar", "nickname", "user", "username"}
#: A host's vote counts for paths on at least one of so many of its pages, so its list has at most so many times a page's blocks.
RARE = 20
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}


def _boiler(told: str) -> bool:
    """Whether a class or id names what is not the article."""
    for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", told).lower().split():
        words = re.findall(r"[a-z]+", token)
        if not words or words[0] in _TELLS:
            continue
        if any(_BOILER.fullmatch(w) for w in words):
            return True
        if any(map(_MAYBE.fullmatch, words)) and all(_MAYBE.fullmatch(w) or w in _LAYOUT or len(w) == 1 for w in words):
            return True
    return False


class Page:
    """nodes: (parent, tag, label: tag and generalised classes, the nearest element at or around it that can hold an article);
    out: whether a node is left out; keys: hashes of the nodes' paths; pieces: (node, text or None for a break, whether in a link,
    characters but white space). One pass, linear in the page's length
    however deep or broken it is: paths are not stored, and a quote that nothing closes is an ordinary character."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, str, int]] = [(-1, "", "", 0)]
        self.out, self.keys, self.authors = [False], [0], [False]
        self.pieces: list[tuple[int, str | None, bool, int]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: dict[str, int] = {}
        self.blocks = [0]  # places in the stack that are not inline
        at, n, open_quotes = 0, len(source), {'"': True, "'": True}
        while at < n:
            lt = source.find("<", at)
            stop = n if lt < 0 else lt
            if stop > at:
                self._text(source[at:stop])
            if lt < 0:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(source, lt + 1)
            if not m:
                self._text("<")
                at = lt + 1
                continue
            end = m.end()
            while True:
                end = _PLAIN.match(source, end).end()
                if end >= n or source[end] == ">":
                    break
                quote = source[end]
                close = source.find(quote, end + 1) if open_quotes[quote] else -1
                open_quotes[quote] = close >= 0  # nothing behind closes it either
                end = close + 1 if close >= 0 else end + 1
            at = end + 1
            if end >= n:
                break
            at = self._tag_at(source, m[1], m[2].lower(), source[m.end() : end], at)

    def _text(self, text: str) -> None:
        text = html.unescape(text)
        self.pieces.append((self.stack[-1][1], text, self.open.get("a", 0) > 0, len("".join(text.split()))))

    def _cut(self, k: int) -> None:
        """Closes the elements of the stack from k on."""
        for tag, _ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]
        while self.blocks[-1] >= k:
            self.blocks.pop()

    def _tag_at(self, source: str, closing: str, tag: str, attributes: str, at: int) -> int:
        """Takes a tag; gives the place where reading goes on."""
        stack = self.stack
        if tag not in _INLINE:
            self.pieces.append((stack[-1][1], None, False, 0))
        if closing:
            if self.open.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                self._cut(k)
            return at
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            stop = source.find(">", end.start()) if end else -1
            return stop + 1 if stop >= 0 else len(source)
        gone = _CLOSES.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        while gone and self.blocks[-1] and stack[self.blocks[-1]][0] in gone:
            self._cut(self.blocks[-1])
        if tag in _VOID:
            return at
        parent = stack[-1][1]
        names = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(attributes)} if attributes else {}
        out = self.out[parent] or tag in _OUT or (tag == "header" and not self.open.get("article") and not self.open.get("main"))
        if not out and names and tag not in ("html", "body", "article", "main"):
            out = _boiler(names.get("class", "") + " " + names.get("id", "")) or names.get("role", "").lower() in _BOILER_ROLES
        label = tag + "".join("." + c for c in sorted(re.sub(r"\d+", "#", names.get("class", "").replace(">", "")).lower().split()))
        node = len(self.nodes)
        self.nodes.append((parent, tag, label, node if tag in _HOLDS else self.nodes[parent][3]))
        self.out.append(out)
        self.keys.append(xxhash.xxh64_intdigest(label, seed=self.keys[parent]))
        self.authors.append(not _AUTHOR.isdisjoint(re.findall(r"[a-z]+", names.get("class", "").lower())))
        if tag not in _INLINE:
            self.blocks.append(len(stack))
        stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        return at

    def path(self, node: int) -> str:
        """Labels from the page down to the node."""
        out = []
        while node > 0:
            out.append(self.nodes[node][2])
            node = self.nodes[node][0]
        return "".join(">" + x for x in reversed(out))

    def at_path(self, path: str) -> set[int]:
        """The elements at the path that can hold an article and are not left out."""
        labels = path.split(">")[1:]
        depth, found = [0], set()  # how many labels lead to the node, or -1
        if not labels:
            return {0}
        for k in range(1, len(self.nodes)):
            parent, _, label, holder = self.nodes[k]
            d = depth[parent]
            d = d + 1 if 0 <= d < len(labels) and labels[d] == label else -1
            depth.append(d)
            if d == len(labels) and holder == k and not self.out[k]:
                found.add(k)
        return found

    def peak(self) -> int:
        """The container whose paragraphs hold most text outside links; half counts for the container around it too."""
        score: dict[int, float] = {}
        for node, text, link, size in self.pieces:
            if text and not link and not self.out[node]:
                node = self.nodes[node][3]
                score[node] = score.get(node, 0.0) + size
                if node:
                    around = self.nodes[self.nodes[node][0]][3]
                    score[around] = score.get(around, 0.0) + size / 2
        return max(score, key=lambda k: (score[k], -k), default=0)

    def best(self) -> int:
        """The peak, or what is around it where that holds more of the article: the outermost article or main, else the innermost
        container of all text outside links that is not left out."""
        node = self.peak()
        around, k = node, node
        while k >= 0:
            if self.nodes[k][1] in ("article", "main"):
                around = k
            k = self.nodes[k][0]
        if around != node or self.nodes[node][1] in ("article", "main"):
            return around
        held = self._sizes()
        top, k = node, self.nodes[node][0]
        while k >= 0:
            if self.nodes[k][3] == k and held[k] > held[top]:
                top = k
            k = self.nodes[k][0]
        return top

    def judged(self) -> tuple[int, dict[int, tuple[int, bool, int, bool]]]:
        """A hash of the peak's text, which tells pages from their copies, and for the path of each block with text that is not
        left out: (hash of its text, whether it is a list of links, 1 for a thread of readers, 0 for what may be one, else -1,
        whether it holds half of the page's text or more)."""
        n = len(self.nodes)
        held, linked, links, hashes, authors = [0] * n, [0] * n, [0] * n, [0] * n, list(self.authors)
        for node, text, link, size in self.pieces:
            if size and not self.out[node]:
                held[node] += size
                linked[node] += size if link else 0
                hashes[node] += xxhash.xxh64_intdigest("".join(text.split()))
        told: list[list] = [[None, 0, 0, 0, True] for _ in range(n)]  # label of children, how many, their characters, those of headings, alike and with authors
        for k in range(n - 1, 0, -1):
            parent, tag, label, _ = self.nodes[k]
            links[k] += tag == "a"
            held[parent], linked[parent], links[parent], hashes[parent] = held[parent] + held[k], linked[parent] + linked[k], links[parent] + links[k], hashes[parent] + hashes[k]
            authors[parent] = authors[parent] or authors[k]
            if held[k] and tag not in _INLINE:
                of = told[parent]
                if tag in _HEADINGS:
                    of[3] += held[k]
                else:
                    of[4] = of[4] and authors[k] and of[0] in (None, label)
                    of[0], of[1], of[2] = label, of[1] + 1, of[2] + held[k]
        within, out = [False] * n, {}
        for k in range(1, n):
            parent, tag, _, _ = self.nodes[k]
            within[k] = within[parent] or tag in ("article", "main")
            if tag not in _BLOCKS or not held[k] or self.out[k]:
                continue
            label, count, chars, headings, alike = told[k]
            whole = 10 * held[k] > 9 * held[0]
            menu = links[k] >= 3 and 3 * linked[k] >= 2 * held[k] and not within[k] and not whole
            if not alike or not count or chars + headings < held[k] or whole or label.split(".")[0] == "article" and not within[k]:
                thread = -1
            else:
                thread = int(count > 1)
            before = out.get(self.keys[k])
            row = (hashes[k], menu, thread, 2 * held[k] >= held[0])
            out[self.keys[k]] = row if before is None else (before[0] + row[0], before[1] and row[1], min(before[2], row[2]), before[3] or row[3])
        return hashes[self.peak()], out

    def leave_out(self, votes: dict[int, tuple[int, bool, int, bool]], gone: set[int], stay: set[int]) -> None:
        """Leaves out the blocks at the paths `gone`, and by the page's own votes those that are not at the paths `stay`. A page of
        which nothing would be left stays as it is."""
        before = self.out
        drop = gone | {key for key, (_, menu, thread, _) in votes.items() if menu or thread > 0} - stay
        if not drop:
            return
        self.out = list(before)
        for k in range(1, len(self.nodes)):
            parent, tag, _, _ = self.nodes[k]
            self.out[k] = before[k] or self.out[parent] or tag in _BLOCKS and self.keys[k] in drop
        if not any(self._own_sizes()):
            self.out = before

    def _own_sizes(self) -> list[int]:
        """Characters outside links of each element itself, without what is left out."""
        held = [0] * len(self.nodes)
        for node, text, link, size in self.pieces:
            if text and not link and not self.out[node]:
                held[node] += size
        return held

    def _sizes(self) -> list[int]:
        """Characters outside links in each element and what it holds."""
        held = self._own_sizes()
        for k in range(len(held) - 1, 0, -1):
            held[self.nodes[k][0]] += held[k]
        return held

    def _inside(self, chosen: set[int]) -> list[bool]:
        inside: list[bool] = []
        for k, (parent, _, _, _) in enumerate(self.nodes):
            inside.append(not self.out[k] and (k in chosen or parent >= 0 and inside[parent]))
        return inside

    def text(self, path: str | None) -> str:
        """The text of the elements at the path, or of the best container if there is none or they hold less than half as much."""
        chosen = self.at_path(path) if path is not None else set()
        own = self.best()
        inside = self._inside(chosen)
        if own not in chosen:
            held, other = self._own_sizes(), self._inside({own})
            if not chosen or 2 * sum(n for n, x in zip(held, inside, strict=True) if x) < sum(n for n, x in zip(held, other, strict=True) if x):
                inside = other
        return " ".join("".join(" " if t is None else t for node, t, _, _ in self.pieces if inside[node]).split())


VOTES = "host string, path string, key long, page long, text long, menu boolean, thread int, large boolean"


def _long(x: int) -> int:
    """The lowest 64 bits as a signed number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the path of the best container for each page, and one with a key for each of its blocks' paths."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("key", pa.int64()), ("page", pa.int64()), ("text", pa.int64()), ("menu", pa.bool_()), ("thread", pa.int32()), ("large", pa.bool_())])
    for batch in batches:
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source or "")
            told, votes = page.judged()
            page.leave_out(votes, set(), set())
            rows.append((host, page.path(page.best()), None, None, None, None, None, None))
            rows += [(host, None, _long(key), _long(told), _long(text), menu, thread, large) for key, (text, menu, thread, large) in votes.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        texts = []
        for source, path, gone, stay in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            page = Page(source or "")
            page.leave_out(page.judged()[1], {x % (1 << 64) for x in gone or ()}, {x % (1 << 64) for x in stay or ()})
            texts.append(page.text(path))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)


def host_of(url) -> F.Column:
    """The host in lower case, with neither user nor port; null if the url names none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, gone, stay): the path that most pages of the host vote for (ties: the smaller path), and the keys of the paths
    whose blocks it leaves out or keeps. Left out is what says the same on at least three different pages, with at most one text
    for two of them, and what more pages call a list of links, or a thread of readers, than not."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null").mapInArrow(_votes, VOTES)
    votes = common.written(votes, "host-votes")
    counts = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = counts.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("path"))).alias("top"), F.sum("n").alias("pages")).select("host", "top.path", "pages")
    blocks = votes.where("key is not null").groupBy("host", "key").agg(
        F.count("*").alias("n"), F.countDistinct("page").alias("differ"), F.countDistinct("text").alias("texts"), F.count_if("large").alias("large"),
        F.count_if("menu").alias("menus"), F.count_if(F.col("thread") > 0).alias("threads"), F.count_if(F.col("thread") < 0).alias("others"),
    )
    same = "differ >= 3 and 2 * texts <= differ and 2 * large <= n"
    judged = blocks.select("host", "key", "n", F.expr(f"{same} or 2 * menus > n or threads > others").alias("gone"), F.expr("menus + threads > 0").alias("asked"))
    judged = judged.where("gone or asked").join(winners.select("host", "pages"), "host").where(f"{RARE} * n >= pages")
    lists = judged.groupBy("host").agg(F.collect_list(F.expr("case when gone then key end")).alias("gone"), F.collect_list(F.expr("case when not gone then key end")).alias("stay"))
    return winners.drop("pages").join(lists, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html). Null or empty html gives the empty text; a page
    whose url names no host is extracted by its own best container and votes; repeated rows each get a row, and count as one page
    where texts that recur are looked for. Inside an article, elements of the tags nav, footer, aside and form are left out too."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    winners = common.written(winning_paths(pages), "host-paths")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 8 * F.coalesce(F.size("gone") + F.size("stay"), F.lit(0)))).collect()[0][0] or 0
    few = size <= BROADCAST_BYTES
    host = host_of(F.col("url"))
    rows = pages.withColumn("host", host).join(F.broadcast(winners) if few else winners, "host", "left")
    return rows.select("page_id", "url", "html", "path", "gone", "stay").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
