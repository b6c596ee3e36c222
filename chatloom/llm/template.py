"""Main text of web pages by templates deduced from equivalence classes of tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from chatloom.llm.common import landed

# A class of tokens is frequent if it stands on this share of a host's pages, and on two at least; an
# element holds the varying text if this share of it is in there.
SUPPORT, WHOLE = 1 / 32, 0.9

# A tag up to its end outside quotes. Possessive, so that a tag without an end is given up in one go.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var".split()
)
# Elements and words of class, id or role that stand for what surrounds an article: fixed values.
_AROUND_TAGS = set("nav header footer aside form button select dialog menu head object audio video canvas".split())
_AROUND_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related comment comments reply replies"
    " respond disqus popup modal overlay subscribe newsletter signup login footer header masthead toolbar widget"
    " complementary contentinfo search".split()
)
# Never around an article, whatever they are named; and parts of a name such as has-sidebar, no-sidebar,
# comment-open or search-results, which tells the state of an element and not what it is.
_NEVER_AROUND = set("html body main article".split())
_STATE_WORDS = set(
    "has have no not non without with is are open opened closed enabled disabled active inactive on off"
    " hidden visible shown left right results allowed supports".split()
)
_MAIN_WORDS = set("article main content post entry story body".split())
_WORDS = re.compile(r"[a-z]+")
# Elements that may hold an article, those that may be lists of links, and headings.
_CONTAINERS = set("html body div section main article center table tbody tr td".split())
_LISTS = set("div section center table tbody tr td ul ol dl".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


def events(html: str) -> Iterator[tuple]:
    """('text', str), ('open', tag, words of class, id and role) and ('close', tag, None), in page order.

    Every character is looked at a fixed number of times. Where a tag has no end outside quotes, the
    quotes of the page do not balance: that tag and all later ones end at their first `>`.
    """
    at = start = 0
    end, last = len(html), html.rfind(">")
    tags = _TAG
    while (at := html.find("<", at)) >= 0 and at < last:
        mark = html[at + 1]
        if mark in "!?":
            if start < at:
                yield "text", html[start:at], None
            if html.startswith("<!--", at):
                close = html.find("-->", at + 4)
                at = close + 3 if close >= 0 else end
            else:
                at = html.find(">", at) + 1
            start = at
            continue
        found = tags.match(html, at)
        if not found and tags is _TAG and _PLAIN.match(html, at):
            tags = _PLAIN
            found = tags.match(html, at)
        if not found:
            at += 1
            continue
        if start < at:
            yield "text", html[start:at], None
        start = at = found.end()
        tag, inside = found[2].lower(), found[3]
        if found[1]:
            yield "close", tag, None
            continue
        labels = " ".join("".join(x[1:]) for x in _ATTRIBUTE.findall(inside)).lower()
        yield "open", tag, labels
        if tag in _RAW and not inside.endswith("/"):
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = (html.find(">", close.end()) + 1 or end) if close else end
            start = at
            yield "close", tag, None
        elif tag in _VOID:
            yield "close", tag, None
    if start < end:
        if html.startswith("<!--", at) and start <= at:  # a comment that nothing closes
            end = at
        if start < end:
            yield "text", html[start:end], None


def around(tag: str, labels: str) -> bool:
    """If an element is named as one that surrounds an article, by its tag or by one class, id or role."""
    if tag in _NEVER_AROUND:
        return False
    if tag in _AROUND_TAGS or tag in _RAW:
        return True
    for label in labels.split():
        parts = _WORDS.findall(label)
        if not _AROUND_WORDS.isdisjoint(parts) and _STATE_WORDS.isdisjoint(parts):
            return True
    return False


class Walk:
    """The open elements while the events of a page pass: [tag, role, characters, those in links], a role
    being the hash of the path of tags and labels that leads to an element."""

    def __init__(self) -> None:
        self.stack: list[list] = []
        self.tags: Counter[str] = Counter()

    def open(self, tag: str, labels: str) -> int:
        if tag not in _INLINE and tag not in _VOID:
            while self.stack and (self.stack[-1][0] in _INLINE or self.stack[-1][0] == "p"):
                self.pop()
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
                self.pop()
        parent = self.stack[-1][1] if self.stack else 0
        role = xxh3_64_intdigest(f"{parent} {tag} {labels}") >> 1
        self.stack.append([tag, role, 0, 0])
        self.tags[tag] += 1
        return role

    def pop(self) -> None:
        self.tags[self.stack.pop()[0]] -= 1

    def close(self, tag: str) -> None:
        if self.tags[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()


class Measure(Walk):
    """A walk that adds the characters of an element to those of its parent when it ends, save those
    of elements that are around."""

    def __init__(self) -> None:
        super().__init__()
        self.out: dict[tuple[int, int], list] = {}

    def pop(self) -> None:
        tag, role, chars, linked = self.stack[-1]
        super().pop()
        token = self.out[role, 0]
        linked = chars if tag == "a" else linked
        token[4] += chars
        token[6] += linked
        if self.stack and not token[5]:
            self.stack[-1][2] += chars
            self.stack[-1][3] += linked


def page_tokens(html: str) -> dict[tuple[int, int], list]:
    """Tokens of a page: (role, 0) for elements, (role, hash) for texts in them, each with [count,
    parent role, tag, 1 if named like an article, characters, 1 if around, characters in links]. An
    element's characters are those of all text below it, save in elements below it that are around."""
    walk = Measure()
    out = walk.out
    for kind, value, labels in events(html):
        if kind == "open":
            role = walk.open(value, labels)
            parent = walk.stack[-2][1] if len(walk.stack) > 1 else 0
            token = out.get((role, 0))
            if token is None:
                named = int(not _MAIN_WORDS.isdisjoint(_WORDS.findall(labels)))
                token = out[role, 0] = [0, parent, value, named, 0, int(around(value, labels)), 0]
            token[0] += 1
        elif kind == "close":
            walk.close(value)
        elif walk.stack and not value.isspace():
            role = walk.stack[-1][1]
            key = (role, (xxh3_64_intdigest(value.strip()) >> 1) | 1)
            text = out.setdefault(key, [0, role, "", 0, 0, 0, 0])
            text[0] += 1
            text[4] += len(value)
            walk.stack[-1][2] += len(value)
    while walk.stack:
        walk.pop()
    return out


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(host, role, item, parent, tag, named, around, pages, times, chars, linked, vector): tokens with their
    occurrence vectors over the pages of a host.

    The vector, a count per page, is held as sums over pages that combine before the shuffle, so the
    pages of a host never meet; equal vectors make one class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for (role, item), token in page_tokens(html).items():
                    rows.append((host, page, role, item, *token))
            columns = list(zip(*rows, strict=True)) or [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["host", "page", "role", "item", "n", "parent", "tag", "named", "chars", "around", "linked"]
    long, text = pa.int64(), pa.string()
    kinds = [text, long, long, long, long, long, text, long, long, long, long]
    schema = "host string, page long, role long, item long, n long, parent long, tag string, named long, chars long, around long, linked long"
    tokens = pages.select("host", "page", "html").mapInArrow(run, schema)
    return tokens.groupBy("host", "role", "item").agg(
        F.first("parent").alias("parent"),
        F.first("tag").alias("tag"),
        F.max("named").alias("named"),
        F.max("around").alias("around"),
        F.count("*").alias("pages"),
        F.sum("n").alias("times"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
    )


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, mains, closed): for every host the roles of the elements that hold articles, of which a page
    takes the first it has, and roles that belong to the template where an article is all of a page.

    Tokens on fewer pages than SUPPORT asks are left out before anything is gathered, so a host's
    list is at most 1 / SUPPORT times as long as a page.
    """
    counted = pages.groupBy("host").agg(
        F.count("*").alias("all_pages"), F.bit_xor(F.xxhash64("page", F.lit(1).cast("long"))).alias("all_vector")
    )
    frequent = (F.col("pages") >= F.col("all_pages") * SUPPORT) & ((F.col("pages") > 1) | (F.col("all_pages") == 1))
    classes = equivalence_classes(pages).join(counted, "host").where(frequent)
    names = ("role", "item", "parent", "tag", "named", "around", "pages", "times", "chars", "linked", "vector")
    listed = classes.groupBy("host", "all_pages", "all_vector").agg(
        F.sort_array(F.collect_list(F.struct(*names))).alias("tokens")
    )

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            hosts, mains, closed = [], [], []
            for host, many, vector, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Template(tokens, many, vector)
                hosts.append(host)
                mains.append(found.mains())
                closed.append(sorted(found.closed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(mains, longs), pa.array(closed, longs)],
                names=["host", "mains", "closed"],
            )

    schema = "host string, mains array<long>, closed array<long>"
    return listed.select("host", "all_pages", "all_vector", "tokens").mapInArrow(deduce, schema)


class Template:
    """The template of a host, nested from its equivalence classes.

    A text on many pages, once on each, is constant; all other text varies. Elements that are once on
    each of their pages form classes by their occurrence vectors. From the whole page inwards a class
    is entered where it holds the varying text of its parent, and several classes where their pages
    part those of the parent (their vectors add up to its vector): those are layouts of the host. Text
    inside the element that is reached is never looked at again.
    """

    def __init__(self, tokens: list[dict], many: int, vector: int) -> None:
        self.elements = {t["role"]: t for t in tokens if t["item"] == 0}
        self.elements[0] = dict(parent=None, tag="", named=0, around=0, pages=many, times=many, chars=0, linked=0, vector=vector)
        self.children: dict[int, list[int]] = {}
        for role, t in self.elements.items():
            if role:
                self.children.setdefault(t["parent"], []).append(role)
        self.order: list[int] = []  # each element before what is in it
        todo = [0]
        while todo:
            self.order.append(todo.pop())
            todo.extend(self.children.get(self.order[-1], []))
        self.place = {r: k for k, r in enumerate(self.order)}
        self.until = {r: k + 1 for k, r in enumerate(self.order)}  # where what is in it ends
        self.closed: set[int] = set()
        self.shut = {r for r in self.order if self.elements[r]["around"]}
        self.chars = {r: self.elements[r]["chars"] for r in self.order}
        self.chars[0] = sum(self.chars[r] for r in self.children.get(0, []) if r not in self.shut)
        constant = dict.fromkeys(self.order, 0)
        for t in tokens:
            if t["item"] and many > 1 and t["times"] == t["pages"]:
                constant[t["parent"]] += t["chars"]
        for r in reversed(self.order[1:]):
            parent = self.elements[r]["parent"]
            self.until[parent] = max(self.until[parent], self.until[r])
            if r not in self.shut:
                constant[parent] += constant[r]
        self.varying = {r: self.chars[r] - constant[r] for r in self.order}
        if not any(self.varying.values()):  # copies of one page do not show what varies
            self.varying = dict(self.chars)
        dark = 0
        for k, role in enumerate(self.order):  # lists of links, whatever they are named
            t = self.elements[role]
            if k >= dark and role not in self.shut and t["tag"] in _LISTS and 2 * t["linked"] > t["chars"]:
                self.shut.add(role)
                for part in (self.chars, self.varying):
                    self.take(part, t["parent"], part[role])
            if k >= dark and role in self.shut:
                dark = self.until[role]
        self.headings = [r for r in self.order if self.elements[r]["tag"] in _HEADINGS]
        while not self.varying[0]:
            # Where all that varies is in elements around, the outermost named so hold the article.
            outer = [
                r
                for r in self.shut
                if self.varying[r] and self.elements[r]["tag"] not in _AROUND_TAGS and self.elements[r]["tag"] not in _RAW
                and not self.hidden(self.elements[r]["parent"])
            ]
            if not outer:
                break
            self.shut.difference_update(outer)
            for r in outer:
                for part in (self.chars, self.varying):
                    self.take(part, self.elements[r]["parent"], -part[r])

    def take(self, part: dict[int, int], role: int | None, chars: int) -> None:
        """Take characters from an element and from all it is in, up to one that is around."""
        while role is not None and role in part:
            part[role] -= chars
            if role in self.shut:
                return
            role = self.elements[role]["parent"]

    def hidden(self, role: int | None) -> bool:
        while role is not None:
            if role in self.shut:
                return True
            role = self.elements[role]["parent"] if role in self.elements else None
        return False

    def inside(self, role: int, outer: int) -> bool:
        return self.place[outer] <= self.place[role] < self.until[outer]

    def once(self, role: int) -> bool:
        return self.elements[role]["times"] == self.elements[role]["pages"]

    def mains(self) -> list[int]:
        root, dark = [], 0
        for k, r in enumerate(self.order):
            dark = self.until[r] if k >= dark and r in self.shut else dark
            if r and k >= dark and self.once(r):
                root.append(r)
        usual = self.varying[0] / self.elements[0]["pages"]
        named = [r for r in root if self.elements[r]["tag"] in ("article", "main")] or [
            r for r in root if self.elements[r]["named"] and 2 * self.varying[r] >= usual * self.elements[r]["pages"]
        ]
        named.sort(key=lambda r: (self.elements[r]["tag"] != "article", -self.elements[r]["chars"], self.place[r]))
        return named + [r for r in self.enter(0) if r not in named]

    def enter(self, start: int) -> list[int]:
        """Roles of the elements that hold the varying text of the layouts below `start`, inmost first."""
        out, todo = [], [start]
        while todo:
            role = todo.pop()
            t = self.elements[role]
            classes: dict[tuple[int, int], list[int]] = {}
            for c in self.children.get(role, []):
                e = self.elements[c]
                if self.varying[c] > 0 and self.once(c) and c not in self.shut and e["tag"] in _CONTAINERS:
                    classes.setdefault((e["vector"], e["pages"]), []).append(c)
            vector = pages = 0
            for of_class, number in classes:
                vector, pages = vector ^ of_class, pages + number
            inner = []
            if classes and (vector, pages) == (t["vector"], t["pages"]):  # the classes part the pages
                all_of = sum(self.varying[c] for members in classes.values() for c in members)
                if all_of >= WHOLE * self.varying[role]:
                    # What varies outside the classes is shared out to them by their pages.
                    outside = (self.varying[role] - all_of) / pages
                    for members in classes.values():
                        best = max(members, key=lambda c: self.varying[c])
                        others = [c for x in classes.values() if x is not members for c in x]
                        of_class = sum(self.varying[c] for c in members) + outside * self.elements[best]["pages"]
                        if self.varying[best] >= WHOLE * of_class and self.may_enter(role, best, others):
                            inner.append(best)
            todo.extend(inner)
            if len(inner) < max(1, len(classes)):
                self.close_constant(role)
                out.append(role)
        return [r for r in reversed(out) if r]

    def may_enter(self, role: int, best: int, others: list[int]) -> bool:
        """If leaving what is outside `best` is safe: no heading is there but in `others`, elements of other
        layouts (around a whole page: no heading that varies), and the constant text left is outweighed
        by varying text of as many pages as bear it out."""
        part = self.varying if self.elements[role]["tag"] in ("", "html", "body") else self.chars
        for r in self.headings:
            if part[r] > 0 and self.inside(r, role) and not any(self.inside(r, c) for c in (best, *others)):
                if not self.hidden(r):
                    return False
        t, many = self.elements[best], self.elements[best]["pages"]
        if many < 2:
            return self.chars[best] == self.chars[role]
        left = (self.chars[role] / self.elements[role]["pages"]) - t["chars"] / many
        return left <= self.varying[best] / many * (many - 1)

    def close_constant(self, role: int) -> None:
        """Where an article is all of a page, close the containers with nothing but constant text."""
        t = self.elements[role]
        if t["tag"] not in ("", "html", "body") or t["pages"] < 2:
            return
        constant = [
            c
            for c in self.children.get(role, [])
            if self.elements[c]["tag"] in _LISTS and self.once(c) and c not in self.shut and not self.varying[c] and self.chars[c]
        ]
        if sum(self.chars[c] for c in constant) <= self.varying[role] * (t["pages"] - 1):
            self.closed.update(constant)


def main_text(html: str, mains: list[int] | None, closed: Set[int]) -> str:
    """Blocks of text in the first element of the roles `mains` that the page has, joined by line feeds;
    without such an element in the page, those of its first article or main element, or else of all that
    is not around one. Elements of the roles `closed` are left out, save in an article so named. What is
    outside the element never hides it, save that a named one outside all that is around comes first."""
    main: int | None = None
    if mains:
        walk, has = Walk(), set()
        for kind, value, labels in events(html):
            if kind == "open":
                has.add(walk.open(value, labels))
            elif kind == "close":
                walk.close(value)
        main = next((r for r in mains if r in has), None)
    for wanted in ("role", "name", "inner name", "all")[main is None :]:
        walk, blocks, current = Walk(), [], []
        level, seen = None, False  # depth of the open main element
        shut: int | None = None  # depth of an element around the article

        def flush() -> None:
            text = " ".join(unescape("".join(current)).split())
            if text:
                blocks.append(text)
            current.clear()

        for kind, value, labels in events(html):
            if kind == "open":
                role = walk.open(value, labels)
                deep = len(walk.stack)
                if level is not None and deep <= level:
                    flush()
                    level = None
                if shut is not None and deep <= shut:
                    shut = None
                if value not in _INLINE and value != "br":
                    flush()
                elif value == "br" and shut is None:
                    current.append(" ")
                begins = False
                if level is None and not (seen and wanted in ("name", "inner name")):
                    begins = (
                        (wanted == "role" and role == main)
                        or (shut is None and wanted == "name" and value in ("article", "main"))
                        or (wanted == "inner name" and value in ("article", "main"))
                        or (shut is None and wanted == "all" and deep == 1)
                    )
                    if begins:
                        level, seen = deep, True
                        if wanted != "all":
                            shut = None
                if shut is None and not (begins and wanted == "role"):
                    if around(value, labels) or (role in closed and wanted in ("role", "all")):
                        shut = deep
            elif kind == "close":
                if value not in _INLINE and value != "br":
                    flush()
                walk.close(value)
                deep = len(walk.stack)
                if level is not None and deep < level:
                    flush()
                    level = None
                if shut is not None and deep < shut:
                    shut = None
            elif shut is None and (level is not None or (wanted == "all" and not walk.stack)):
                current.append(value)
                seen = True
        flush()
        if seen or wanted == "all":
            return "\n".join(blocks)
    return ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`.

    Null or empty html: empty text. A null url, or one without a host, belongs to the host ''. A host
    with one page has only the structure of that page to go by. Bytes that are no UTF-8 become U+FFFD.
    Repeated rows give repeated results. An empty table gives an empty result. Other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    page = pages.select(
        "page_id", "url", host.alias("host"), F.make_valid_utf8(F.coalesce("html", F.lit(""))).alias("html"),
        F.xxhash64("page_id", "url").alias("page"),
    )
    templates = landed(host_templates(page), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, mains, closed = (batch.column(i).to_pylist() for i in (2, 3, 4))
            texts = [main_text(h, m, set(c or ())) for h, m, c in zip(html, mains, closed, strict=True)]
            lengths = pa.array(np.array([len(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = page.join(templates, "host", "left").select("page_id", "url", "html", "mains", "closed")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
