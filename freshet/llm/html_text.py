"""Operator 5: main text of HTML pages by consensus paths of hosts.

Each page's containers are scored by the text of their paragraphs, less that of links and of
boilerplate.  The best one is widened to the article or main element around it, or else to the
containers around it that add more text than links.  Pages vote for the generalised tag-class path of their best container; votes are
added up per host in Spark.  Pages are then extracted again at their host's winning path.  A
page's own best container stays beside what the path finds, in page order, unless it lies inside
it.  It is left out only if it is mostly links, or if the host knows its path for side matter:
more pages have text there without it being their best than have their best there.

Text of boilerplate is left out by tag, role and visibility, and by class or id: always where a
name says nothing but boilerplate (``side-menu``, ``user-comments``), where it says more
(``news-alert``) only outside articles and if the element is short or mostly links.  A form goes
unless it wraps an article or paragraphs, its controls always.  Character references are decoded;
white space inside a block becomes one space; blocks are joined by an empty line.

Defined cases: a null or empty page has an empty text; a null URL votes for the empty host; equal
rows, and rows with equal or null ids, give equal results for equal pages; very long and deeply
nested pages are read whole, in time linear in their length; columns besides the id, URL and html
are left out, whatever they are called; malformed markup is read as far as it goes (unclosed elements end with
their parents); an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shard_count

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.IGNORECASE)
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROP_TAGS = frozenset("nav footer aside script style noscript iframe template textarea button select option input svg math canvas object embed dialog menu head title xmp datalist audio video map".split())
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended recommendations sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar pagination pager comment comments "
    "reply replies respond discussion disqus widget signup login search skip taboola outbrain".split()
)
#: Words that name comments, in whatever company of _PARTS and _PEOPLE, and those that say so of no element.
_COMMENT_WORDS = frozenset("comment comments commenter reply replies respond disqus".split())
_PEOPLE = frozenset("reader readers user users author body form thread text content meta main page data entry count add all new leave latest recent odd even depth".split())
#: Inside an article headings have headers.
_INSIDE_ONLY = frozenset("header masthead".split())
_PARTS = frozenset(
    "area bar block blocks box container group inline inner item items js links list module outer panel post posts section slot stories story top bottom unit widget widgets wrap wrapper "
    "article articles results result more left right main sticky fixed primary secondary site page global".split()
)
#: An element whose name says more than boilerplate stays with so many characters of text that isn't linked, if no more are linked.
OWN_TEXT = 140
#: Characters that make a paragraph of a form's own text, and how many such paragraphs make the form a wrapper.
FORM_PARAGRAPH, FORM_PARAGRAPHS = 80, 2
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: An element of the first kind is ended by an opening tag of the second.
_BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_CONTAINERS = frozenset("article main div section td body blockquote center".split())
_BONUS = {"article": 1.5, "main": 1.3, "body": 0.6}
#: Between the labels of a path: no class or tag has white space.
SEPARATOR = " "
#: Bytes of the compressed input in a shard; html is several times as long.
SHARD_BYTES = 1 << 18


def _named(name: str, inside: bool) -> int:
    """What a class or id says of its element: 2 nothing but boilerplate, 1 boilerplate among other things, 0 neither."""
    words = [x.lower() for x in _WORDS.findall(name) if not x.isdigit()]
    if any(x in _COMMENT_WORDS for x in words):
        return 2 if all(x in _COMMENT_WORDS or x in _DROP_WORDS or x in _PARTS or x in _PEOPLE for x in words) else 1
    if inside:
        words = [x for x in words if x not in _INSIDE_ONLY]
    if not any(x in _DROP_WORDS for x in words):
        return 0
    return 2 if all(x in _DROP_WORDS or x in _PARTS for x in words) else 1


class _Tags:
    """Ends of tags in a source, each byte being looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in "\"'>"}
        # Places outside quotes from which no end of a tag is reached.
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin here, not one in quotes if there is another; -1: none."""
        if at > self.last[">"]:
            return -1
        place, seen = at, []
        while place not in self.dead:
            m = _STOP.search(self.source, place)
            if m is None:
                break
            c, k = m[0], m.start()
            if c == ">":
                return k
            seen.append(place)
            if k >= self.last[c]:
                break
            place = self.source.index(c, k + 1) + 1
        self.dead.update(seen)
        return self.source.find(">", at)


class Page:
    """Elements as parallel lists (parent, tag, label, dropped), and text with the element it is in."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.dropped = [-1], ["#root"], [""], [False]
        # Of each element: whether it is in an article or main element, or in a link; the next container; a hash of its path.
        self.in_article, self.in_link, self.container, self.hash = [False], [False], [0], [0]
        self.text: list[tuple[int, str]] = []  # an empty text marks a block's edge
        # Elements that what they hold decides about: forms, and those with a name of which boilerplate is a part.
        self.forms: list[int] = []
        self.doubtful: list[int] = []
        # Open elements, and of them the places of each tag and of those that aren't inline.
        self.stack, self.open, self.blocks = [0], {}, [0]
        self._read(source)
        self._settle()

    def _edge(self, tag: str) -> None:
        if tag not in _INLINE:
            self.text.append((self.stack[-1], ""))

    def _read(self, source: str) -> None:
        tags, at, plain, n = _Tags(source), 0, 0, len(source)
        while at < n:
            start = source.find("<", at)
            if start < 0:
                break
            after = source[start + 1 : start + 4]
            if after == "!--":
                close = source.find("-->", start + 4)
                end = n if close < 0 else close + 3
            elif after[:1] in ("!", "?"):
                close = source.find(">", start) if start < tags.last[">"] else -1
                end = close + 1
            else:
                closing = after[:1] == "/"
                name = _NAME.match(source, start + 1 + closing)
                close = -1 if name is None else source.find(">", name.end()) if closing and start < tags.last[">"] else -1 if closing else tags.end(name.end())
                end = close + 1
            if not end:  # no tag
                at = start + 1
                continue
            if start > plain:
                self.text.append((self.stack[-1], source[plain:start]))
            at = plain = end
            if after[:1] in ("!", "?"):
                continue
            tag = name[0].lower()
            if closing:
                self._ended(tag)
                continue
            attributes = source[name.end() : close]
            if tag == "br" or tag == "wbr":
                if tag == "br":
                    self.text.append((self.stack[-1], " "))
                continue
            if tag in _BLOCKS_END_P:
                self._end({"p"}, {"body", "div", "article", "section", "td", "th", "table", "button"})
            if tag in _SIBLINGS:
                self._end(_SIBLINGS[tag], _SCOPES[tag])
            self._edge(tag)
            number = self._add(self.stack[-1], tag, attributes)
            if tag in _RAW:
                close = _RAW[tag].search(source, at)
                at = plain = close.end() if close else n
            elif tag not in _VOID and not attributes.endswith("/"):
                self.open.setdefault(tag, []).append(len(self.stack))
                if tag not in _INLINE:
                    self.blocks.append(len(self.stack))
                self.stack.append(number)
        if plain < n:
            self.text.append((self.stack[-1], source[plain:]))

    def _ended(self, tag: str) -> None:
        """An end tag; that of an inline element reaches no further than the block it is in."""
        k = self._place(tag)
        if k and (tag not in _INLINE or k > self.blocks[-1]):
            self._close(k)
            self._edge(tag)

    def _place(self, tag: str) -> int:
        places = self.open.get(tag)
        return places[-1] if places else 0

    def _close(self, k: int) -> None:
        for number in self.stack[k:]:
            self.open[self.tag[number]].pop()
            if self.tag[number] not in _INLINE:
                self.blocks.pop()
        del self.stack[k:]

    def _end(self, tags: set[str], scope: set[str]) -> None:
        k = max(map(self._place, tags))
        if k and k > max(map(self._place, scope)):
            self.text.append((self.stack[-1], ""))
            self._close(k)

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        names, drop, doubt = "", tag in _DROP_TAGS, False
        label = tag
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "class":
                    label = tag + "." + ".".join(sorted({re.sub(r"\d+", "#", x) for x in value.split()}))
                if key in ("class", "id"):
                    names += " " + value
                elif key == "role":
                    drop |= value.lower() in _DROP_ROLES
                elif key == "hidden":
                    drop |= value.lower() != "until-found"
                elif key == "aria-hidden":
                    drop |= value.lower() == "true"
                else:
                    drop |= bool(_HIDDEN.search(value))
        inside = self.in_article[parent]
        number = len(self.tag)
        if names and tag not in ("html", "body"):
            said = max(_named(x, inside) for x in names.split()) if names.split() else 0
            if tag in ("article", "main"):
                # Only comments are articles of their own.
                drop |= said == 2 and any(x.lower() in _COMMENT_WORDS for x in _WORDS.findall(names))
            else:
                drop |= said == 2
                doubt = said == 1 and not inside
        if tag == "header":
            drop |= not inside
        if tag == "form":
            self.forms.append(number)
        elif doubt and not drop:
            self.doubtful.append(number)
        self.parent.append(parent), self.tag.append(tag), self.label.append(label), self.dropped.append(drop or self.dropped[parent])
        self.in_article.append(inside or tag in ("article", "main")), self.in_link.append(tag == "a" or self.in_link[parent])
        self.container.append(number if tag in _CONTAINERS else self.container[parent]), self.hash.append(hash((self.hash[parent], label)))
        return number

    def _settle(self) -> None:
        """Decides about forms and doubtful elements by what they hold, from the inside out."""
        if not self.forms and not self.doubtful:
            return
        n = len(self.tag)
        plain, linked, paragraphs, articles = [0] * n, [0] * n, [0] * n, [0] * n
        of_paragraph = [0] * n
        for k in range(1, n):
            of_paragraph[k] = k if self.tag[k] == "p" else of_paragraph[self.parent[k]]
        own: dict[int, int] = {}
        for number, text in self.text:
            size = 0 if self.dropped[number] else len(text.strip())
            if size:
                (linked if self.in_link[number] else plain)[number] += size
                if of_paragraph[number] and not self.in_link[number]:
                    own[of_paragraph[number]] = own.get(of_paragraph[number], 0) + size
        for k, size in own.items():
            paragraphs[k] += size >= FORM_PARAGRAPH
        drop, doubtful = set(), set(self.doubtful)
        for k in range(n - 1, 0, -1):
            articles[k] += self.tag[k] in ("article", "main") and not self.dropped[k]
            if self.tag[k] == "form":
                gone = not articles[k] and paragraphs[k] < FORM_PARAGRAPHS
            else:
                gone = k in doubtful and not articles[k] and (plain[k] < OWN_TEXT or linked[k] > plain[k])
            if gone:
                drop.add(k)
            else:
                for count in (plain, linked, paragraphs, articles):
                    count[self.parent[k]] += count[k]
        for k in range(1, n):
            self.dropped[k] = self.dropped[k] or k in drop or self.dropped[self.parent[k]]

    def upwards(self, number: int):
        while number > 0:
            yield number
            number = self.parent[number]

    def path(self, number: int) -> str:
        parts = []
        while number > 0:
            parts.append(self.label[number])
            number = self.parent[number]
        return SEPARATOR.join(reversed(parts))

    def best(self) -> tuple[int, float, set[int]]:
        """The best container, widened, its score before that, and the containers of plain text outside it."""
        score: dict[int, float] = {}
        linked: list[tuple[int, int]] = []
        plain: list[tuple[int, int]] = []
        for number, text in self.text:
            size = len(text.strip()) if text and not self.dropped[number] else 0
            if not size:
                continue
            if self.in_link[number]:
                linked.append((number, size))
                continue
            plain.append((number, size))
            # The paragraph's container gets all of it, the next ones less and less.
            weight, k = 1.0, self.container[number]
            while k > 0 and weight > 0.05:
                score[k] = score.get(k, 0.0) + weight * size * _BONUS.get(self.tag[k], 1.0)
                weight *= 0.5
                k = self.container[self.parent[k]]
        if not score:
            return 0, 0.0, set()
        number = max(score, key=lambda k: (score[k], -k))
        root = self._widened(number, plain, linked)
        inside = self.within({root})
        return root, score[number], {self.container[k] for k, _ in plain if not inside[k]} - {0, *self.upwards(root)}

    def _widened(self, number: int, plain: list[tuple[int, int]], linked: list[tuple[int, int]]) -> int:
        """The outermost article around a container, or else main; or else what adds more text than links, below body."""
        around = list(self.upwards(number))
        for tag in ("article", "main"):
            found = [k for k in around if self.tag[k] == tag]
            if found:
                return found[-1]
        if self.tag[number] == "body":
            return number
        # Text less links that each container around adds to the one before it.
        level = [-1] * len(self.tag)
        for i, k in enumerate(around):
            level[k] = i
        for k in range(1, len(level)):
            if level[k] < 0:
                level[k] = level[self.parent[k]]
        more = [0] * len(around)
        for sign, texts in ((1, plain), (-1, linked)):
            for k, size in texts:
                if level[k] >= 0:
                    more[level[k]] += sign * size
        added = 0
        for i, k in enumerate(around[1:], 1):
            added += more[i]
            if self.tag[k] == "body" or added < 0:
                break
            if added > 0 and self.tag[k] in _CONTAINERS:
                number, added = k, 0
        return number

    def within(self, roots: set[int]) -> list[bool]:
        """Whether each element is one of these or inside one."""
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = k in roots or (k > 0 and inside[self.parent[k]])
        return inside

    def extract(self, roots: set[int]) -> str:
        """The blocks of text inside some elements."""
        inside = self.within(roots)
        blocks, now = [], []
        for number, text in self.text:
            if text == "":
                if now:
                    blocks.append("".join(now))
                    now = []
            elif inside[number] and not self.dropped[number]:
                now.append(text)
        blocks.append("".join(now))
        clean = (" ".join(entities.unescape(b).split()) for b in blocks)
        return "\n\n".join(b for b in clean if b)

    def at(self, path: str) -> set[int]:
        wanted = 0
        for label in path.split(SEPARATOR):
            wanted = hash((wanted, label))
        return {k for k in range(1, len(self.tag)) if self.hash[k] == wanted and not self.dropped[k]}

    def mostly_links(self, roots: set[int]) -> bool:
        inside, plain = self.within(roots), 0
        for number, text in self.text:
            if inside[number] and not self.dropped[number]:
                plain += -len(text.strip()) if self.in_link[number] else len(text.strip())
        return plain < 0


def main_text(source: str | None, path: str | None = None, sides=()) -> str:
    """A page's main text: at the host's path if the page has it, and in the page's own best container unless its path is one of ``sides``."""
    if not source:
        return ""
    page = Page(source)
    best = page.best()[0]
    roots = page.at(path) if path else set()
    if not roots:
        return page.extract({best})
    if not roots.isdisjoint(page.upwards(best)):
        return page.extract(roots)
    inside = page.within({best})
    if page.tag[best] not in ("article", "main") and not any(inside[k] for k in roots):
        if page.mostly_links(roots):
            return page.extract({best})
        if page.mostly_links({best}) or (sides and page.path(best) in sides):
            return page.extract(roots)
    return page.extract(roots | {best})


def _votes(batches):
    for batch in batches:
        count: dict[tuple[str, str], list[float]] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if source:
                page = Page(source)
                number, score, others = page.best()
                if number:
                    v = count.setdefault((host, page.path(number)), [0, 0, 0.0])
                    v[0] += 1
                    v[2] += score
                for path in {page.path(k) for k in others}:
                    count.setdefault((host, path), [0, 0, 0.0])[1] += 1
        columns = [pa.array([int(v[k]) for v in count.values()], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in count], pa.string()), pa.array([p for _, p in count], pa.string()), *columns], ["host", "path", "votes", "passed", "score"])


def _texts(pages: pa.Table, winners: pa.Table) -> pa.Table:
    known = {h: (p, frozenset(s)) for h, p, s in zip(*[winners.column(c).to_pylist() for c in ("of", "path", "sides")])}
    texts = [main_text(s, *known.get(h, ())) for h, s in zip(pages.column("host").to_pylist(), pages.column("html").to_pylist())]
    return pa.table({"id": pages.column("id"), "url": pages.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def host_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: the id, url, text and n_chars."""
    shards = shard_count(pages, SHARD_BYTES)
    rows = pages.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(url_col)), F.lit(shards)).cast("int").alias("shard"),
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        host_of(F.col(url_col).cast("string")).alias("host"),
        F.col(html_col).cast("string").alias("html"),
    )
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string, votes long, passed long, score long").groupBy("host", "path").agg(*[F.sum(x).alias(x) for x in ("votes", "passed", "score")])
    # Of the paths that were some page's best, those passed over by more pages; there are as many as best paths at most.
    side = F.when(F.col("passed") > F.col("votes"), F.col("path"))
    winners = votes.filter("votes > 0").groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("x"), F.collect_list(side).alias("sides")).select("host", F.col("x.path").alias("path"), "sides")
    # A host's path goes to the shards that hold pages of it, so no shard gets a large host whole.
    wanted = rows.select(F.col("shard").alias("to"), "host").distinct().join(winners, "host").select("to", F.col("host").alias("of"), "path", "sides")
    out = rows.groupBy("shard").cogroup(wanted.groupBy("to")).applyInArrow(_texts, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
