"""Main text of web pages, without the site's templates.

All elements of a page are hashed as subtrees, and their places by the names
and classes above them. Spark counts both for each host: the place that holds
the most of the host's different words is where its articles stand, so all
beside it is template; and so are subtrees there that recur in many different
articles. HTML's own roles and class words decide where counts are silent:
on pages without that place, and on what an article holds besides its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import small_batches, stash, text_or_empty

_RAW = (
    r"<!--.*?(?:-->|(?P<comment>\Z))|<!\[CDATA\[.*?(?:\]\]>|(?P<section>\Z))|<[!?][^>]*+>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|math|iframe|select|object|canvas|audio|video)\b[^>]*+(?<!/)>(?:.*?</(?P=raw)\s*+>|(?P<rest>.*\Z))"
    r"|<(?:script|style|noscript|template|textarea|title|svg|math|iframe|select|object|canvas|audio|video)\b[^>]*+(?<=/)>"
    r"|</(?P<end>[a-z][^\s/>]*+)[^>]*+>|<(?P<start>[a-z][^\s/>]*+)(?P<attrs>%s)>|(?P<unquoted><[a-z][^>]*+>)"
)
_MARKUP, _WITHOUT_QUOTES = (re.compile(_RAW % attrs, re.IGNORECASE | re.DOTALL) for attrs in (r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", "[^>]*+"))
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

# fixed values: element names of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_NO_TEXT = frozenset("form button dialog head fieldset input".split())
_OTHER = _NO_TEXT | frozenset("nav footer aside menu".split())
#: An element of the first name ends an open one of the others.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Class, id or role words of elements that are not the article.
_NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall"
    r"|sidebar|side|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|skip|search|login"
    r"|header|masthead|footer|copyright|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|teasers?|tags|complementary|contentinfo)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Whole class tokens and roles that mark a container inside an article: a word of furniture, alone or with words of layout.
_FURNITURE = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall"
    r"|sidebar|side|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|skip|search|login"
    r"|header|masthead|footer|copyright|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|teasers?|tags|complementary|contentinfo)"
    r"(?:[_-](?:ads?|articles?|area|banner|bar|block|box|buttons?|container|form|icons?|items?|links?|list|menu|nav|notice|popup|posts?|section|stories|widget|wrap|wrapper))*",
    re.IGNORECASE,
)
#: Ids that publishing software gives to the readers' comments; other ids inside an article are anchors.
_COMMENT_IDS = frozenset("comments respond disqus_thread".split())


@dataclass(eq=False, slots=True)
class Node:
    name: str
    mark: str = ""
    roles: tuple[str, ...] = ()  # class tokens and roles
    ident: str = ""
    parent: Node | None = None
    parts: list = field(default_factory=list)  # strings and nodes

    def inline(self) -> bool:
        return self.name in _INLINE


def _markup(page: str) -> Iterator[tuple[str, re.Match | None, str | None]]:
    """The text before each piece of markup, with the markup and its kind; at last the text behind it, with None.

    Takes time in proportion to the page: behind the last > no tag can end, and
    once a quote in a tag has not been closed up to there, quotes do not count
    any more.
    """
    last, at, pattern = page.rfind(">") + 1, 0, _MARKUP
    while m := pattern.search(page, at, last):
        kind = m.lastgroup
        if kind == "unquoted":
            pattern = _WITHOUT_QUOTES
            m = pattern.search(page, m.start(), last)
            kind = m.lastgroup
        yield page[at : m.start()], m, kind
        at = m.end()
        if kind in ("comment", "section", "rest"):
            return  # what is never closed takes the rest of the page
    yield re.split("<(?=[a-z/!?])", page[at:], maxsplit=1, flags=re.IGNORECASE)[0], None, None


def parse(page: str) -> Node:
    """The element tree of a page; unclosed and stray tags are put right as far as the blocks need it."""
    root = Node("#root")
    at, open_names = root, Counter()

    def leave(node: Node) -> Node:
        """Close all open elements up to this one; what it stands in."""
        inner = at
        while inner is not node.parent:
            open_names[inner.name] -= 1
            inner = inner.parent
        return inner

    for text, m, kind in _markup(page):
        if text:
            at.parts.append(text)
        if kind == "end":
            name = m["end"].lower()
            if open_names[name]:
                node = at
                while node.name != name:
                    node = node.parent
                at = leave(node)
            continue
        if kind != "attrs":
            continue
        name, attrs = m["start"].lower(), m["attrs"]
        if name in _VOID:
            at.parts.append(Node(name))
            continue
        ends = _ENDS.get(name) or ({"p"} if name in _ENDS_P else None)
        if ends and any(open_names[e] for e in ends):
            node = at
            while node is not root and node.name not in ends and (node.inline() or node.name == "p"):
                node = node.parent
            if node.name in ends:
                at = leave(node)
        node = Node(name, parent=at)
        if attrs:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attrs)}
            node.mark = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
            node.roles, node.ident = tuple(f"{found.get('class', '')} {found.get('role', '')}".split()), found.get("id", "").strip()
        at.parts.append(node)
        if not attrs.rstrip().endswith("/"):
            at = node
            open_names[name] += 1
    return root


def is_other(node: Node, in_article: bool, page: bool = False, roles: bool = True) -> bool:
    """Whether HTML or the element's marks say that it is not the article's text.

    Inside an article only containers are asked, for their whole class tokens
    and roles; on a page that has no article (page) every mark counts. Without
    roles only elements that hold no text to read are other.
    """
    if not roles:
        return node.name in _NO_TEXT
    if node.name in _OTHER:
        return True
    if node.name == "header" and not (in_article and any(isinstance(p, Node) and p.name in ("h1", "h2") for p in node.parts)):
        return True
    if in_article and not page:
        return node.name in _CONTAINERS and (node.ident in _COMMENT_IDS or any(_FURNITURE.fullmatch(t) for t in node.roles))
    return bool(node.mark) and node.name not in ("html", "body", "main") and bool(_NOT_MAIN.search(node.mark))


def _outermost(root: Node, wanted) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is not root and wanted(node):
            out.append(node)
        else:
            stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not is_other(p, False)]
    return out


def main_roots(root: Node, roles: bool = True) -> list[Node]:
    """The outermost articles that are not marked otherwise; else the main elements; else, and without roles, the page."""
    if not roles:
        return [root]
    return _outermost(root, lambda n: n.name == "article") or _outermost(root, lambda n: n.name == "main" or "main" in n.mark.split()) or [root]


def subtree_hashes(root: Node) -> dict[int, int]:
    """By identity of each element: a signed 64-bit hash of its name, marks, text and children."""
    order, stack, known = [], [root], {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    for node in reversed(order):  # children before their parents
        h = xxhash.xxh64(f"{node.name}|{node.mark}")
        for part in node.parts:
            h.update(known[id(part)].to_bytes(8, "little", signed=True) if isinstance(part, Node) else " ".join(part.split()).encode())
        value = h.intdigest()
        known[id(node)] = value - 2**64 if value >= 2**63 else value
    return known


#: Elements that can be template. Articles quote one another, so that a single block needs a larger share of the host's articles than a container.
_CONTAINERS = frozenset("div section ul ol dl table figure details center".split())
_BLOCKS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr blockquote pre address header".split())
#: Every page has the first two; cells say by chance what others do.
_UNCOUNTED = frozenset("html body td th".split())
#: Words that a subtree of the article must have to be counted; less, such as "Yes" or a heading "References", articles have in common by chance.
LEAST_WORDS = 3


def _word_counts(root: Node) -> dict[int, int]:
    """By identity of each element: the words of its text."""
    order, stack, counts = [], [root], {}
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    for node in reversed(order):
        counts[id(node)] = sum(counts[id(p)] if isinstance(p, Node) else len(p.split()) for p in node.parts)
    return counts


@dataclass(frozen=True)
class Element:
    """An element as it is counted: its place is a hash of the names and classes down to it, own are its words outside inner containers."""

    node: Node
    is_block: bool
    place: int
    depth: int
    words: int
    own: int


def _signed(h: xxhash.xxh64) -> int:
    return h.intdigest() - 2**63


@lru_cache(maxsize=100_000)
def _place(outer: int, name: str, roles: tuple[str, ...]) -> int:
    shape = " ".join(sorted(t for t in roles if not any(c.isdigit() for c in t)))
    return _signed(xxhash.xxh64(f"{outer}|{name}|{shape}"))


def elements(root: Node, least_words: int = LEAST_WORDS) -> list[Element]:
    """The page itself, and its containers and single blocks of so many words or more, in page order.

    Ids and classes with digits belong to a page more often than to a template,
    so they are no part of a place, nor are inline elements. The page as a whole has depth 0.
    """
    words = _word_counts(root)
    found, stack = [], [(root, 0, 0)]
    while stack:
        node, place, depth = stack.pop()
        inner = [p for p in node.parts if isinstance(p, Node) and words[id(p)] and p.name != "head"]
        is_block = node.name in _BLOCKS
        if depth == 0 or (node.name not in _UNCOUNTED and (is_block or not node.inline()) and words[id(node)] >= least_words):
            own = words[id(node)] - sum(words[id(p)] for p in inner if not p.inline() and p.name not in _BLOCKS)
            found.append(Element(node, is_block, place, depth, words[id(node)], own))
        stack += [(p, place if p.name in _INLINE else _place(place, p.name, p.roles), depth + 1) for p in reversed(inner)]
    return found


def keys(root: Node) -> dict[int, int]:
    """By identity of each counted element below the page the hash by which it is counted; containers and blocks apart."""
    known = subtree_hashes(root)
    return {id(e.node): known[id(e.node)] ^ e.is_block for e in elements(root) if e.depth}


def without(root: Node, dropped: set[int]) -> set[int]:
    """Cut the elements with the dropped keys out of the tree; their identities."""
    cut = {node for node, key in keys(root).items() if key in dropped}
    stack = [root] if cut else []
    while stack:
        node = stack.pop()
        for k, part in enumerate(node.parts):
            if isinstance(part, Node):
                if id(part) in cut:
                    node.parts[k] = Node("#gap")
                else:
                    stack.append(part)
    return cut


def at_place(root: Node, place: int | None) -> list[Node]:
    """The elements that stand at a place, in page order, however short."""
    return [] if place is None else [e.node for e in elements(root, 1) if e.place == place and e.depth and not e.is_block]


def text_size(node: Node) -> int:
    """The characters of the element's text, white space left out."""
    size, stack = 0, [node]
    while stack:
        node = stack.pop()
        for part in node.parts:
            if isinstance(part, Node):
                if part.name != "head":
                    stack.append(part)
            else:
                size += sum(map(len, html.unescape(part).split()))
    return size


def block_texts(mains: list[Node], roles: bool = True) -> list[str]:
    """The blocks below the main elements in page order, references decoded and white space made single."""
    blocks, run = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    page = bool(mains) and mains[0].name == "#root"
    stack: list = list(reversed(mains))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            run.append(part)
        elif part is None:
            flush()
        elif is_other(part, True, page, roles) and not any(part is m for m in mains):
            flush()
        else:
            if not part.inline():
                flush()
                stack.append(None)
            stack += reversed(part.parts)
    flush()
    return blocks


def host_of(url: str) -> Column:
    """The host in the URL, small letters, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_ELEMENT = ("subtree", "parent", "is_block", "place", "depth", "words", "own")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, elements: what each page has to be counted."""
    for batch in batches:
        offsets, columns = [0], [[] for _ in _ELEMENT]
        for text in batch.column("html").to_pylist():
            root = parse(text)
            known = subtree_hashes(root)
            for e in elements(root):
                # what stands alone in its element is counted by the next one out, or copies of it would look alike
                parent = e.node.parent or e.node
                row = (known[id(e.node)] ^ e.is_block, known[id(parent)], e.is_block, e.place, e.depth, e.words, e.own)
                for column, value in zip(columns, row):
                    column.append(value)
            offsets.append(len(columns[0]))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _ELEMENT)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)], ["host", "elements"])


def _extract(roles: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counted, marked = [], [], []
            for page, place, dropped in zip(*(batch.column(c).to_pylist() for c in ("html", "place", "dropped"))):
                root = parse(page)
                whole = text_size(root)
                mains = at_place(root, place)
                gone = without(root, set(dropped)) if dropped else set()
                left = [m for m in mains if id(m) not in gone]
                cut = whole - (sum(map(text_size, left)) if mains else text_size(root))
                blocks = block_texts(left if mains else main_roots(root, roles), roles)
                marked.append(whole - cut - sum(len(w) for b in blocks for w in b.split()))
                counted.append(cut)
                texts.append(" ".join(blocks))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counted, pa.int64()), pa.array(marked, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "cut_by_counts", "cut_by_roles"])

    return run


#: Keys over which a host's pages are dealt, as one host may have a large part of them.
SALTS = 64
#: Of the words at a place, so many stand outside inner containers where an article's headings and paragraphs do.
LEAST_OWN = 0.01


def article_places(found: DataFrame, main_share: float) -> DataFrame:
    """host, place, articles: where a host's articles stand, and how many different ones there do.

    The places that hold main_share of the host's words or more, each different
    text counted once, lie one in the other. The outermost that has words of its
    own is it (inside, a heading would be lost), or else the innermost. Hosts
    without such a place have a null, and all their different pages as articles.
    """
    texts = found.where("not is_block").groupBy("host", "place", "depth", "subtree").agg(F.first("words").alias("words"), F.first("own").alias("own"))
    places = texts.groupBy("host", "place", "depth").agg(F.sum("words").alias("words"), F.sum("own").alias("own"), F.count("*").alias("articles"))
    # written, so that the join has an exchange of its own on each side
    places = stash(places, "html-places")
    whole = places.where("depth = 0").select("host", F.col("words").alias("of"))
    chain = places.join(whole, "host").where((F.col("depth") == 0) | (F.col("words") >= main_share * F.col("of")))
    here = F.struct(F.when(F.col("depth") > 0, F.col("place")).alias("place"), "articles")
    owns = (F.col("depth") > 0) & (F.col("own") >= LEAST_OWN * F.col("words"))
    first = F.min_by(F.when(owns, here), F.when(owns, F.col("depth")))
    return chain.groupBy("host").agg(F.coalesce(first, F.max_by(here, "depth")).alias("at")).select("host", "at.*")


def extract_text(pages: DataFrame, main_share: float = 0.5, least_pages: int = 10, container_share: float = 0.3, block_share: float = 0.9, roles: bool = True) -> DataFrame:
    """page_id, url, text (the main text, empty if none), cut_by_counts, cut_by_roles for each row of pages.

    A host's articles stand where main_share of its different words are
    (article_places); on its pages all that is elsewhere goes. There, an
    element is template as well if its subtree stands in at least
    least_pages different articles (told apart by what it stands in) and in a
    share of container_share of the host's for a container, of block_share for a
    single block such as a paragraph, as articles quote one another. Inline
    elements, and those of under LEAST_WORDS words, are not judged. Copies of one
    article count once, so that a page that is repeated keeps its text. The
    shares bound a host's templates by a number of pages' elements.

    On pages that have nothing at that place, roles and class words find the
    article; everywhere they take out what stands in it besides its text (menus,
    adverts, forms, comments). With roles false only elements without readable
    text go, and pages without the place stay whole. The last two columns are
    the characters of text, white space left out, that each of the two took.

    Null pages are empty. A null or strange URL has the empty host. Rows that
    repeat a page_id give a row each; extra columns are ignored; an empty table
    gives an empty one. A page takes time in proportion to its length, broken
    markup included; only elements nested very deep cost more.
    """
    small_batches(pages.sparkSession, 500)
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    hosted = rows.select(F.xxhash64(host_of("url")).alias("host"), "html")
    element = "struct<subtree:long,parent:long,is_block:boolean,place:long,depth:int,words:long,own:long>"
    found = stash(hosted.mapInArrow(_counted, f"host long, elements array<{element}>"), "html-elements")
    found = found.select("host", F.explode("elements").alias("e")).select("host", "e.*")
    places = stash(article_places(found, main_share), "html-main")

    # an element by what it stands in, first: copies of an article are one
    stands = found.where("depth > 0").groupBy("host", "subtree", "is_block", "parent").agg(F.lit(1).alias("n"))
    often = stands.groupBy("host", "subtree", "is_block").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    share = F.when(F.col("is_block"), block_share).otherwise(container_share)
    recurring = often.join(places.select("host", "articles"), "host").where(F.col("n") >= share * F.col("articles"))
    dropped = recurring.groupBy("host").agg(F.collect_set("subtree").alias("dropped"))
    known = places.select("host", "place").join(dropped, "host", "left")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # written, so that the join has an exchange of its own on each side, which Spark can split
    known = stash(known, "html-templates")
    dealt = [F.xxhash64(host_of("url")).alias("host"), F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int").alias("salt")]
    # not broadcast, as hosts grow with the pages
    joined = rows.select("*", *dealt).join(known.hint("merge"), ["host", "salt"], "left").select("page_id", "url", "html", "place", "dropped")
    return joined.mapInArrow(_extract(roles), "page_id long, url string, text string, cut_by_counts long, cut_by_roles long")
