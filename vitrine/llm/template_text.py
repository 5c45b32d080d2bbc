"""Main text of web pages by equivalence classes of template tokens.

Plan
----
1. A map-only pass parses every page into tokens: a tag token is an element with
   its path of enclosing elements (names, classes, ids), a text token is a block of
   text with the path it stands in. Tasks add up, per host and token, the number of
   pages and the occurrence vector: the sum over pages of a hash of (page, how often
   the token occurs there), so equal sums are equal vectors and sums of tasks add up
   to the whole host's, however many pages it has. No page is shuffled.
2. Tokens of one host with equal vectors are one equivalence class. A class is valid
   if it holds a tag token and enough different pages have it (``LEAST_PAGES``; and all
   of the host's pages, or half of them for pages without a marked article). As tag
   tokens carry their path, a token lies on every page and within every element of
   the classes above it: valid classes nest into the host's template, the element tree.
3. Text tokens of valid classes are template text. Slots (elements with text of
   their own) that are mostly links all over the host are menus.
4. A second map-only pass parses the pages again with their host's template, sent
   along as one thin row per host (broadcast when its measured size is below
   ``BROADCAST_BYTES``, otherwise an ordinary join that adaptive execution may split),
   and keeps the text of the slots that remain: those of the article element if the
   page has one, else of the main element, else all; without template text, menus
   and the elements whose name, role, class or id says what they are
   (:data:`OUT_TAGS`, :data:`OUT_ROLES`, :data:`OUT_WORDS`).

In a task, text of marked articles stays a candidate only while every page of the
host has it there, since only such text can be in all of the host's pages.

Cases: null html is empty and gives empty text; bytes that are not UTF-8 are replaced;
a page of a host with fewer than ``LEAST_PAGES`` different pages, or with no host in its
url, has no template to remove (copies of one page are one); pages of any length are
parsed whole; an unclosed comment or script ends with the page, an unmatched quote in
a tag with the next ">";
repeated rows each give a row; null ids and urls pass through; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common as C

LEAST_PAGES = 8
SHARE = 0.5  # of a host's pages, for pages without a marked article
LINKED = 0.5  # of a slot's characters
BROADCAST_BYTES = 32 << 20
HELD = 200_000  # tokens a task adds up before it sends them on

# fixed values: what elements, roles and words of classes and ids stand for
OUT_TAGS = frozenset("""head title nav footer aside form script style noscript template iframe object embed applet svg math
    canvas audio video select option datalist button textarea input menu dialog noframes noembed xmp map""".split())
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes xmp".split())
OUT_ROLES = frozenset("""navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar
    toolbar tooltip status""".split())
OUT_WORDS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts
    advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related
    recommended recommendations comment comments disqus reply replies respond discussion pagination pager skip toolbar
    search copyright tagcloud""".split())
PAGE_HEAD = frozenset("header masthead".split())  # of a page; an article's own header belongs to it
COMMENT_WORDS = frozenset("comment comments reply replies discussion disqus".split())
NOT_OUT = frozenset("has with no without".split())  # "has-sidebar" says what a wrapper holds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby
    s samp small span strike strong sub sup time tt u var wbr""".split())
# an opening element closes these, up to the elements that hold it
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
          "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
          "thead": ("thead tbody tfoot tr td th", ("table",)), "tbody": ("thead tbody tfoot tr td th", ("table",)),
          "tfoot": ("thead tbody tfoot tr td th", ("table",)), "option": ("option", ("select", "datalist"))}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]{0,5000}"|'[^']{0,5000}')*+(?=>)|[^>]*)(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TELLING = re.compile(r"\b(?:class|id|role|hidden|style|itemprop|aria-hidden)\b", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TAGS}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBER = re.compile(r"\d+")
MASK = (1 << 60) - 1
ARTICLE, MAIN = 2, 1


class Kind:
    """What a start tag says: its share of the path, and what it stands for."""

    __slots__ = ("name", "code", "out", "head", "level", "comment")

    def __init__(self, tag: str, attributes: str) -> None:
        found: dict[str, str] = {}
        hidden = False
        if attributes and TELLING.search(attributes):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            bare = ATTRIBUTE.sub(" ", attributes).lower().split()
            style = found.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in bare or "hidden" in found or found.get("aria-hidden", "").lower() == "true" \
                or "display:none" in style or "visibility:hidden" in style
        names = " ".join(sorted(f"{found.get('class', '')} {found.get('id', '')}".split()))
        role, prop = found.get("role", "").lower(), found.get("itemprop", "")
        words = {w.lower() for w in WORD.findall(names)}
        said = set() if words & NOT_OUT else words
        self.name = f"{tag}[{NUMBER.sub('0', names)}]" if names else tag
        self.code = xxhash.xxh64_intdigest(self.name.encode("utf-8", "replace"))
        self.comment = bool(said & COMMENT_WORDS)
        self.level = ARTICLE if tag == "article" or role == "article" or prop == "articleBody" \
            else MAIN if tag == "main" or role == "main" else 0
        whole = tag in ("html", "body") or self.level > 0
        self.out = tag in OUT_TAGS or role in OUT_ROLES or hidden or self.comment and tag not in ("html", "body") \
            or not whole and bool(said & OUT_WORDS)
        self.head = not whole and (tag == "header" or bool(said & PAGE_HEAD))


_KINDS: dict[tuple[str, str], Kind] = {}


def kind_of(tag: str, attributes: str) -> Kind:
    if attributes and not TELLING.search(attributes):
        attributes = ""
    kind = _KINDS.get((tag, attributes))
    if kind is None:
        if len(_KINDS) > 50_000:
            _KINDS.clear()
        kind = _KINDS[tag, attributes] = Kind(tag, attributes)
    return kind


class Element:
    __slots__ = ("tag", "path", "out", "level", "link", "name")

    def __init__(self, tag: str, path: int, out: bool, level: int, link: bool, name: str) -> None:
        self.tag, self.path, self.out, self.level, self.link, self.name = tag, path, out, level, link, name


class Block:
    """A run of text between the edges of blocks: its slot and what it says."""

    __slots__ = ("slot", "level", "text", "linked")

    def __init__(self, slot: int, level: int, text: str, linked: int) -> None:
        self.slot, self.level, self.text, self.linked = slot, level, text, linked

    @property
    def token(self) -> int:
        return (xxhash.xxh64_intdigest(self.text.encode("utf-8", "surrogatepass")) ^ self.slot * 0x9E3779B1) & MASK


class Page:
    """Elements (path, name, how often) and the blocks of text that are not
    marked as something else than main text."""

    def __init__(self, source: str) -> None:
        self.paths: Counter[int] = Counter()
        self.names: dict[int, str] = {}
        self.blocks: list[Block] = []
        self.level = 0
        self._stack = [Element("", 1, False, 0, False, "")]
        self._held: list[str] = []
        self._slot: Element | None = None
        self._linked = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self._text(source[at:stop])
            if m is None:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW_TAGS:
                last = RAW_END[tag].search(source, at)
                at = last.start() if last else end
        self._edge()

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if top.out:
            return
        text = references.unescape(raw) if "&" in raw else raw
        if self._slot is None and not text.isspace():
            # the slot of a block: the innermost element around it that is no inline one
            self._slot = next(e for e in reversed(self._stack) if e.tag not in INLINE)
            self._level = top.level
        self._held.append(text)
        if top.link:
            self._linked += len(text)

    def _edge(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                self.blocks.append(Block(self._slot.path, self._level, text, min(self._linked, len(text))))
            self._held, self._slot, self._linked = [], None, 0

    def _pop(self, depth: int) -> None:
        del self._stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag not in INLINE:
            self._edge()
            if tag == "br":
                return
            if tag in CLOSES:
                closed, holders = CLOSES[tag]
                self._close_open(closed.split(), holders)
            self._close_open(("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag[:1] == "h" and tag[1:].isdigit() or tag == "p"
                             else ("p",), ("td", "th", "li", "dd", "div", "section", "article", "blockquote", "body",
                                           "main", "aside", "nav", "header", "footer", "form", "figure", "button", "object"))
        kind = kind_of(tag, attributes)
        above = stack[-1]
        path = ((above.path * 0x9E3779B97F4A7C15 ^ kind.code) * 0xBF58476D1CE4E5B9 >> 3) & MASK
        self.paths[path] += 1
        if path not in self.names:
            self.names[path] = f"{above.name}/{kind.name}"[-400:]
        if tag in VOID:
            return
        level = max(above.level, kind.level)
        out = above.out or kind.out or kind.head and not above.level
        if above.out and kind.level == ARTICLE and not kind.out and above.tag in ("form", "html", "body"):
            out = False  # a form around the whole page
        if kind.level and not out:
            self.level = max(self.level, kind.level)
        stack.append(Element(tag, path, out, level, above.link or tag == "a", self.names[path]))

    def _close_open(self, tags, holders) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[depth].tag
            if tag in tags:
                self._pop(depth)
                return
            if tag in holders:
                return

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._edge()
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].tag == tag:
                self._pop(depth)
                return
            if tag in INLINE and self._stack[depth].tag not in INLINE:
                return

    def main(self) -> list[Block]:
        return [b for b in self.blocks if b.level >= self.level]


def decode(body: bytes) -> str:
    return body.decode("utf-8", "replace")


# --- occurrence vectors ------------------------------------------------------------

TAG, COMMON, TEXT, CONTENT = 0, 1, 2, 3  # COMMON: text of marked articles, TEXT: of other pages
COUNTED = ("host string, kind int, token bigint, pages bigint, vector bigint, chars bigint, linked bigint, name string")
COUNTED_SCHEMA = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("token", pa.int64()), ("pages", pa.int64()),
                            ("vector", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("name", pa.string())])


def occurrence(content: int, count: int) -> int:
    """Hash of (page, number of occurrences); sums of it stand for vectors."""
    x = (content ^ count * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 31) & MASK


class Counts:
    """Sums per host and token of the pages of one task."""

    def __init__(self) -> None:
        self.tokens: dict[tuple, list] = {}  # (host, kind, token): pages, vector, chars, linked, name
        self.common: dict[str, dict[int, list]] = {}  # text that every page of the host has had
        self.n_common = 0

    def add(self, host: str, body: bytes) -> None:
        page = Page(decode(body))
        content = xxhash.xxh64_intdigest(body)
        sign: dict[int, int] = {}

        def of(count: int) -> int:
            if count not in sign:
                sign[count] = occurrence(content, count)
            return sign[count]

        def count(kind: int, token: int, n: int, chars: int = 0, linked: int = 0, name: str | None = None) -> None:
            have = self.tokens.get((host, kind, token))
            if have is None:
                self.tokens[host, kind, token] = [1, of(n), chars, linked, name]
            else:
                have[0] += 1
                have[1] = (have[1] + of(n)) & MASK
                have[2] += chars
                have[3] += linked
        chars: Counter[int] = Counter()
        linked: Counter[int] = Counter()
        blocks = page.main()
        for b in blocks:
            chars[b.slot] += len(b.text)
            linked[b.slot] += b.linked
        for path, n in page.paths.items():
            count(TAG, path, n, chars[path], linked[path], page.names[path])
        texts = Counter(b.token for b in blocks)
        if page.level:
            old = self.common.get(host)
            new = {t: [1, of(n)] for t, n in texts.items()} if old is None else {
                t: [old[t][0] + 1, (old[t][1] + of(n)) & MASK] for t, n in texts.items() if t in old}
            self.n_common += len(new) - len(old or ())
            self.common[host] = new
        else:
            for t, n in texts.items():
                count(TEXT, t, n)
        count(CONTENT, content & MASK, 1)

    def batch(self) -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in self.tokens.items()]
        rows += [(host, COMMON, t, *v, 0, 0, None) for host, texts in self.common.items() for t, v in texts.items()]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), COUNTED_SCHEMA)],
                                          schema=COUNTED_SCHEMA)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        for host, body in zip(batch.column("host"), batch.column("body")):
            counts.add(host.as_py(), body.as_py())
            if len(counts.tokens) + counts.n_common > HELD:
                yield counts.batch()
    if counts.tokens:
        yield counts.batch()


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, body): the host of the url in lower case, or ''."""
    host = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")),
                            r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    return pages.select("page_id", "url", F.lower(host).alias("host"), C.text_bytes("html").alias("body"))


def template_tokens(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """The tokens of valid classes: (host, kind, token, pages, class_id, class_size,
    share_linked, name), class_id being the occurrence vector. Tag tokens come with
    their path in ``name``: the host's template is the tree of these paths."""
    whole = F.lit(1 << 60).cast("decimal(38,0)")
    vector = (F.sum(F.col("vector").cast("decimal(38,0)")) % whole).cast("bigint")
    counted = C.through_table(
        with_host(pages).where("host != ''").select("host", "body").mapInArrow(_count, COUNTED).groupBy(
            "host", "kind", "token").agg(F.sum("pages").alias("pages"), vector.alias("vector"), F.sum("chars").alias("chars"),
                                         F.sum("linked").alias("linked"), F.min("name").alias("name")), "tokens")
    hosts = counted.where(F.col("kind") == CONTENT).groupBy("host").agg(
        F.count("*").alias("contents"), F.sum("pages").alias("host_pages")).where(F.col("contents") >= least)
    enough = F.when(F.col("kind") == COMMON, F.col("host_pages")).otherwise(F.ceil(F.col("host_pages") * SHARE))
    frequent = counted.where(F.col("kind") != CONTENT).join(hosts, "host").where(
        (F.col("pages") >= enough) & (F.col("pages") >= least))
    classes = frequent.groupBy("host", "vector", "pages").agg(
        F.count("*").alias("class_size"), F.max(F.col("kind") == TAG).alias("valid")).where("valid").drop("valid")
    share = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars"))
    return frequent.join(classes, ["host", "vector", "pages"]).select(
        "host", "kind", "token", "pages", F.col("vector").alias("class_id"), "class_size", share.alias("share_linked"), "name")


def templates(tokens: DataFrame) -> DataFrame:
    """One thin row per host: its template text and its slots that are menus. Each
    lies on at least half of the host's pages, so both lists are as short as a page."""
    text = F.col("kind") != TAG
    menu = (F.col("kind") == TAG) & (F.col("share_linked") > LINKED)
    return tokens.where(text | menu).groupBy("host").agg(
        F.collect_set(F.when(text, F.col("token"))).alias("texts"), F.collect_set(F.when(menu, F.col("token"))).alias("menus"))


def main_text(body: bytes, texts: set[int], menus: set[int]) -> str:
    page = Page(decode(body))
    return " ".join(b.text for b in page.main() if (page.level or b.slot not in menus)
                    and not (texts and b.token in texts))


def _extract():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.by_bytes([batch], "body", 1 << 24):
                out = []
                known: dict[str, tuple[set, set]] = {}
                for host, body, texts, menus in zip(*(part.column(c) for c in ("host", "body", "texts", "menus"))):
                    name = host.as_py()
                    if name not in known:
                        known[name] = set(texts.as_py() or ()), set(menus.as_py() or ())
                    out.append(main_text(body.as_py(), *known[name]))
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), part.column("url"), pa.array(out, pa.string()),
                    pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, least: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = C.through_table(templates(template_tokens(pages, least)), "templates")
    size = found.agg(F.sum(F.octet_length("host") + 8 * (F.size("texts") + F.size("menus")) + 64)).first()[0] or 0
    rows = with_host(pages)
    joined = rows.join(F.broadcast(found) if size <= broadcast_bytes else found, "host", "left")
    kinds = dict(rows.dtypes)
    return joined.select("page_id", "url", "host", "body", "texts", "menus").mapInArrow(
        _extract(), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op13_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(C.read_table(spark, sf_dir, "pages"))
