"""Operator 2: main text of web pages by template deduction.

Pages of a host are made by few programs. Tokens of a page are its elements (by their path, classes and ids included)
and its blocks of text. Tokens that occur equally often in each page of a host share an occurrence vector and form an
equivalence class. Classes that a few distinct pages have, however large the host, and whose tokens keep their order and
nest, make up the host's template: so each of a host's layouts has its own classes. A token that moves within its class,
or between the slots of a class of more pages that its own crosses, is left out. What the template's text says is the
frame of the site; what fills its slots is extracted.

An occurrence vector is a fingerprint: the XOR over the distinct pages of a hash of page and count. It is combined in
the tasks before the shuffle, so a host with a third of all pages is a row per token and task. Places of tokens are
combined alike. Pages of such hosts are dealt by host and salt, and meet a copy of their classes and template there.

Near copies of a page (print views, tracked links, counters) share all but little of their text. A class that fewer than
half of a host's pages have is no template if its pages hold at least three times as much text of such classes as text
that is theirs alone: those are copies, and their common text is the article.

Slots of menus, headers, footers, sidebars, notices, adverts, forms and comments are told by the tag or a whole name of
an element; one word of a name counts only outside of articles and for an element of the template, and what holds the
article or most of the text is no frame for being a form or a widget. Among the other
slots, the article's are those with an article or a main element, all of them; else a name that says content; else all
that is left. Nothing else is dropped, linked blocks included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import key_type, table
from faultline.llm.html_blocks import Block, Element, Page, read
from faultline.sources.shared import materialise

#: Distinct pages that have a template's token, at least.
LEAST = 3
#: Pages of a host that one task takes, about.
DEALT = 2_000
#: Hosts whose templates a task keeps.
HOSTS = 200

_FRAME_TAGS = frozenset("head nav footer aside form dialog menu select button fieldset noscript svg math template object audio video canvas map datalist".split())
_FRAME_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement advertising advertorial "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup social share sharing sharebar breadcrumb breadcrumbs related recommended "
    "recommendations comment comments respond disqus replies widget widgets toolbar pagination pager masthead login "
    "search searchform form copyright contentinfo complementary alert skip topbar".split()
)
#: Words of a place that a whole name of a frame may hold besides.
_PLACE_WORDS = frozenset("site page main top bottom left right primary secondary global container wrapper wrap box bar area block list links posts section".split())
#: Inside an article these are names of its own parts as well.
_OWN_WORDS = frozenset("header alert form notice notices search social notification login".split())
#: Around an article, only these make it something else than the article.
_COMMENT_WORDS = frozenset("comment comments respond disqus replies related recommended sidebar ad ads advert".split())
#: Names of an element that holds the article or more than half of a page's text say nothing.
_HOLDER_WORDS = frozenset("form widget widgets".split())
#: Whole names inside an article that may be its own; the host's template tells, and a title inside.
_TWO_SENSES = frozenset(map(frozenset, (("cookies",), ("banner",), ("menu",))))
_CONTENT_WORDS = frozenset("article post entry story content main text body".split())
_MAIN_NAMES = frozenset(map(frozenset, (("main",), ("main", "content"), ("main", "text"), ("main", "article"))))


def _says(e: Element, words: frozenset[str], but: frozenset[frozenset[str]] = frozenset()) -> bool:
    """A whole name of the element, not one word of it, says one of the words; words of frames may stand beside it."""
    return any(w & words and w <= words | _OWN_WORDS | _PLACE_WORDS for w in e.whole if w not in but)


def _is_home(e: Element) -> bool:
    """An article or a main element."""
    if e.tag == "article" and not _says(e, _COMMENT_WORDS) or e.tag == "main":
        return True
    return e.tag != "body" and not _MAIN_NAMES.isdisjoint(e.whole)


def _is_frame(e: Element, inside: bool, wide: bool, titled: bool, given: Callable[[Element], bool]) -> bool:
    """Its tag or a whole name marks a frame; outside of articles, also a word of the name of a template's element.

    `wide`: it holds an article or more than half of the page's text; `titled`: it holds a first heading.
    """
    if e.hidden or e.tag in _FRAME_TAGS and not (wide and e.tag == "form"):
        return True
    if e.tag in ("html", "body", "article", "main"):
        return e.tag == "article" and _says(e, _COMMENT_WORDS)
    if inside:
        own = frozenset() if given(e) and not titled else _TWO_SENSES
        return _says(e, _FRAME_WORDS - _OWN_WORDS, own)
    words = _FRAME_WORDS - _HOLDER_WORDS if wide else _FRAME_WORDS
    return e.tag == "header" or _says(e, words) or bool(e.words & words) and given(e)


def _holders(page: Page) -> tuple[list[bool], list[bool]]:
    """By number of an element: whether it holds an article or more than half of the text, and a first heading."""
    size = [0] * len(page.elements)
    titled = [e.tag == "h1" for e in page.elements]
    holds = [False] * len(page.elements)
    for b in page.blocks:
        if b.inside:
            size[b.inside.number] += len(b.text)
    for e in reversed(page.elements):
        if e.parent:
            up = e.parent.number
            size[up] += size[e.number]
            titled[up] = titled[up] or titled[e.number]
            holds[up] = holds[up] or holds[e.number] or _is_home(e)
    half = sum(len(b.text) for b in page.blocks) / 2
    return [h or n > half for h, n in zip(holds, size)], titled


def _states(page: Page, given: Callable[[Element], bool]) -> tuple[list[Element | None], list[bool]]:
    """By number of an element: the outermost article or main element around it, and whether it lies in a frame."""
    home: list[Element | None] = []
    frame: list[bool] = []
    wide, titled = _holders(page)
    around: list[bool] = []  # the same, should an article follow inside: a wrapper's name says little there, its tag does
    for e in page.elements:
        up = e.parent.number if e.parent else -1
        of, framed, wrapped = (home[up], frame[up], around[up]) if e.parent else (None, False, False)
        if of:
            framed = framed or _is_frame(e, True, False, titled[e.number], given)
        elif _is_home(e):
            of, framed = e, wrapped
        else:
            framed = framed or _is_frame(e, False, wide[e.number], titled[e.number], given)
            wrapped = wrapped or e.hidden or e.tag in _FRAME_TAGS and e.tag != "form" or e.tag not in ("html", "body") and _says(e, _COMMENT_WORDS)
        home.append(of)
        frame.append(framed)
        around.append(wrapped)
    return home, frame


def block_token(block: Block) -> int:
    """A block of text at its place, an even number; the same text elsewhere is another token."""
    return xxhash.xxh3_64_intdigest(f"{block.inside.path if block.inside else 0:x}\n{block.text}") >> 1 & ~1


def path_token(path: int) -> int:
    """An element, an odd number."""
    return path >> 1 | 1


def sequence(page: Page) -> list[int]:
    """Tokens of a page in the order of the page: elements where they open, and blocks."""
    return [path_token(x) if isinstance(x, int) else block_token(x) for x in page.order]


def main_text(page: Page, template: frozenset[int]) -> str:
    """The blocks in the article's slots, joined by line feeds; text of the host's template is left out."""

    def given(e: Element) -> bool:
        """The element is the template's."""
        return path_token(e.path) in template

    blocks = [b for b in page.blocks if block_token(b) not in template] if template else page.blocks
    home, frame = _states(page, given)
    open_ = [b for b in blocks if not b.inside or not frame[b.inside.number]]
    # All articles and main elements, with all that they hold.
    if found := [b for b in open_ if b.inside and home[b.inside.number]]:
        return "\n".join(b.text for b in found)
    # No element says that it is the article: the slots with a name that says content, else all.
    slot, content = [-1], [False]  # by number and one: the nearest element of the template, and a name that says content
    for e in page.elements:
        up = e.parent.number + 1 if e.parent else 0
        slot.append(e.number if given(e) else slot[up])
        content.append(content[up] or bool(e.words & _CONTENT_WORDS) and e.tag != "body")
    places_ = [b.inside.number + 1 if b.inside else 0 for b in open_]
    some = any(content[p] for p in places_)
    chosen = {slot[p] for p in places_ if content[p] and slot[p] >= 0}
    return "\n".join(b.text for b, p in zip(open_, places_) if content[p] or slot[p] in chosen or not some)


def _rows(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """(key, host, source): the host of an address, in lower case and without its port; "" for none."""
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("text"),
        host.alias("host"),
        F.col(f"`{url}`").alias("url"),
    )


def _parsed(rows: DataFrame) -> DataFrame:
    """(host, page, sequence, sizes): the tokens of each distinct page of a host in page order and the characters of its
    blocks, 0 for elements; copies are one page."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("sequence", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found, sizes = [], [], []
            for source in batch.column(1):
                text = source.as_py()
                numbers.append(xxhash.xxh3_64_intdigest(text) >> 1)
                page = read(text)
                found.append(sequence(page))
                sizes.append([0 if isinstance(x, int) else len(x.text) for x in page.order])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), *(pa.array(c, f.type) for c, f in zip((numbers, found, sizes), list(schema)[1:]))], schema=schema
            )

    return rows.select("host", "text").mapInArrow(parsed, "host string, page long, sequence array<long>, sizes array<int>").dropDuplicates(["host", "page"])


def _classes(seen: DataFrame) -> DataFrame:
    """(host, class, pages, token): tokens that LEAST pages have equally often, of classes with an element and more."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(s.values.to_numpy(), return_counts=True) for s in batch.column(2)]
            sizes = [len(t) for t, _ in each]
            if sum(sizes):
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows).cast(pa.string()), batch.column(1).take(rows),
                        pa.array(np.concatenate([t for t, _ in each]), pa.int64()),
                        pa.array(np.concatenate([n for _, n in each]), pa.int64()),
                    ],
                    schema=schema,
                )

    vectors = seen.mapInArrow(counted, "host string, page long, token long, n long").groupBy("host", "token").agg(
        F.expr("bit_xor(xxhash64(page, n))").alias("class"), F.count(F.lit(1)).alias("pages")
    )
    common = materialise(vectors.filter(F.col("pages") >= LEAST), "vectors")
    return _with_element(common, 2)


def _with_element(tokens_: DataFrame, least: int) -> DataFrame:
    """Classes of `least` tokens that hold an element: text that comes and goes with none is no part of a template."""
    one = tokens_.groupBy("host", "class", "pages").agg(F.collect_list("token").alias("tokens"))
    held = one.filter((F.size("tokens") >= least) & F.exists("tokens", lambda t: F.pmod(t, F.lit(2)) == 1))
    return held.select("host", "class", "pages", F.explode("tokens").alias("token"))


def places(found: list[int], classes: dict[int, int], pages: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(token, class, place) on a page: a token's place in its own class, and in a class of more pages that its own
    crosses here, that is, whose occurrences neither lie between two of its tokens nor the other way round.

    A class repeats its tokens in one order, so a place is the number of the class's tokens before, modulo its size.
    """
    known = [(t, classes[t]) for t in found if t in classes]
    size = Counter(c for c in map(classes.get, {t for t, _ in known}))
    before: Counter[int] = Counter()
    begun: dict[int, None] = {}  # classes within an occurrence, the last one begun at the end
    crossed: dict[int, set[int]] = {}
    for t, c in known:
        at = before[c] % size[c]
        before[c] += 1
        yield t, c, at
        if size[c] > 1:
            for d in reversed(begun) if at else ():
                if d == c:
                    break
                weak, strong = sorted((c, d), key=lambda x: (pages[x], x))
                crossed.setdefault(weak, set()).add(strong)
            if not at:
                begun[c] = None
            elif at == size[c] - 1:
                del begun[c]
    if crossed:
        before.clear()
        for t, c in known:
            for d in crossed.get(c, ()):
                yield t, d, before[d] % size[d]
            before[c] += 1


def _shares(found: list[int], sizes: list[int], classes: dict[int, int], minor: set[int]) -> tuple[int, int, set[int]]:
    """Characters of a page that no class has, those that the `minor` classes have, and the minor classes on the page."""
    own, copied, on = 0, 0, set()
    for t, n in zip(found, sizes):
        c = classes.get(t)
        if c is None:
            own += n
        elif c in minor:
            copied += n
            on.add(c)
    return own, copied, on


def _dealt(rows: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """`rows` beside what was found for their host; rows of a large host are dealt out and meet copies of it."""
    copies = F.ceil(F.col("rows") / DEALT).cast("long")
    dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("rows")
    # The number of pages of a host is on the template's side, so each page first learns its host's number of salts. The
    # table of large hosts is small, one row for DEALT pages at most; Spark broadcasts it if its size allows, and splits
    # the pages of a large host if not.
    many = found.filter(copies > 1).select("host", copies.alias("copies"))
    salted = rows.join(many, "host", "left").withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("copies", F.lit(1))))
    return salted.drop("copies").join(dealt, ["host", "salt"])


def templates(rows: DataFrame) -> DataFrame:
    """(host, rows, template): the tokens of the host's valid equivalence classes.

    A class is valid if LEAST distinct pages have its tokens equally often, if it holds an element, and if its tokens
    keep their order and nest: those whose place is not the same on all pages, see `places`, go, and classes of near
    copies.
    """
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("rows"))
    seen = materialise(_parsed(rows), "sequences")
    classes = materialise(_classes(seen), "classes")
    sides = classes.groupBy("host").agg(F.collect_list(F.struct("token", "class", "pages")).alias("all"))
    distinct = seen.groupBy("host").agg(F.count(F.lit(1)).alias("distinct"))
    by_host = sides.join(distinct, "host").select("host", "distinct", *(F.col(f"all.{c}").alias(c) for c in ("token", "class", "pages")))
    schema = pa.schema([(c, pa.string() if c == "host" else pa.int64()) for c in ("host", "token", "of", "low", "high", "copied")])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[dict, dict]] = {}
        minor: dict[str, set[int]] = {}
        for batch in batches:
            ends: dict[tuple, list[int]] = {}
            shares: dict[tuple, list[int]] = {}
            for i, host in enumerate(batch.column(0).to_pylist()):
                if host not in kept:
                    if len(kept) >= HOSTS:
                        kept.clear()
                    t, c, n = (batch.column(k)[i].as_py() for k in (2, 3, 4))
                    kept[host] = dict(zip(t, c)), dict(zip(c, n))
                    pages = batch.column(5)[i].as_py()
                    minor[host] = {c for c, n in kept[host][1].items() if 2 * n < pages}
                found = batch.column(1)[i].as_py()
                own, copied, on = _shares(found, batch.column(6)[i].as_py(), kept[host][0], minor[host])
                for of in on:
                    share = shares.setdefault((host, None, of), [0, 0])
                    share[0] += own
                    share[1] += copied
                for token, of, at in places(found, *kept[host]):
                    end = ends.setdefault((host, token, of), [at, at])
                    if at < end[0]:
                        end[0] = at
                    elif at > end[1]:
                        end[1] = at
            out = [[*key, *end, None] for key, end in ends.items()]
            out += [[*key, own, None, copied] for key, (own, copied) in shares.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    beside = _dealt(seen, materialise(total.join(by_host, "host"), "sides"), "page").select("host", "sequence", "token", "class", "pages", "distinct", "sizes")
    ends = beside.mapInArrow(placed, "host string, token long, of long, low long, high long, copied long")
    # Rows without a token hold the text of a class's pages: their own, and that of classes of fewer than half of the pages.
    judged = materialise(
        ends.groupBy("host", "token", "of").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("low").alias("own"), F.sum("copied").alias("copied")
        ).filter("low < high OR token IS NULL AND 3 * own <= copied AND copied > 0"),
        "judged",
    )
    moved = judged.filter("token IS NOT NULL").select("host", "token").distinct()
    copies = judged.filter("token IS NULL").select("host", F.col("of").alias("class"))
    valid = _with_element(classes.join(moved, ["host", "token"], "left_anti").join(copies, ["host", "class"], "left_anti"), 2)
    template = valid.groupBy("host").agg(F.collect_list("token").alias("template"))
    return total.join(template, "host", "left").select(
        "host", "rows", F.coalesce("template", F.array().cast("array<long>")).alias("template")
    )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row: key, url, text.

    `text` is the article's blocks in page order, joined by line feeds; character references are decoded and white space
    within a block is one blank. Null and empty sources, and pages without an article, have an empty text. Pages without
    a host form one group. Repeated rows and keys are extracted each; a null key or url stays null; other columns are
    ignored; an empty table gives no rows.
    """
    rows = _rows(pages, key, url, source)
    found = materialise(templates(rows), "templates")
    joined = _dealt(rows, found, "text", "key").select("key", "text", "template", "url", "host")
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (key, url))
    schema = pa.schema([("key", key_type(joined)), ("url", pa.string()), ("text", pa.string())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, frozenset[int]] = {}
        for batch in batches:
            out = []
            for i, host in enumerate(batch.column(4).to_pylist()):
                if host not in kept:
                    if len(kept) >= HOSTS:
                        kept.clear()
                    kept[host] = frozenset(batch.column(2)[i].as_py())
                out.append(main_text(read(batch.column(1)[i].as_py()), kept[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(schema.field(0).type), batch.column(3).cast(pa.string()), pa.array(out, pa.string())],
                schema=schema,
            )

    got = joined.withColumn("url", F.col("url").cast("string")).mapInArrow(texts, f"key {kind}, url string, text string")
    return got.select(F.col("key").alias(key), F.col("url").cast(url_kind).alias(url), "text")


def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
