"""Main text of web pages by consensus container paths of their host.

First pass, within the rows: a page is parsed into blocks of text, each under
its chain of containers, and every container is scored by the text in it. Then
the hosts' pages vote in Spark: each page gives each of its generalised tag-class
paths its best container's share of the page's highest score; votes are summed
by host and path, with partial sums, and a host's path with most votes wins.
Second pass: every page is extracted again from the containers on its host's
winning path; a page without such a container uses its own best one."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.storage import stored

# -- fixed values of the markup language

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
option p pre search section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element's start tag that ends an open element of the same group, up to the nearest of the bounds.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
            "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
            "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
            "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
#: An end tag or an implied end does not reach past these.
SCOPE = frozenset("table td th caption html body article section aside main nav header footer form".split())

# -- fixed words of page design

#: Elements that are never part of an article.
NOISE_TAGS = frozenset("""nav footer aside form button select menu dialog script style noscript template svg canvas
object embed iframe audio video head title textarea input datalist map search noembed noframes xmp""".split())
#: Words in a class or id that name something beside the article.
NOISE_WORDS = frozenset("""ad ads adbox adbanner adsense advert adverts advertisement advertising banner breadcrumb
breadcrumbs captcha comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr masthead menu
menubar modal nav navbar navigation navi newsletter notice notification outbrain overlay pager pagination paywall popup
promo promoted promotion rating reactions recommended related replies reply respond share sharing sidebar signup
sitemap skip skyscraper social sponsor sponsored subscribe subscription taboola tagcloud toolbar topbar tracking
widget widgets""".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reactions replies reply respond".split())
NOISE_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
toolbar""".split())
#: Words that name the article.
ARTICLE_WORDS = frozenset("article articlebody body content entry hentry main post story text".split())
#: Class words that tell how a page is laid out, not what an element is.
STATE = re.compile(r"(?:^|[-_])(?:has|with|without|no|is|js|not|show|hide)[-_]", re.I)

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)(?:>|((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)|"
                 r"!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))", re.S)
#: The tags whose end is looked for at once, with everything up to it.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+")
#: First or last word of a header's class or id.
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|\s)|(?:^|\s)header[_-]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACES = re.compile(r"[\s]+")
#: Letters of a block from which it counts as prose, when few of them are links.
PROSE = 25
#: What a container keeps of the score of those inside it.
FADE = 0.8
#: Highest vote of a page.
VOTE = 1000


@dataclass(slots=True)
class Box:
    """An element: its path from the root and the number of its parent; noise:
    what kind of noise it is (see ``_named``), or lies in."""
    tag: str
    path: str
    up: int
    noise: int
    header: bool
    good: bool
    items: int = 0
    score: float = 0.0


#: Kinds of noise: by class words, by class words for reader comments, by the element itself.
WORDS, COMMENTS, SURE = 1, 2, 3


def _unescaped(text: str) -> str:
    return html.unescape(text) if "&" in text else text


@lru_cache(maxsize=20_000)
def _named(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    """(generalised step of the path, kind of noise or 0, named like an article,
    a header)."""
    if not attributes:
        return tag, SURE if tag in NOISE_TAGS else 0, tag in ("article", "main"), tag == "header"
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    classes = [c for c in _unescaped(found.get("class", "")).split() if not STATE.search(c)]
    names = [*classes, *[i for i in found.get("id", "").split() if not STATE.search(i)]]
    words = {w for n in names for w in WORD.findall(CAMEL.sub(" ", n).lower())}
    step = ".".join([tag, *sorted({DIGITS.sub("#", c.lower()) for c in classes})])
    hidden = "hidden" in found or HIDDEN.search(found.get("style", "")) is not None
    noise = SURE if tag in NOISE_TAGS or hidden or found.get("role", "").lower() in NOISE_ROLES else 0
    if not noise and tag not in ("html", "body", "main", "article") and words & NOISE_WORDS:
        noise = COMMENTS if words & COMMENT_WORDS else WORDS
    good = tag in ("article", "main") or found.get("itemprop", "").lower() == "articlebody" or bool(words & ARTICLE_WORDS)
    header = tag == "header" or (tag not in ("html", "body", "main", "article")
                                 and HEADER.search(" ".join(names).lower()) is not None)
    return step, noise, good, header


def parse(page: str) -> tuple[list[Box], list[tuple[int, str, int]]]:
    """(boxes, blocks (box, text, link letters)) of a page; box 0 is the page."""
    boxes = [Box("", "", -1, 0, False, False)]
    open_: list[int] = [0]
    blocks: list[tuple[int, str, int]] = []
    text: list[str] = []
    links: list[str] = []
    depth = {"a": 0}
    inline: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(_unescaped("".join(text)).split())
            if joined:
                linked = len("".join(_unescaped("".join(links)).split())) if links else 0
                blocks.append((open_[-1], joined, linked))
            text.clear()
            links.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if depth["a"]:
            links.append(piece)

    def close(upto: int) -> None:
        flush()
        del open_[upto:]
        inline.clear()
        depth["a"] = 0

    def close_p() -> None:
        for k in range(len(open_) - 1, 0, -1):
            tag = boxes[open_[k]].tag
            if tag == "p":
                close(k)
                return
            if tag in SCOPE:
                return

    at, skip = 0, None
    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        slash, tag, quoted, broken = m.groups()
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), bool(slash), quoted or broken or ""
        if ends:
            if tag == "p" or tag in BLOCK or (tag in NOISE_TAGS and tag not in VOID):
                for k in range(len(open_) - 1, 0, -1):
                    name = boxes[open_[k]].tag
                    if name == tag or (tag in HEADINGS and name in HEADINGS):
                        close(k)
                        break
                    if name in SCOPE and tag not in SCOPE:
                        break
                else:
                    flush()
            elif tag in inline:
                while inline.pop() != tag:
                    pass
                depth["a"] = inline.count("a")
            elif tag == "br":
                add(" ")
            continue
        if tag in ("br", "wbr", "img"):
            add(" " if tag == "br" else "")
            continue
        if tag == "body" or tag == "html":
            if any(boxes[k].tag == tag for k in open_):
                continue
        if tag in BLOCK or tag in NOISE_TAGS:
            if tag in BLOCK:
                close_p()
            if tag in HEADINGS and boxes[open_[-1]].tag in HEADINGS:
                close(len(open_) - 1)
            if tag == "body":
                for k in range(len(open_) - 1, 0, -1):
                    if boxes[open_[k]].tag == "head":
                        close(k)
                        break
            ends_too, bounds = SIBLINGS.get(tag, ((), ()))
            if ends_too:
                for k in range(len(open_) - 1, 0, -1):
                    name = boxes[open_[k]].tag
                    if name in bounds:
                        break
                    if name in ends_too:
                        close(k)
                        if tag not in ("tr", "tbody", "thead", "tfoot"):
                            break
            if tag == "hr" or tag in VOID:
                flush()
                continue
            flush()
            up = boxes[open_[-1]]
            step, noise, good, header = _named(tag, attributes)
            if tag == "li":
                up.items += 1
            boxes.append(Box(tag, f"{up.path}>{step}" if up.path else step, open_[-1], noise, header, good))
            open_.append(len(boxes) - 1)
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
                close(len(open_) - 1)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            inline.append(tag)
            if tag == "a":
                depth["a"] = 1
    if at < len(page):
        add(page[at:])
    flush()
    for b in boxes:
        if b.tag in ("article", "main"):  # what holds an article is no noise for its class, but reader comments are
            up = b.up
            while up > 0:
                if boxes[up].noise == WORDS:
                    boxes[up].noise = 0
                up = boxes[up].up
    for b in boxes[1:]:
        b.noise = b.noise or boxes[b.up].noise
        b.header = b.header or boxes[b.up].header
    return boxes, blocks


def _drop(boxes: list[Box], blocks: list[tuple[int, str, int]]) -> list[bool]:
    """Which blocks are no text of an article: those in named noise, those in a
    header that are no heading, and lists of short links."""
    sums = [[0, 0] for _ in boxes]
    for box, text, linked in blocks:
        k = box
        while k >= 0:
            sums[k][0] += len(text)
            sums[k][1] += linked
            k = boxes[k].up
    menu = [b.tag in ("ul", "ol", "dl", "menu", "dir") and b.items >= 3 and sums[k][0] < 40 * b.items
            and sums[k][1] >= 0.8 * sums[k][0] for k, b in enumerate(boxes)]
    for k, b in enumerate(boxes):
        menu[k] = menu[k] or (b.up >= 0 and menu[b.up])
    return [boxes[k].noise or menu[k] or (boxes[k].header and boxes[k].tag not in HEADINGS) for k, _, _ in blocks]


def _score(boxes: list[Box], blocks: list[tuple[int, str, int]], dropped: list[bool]) -> None:
    """Each box's score: its own prose, and what fades up from the boxes inside;
    article-like names count half as much again, links and stray blocks less."""
    for (box, text, linked), out in zip(blocks, dropped):
        if out:
            continue
        plain = len(text) - linked
        weight = float(plain if plain >= PROSE and linked < 0.5 * len(text) or boxes[box].tag in HEADINGS else -linked)
        k, holder = box, boxes[box]
        if holder.tag in HEADINGS or holder.tag in ("p", "li", "blockquote", "pre", "dt", "dd", "td", "th", "figcaption"):
            k = holder.up if holder.up >= 0 else box  # the container of paragraphs, not the paragraph
        while k >= 0:
            boxes[k].score += weight
            weight *= FADE
            k = boxes[k].up
    for b in boxes:
        if b.good and not b.noise:
            b.score *= 1.5


def votes(page: str) -> list[tuple[str, int]]:
    """(path, vote) of each generalised path of the page's containers."""
    boxes, blocks = parse(page)
    _score(boxes, blocks, _drop(boxes, blocks))
    return _votes(boxes)


def _votes(boxes: list[Box]) -> list[tuple[str, int]]:
    best: dict[str, float] = {}
    for b in boxes:
        if b.score > 0 and not b.noise:
            best[b.path] = max(best.get(b.path, 0.0), b.score)
    top = max(best.values(), default=0.0)
    return sorted((p, round(VOTE * s / top)) for p, s in best.items() if round(VOTE * s / top) > 0)


def main_text(page: str, path: str | None) -> str:
    """The blocks in the containers on ``path``, in page order, a line each; with
    no such container those in the page's own best one."""
    boxes, blocks = parse(page)
    dropped = _drop(boxes, blocks)
    chosen = {k for k, b in enumerate(boxes) if b.path == path and not b.noise} if path is not None else set()
    inside = _inside(boxes, chosen)
    if not any(inside[k] and not out for (k, _, _), out in zip(blocks, dropped)):
        _score(boxes, blocks, dropped)
        ranked = _votes(boxes)
        if not ranked:
            return "\n".join(t for (_, t, _), out in zip(blocks, dropped) if not out)
        own = min(ranked, key=lambda x: (-x[1], x[0]))[0]
        inside = _inside(boxes, {k for k, b in enumerate(boxes) if b.path == own and not b.noise})
    return "\n".join(t for (k, t, _), out in zip(blocks, dropped) if inside[k] and not out)


def _inside(boxes: list[Box], chosen: set[int]) -> list[bool]:
    inside: list[bool] = []
    for k, b in enumerate(boxes):
        inside.append(k in chosen or (b.up >= 0 and inside[b.up]))
    return inside


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null where the address has none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host, from rows (host, html).
    Ties go to the smaller path."""
    schema = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("vote", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("vote", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                cast = [[{"path": p, "vote": v} for p, v in votes(x.as_py() or "")] for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cast, kind)], names=["host", "votes"])

    cast = pages.where("host IS NOT NULL").select("host", "html").mapInArrow(
        run, T.StructType([T.StructField("host", T.StringType()), T.StructField("votes", schema)]))
    sums = cast.select("host", F.explode("votes").alias("v")).groupBy("host", "v.path").agg(F.sum("v.vote").alias("votes"))
    best = sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars long.

    Null html counts as empty, its text is ''; a page whose address is null or
    has no host has no vote and uses its own best container; repeated rows vote
    and come out each; an empty table gives no rows; other columns are not read.
    The winning paths (a row a host) are written to shared storage; whether they
    are small enough to be broadcast is left to the size Spark sees there, and a
    large host's pages are split by the skewed join otherwise."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"),
                        pages[html_col].cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    winners = stored(host_paths(rows), "host-paths")
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x.as_py() or "", p.as_py()) for x, p in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
