"""Operator 12: main text of HTML pages by the maximum-scoring subsequence.

A page is a row of words and tags. A word scores the share of such words that are main text on the
labelled pages, from -1 to 1; a tag costs the more the oftener such tags stand outside. One
linear scan finds the contiguous region of the greatest sum. Such words are those of the same kind of
block, in a link or not; such tags those of the same name and kind of part (menu, footer, advert and so
on, told by element, role and class); on a page that marks its main text, those inside or outside the
mark. Words of a part that is never main text score nothing: the tags around them tell regions apart,
and the text is the region's blocks without them.

Labelled pages are those whose markup says where the main text is: with one ``article`` (or
else one ``main``) that is in no other part. :func:`fit` counts words and tags inside and
outside it on at most ``LABELLED`` pages, chosen by a hash of their text; a prior of ``PRIOR``
words stands for what they do not show, so pages without any mark are scored as well.

Scale: the fit is one aggregation to some hundred counts; extraction is a map of the pages in linear
time, with batches bounded in bytes. Each page is held whole in one task, and nothing is cut.

Edge cases: a null or empty page, and one without main text, give an empty text. Unclosed
elements, comments and quotes are read as far as they go. Null or shared page_id and url are passed
on; rows that are alike give the same; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import ast
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, sampled, table

LABELLED = 4000  # pages that the weights are fitted on, at most
PRIOR = 200.0  # words (or tags) that a prior share counts for
OUTSIDE_COST = 3.0  # of a tag that never stands in main text

# Element names of HTML.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head noscript template svg canvas audio video object select option button datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody
    td template tfoot th thead tr ul""".split()
)
INLINE = frozenset("a b br code em i img input span strong sub sup u".split())
#: Elements that one of the given name ends.
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
# Parts of a page by element, by role, and by the words of class and id.
PARTS = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "footer", "header": "header", "form": "form", "fieldset": "form", "search": "form", "dialog": "notice"}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice"}
WORDS = {
    word: part
    for part, words in {
        "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager",
        "header": "header masthead topbar",
        "footer": "footer colophon copyright",
        "side": "sidebar aside related recommended recommendations widget widgets trending share sharing social",
        "advert": "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion banner",
        "notice": "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe paywall",
        "comment": "comment comments commentlist disqus replies respond",
        "form": "form login signup searchform searchbox",
    }.items()
    for word in words.split()
}
MARKS = ("article", "main")
#: Shares of main text before any page is seen: by block, of words in links, and of tags.
SHARES = {"p": 0.85, "pre": 0.85, "blockquote": 0.85, "h1": 0.85, "h2": 0.8, "h3": 0.75, "h4": 0.7, "dd": 0.7, "dt": 0.7, "figcaption": 0.7, "li": 0.65, "td": 0.6}
OTHER_SHARE, LINK_SHARE, PART_SHARE, TAG_SHARE, TEXT_TAG_SHARE = 0.55, 0.25, 0.02, 0.7, 0.95

_STRICT = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
_ODD = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """A page as a row of tags and words; ``blocks`` holds the pieces of text of each block, in order."""

    #: (kind, count, block, mark), a kind being (word or tag, block or name, whether in a link, part): a tag has the block -1, words that of their block; the mark is that around them.
    row: list[tuple[tuple, int, int, int]] = field(default_factory=list)
    blocks: list[list[str]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)  # of each block
    marks: list[int] = field(default_factory=list)  # of each block: the number of the mark it is in, or -1
    marked: dict[str, list[int]] = field(default_factory=dict)  # numbers of the marks of a name
    doubtful: bool = False  # a heading or mark lies in a part that only a class names


def _part(name: str, attributes: str, marked: bool) -> tuple[str, str]:
    """What part of a page an element opens, if any, and what says so where that may err: a form or a class."""
    part = "" if name == "header" and marked else PARTS.get(name, "")
    if part or not attributes or name in ("html", "body", "main"):
        return part, "form" if name == "form" else ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "hidden", ""
        if key == "role" and value.lower() in ROLES:
            return ROLES[value.lower()], ""
        if key in ("class", "id"):
            words = [w.lower() for w in _PIECES.findall(value)]
            for word in words:
                part = WORDS.get(word, "")
                if part == "header" and (marked or not {"post", "entry", "article", "content"}.isdisjoint(words)):
                    part = ""
                if part and (name != "article" or part in ("comment", "advert")):
                    return part, "class"
    return "", ""


def read(html: str, by_class: bool = True) -> Page:
    """The page's tags and words; parts that only a class names count if ``by_class``."""
    page = Page()
    stack: list[tuple[str, str, str, int]] = []  # (name, part, what may err, mark)
    opened: Counter[str] = Counter()
    link, fresh, at, scan = False, True, 0, _STRICT

    def text(piece: str) -> None:
        nonlocal fresh
        piece = entities.unescape(piece) if "&" in piece else piece
        name, part, _, mark = stack[-1] if stack else ("body", "", "", -1)
        if part == "unseen":
            return
        if fresh:
            if not piece or piece.isspace():
                return
            page.blocks.append([])
            page.parts.append(part)
            page.marks.append(mark)
            fresh = False
        page.blocks[-1].append(piece)
        count = len(piece.split())
        if count:
            page.row.append((("word", name if name in SHARES else "", link, part), count, len(page.blocks) - 1, mark))

    def close(name: str) -> None:
        while stack:
            gone = stack.pop()[0]
            opened[gone] -= 1
            if gone == name:
                break

    def enter(name: str, attributes: str) -> None:
        top, part, soft, mark = stack[-1] if stack else ("", "", "", -1)
        before = part
        own, own_soft = _part(name, attributes, opened["article"] > 0)
        if own_soft == "class" and not by_class:
            own = own_soft = ""
        page.doubtful |= soft == "class" and name in ("h1", *MARKS)
        if name in UNSEEN:
            part = "unseen"
        elif name in MARKS and (not part or (soft and part in ("header", "form", "notice"))):
            # an article in an article is a reader's comment
            part, soft = (own, own_soft) if own or not opened["article"] else ("comment", "")
            if not part:
                mark = sum(map(len, page.marked.values()))
                page.marked.setdefault(name, []).append(mark)
        elif not part:
            part, soft = own, own_soft
        if name not in VOID and (name in BLOCK or name in UNSEEN or part != before):
            stack.append((name, part, soft, mark))
            opened[name] += 1

    while (left := html.find("<", at)) >= 0:
        tag, odd = scan.match(html, left), None
        if tag is None:
            odd = _ODD.match(html, left)
            if odd is None and html[left + 1 : left + 2].isascii() and html[left + 1 : left + 2].isalpha():
                scan = _LOOSE  # a quote stays open: from here on a tag ends at its first bracket
                tag = scan.match(html, left)
        if tag is None and odd is None:
            text(html[at : left + 1])  # a bracket that opens nothing is text
            at = left + 1
            continue
        if left > at:
            text(html[at:left])
        at = (tag or odd).end()
        if odd is not None:
            continue
        ends, name, block = tag[1], tag[2].lower(), tag[2].lower() in BLOCK
        if name in RAW and not ends:
            rest = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = rest.end() if rest else len(html)
            continue
        if block:
            fresh, link = True, False
        elif name == "br":
            text(" ")
        elif name == "a":
            link = not ends
        if ends:
            part = stack[-1][1] if stack else ""
            if opened[name]:
                close(name)
            mark = stack[-1][3] if stack else -1
        else:
            if block and opened["head"] and name not in UNSEEN:
                close("head")
            if block and opened["p"]:
                close("p")
            if stack and stack[-1][0] in SIBLINGS.get(name, ()):
                close(stack[-1][0])
            mark = stack[-1][3] if stack else -1
            enter(name, tag[3])
            part = stack[-1][1] if stack else ""
        page.row.append((("tag", name if block or name in INLINE else "", False, part), 1, -1, mark))
    if at < len(html):
        text(html[at:])
    return page


def mark_of(page: Page) -> int:
    """The number of the one mark that holds the main text, or -1: the only article with words, or else the only main."""
    held = {m for m, p, b in zip(page.marks, page.parts, page.blocks) if not p and any(not t.isspace() for t in b)}
    for name in MARKS:
        some = [m for m in page.marked.get(name, []) if m in held]
        if some:
            return some[0] if len(some) == 1 else -1
    return -1


def _on_marked(kind: tuple, inside: bool) -> tuple:
    """What a kind of word or tag counts as on a page that marks its main text."""
    return (f"{kind[0]} of a marked page", "", inside, "" if inside else kind[3])


def _counted(page: Page, mark: int) -> Iterator[tuple[tuple, int, bool]]:
    """Kinds of words and tags of a labelled page, how many, and whether they are main text; each counts for two kinds."""
    for kind, count, _, around in page.row:
        inside = around == mark
        if kind[0] == "tag" or not kind[3]:
            yield kind, count, inside and not kind[3]
        yield _on_marked(kind, inside), count, inside


def prior(kind: tuple) -> float:
    """The share of main text that is supposed of a kind before any page is seen."""
    what, name, flag, part = kind
    if part:
        return PART_SHARE
    if what.endswith("marked page"):
        return 1.0 if flag else 0.0
    if what == "tag":
        return TEXT_TAG_SHARE if name in SHARES or name in INLINE else TAG_SHARE
    return LINK_SHARE if flag else SHARES.get(name, OTHER_SHARE)


def fit(pages: DataFrame, text: str = "html", most: int = LABELLED) -> dict[tuple, tuple[float, float]]:
    """Words (or tags) of every kind on labelled pages: (inside the main text, in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter[tuple] = Counter()
        every: Counter[tuple] = Counter()
        for batch in batches:
            for value in batch.column(0):
                page = read(value.as_py())
                mark = mark_of(page)
                if mark >= 0:
                    for kind, count, is_in in _counted(page, mark):
                        every[kind] += count
                        inside[kind] += count * is_in
        kinds = list(every)
        yield pa.RecordBatch.from_arrays([pa.array([repr(k) for k in kinds], pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([every[k] for k in kinds], pa.int64())], ["kind", "inside", "every"])

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(text).cast("string").alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    counts = sampled(rows, "html", rows.count(), most).mapInArrow(run, "kind string, inside long, every long")
    found = counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("every").alias("every")).collect()
    return {ast.literal_eval(r["kind"]): (r["inside"], r["every"]) for r in found}


def weight(counts: dict, kind: tuple) -> float:
    """A word's score or a tag's cost."""
    inside, every = counts.get(kind, (0, 0))
    share = (inside + PRIOR * prior(kind)) / (every + PRIOR)
    return OUTSIDE_COST * (share - 1) if kind[0].startswith("tag") else 2 * share - 1


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part of the greatest sum above zero, the first of equals; (0, 0) if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, found = total, (start, k + 1)
    return found


def main_text(html: str | None, counts: dict, known: dict | None = None) -> str:
    """The main text's blocks, joined by empty lines. ``known`` keeps weights from page to page."""
    known = {} if known is None else known
    for by_class in (True, False):
        page = read(html or "", by_class)
        mark = mark_of(page)
        scores = []
        for kind, count, block, around in page.row:
            if mark >= 0:
                kind = _on_marked(kind, around == mark)
            if kind not in known:
                known[kind] = weight(counts, kind)
            scores.append(0.0 if block >= 0 and page.parts[block] else known[kind] * count)
        start, end = best_region(scores)
        chosen = sorted({block for _, _, block, _ in page.row[start:end] if block >= 0 and not page.parts[block]})
        if chosen:
            return "\n\n".join(" ".join("".join(page.blocks[b]).split()) for b in chosen)
        if not page.doubtful:
            break
    return ""


def extract(pages: DataFrame, counts: dict, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(counts)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(text).cast("string").alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = [main_text(v.as_py(), shared.value, known) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


def sql() -> str:
    """The same for pages that mark their text by one plain ``article`` of headings and paragraphs, as all of the tables do."""
    decoded = "a"
    # The character references that the tables hold; the ampersand comes last.
    for name, sign in {"&quot;?": '"', "&lt;?": "<", "&gt;?": ">", "&copy;?": "©", "&middot;?": "·", "&amp;?": "&"}.items():
        decoded = f"regexp_replace({decoded}, '{name}', '{sign}', 'g')"
    return f"""WITH A AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>((?s:.*))</article>', 1), '</?(?:h1|p)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') AS a FROM pages),
B AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split({decoded}, chr(1)), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> ''), chr(10) || chr(10)) AS text FROM A)
SELECT page_id, url, text, length(text) AS n_chars FROM B"""
