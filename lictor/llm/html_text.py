"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks in page order, each under its root-to-leaf tag path. Inline tags are fused into the path of
the block around them. Then, per page:

1. Blocks of named boilerplate go: tags (`OUT_TAGS`), hidden elements, and elements with a class, id or role token that
   is a word of `OUT_WORDS`, or such words with parts of `BESIDE` (`sidebar-left`; not `has-sidebar` or `comments-open`).
   A token never takes away an article or main part, or an element with more than half of the page's unlinked text (unless
   it is a single block beside a marked article), and counts for nothing if no text would be left. If the page marks an article or main part that holds more than half of
   the weight, only that part stays; a short marked teaser is a block like others.
2. Text length, link text and punctuation are summed per tag path. A path's ratio is its unlinked text per block, plus
   `MARK` characters for each punctuation mark per block.
3. The ratios are smoothed over neighbouring blocks in page order, and averaged per path again, so that a short heading
   between paragraphs gets part of their weight.
4. Without such a marked part, the content root is the deepest section that still holds `HOLDS` of the whole weight.
5. Of what is left, only paths go whose smoothed ratio is below `LEAST` of the text-weighted mean and whose text is mostly
   linked (more than `LINKED`), such as a list of other pages. All blocks of all other paths are kept, whole: long
   paragraphs raise the mean, and short list items, cells or code lines beside them are no boilerplate for that.

Pages are worked on one by one inside Spark's Arrow batches; nothing is shuffled. Character references are decoded,
white space inside a block becomes one space, blocks are joined by an empty line.

Nulls and odd rows: null or empty html gives an empty text; a null page_id or url is carried along; repeated rows give
repeated rows; an empty table an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lictor.llm import hashing as H
from lictor.llm.tables import map_arrow

MARK, HOLDS, LEAST, LINKED = 10.0, 0.6, 0.1, 0.5
KERNEL = (1, 2, 3, 2, 1)

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SECTIONS = frozenset("html body main article section div table tbody tr td center".split())
OUT_TAGS = frozenset("head nav footer aside form script style noscript template button select textarea option iframe object svg canvas audio video dialog menu".split())
#: Words of class, id and role names that mark boilerplate.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice alert popup "
    "modal newsletter subscribe signup login search form comment comments respond replies disqus toolbar pagination pager".split())
#: Parts that a token of boilerplate words may have beside them.
BESIDE = frozenset(
    "left right top bottom upper lower inner outer primary secondary main global site page post article entry wrapper wrap container box bar area section "
    "block list links link item items header widgets buttons button icons icon text message overlay slot unit first second".split())
#: An opening tag of the key closes an open tag of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


class _Open:
    """An element that is open: its tag, whether it or one around it is out or marked content, the named elements it is in, its section path."""

    __slots__ = ("tag", "out", "marked", "named", "path")

    def __init__(self, tag: str, out: bool, marked: bool, named: tuple, path: tuple):
        self.tag, self.out, self.marked, self.named, self.path = tag, out, marked, named, path


def _attributes(attrs: str) -> dict[str, str]:
    """Lower-case name -> value; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _boilerplate(token: str, marked: bool) -> bool:
    """A class, id or role token of boilerplate words alone, or with parts of `BESIDE`."""
    if token.lower() in OUT_WORDS:
        return True
    parts = [w.lower() for w in _PARTS.findall(token)]
    return (any(w in OUT_WORDS for w in parts) or "header" in parts and not marked) and all(w in OUT_WORDS or w in BESIDE or w.isdigit() for w in parts)


def _opened(tag: str, attrs: str, around: _Open, place: int) -> _Open:
    has = _attributes(attrs) if attrs else {}
    role = has.get("role", "").lower().split()
    out = around.out or tag in OUT_TAGS or (tag == "header" and not around.marked)
    own = tag in ("article", "main") or "main" in role
    named = around.named
    if has and not out and tag not in ("html", "body"):
        out = "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(has.get("style", "")))
        if not own and any(_boilerplate(token, around.marked) for name in ("class", "id", "role") for token in has.get(name, "").split()):
            named = (*named, place)
    marked = around.marked or own and tag not in ("html", "body")
    path = around.path if tag in INLINE else (*around.path, tag)
    return _Open(tag, out, marked, named, path)


def blocks(page: str) -> list[tuple[tuple, str, int, bool]]:
    """(tag path, text, length of its linked text, inside a marked article) of every block that is no named boilerplate."""
    found = _pieces(page)
    unlinked, within, total, anywhere, article = defaultdict(int), defaultdict(set), 0, False, False
    for i, (_, marked, pieces) in enumerate(found):
        for text, linked, named in pieces:
            n = len("".join(text.split()))
            anywhere = anywhere or n > 0 and not named
            article = article or n > 0 and not named and marked
            n = 0 if linked else n
            total += n
            for place in named:
                unlinked[place] += n
                if n:
                    within[place].add(i)
    # A named element with most of the unlinked text is a container of content; not a single block beside a marked article.
    stays = {place for place, n in unlinked.items() if 2 * n > total and (len(within[place]) > 1 or not article)}
    if not anywhere and not any(stays.issuperset(named) and not text.isspace() for _, _, pieces in found for text, _, named in pieces):
        stays = set(unlinked)
    out: list[tuple[tuple, str, int, bool]] = []
    for path, marked, pieces in found:
        kept = [p for p in pieces if stays.issuperset(p[2])]
        text = " ".join(html.unescape("".join(p[0] for p in kept)).split())
        if text:
            out.append((path, text, min(sum(len(p[0].strip()) for p in kept if p[1]), len(text)), marked))
    return out


def _pieces(page: str) -> list[tuple[tuple, bool, list[tuple[str, bool, tuple]]]]:
    """(tag path, inside a marked article, pieces) of every block; a piece is its raw text, whether linked, and the places of the named elements around."""
    stack = [_Open("", False, False, (), ())]
    found: list[tuple[tuple, bool, list]] = []
    parts: list[tuple[str, bool, tuple]] = []
    here = stack[0]

    def finish() -> None:
        nonlocal parts
        if parts:
            found.append((here.path, here.marked, parts))
            parts = []

    def close(until: int) -> None:
        nonlocal here
        if any(e.tag not in INLINE for e in stack[until:]):
            finish()
        del stack[until:]
        here = stack[-1]

    at, n = 0, len(page)
    while at < n:
        token = _TOKEN.search(page, at)
        text = page[at:token.start()] if token else page[at:]
        if text and not here.out:
            parts.append((text, any(e.tag == "a" for e in stack), here.named))
        if token is None:
            break
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close(depth)
            continue
        if tag not in INLINE:
            finish()
            shut = CLOSES.get(tag, set()) | {"p"}
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in shut or stack[i].tag in SECTIONS | {"ul", "ol", "dl"}), 0)
            if depth and stack[depth].tag in shut:
                close(depth)
        elif tag == "br" and not here.out:
            parts.append((" ", False, here.named))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            here = _opened(tag, token["attrs"], here, at)
            stack.append(here)
    finish()
    return found


def _ratios(found: list[tuple[tuple, str, int, bool]]) -> tuple[dict, list[float]]:
    """Smoothed ratio per path, and every block's own share of the weight."""
    sums: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path, text, linked, _ in found:
        of = sums[path]
        of[0] += len(text) - linked
        of[1] += len(_PUNCTUATION.findall(text)) * (1 - linked / len(text))
        of[2] += 1
    ratio = {path: (length + MARK * marks) / count for path, (length, marks, count) in sums.items()}
    value = [ratio[b[0]] for b in found]
    reach = len(KERNEL) // 2
    smooth: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0])
    for i, block in enumerate(found):
        weights = [(KERNEL[j - i + reach], value[j]) for j in range(max(0, i - reach), min(len(found), i + reach + 1))]
        of = smooth[block[0]]
        of[0] += sum(w * v for w, v in weights) / sum(w for w, _ in weights)
        of[1] += 1
    return {path: total / count for path, (total, count) in smooth.items()}, value


def _root(found: list[tuple[tuple, str, int, bool]], value: list[float]) -> tuple:
    """The deepest section path that holds enough of the whole weight."""
    total, root = sum(value), ()
    while True:
        below: dict[tuple, float] = defaultdict(float)
        for block, weight in zip(found, value, strict=True):
            path = block[0]
            if path[:len(root)] == root and len(path) > len(root) and path[len(root)] in SECTIONS:
                below[path[:len(root) + 1]] += weight
        best = max(below, key=lambda p: (below[p], p), default=None)
        if best is None or below[best] < HOLDS * total:
            return root
        root = best


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    smooth, value = _ratios(found)
    if 2 * sum(v for b, v in zip(found, value, strict=True) if b[3]) > sum(value):
        found = [b for b in found if b[3]]
        smooth, value = _ratios(found)
    else:
        root = _root(found, value)
        found, value = zip(*((b, v) for b, v in zip(found, value, strict=True) if b[0][:len(root)] == root), strict=True)
    mean = sum(v * len(b[1]) for b, v in zip(found, value, strict=True)) / sum(len(b[1]) for b in found)
    sizes: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for path, text, linked, _ in found:
        sizes[path][0] += len(text)
        sizes[path][1] += linked
    links = {path for path, (size, linked) in sizes.items() if linked > LINKED * size}
    return "\n\n".join(b[1] for b in found if b[0] not in links or smooth[b[0]] >= LEAST * mean)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.small(batches, "html"):
            texts = [main_text(page) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return map_arrow(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html"), work, "page_id long, url string, text string")
