"""Main text of web pages by tag-path ratios.

Every piece of text of a page belongs to the path of tags from the root to it. Per path, the characters and the punctuation
marks per piece are averaged, smoothed over the order in which paths appear, and fused into one weight. Paths of menus,
notices and the like weigh nothing. The content is the subtree that holds nearly all of the weight, less such paths and
lists of links. An article tag makes what stands in it heavier, and no more.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusflow.llm.common import with_python

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)"
    r"(?:.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo cite code data dfn del em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr"
    " label img".split()
)
#: Tags whose text is no part of an article, wherever they stand.
_OUTSIDE = frozenset("nav header footer aside button select option menu dialog head fieldset input object".split())
#: Words in class, id, role or label that mark such parts, also inside a longer name (``comment-list``).
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar masthead copyright cookie cookies consent gdpr popup modal newsletter subscribe signup"
    " login comment comments reply replies respond disqus pagination pager".split()
)
#: Words that mark them alone; inside a longer name (``social-history``) in an article, the text decides.
_HINTS = frozenset(
    "banner rail header footer notice overlay discussion share sharing social related recommended trending toolbar widget"
    " search skip complementary contentinfo dialog alert tags".split()
)
#: Ends the path of a part that only a longer name with such a word marks.
_HINTED = "\0"
_PROSE_CHARS = 200
_CONTENT = frozenset("article main articlebody post-body entry-content article-body post-content".split())
_CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_CLOSE_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section"
    " table ul".split()
)
_LINK = re.compile(r"/a(?:\.[^/]*)?(?:/|$)")
_SHARE = 0.9
#: How much heavier text counts inside an article tag.
_ARTICLE = 3
_MARK = re.compile(r"[.,;:!?…。，、]")


class _Node:
    __slots__ = ("above", "marks", "name", "outside", "path")

    def __init__(self, name: str, path: str, outside: bool, marks: tuple[str, ...], above: tuple[str, ...] | None):
        self.name, self.path, self.outside, self.marks, self.above = name, path, outside, marks, above


def _opened(name: str, attributes: str, parent: _Node) -> _Node:
    words, marked, hinted, content = [], name == "form", False, name in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() in ("class", "id"):
            words.append(value)
        content = content or any(v in _CONTENT for v in value.split())
        for v in value.split():
            parts = re.split(r"[-_]+", v)
            marked = marked or v in _HINTS or any(p in _MARKS for p in (v, *parts))
            hinted = hinted or any(p in _HINTS for p in parts)
    if name in ("html", "body", "article", "main"):
        marked = hinted = False
    path = f"{parent.path}/{name}" + "".join(f".{w}" for w in words)
    above = parent.marks if content and parent.above is None else parent.above
    marks = (*parent.marks, path if marked else path + _HINTED) if marked or hinted else parent.marks
    return _Node(name, path, parent.outside or name in _OUTSIDE, marks, above)


def text_pieces(page: str) -> Iterator[tuple[str, str, bool, bool, bool]]:
    """``path, text, outside, inside an article, begins a block`` of each piece of text, in page order.

    A part that words or a form mark is outside, unless it is a wrapper: it holds half of the page's text, and half of the
    text inside article tags, or nearly all of the text that is not marked elsewhere where there are no such tags. Nor is one
    outside that a word inside a longer name marks, if it stands in an article and reads like the rest of it.
    """
    pieces = list(_marked_pieces(page))
    every = tagged = free = 0
    below: dict[str, list[int]] = {}  # all text, text inside articles, text that no mark within is around
    outer: dict[str, str] = {}
    for _, text, outside, marks, above, _ in pieces:
        size = 0 if outside else len(text.strip())
        every += size
        free += 0 if marks else size
        tagged += 0 if above is None else size
        for i, m in enumerate(marks):
            if m not in below:
                below[m] = [0, 0, 0]
                outer[m] = marks[i - 1] if i else ""
        if marks:
            below[marks[-1]][0] += size
            below[marks[-1]][2] += size
        if above:
            below[above[-1]][1] += size
    lifted = set()
    for m in sorted(below, key=len, reverse=True):
        size, inside, own = below[m]
        near = 2 * inside >= tagged if tagged else own >= _SHARE * (free + own)
        if size and 2 * size >= every and near:
            lifted.add(m)
        if o := outer[m]:
            below[o][0] += size
            below[o][1] += inside
            below[o][2] += own if m in lifted else 0
    lifted |= _prose(pieces)
    for path, text, outside, marks, above, begins in pieces:
        yield path, text, outside or not lifted.issuperset(marks), above is not None, begins


def _prose(pieces: list) -> set[str]:
    """Parts inside an article, marked by a word in a longer name only, whose pieces are about as long and as punctuated as
    those of the article that nothing marks, and which are no lists of links."""
    sums: dict[str, list[int]] = {}
    for path, text, outside, marks, above, _ in pieces:
        stripped = text.strip()
        key = marks[-1] if marks else ""
        if stripped and not outside and above is not None and (not key or key.endswith(_HINTED)):
            own = sums.setdefault(key, [0, 0, 0, 0])
            linked = len(stripped) if _LINK.search(path) else 0
            for i, n in enumerate((len(stripped), len(_MARK.findall(stripped)), 1, linked)):
                own[i] += n
    rest = sums.pop("", None)
    if not rest:
        return set()
    return {
        m
        for m, (chars, marks, count, linked) in sums.items()
        if chars >= _PROSE_CHARS and 3 * linked < chars and 2 * chars * rest[2] >= rest[0] * count and 2 * marks * rest[0] >= rest[1] * chars
    }


def _marked_pieces(page: str) -> Iterator[tuple[str, str, bool, tuple[str, ...], tuple[str, ...] | None, bool]]:
    """As ``text_pieces``, with the paths of the marked parts around a piece, and of those around the article it is in."""
    root = _Node("", "", False, (), None)
    stack, at, block = [root], 0, True

    def pieces(upto: int):
        if upto > at:
            yield stack[-1].path, references.unescape(page[at:upto]), stack[-1].outside, stack[-1].marks, stack[-1].above, block

    for m in _TOKEN.finditer(page):
        for piece in pieces(m.start()):
            yield piece
            block = False
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            block = True
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("table", "article", "main", "body") and name in ("p", "li", "td", "th", "tr", "dd", "dt"):
                    break
            continue
        closes = ("p",) if name in _CLOSE_P else _CLOSES.get(name, ())
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    del stack[k:]
                    break
                if stack[k].name not in _INLINE and stack[k].name not in ("p", *closes):
                    break
        if name not in _VOID and not m["attributes"].rstrip().endswith("/"):
            stack.append(_opened(name, m["attributes"], stack[-1]))
    yield from pieces(len(page))


def path_weights(pieces: list[tuple[str, str, bool, bool, bool]]) -> dict[str, float]:
    """A weight per path: smoothed characters per piece times the share of smoothed punctuation, 0 outside, and 0 for the
    lighter of the two where some text stands inside article tags and some does not.
    """
    sums: dict[str, list[float]] = {}
    for path, text, outside, inside, _ in pieces:
        if stripped := text.strip():
            own = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0 if outside else 1.0, False])
            own[0] += len(stripped)
            own[1] += len(_MARK.findall(stripped))
            own[2] += 1
            own[4] = own[4] or inside
    ratios = [(s[0] / s[2], s[1] / s[2]) for s in sums.values()]
    out = {}
    for i, (path, s) in enumerate(sums.items()):
        near = [(math.exp(-((k - i) ** 2) / 2), *ratios[k]) for k in range(max(0, i - 2), min(len(ratios), i + 3))]
        total = sum(w for w, _, _ in near)
        chars, marks = (sum(w * x[j] for w, *x in near) / total for j in (0, 1))
        out[path] = s[3] * math.log1p(chars) * (1 + math.log1p(marks)) * s[0]
    # Text inside article tags and text outside of them are different stories. The heavier one is the content; the tags
    # treble a weight.
    tagged = sum(w for p, w in out.items() if sums[p][4])
    article = _ARTICLE * tagged >= sum(out.values()) - tagged and tagged > 0
    return {p: w if sums[p][4] == article else 0.0 for p, w in out.items()}


def _below(values: dict[str, float]) -> dict[str, float]:
    """The sum of values of each subtree."""
    inside: dict[str, float] = {}
    for path, value in values.items():
        for m in re.finditer(r"/|$", path):
            if m.start():
                inside[path[: m.start()]] = inside.get(path[: m.start()], 0) + value
    return inside


def _link_lists(pieces: list[tuple[str, str, bool, bool, bool]], weights: dict[str, float], root: str) -> set[str]:
    """Subtrees below ``root`` that are links by half and weigh less per character than its other text."""
    chars: dict[str, float] = {}
    for path, text, *_ in pieces:
        if weights.get(path):
            chars[path] = chars.get(path, 0) + len(text.strip())
    size, weight = _below(chars), _below({p: w for p, w in weights.items() if w})
    links = _below({p: n for p, n in chars.items() if _LINK.search(p)})
    all_weight, all_size = weight.get(root, sum(weights.values())), size.get(root, sum(chars.values()))
    return {
        p
        for p, n in links.items()
        if p.startswith(f"{root}/") and not _leaf_of_block(p) and 2 * n >= size[p] and weight[p] * (all_size - size[p]) < (all_weight - weight[p]) * size[p]
    }


def main_text(page: str, share: float = 0.9) -> str:
    """The article's text: white space inside blocks collapsed, blocks joined by one space."""
    pieces = list(text_pieces(page))
    weights = path_weights(pieces)
    total = sum(weights.values())
    if not total:
        return ""
    inside = _below(weights)
    # The deepest subtree that holds the share; of one path through the tree, as any other holds less than half.
    root = max((p for p, w in inside.items() if w >= share * total), key=lambda p: p.count("/"), default="")
    while root and _leaf_of_block(root):
        root = root.rpartition("/")[0]
    gone = _link_lists(pieces, weights, root)
    listed = {p: any(p == g or p.startswith(f"{g}/") for g in gone) for p in weights} if gone else {}
    blocks: list[str] = []
    for path, text, outside, _, begins in pieces:
        if begins or not blocks:
            blocks.append("")
        # Blank text has no weight of its own and goes with the blocks around it.
        kept = (path == root or path.startswith(f"{root}/")) and weights.get(path, 1) and not listed.get(path)
        if kept and not outside:
            blocks[-1] += text
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def _leaf_of_block(path: str) -> bool:
    """Whether a path ends in a paragraph, heading or smaller unit: content is never one of them alone."""
    name = path.rpartition("/")[2].partition(".")[0]
    return name in _INLINE or name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote")


def _extracted(batches):
    for batch in batches:
        texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html, any other columns).

    A null or empty page, or one without an article, gives an empty text. Rows that repeat are extracted each. Pages are
    parsed where they are read, whole; nothing is shuffled.
    """
    with_python(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    schema = T.StructType(
        [rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return rows.mapInArrow(_extracted, schema)
