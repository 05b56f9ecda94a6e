"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page tree.

A page is cut into leaf blocks: runs of text between block-level tags, with the names, classes and ids of all open
elements. Each block is labelled main text or not. Features are its ancestors' tags and class or id words, its own
block tag and the shape of its text; neighbouring labels are tied by transition weights. The most likely labelling of
the whole page is found by Viterbi, and the blocks labelled as main text are joined by line feeds.

Training pages are labelled by their own markup: a page with one ``article`` (or ``main``) holds its main text there,
less the parts that elements inside set aside. As real pages of one source share a layout, each one also gives laid-out
variants: the same main text and the same menu, notice and footer texts in other layouts, whose labels are known
because each piece is placed on purpose. At most ``MAX_TRAINING_PAGES`` pages are used, by hash order of page_id.

Null or empty pages give an empty text; malformed markup is read as far as it goes; ties prefer main text. Without
labelled pages all blocks count as main text. Nothing is capped: every block of every page is labelled.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import or_empty

MAX_TRAINING_PAGES = 240
VARIANTS = 3
EPOCHS = 6

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var ruby rt rp".split()
)
UNSEEN = frozenset(
    "script style noscript template svg iframe object head title textarea select button canvas audio video math".split()
)
CLOSED_BY_SIBLING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav"
    " ol p pre section table ul".split()
)

#: Elements that may stand in a head; any other start tag ends it, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: Hidden elements that are skipped whole up to their end tag.
SKIPPED = frozenset("noscript template svg iframe".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>[^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+|[^>]*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    features: tuple[str, ...]
    inside: frozenset[str]


def _own_features(tag: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (f"tag={tag}",)
    found = [f"tag={tag}"]
    for match in _NAMES.finditer(attributes):
        value = match[2] or match[3] or match[4] or ""
        found += [f"name={part.lower()}" for part in _PARTS.findall(value) if not part.isdigit()]
    return tuple(dict.fromkeys(found))


def _shape(text: str, linked: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    size = next((name for most, name in ((2, "1"), (6, "3"), (15, "7"), (40, "16")) if words <= most), "41")
    share = linked / max(len(text), 1)
    links = "none" if linked == 0 else "few" if share < 0.4 else "most"
    end = "stop" if text[-1] in ".!?…\"'”»" else "open"
    found = ("bias", f"words={size}", f"links={links}", f"end={end}", f"words={size} links={links}", f"words={size} end={end}")
    return found + ("sign=copyright",) if "©" in text else found


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in page order: decoded text with single spaces, features, and the tags it stands in."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, links, hidden, block_tag = 0, 0, 0, "body"

    #: Depths of hidden elements without an end tag: they last until the next start tag of a block.
    loose: list[int] = []
    ends: dict[str, int] = {}

    def last_end(tag: str) -> int:
        if tag not in ends:
            ends[tag] = max((found.start() for found in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
        return ends[tag]

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            path = tuple(feature for _, features in stack for feature in features)
            shape = (*_shape(text, linked), f"block={block_tag}")
            blocks.append(Block(text, path + shape, frozenset(tag for tag, _ in stack)))
        pieces.clear()
        linked = 0

    def close(down_to: int) -> None:
        nonlocal links, hidden, block_tag
        for tag, _ in stack[down_to:]:
            links -= tag == "a"
            hidden -= tag in UNSEEN
        del stack[down_to:]
        while loose and loose[-1] >= down_to:
            loose.pop()
        block_tag = next((tag for tag, _ in reversed(stack) if tag not in INLINE), "body")

    def close_last(tag: str) -> None:
        place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
        if place >= 0:
            close(place)

    def write(raw: str) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and raw.strip():
            close_last("head")
        if raw and not hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    while match := _MARKUP.search(page, at):
        write(page[at : match.start()])
        at = match.end()
        if match["tag"] is None:
            continue
        tag = match["tag"].lower()
        if match["end"]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag not in INLINE:
                flush()
            if place >= 0:
                if tag in INLINE and any(open_tag not in INLINE for open_tag, _ in stack[place + 1 :]):
                    continue
                close(place)
            continue
        if hidden and tag not in IN_HEAD:
            close_last("head")
        if tag == "br":
            pieces.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            self_closed = match["attributes"].rstrip().endswith("/")
            if tag in SKIPPED and (self_closed or last_end(tag) >= at):
                if not self_closed:
                    at = re.compile(rf"</{tag}\s*>", re.I).search(page, at).end()
                continue
            if tag not in INLINE:
                flush()
                if loose and tag in ENDS_PARAGRAPH:
                    close(loose[0])
                if tag in ("button", "select") and hidden:
                    close_last(tag)
                siblings = CLOSED_BY_SIBLING.get(tag, {"p"} if tag in ENDS_PARAGRAPH else set())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in siblings:
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if self_closed and tag not in INLINE and tag in UNSEEN:
                continue
            if tag in UNSEEN and tag != "head" and last_end(tag) < at:
                loose.append(len(stack))
            stack.append((tag, _own_features(tag, match["attributes"])))
            links += tag == "a"
            hidden += tag in UNSEEN
            if tag not in INLINE:
                block_tag = tag
    write(page[at:])
    flush()
    return blocks


# --- labelled pages

_SET_ASIDE = frozenset("nav aside form footer".split())

# Names that page layouts commonly give to main text and to what stands around it.
MAIN_WRAPPERS = (
    "<article>", "<main>", '<main id="main"><article class="post">', '<div class="content">', '<div id="main-content">',
    '<div class="post-body">', '<div class="entry-content">', '<section class="story">', '<div itemprop="articleBody">',
    '<div class="article-text body">', '<div role="main">', "<div>",
)
AROUND = {
    "menu": ('<ul class="menu">', '<div class="navbar navigation">', '<div id="topnav">', '<div class="breadcrumbs">', "<nav>", '<div role="navigation">'),
    "head": ("<header>", '<div class="header site-header">', '<div id="masthead" class="banner">', '<div class="top-bar logo">'),
    "foot": ("<footer>", '<div class="footer">', '<div id="site-footer" class="copyright legal">', '<div class="bottom-links">'),
    "side": ("<aside>", '<div class="sidebar">', '<div id="secondary" class="widget">', '<aside class="related">', '<div class="related-posts more recommended">', '<div class="popular trending">'),
    "note": ('<div class="cookie-notice consent">', '<div id="gdpr" class="banner">', '<div class="notice alert message">', '<div class="popup modal overlay">', '<div role="alert" class="warning">', '<div class="privacy disclaimer">'),
    "advert": ('<div class="ad">', '<div class="advert sponsored">', '<div class="promo advertisement">', '<ins class="ads banner">', '<div id="sponsor">', "<aside class='ad-slot'>"),
    "form": ('<form class="newsletter subscribe">', '<form action="/login">', "<form>", '<div class="search form">', '<div class="signup subscription">'),
    "comment": ('<div class="comments">', '<section id="comments">', '<div class="comment reply">', '<ol class="comment-list discussion">', '<div id="disqus" class="responses">', '<section class="user-comments reader">', '<div class="reviews feedback">'),
    "share": ('<div class="share social">', '<ul class="tags">', '<div class="meta byline author">', '<div class="toolbar pagination">'),
}


def _closing(opening: str) -> str:
    return "".join(f"</{tag}>" for tag in reversed(re.findall(r"<(\w+)", opening)))


def _variant(main: list[Block], other: list[Block], chance: random.Random) -> tuple[list[Block], list[int]]:
    """The same texts in another layout, as leaf blocks with their labels."""
    spare = [block.text for block in other] or ["more"]

    def words(low: int, high: int) -> str:
        pool = " ".join(chance.sample(spare, min(4, len(spare)))).split()
        return entities.escape(" ".join(chance.choices(pool, k=chance.randint(low, high))))

    def around(kind: str) -> str:
        opening = chance.choice(AROUND[kind])
        if kind in ("menu", "foot", "share", "side") and chance.random() < 0.6:
            count = chance.randint(2, 6)
            inner = "".join(f'<li><a href="/{at}">{words(1, 3)}</a></li>' for at in range(count))
            inner = inner if opening.startswith(("<ul", "<ol")) else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><p>{words(2, 9)}</p>"
        elif kind == "comment":
            texts = [entities.escape(chance.choice(main).text) if main else words(5, 30) for _ in range(chance.randint(1, 4))]
            tag = chance.choice(("p", "div", "blockquote"))
            inner = "".join(f"<{tag}>{text if chance.random() < 0.7 else words(4, 30)}</{tag}>" for text in texts)
        else:
            shapes = ("<h1>{}</h1>", "<a href='/'>{}</a>", "<p>{}</p>") if kind == "head" else ("<p>{}</p>", "{}", "<span>{}</span>", "<h3>{}</h3>")
            inner = chance.choice(shapes).format(words(2, 8 if kind == "head" else 25))
        return f"{opening}{inner}{_closing(opening)}"

    wrapper = chance.choice(MAIN_WRAPPERS)
    inside = [k for k in ("advert", "share", "side", "form", "note", "comment") if chance.random() < 0.25]
    pieces = [(around(kind), 0) for kind in ("note", "head", "menu", "advert") if chance.random() < 0.7]
    body: list[tuple[str, int]] = []
    for at, block in enumerate(main):
        tag = "h1" if at == 0 else chance.choices(("p", "h2", "li", "blockquote", "div", "td"), (80, 6, 4, 4, 3, 3))[0]
        text = entities.escape(block.text)
        if at and chance.random() < 0.15:
            text = f"{text[: len(text) // 2]}<a href='#'>{text[len(text) // 2 :]}</a>" if "&" not in text else text
        written = f"<{tag}>{text}</{tag}>"
        holder = {"li": "ul", "td": "table"}.get(tag)
        body.append((f"<{holder}>{written}</{holder}>" if holder else written, 1))
    for kind in inside:
        body.insert(chance.randint(1, len(body)) if kind != "comment" else len(body), (around(kind), 0))
    after = [(around(kind), 0) for kind in ("share", "comment", "side", "form", "advert", "foot") if chance.random() < 0.6]
    pieces.append((wrapper, None))
    pieces += body
    pieces.append((_closing(wrapper), None))
    pieces += after
    page = "<html><body>" + "".join(text for text, _ in pieces) + "</body></html>"
    labels = [label for text, label in pieces if label is not None for _ in leaf_blocks(text)]
    blocks = leaf_blocks(page)
    return (blocks, labels) if len(blocks) == len(labels) else ([], [])


def labelled_pages(page: str, key: int, variants: int = VARIANTS) -> list[tuple[list[Block], list[int]]]:
    """The page with labels from its own markup, and its variants; nothing if its markup does not say."""
    blocks = leaf_blocks(page)
    for tag in ("article", "main"):
        labels = [int(tag in block.inside and not block.inside & _SET_ASIDE) for block in blocks]
        if any(labels) and len(re.findall(rf"<{tag}\b", page, re.I)) == 1:
            break
    else:
        return []
    main = [block for block, label in zip(blocks, labels, strict=True) if label]
    other = [block for block, label in zip(blocks, labels, strict=True) if not label]
    found = [(blocks, labels)]
    chance = random.Random(key)
    found += [made for made in (_variant(main, other, chance) for _ in range(variants)) if made[0]]
    return found


# --- the field: emission weight of a block for "main" against "not", and a 2 x 2 table of transitions


def fit(pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = EPOCHS, seed: int = 7) -> dict[str, float]:
    """Maximum likelihood by AdaGrad; returns feature weights, transitions under ``next=ab``."""
    names = sorted({feature for rows, _ in pages for features in rows for feature in features})
    place = {name: at for at, name in enumerate(names)}
    coded = [([np.array([place[f] for f in features]) for features in rows], np.array(labels)) for rows, labels in pages]
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    moves, move_squares = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    generator = np.random.default_rng(seed)
    rate, decay = 0.15, 2e-4
    for _ in range(epochs):
        for at in generator.permutation(len(coded)):
            rows, labels = coded[at]
            scores = np.array([[0.0, weights[row].sum()] for row in rows])
            count = len(rows)
            forward, backward = np.zeros((count, 2)), np.zeros((count, 2))
            forward[0] = scores[0]
            for i in range(1, count):
                forward[i] = scores[i] + np.logaddexp.reduce(forward[i - 1][:, None] + moves, axis=0)
            for i in range(count - 2, -1, -1):
                backward[i] = np.logaddexp.reduce(moves + scores[i + 1] + backward[i + 1], axis=1)
            total = np.logaddexp.reduce(forward[-1])
            error = np.exp(forward + backward - total)[:, 1] - labels
            gradient = np.zeros(len(names))
            for row, gap in zip(rows, error, strict=True):
                np.add.at(gradient, row, gap)
            touched = np.nonzero(gradient)[0]
            step = gradient[touched] + decay * weights[touched]
            squares[touched] += step**2
            weights[touched] -= rate * step / np.sqrt(squares[touched])
            if count > 1:
                pair = forward[:-1, :, None] + moves + (scores[1:] + backward[1:])[:, None, :] - total
                change = np.exp(pair).sum(axis=0)
                np.add.at(change, (labels[:-1], labels[1:]), -1.0)
                change += decay * moves
                move_squares += change**2
                moves -= rate * change / np.sqrt(move_squares)
    found = {name: float(weight) for name, weight in zip(names, weights, strict=True)}
    found.update({f"next={a}{b}": float(moves[a, b]) for a in (0, 1) for b in (0, 1)})
    return found


def viterbi(blocks: list[Block], model: dict[str, float]) -> list[int]:
    """The most likely labels of a page's blocks; ties prefer main text."""
    get = model.get
    m00, m01, m10, m11 = (get(f"next={pair}", 0.0) for pair in ("00", "01", "10", "11"))
    back: list[tuple[int, int]] = []
    not_main = main = 0.0
    for at, block in enumerate(blocks):
        emission = sum(get(feature, 0.0) for feature in block.features)
        if at:
            to_not = (0, not_main + m00) if not_main + m00 > main + m10 else (1, main + m10)
            to_main = (0, not_main + m01) if not_main + m01 > main + m11 else (1, main + m11)
            back.append((to_not[0], to_main[0]))
            not_main, main = to_not[1], to_main[1] + emission
        else:
            not_main, main = 0.0, emission
    labels = [int(main >= not_main)] if blocks else []
    for before in reversed(back):
        labels.append(before[labels[-1]])
    return labels[::-1]


def main_text(page: str, model: dict[str, float]) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(block.text for block, label in zip(blocks, viterbi(blocks, model), strict=True) if label)


def train_extractor(pages: DataFrame, *, max_pages: int = MAX_TRAINING_PAGES, variants: int = VARIANTS) -> dict[str, float]:
    """Fit on at most ``max_pages`` pages that label themselves, by hash order of page_id.

    Repeated ids count once, by the least hash of their labelled html.
    """

    @F.pandas_udf("boolean")
    def labelled(htmls: pd.Series) -> pd.Series:
        return pd.Series([bool(labelled_pages(html, 0, 0)) for html in htmls], dtype=bool)

    known = pages.where("page_id IS NOT NULL").select("page_id", or_empty("html").alias("html"))
    marked = known.withColumn("mark", F.xxhash64("html"))
    # only pages that name an element are parsed, and each once
    chosen = marked.where(F.col("html").rlike("(?i)<(article|main)")).where(labelled("html"))
    chosen = chosen.groupBy("page_id").agg(F.min("mark").alias("mark"))
    chosen = chosen.orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = marked.join(F.broadcast(chosen), ["page_id", "mark"])
    sample = sample.groupBy("page_id").agg(F.min("html").alias("html"))

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_id")
        made = []
        for page_id, page in zip(frame.page_id, frame.html, strict=True):
            made += labelled_pages(page, zlib.crc32(str(page_id).encode()), variants)
        model = fit([([block.features for block in blocks], labels) for blocks, labels in made]) if made else {}
        return pd.DataFrame({"feature": list(model), "weight": list(model.values())})

    rows = sample.groupBy(F.lit(0).alias("model")).applyInPandas(train, "feature string, weight double").collect()
    return {row.feature: row.weight for row in rows}


def extract_text(pages: DataFrame, model: dict[str, float]) -> DataFrame:
    """``pages`` with ``text`` (empty if a page has no main text) and ``n_chars``, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([main_text(page, model) for page in texts], dtype="object")

    return pages.withColumn("text", extracted(or_empty("html"))).withColumn("n_chars", F.length("text").cast("bigint"))
