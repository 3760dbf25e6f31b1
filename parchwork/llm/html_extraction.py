"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is read once into text blocks, the runs of text between block-level tags. A block is
described by its words and link density, those of the blocks before and after it (Kohlschuetter
et al. 2010), whether it stands in an article or in an element that is by its kind something else,
whether it is a heading, and by how much the names of an element around it tell of other things and how much of the
page's words stand beside that element: a name alone decides nothing. A small decision tree, trained on the labelled
blocks of the pages below, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy
from parchwork.plans.session import spread

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
#: Read as text up to their end tag; without one, script and style go to the end of the page.
RAW = frozenset("script style title".split())
#: Left out where they are closed; without an end tag of its own such a start tag alone is passed over.
EMBEDDED = frozenset("noscript template iframe svg object canvas audio video annotation annotation-xml".split())
FORM = frozenset("form button select option textarea fieldset input datalist".split())
BOILER = frozenset("nav footer aside menu dialog".split()) | FORM
CLOSES_ITSELF = frozenset("li dt dd tr td th option p".split())
#: Roles of such elements.
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class or id that as a rule name something other than main text, and words that often do.
HINTS = frozenset(
    "ad ads advert adverts advertisement aside banner breadcrumb breadcrumbs captcha comment comments complementary contentinfo cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter pagination popup promo promoted related sharebar sidebar signup sponsor sponsored toolbar topbar widget".split()
)
HALF_HINTS = frozenset("consent copyright form header legal login notice notices paywall replies reply share sharing skip social subscribe tags".split())
ARTICLE = frozenset("article main".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--(?:.*?-->|.*\Z)|<[!?/][^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|data-keep|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_PAIR = r"""<!--(?:.*?-->|.*\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\b|\Z)|<(/?){}(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
_SPACE = re.compile(r"\s+")


class TextBlock(NamedTuple):
    text: str
    words: int
    link_density: float
    article: int
    boiler: int
    heading: int
    #: Shares of hints and of half hints among the names of the innermost element around it that has any, and of the page's words beside that element.
    hint: float
    half_hint: float
    beside: float
    keep: int


def _closed(page: str, name: str) -> dict[int, int]:
    """Where elements of this name begin → where they end; those without an end tag of their own are left out."""
    found: dict[int, int] = {}
    begun: list[int] = []
    for m in re.finditer(_PAIR.format(name), page, re.DOTALL | re.IGNORECASE):
        if m[2] and begun:
            found[begun.pop()] = m.end()
        elif m[2] == "" and not m[3].endswith("/"):
            begun.append(m.start())
    return found


class _Open(NamedTuple):
    """An open element and what it adds to all that is in it; `named` is its number among elements with hints, or that of one around it."""

    name: str
    article: int
    boiler: int
    link: int
    heading: int
    keep: int
    named: int


def _hint(told: dict[str, str]) -> tuple[float, float]:
    """Shares of hints and half hints among the names in class and id."""
    names = _NAME.findall(f"{told.get('class', '')} {told.get('id', '')}")
    if not names or {"has", "with", "no"} & set(names):
        return 0.0, 0.0
    return sum(n in HINTS for n in names) / len(names), sum(n in HALF_HINTS for n in names) / len(names)


def blocks(page: str) -> list[TextBlock]:
    """The page's text blocks in order; blocks without visible text are none."""
    out: list[TextBlock] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[_Open] = []
    #: How many open elements have a name, so that an end tag of none is passed over at once.
    count: dict[str, int] = {}
    article = boiler = link = heading = keep = 0
    #: Of elements with hints: the hint, the words within, and the number of the next one around (-1: none); and each block's.
    hints: list[tuple[float, float]] = []
    words_in: list[int] = []
    around: list[int] = []
    owner: list[int] = []
    closed: dict[str, dict[int, int]] = {}
    untitled = False

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                words = len(text.split(" "))
                in_links = len(_SPACE.sub(" ", html.unescape(" ".join(linked))).split()) if linked else 0
                owner.append(stack[-1].named if stack else -1)
                if owner[-1] >= 0:
                    words_in[owner[-1]] += words
                out.append(TextBlock(text, words, min(1.0, in_links / words), int(article > 0), int(boiler > 0), int(heading > 0), 0.0, 0.0, 0.0, int(keep > 0)))
            parts.clear()
            linked.clear()

    def drop(to: int) -> None:
        nonlocal article, boiler, link, heading, keep
        while len(stack) > to:
            e = stack.pop()
            count[e.name] -= 1
            article, boiler, link, heading, keep = article - e.article, boiler - e.boiler, link - e.link, heading - e.heading, keep - e.keep

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            if link:
                linked.append(page[at:end])
        if not m:
            break
        at = m.end()
        close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name in ("mtd", "mtr"):
            parts.append(" ")
        if close:
            if count.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                drop(k)
            continue
        if name in RAW:
            found = None if untitled and name == "title" else re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            untitled |= name == "title" and not found
            at = found.end() if found else at if name == "title" else n
            continue
        if name in EMBEDDED:
            if not rest.endswith("/"):
                if name not in closed:
                    closed[name] = _closed(page, name)
                at = closed[name].get(m.start(), at)
            continue
        # what stands in a head besides titles, scripts and styles has no text; anything else ends it, with or without its end tag
        if name == "head":
            continue
        if name in VOID:
            continue
        if name not in INLINE and stack:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == "p" or (stack[k].name == name and name in CLOSES_ITSELF):
                    drop(k)
                    break
                if stack[k].name not in INLINE:
                    break
        told = dict((k.lower(), (v or "").strip("\"'").lower()) for k, v in _ATTRIBUTE.findall(rest)) if rest.strip(" /") else {}
        hidden = "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "")
        is_boiler = name in BOILER or hidden or told.get("role") in BOILER_ROLES or (name == "header" and not article)
        named = stack[-1].named if stack else -1
        if name not in ARTICLE and name not in ("html", "body", "header") and any(hint := _hint(told)):
            hints.append(hint)
            words_in.append(0)
            around.append(named)
            named = len(hints) - 1
        e = _Open(name, int(name in ARTICLE), int(is_boiler), int(name == "a"), int(len(name) == 2 and name[0] == "h" and name[1] in "123456"), int("data-keep" in told), named)
        stack.append(e)
        count[name] = count.get(name, 0) + 1
        article, boiler, link, heading, keep = article + e.article, boiler + e.boiler, link + e.link, heading + e.heading, keep + e.keep
    flush()
    for k in range(len(hints) - 1, -1, -1):  # elements come after those around them
        if around[k] >= 0:
            words_in[around[k]] += words_in[k]
    total = sum(b.words for b in out)
    return [b if k < 0 else b._replace(hint=hints[k][0], half_hint=hints[k][1], beside=1 - words_in[k] / total) for b, k in zip(out, owner, strict=True)]


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "article", "boiler", "heading", "hint", "half_hint", "beside")


def features(found: list[TextBlock]) -> list[tuple[float, ...]]:
    """A row for each block; beyond the page's ends there is no word and no link."""
    ends = [(0, 0.0), *((b.words, b.link_density) for b in found), (0, 0.0)]
    return [(b.words, b.link_density, *ends[k], *ends[k + 2], b.article, b.boiler, b.heading, b.hint, b.half_hint, b.beside) for k, b in enumerate(found)]


class Leaf(NamedTuple):
    keep: bool


class Split(NamedTuple):
    feature: int
    at_most: float
    left: Leaf | Split
    right: Leaf | Split


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2) -> Leaf | Split:
    """CART under the Gini index; ties in gain go to the first feature and the lowest threshold."""
    share = labels.mean() if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return Leaf(bool(share >= 0.5))
    best, chosen = 1e-9, None
    whole = 2 * share * (1 - share)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = rows[:, f] <= cut
            n = left.sum()
            if min(n, len(labels) - n) < least:
                continue
            p, q = labels[left].mean(), labels[~left].mean()
            gain = whole - (n * 2 * p * (1 - p) + (len(labels) - n) * 2 * q * (1 - q)) / len(labels)
            if gain > best:
                best, chosen = gain, (f, float(cut), left)
    if chosen is None:
        return Leaf(bool(share >= 0.5))
    f, cut, left = chosen
    return Split(f, cut, train(rows[left], labels[left], depth - 1, least), train(rows[~left], labels[~left], depth - 1, least))


def decide(tree: Leaf | Split, row: tuple[float, ...]) -> bool:
    while isinstance(tree, Split):
        tree = tree.left if row[tree.feature] <= tree.at_most else tree.right
    return tree.keep


_LONG = "The river rose again in the night and by morning the lower fields lay under water as far as the mill."
_MID = "Nobody on the farm had seen it so high before."
#: Labelled pages: text under data-keep is main text, all other is not.
LABELLED = (
    f'<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul></nav><div class="ad">Buy two and get one free today.</div><article data-keep><h1>Flood</h1><p>{_LONG}</p><p>{_MID}</p><p>Rain.</p><p>{_LONG}</p></article><footer>&copy; The Valley Post</footer>',
    f'<header><a href=1>The Valley Post</a></header><main data-keep><h1>A long dry summer</h1><p>{_LONG} <a href=2>More on the mill</a></p><p>{_MID}</p><ul><li>Water</li><li>Salt</li></ul></main><aside><h2>Popular</h2><p>{_LONG}</p></aside><footer><a href=1>About</a> <a href=2>Terms</a></footer>',
    f'<div class="cookie-notice">We use cookies to make this site work better for you. <a href=1>Accept</a></div><article><div data-keep><h2>Bread</h2><p>Yes.</p><p>{_LONG}</p><p><a href=1>{_MID}</a></p></div><section class="comments"><p>{_LONG}</p><p>I agree with every word of this.</p></section></article><footer>All rights reserved.</footer>',
    f'<ul><li><a href=1>Start</a></li><li><a href=2>Archive</a></li><li><a href=3>Contact</a></li></ul><div data-keep>{_LONG} {_LONG}</div><div data-keep>{_LONG} {_MID}</div><div data-keep>{_LONG}</div><p><a href=1>Next</a></p><p><a href=1>Back</a></p><p>Printed here</p>',
    f'<div><a href=1>Log in</a> <a href=2>Register</a></div><div><a href=3>All topics</a></div><h1 data-keep>How the mill was built in the old days</h1><div data-keep>{_LONG} {_LONG} {_LONG}</div><div data-keep>{_MID} {_LONG}</div><div><a href=1>Older</a></div><div>Page 1 of 3</div><div><a href=2>Newer</a></div>',
    f'<nav><a href=1>A</a></nav><article data-keep><p>Short.</p></article><form><label>Your name</label><p>Write to us and we will answer within two working days if we can.</p></form><footer>Imprint</footer>',
    f'<div id="sidebar"><p>{_LONG}</p><p>{_MID}</p></div><article data-keep><p>{_MID}</p><p>One.</p><p>Two.</p><p><a href=1>Three.</a></p></article><div class="promo"><p>{_LONG}</p></div><div class="social"><a href=1>Share</a></div>',
    f'<table><tr><td><a href=1>Maps</a></td><td><a href=2>Mail</a></td></tr></table><p data-keep>{_LONG}</p><p data-keep>{_LONG} {_MID}</p><p data-keep>{_LONG}</p><p data-keep>{_LONG} <a href=1>the mill</a></p><p><a href=1>Imprint</a> <a href=2>Privacy</a></p>',
    f'<div class="banner">{_MID}</div><article data-keep><h1>{_MID}</h1><p>{_LONG}</p><h2>Afterwards</h2><p>{_LONG}</p><blockquote>{_MID}</blockquote></article><div class="related"><p><a href=1>{_MID}</a></p><p><a href=2>{_LONG}</a></p></div><footer><p>{_LONG}</p></footer>',
    f'<nav>{_MID}</nav><article data-keep><p>{_LONG} {_LONG}</p></article><footer>{_MID}</footer><div class="ad">{_LONG}</div>',
    f'<div class="ad">{_LONG}</div><div data-keep>{_LONG} {_LONG}</div><div class="newsletter">{_LONG}</div><div data-keep>{_LONG} {_MID}</div><footer>{_MID} {_LONG}</footer>',
    f'<header>{_LONG}</header><div data-keep>{_LONG} {_LONG}</div><div data-keep>{_MID} {_LONG}</div><aside>{_LONG} {_MID}</aside><div data-keep>{_LONG}</div><section id="comments"><p>{_LONG} {_LONG}</p><p>{_LONG}</p><p>{_MID}</p></section>',
    f'<nav>Go</nav><article data-keep><p>{_LONG} {_LONG}</p><p>{_LONG} {_LONG}</p></article><footer>The end.</footer><aside>{_LONG} {_LONG} {_LONG}</aside><form><p>{_LONG} {_LONG}</p><p>{_MID}</p></form>',
    f'<div class="notice"><p>{_LONG} {_LONG}</p></div><div class="sidebar"><p>{_LONG} {_MID}</p><p>{_LONG}</p></div><article data-keep><p>No.</p><p>{_LONG}</p></article><div class="related">{_LONG} {_LONG}</div>',
    f'<article data-keep><p><a href=1>{_MID}</a></p><p>{_MID}</p></article>',
    f'<article data-keep><p><a href=1>{_LONG}</a></p><p>{_LONG}</p><p>So.</p></article>',
    f'<nav><a href=1>{_MID}</a></nav><article data-keep><p>{_LONG}</p></article>',
    f'<article data-keep><p>{_LONG}</p><p><a href=1>{_MID}</a></p><p>The end.</p></article><footer>&copy;</footer>',
    f'<article data-keep><p><a href=1>Yes.</a></p><p>No.</p></article><footer>2001</footer>',
    f'<article data-keep><p><a href=1>{_MID}</a></p><p>Or not.</p><p>So.</p></article>',
    f'<main data-keep><p><a href=1>{_MID}</a></p><p>But then it did.</p></main>',
)
#: Paragraphs of articles, each with something that stands beside it; no text is in two of them.
ARTICLES = (
    (("Court clears the harbour company", "Three judges found on Tuesday that the company had kept to its licence when it dredged the eastern channel.", "The fishermen who had sued it will have to pay their own costs.", "An appeal is open until spring, and their lawyer said that he would read the ruling first.", "Nothing will change in the harbour until then, since the dredgers left in autumn and won't be back before the summer.", "The company's shares rose a little."),
     ("I have been out there every day for forty years and never saw so little cod.", "Same here.", "Who pays for the nets that they tore, does anybody know?")),
    (("Who looks good for Saturday", "Quiet Harbour has won both starts on soft ground and carries less weight than last month.", "Her trainer says that she worked well on Monday, and the draw suits her.", "Old Penny wants a longer trip, and the stable hasn't had a winner since the snow went.", "At a price we would rather have the grey, who was stopped twice in the straight when he was third here in the autumn."),
     ("Odds may change without warning, see the rules of the course for all that applies to bets.", "Play with your head and only if you are of age.")),
    (("When the meters are read", "The council will read the water meters in all streets north of the canal between the third and the ninth of May.", "Please leave the cellar door open, or write down the figures yourself and hand them in at the town hall.", "Whoever has moved since the last reading should say so beforehand.", "Bills go out in June."),
     ("Would you like to get our best stories each Friday morning? Leave your address and we will send them to you.", "You can leave at any time.")),
    (("Why bees dance", "Bees tell each other where to fly by dancing, and the angle of the dance stands for the angle to the sun.", "In the dark of the hive the sun is straight up, so the dancer has to turn all that she saw by a quarter.", "Her sisters read it with their feelers and are rarely wrong by more than a few steps in a hundred.", "How they learn it nobody has seen yet, for young bees dance badly when there is no old one to follow.", "It is the only such speech among insects."),
     ("The ten most read pieces of the month, chosen by our editors for you from all that appeared in print.", "More of them are in the archive, where you can look for words and for days.")),
)
#: Names of elements around whole articles, and of elements beside them.
WHOLE = ("story legal", "post form-guide", "entry notice", "content tags", "article social-text", "legal", "notice", "page-content login-free", "post header-image", "ad-free story text", "main sidebar-right column", "entry")
BESIDE = ("comments", "user-comments", "sidebar", "sidebar-widget", "newsletter-box", "promo", "related-posts", "site-notice", "legal", "share social", "cookie-banner", "ad-slot", "footer-text", "subscribe-form")


def composed() -> list[str]:
    """Pages of articles under each name of WHOLE with an element of each name of BESIDE before, within or after them, and
    pages on which something else is longer than the article."""
    pages = []
    for i, whole in enumerate(WHOLE):
        for j, beside in enumerate(BESIDE):
            (title, *said), other = ARTICLES[(i + j) % len(ARTICLES)]
            other = f'<div class="{beside}">' + "".join(f"<p>{t}</p>" for t in other) + "</div>"
            paragraphs = [f"<h2>{title}</h2>", *(f"<p>{t}</p>" for t in said)]
            k = (0, len(paragraphs) // 2, len(paragraphs))[(2 * i + j) % 3]
            inner = "<div data-keep>" + "".join(paragraphs[:k]) + "</div>" + other + "<div data-keep>" + "".join(paragraphs[k:]) + "</div>"
            # none, a line or a third of the page's words stand beside the whole
            rest = " ".join(ARTICLES[(i + j + 1) % len(ARTICLES)][1])
            around = ("", "<footer>The Valley Post</footer>", f"<aside>{rest}</aside><footer>{rest}</footer>")[(i + 2 * j) % 3]
            pages.append(f'<div class="{whole}">{inner}</div>{around}')
    for i, large in enumerate(("comments", "user-comments", "comments-area", "sidebar", "related", "popup", "related-posts", "newsletter")):
        (title, said, *_), _ = ARTICLES[i % len(ARTICLES)]
        others = "".join(f"<p>{t}</p>" for k, (own, _) in enumerate(ARTICLES) if k != i % len(ARTICLES) for t in own)
        pages.append(f'<div data-keep><h2>{title}</h2><p>{said}</p></div><div id="{large}">{others}</div>')
    return pages


_trained: list[Leaf | Split] = []


def tree() -> Leaf | Split:
    if not _trained:
        found = [blocks(p) for p in (*LABELLED, *composed())]
        rows = np.array([r for b in found for r in features(b)], dtype=float)
        _trained.append(train(rows, np.array([b.keep for p in found for b in p], dtype=float)))
    return _trained[0]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    model = tree()
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(model, row))


def _extract(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(column).to_pylist()]
            yield batch.drop_columns([column]).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    return run


def extract_text(df: DataFrame, column: str = "html") -> DataFrame:
    """`df` with `text` and `n_chars` (code points) in place of `column`.

    Character references are decoded, white space within a block is one blank, blocks are trimmed and
    joined by a line feed in page order; nothing is capped. A null or empty page, or one without main
    text, gives the empty text. Rows are independent; columns named text or n_chars are replaced.
    """
    rest = [f for f in df.schema.fields if f.name not in (column, "text", "n_chars")]
    pages = spread(df).select(*(F.col(f"`{f.name}`") for f in rest), F.col(column).cast("string").alias(column))
    return pages.mapInArrow(tidy(_extract(column)), T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
