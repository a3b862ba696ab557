"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of text runs and tags.  Words score positive where labelled
pages have content and negative elsewhere, tags score negative; one linear scan
finds the contiguous region of the largest sum.  Elements that never are content
(scripts, forms, navigation, adverts, comments and so on, by tag, role, class or
id) count against the region and give it no text.

The weights are log odds, fitted on at most ``sample`` pages that label their
own content with an article element; the chosen pages are those of the least
hashes of their id.  Without labelled pages the prior weights hold.

Defined results: null or empty html, and pages without content, give empty text;
barred p, li, td, th, dt, dd and option end at the tag that implies their end, other
unclosed elements with their page; an unclosed comment or script hides the
rest; repeated rows are kept; an empty table gives no rows; other columns,
``text`` and ``n_chars`` excepted, pass through.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from busweave.llm.words import slices

SAMPLE = 1000

# Elements of the HTML standard by their role here.
_RAW = "script|style|noscript|template|textarea|svg|iframe|object|select|title|annotation|annotation-xml"
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head nav footer aside form button dialog menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|nav\w*|menus?|sidebars?|side|footer|"
    r"masthead|topbar|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|"
    r"commentlist|discussion|repl(?:y|ies)|respond|disqus|widgets?|toolbar|pagination|pager|copyright|"
    r"legal|disclaimer|hidden|site-header|page-header)(?=$|[\s_\d-])",
    re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""display\s*:\s*none|\baria-hidden\s*=\s*["']?true|\shidden(?=[\s>=]|$)""", re.I)
_BLOCKS = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul "
)
_ROW_END = "tr tbody thead tfoot "
# element with an optional end tag: (start tags that imply it, elements inside which they do not)
_IMPLIED = {
    "p": (frozenset((_BLOCKS + _ROW_END + "li dt dd td th").split()), frozenset()),
    "option": (frozenset("option optgroup".split()), frozenset()),
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset("dt dd".split()), frozenset(["dl"]))),
    **dict.fromkeys(("td", "th"), (frozenset((_ROW_END + "td th").split()), frozenset(["table"]))),
}
_MATH = frozenset("math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder "
                  "munderover mtable mtr mtd mstyle mpadded mphantom mfenced menclose mmultiscripts".split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?:{_RAW})(?:/|\s(?>[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=[\s\"']/))>"
    rf"|<({_RAW})\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_CONTENT = frozenset("article main".split())
_CONTEXTS = ("word", "link", "item", "barred")

_PRIOR = {"word": 1.0, "link": -0.5, "item": 0.5, "barred": -0.05}
_PRIOR_TAG = -0.3
_PRIOR_ROWS = 20.0


def _barred(name: str, attributes: str, inside: int) -> bool:
    """True if an element never holds main text."""
    if name in _NEVER or name == "header" and not inside:
        return True
    if not attributes:
        return False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if kind.lower() == "role":
            if value.strip().lower() in _ROLES:
                return True
        elif name not in ("html", "body", "article", "main") and _MARKS.search(value):
            return True
    return bool(_HIDDEN.search(attributes))


def _ends(closing: str, name: str, end: bool, opened: list[str]) -> bool:
    """True if a tag implies the end of the open barred element ``closing``.

    Its successors do, outside nested lists and tables, and so does the end tag
    of a parent: one of an element that was not opened inside.
    """
    if closing not in _IMPLIED:
        return False
    starts, scopes = _IMPLIED[closing]
    if end:
        return name not in (closing, "p", "br") and name not in _INLINE and name not in opened
    return name in starts and not scopes.intersection(opened)


def tokens(page: str):
    """(feature, text, within): tags have text None; words carry their context.

    ``within`` tells whether a labelled content element is open.
    """
    at = barred = link = item = inside = 0
    closing, opened = "", []
    for match in _TOKEN.finditer(page):
        if match.start() > at:
            context = "barred" if barred else "link" if link else "item" if item else "word"
            yield context, page[at : match.start()], inside > 0
        at = match.end()
        name = match[3]
        if name is None:
            continue
        name = name.lower()
        opens = not match[2] and name not in _VOID
        if name in _MATH:
            continue
        if barred and _ends(closing, name, bool(match[2]), opened):
            barred = 0
        if barred:
            if closing in _IMPLIED:
                if opens:
                    opened.append(name)
                elif match[2] and name in opened:
                    del opened[len(opened) - 1 - opened[::-1].index(name) :]
                elif match[2] and name == closing:
                    barred = 0
            elif name == closing:
                barred += 1 if opens else -1
        elif opens and _barred(name, match[4], inside):
            barred, closing, opened = 1, name, []
        elif name == "a":
            link = int(opens)
        elif name in ("li", "td", "th", "dt", "dd", "option"):
            item = int(opens)
        elif name in _CONTENT:
            inside = max(0, inside + (1 if opens else -1))
        yield "/" + name if match[2] else name, None, inside > 0
    if at < len(page):
        context = "barred" if barred else "link" if link else "item" if item else "word"
        yield context, page[at:], inside > 0


def main_text(page: str, weights: dict[str, float]) -> str:
    """Text of the best contiguous region, barred elements left out."""
    best = total = 0.0
    first, region = 0, (0, 0)
    parts = list(tokens(page))
    for i, (feature, text, _) in enumerate(parts):
        if text is None:
            total += weights.get(feature, _PRIOR_TAG)
        else:
            total += weights[feature] * len(text.split())
        if total <= 0:
            total, first = 0.0, i + 1
        elif total > best:
            best, region = total, (first, i + 1)
    out = []
    for feature, text, _ in parts[region[0] : region[1]]:
        if text is None:
            if feature.lstrip("/") not in _INLINE:
                out.append(" ")
        elif feature != "barred":
            out.append(unescape(text))
    return " ".join("".join(out).split())


def _counts(batches):
    for batch in batches:
        found: dict[str, list[int]] = {}
        for page in batch.column("html").to_pylist():
            parts = list(tokens(page or ""))
            if not any(within for *_, within in parts):
                continue
            for feature, text, within in parts:
                n = 1 if text is None else len(text.split())
                row = found.setdefault(feature, [0, 0])
                row[0 if within else 1] += n
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(list(found), pa.string()),
            "inside": pa.array([v[0] for v in found.values()], pa.int64()),
            "outside": pa.array([v[1] for v in found.values()], pa.int64()),
        })


def fit_weights(pages: DataFrame, page: str = "page_id", html: str = "html", sample: int = SAMPLE) -> dict:
    """Weights of words by context and of tags, from self-labelled pages.

    Reads whole pages of at most ``sample`` ids; features are tag names, so the
    fitted table is small.
    """
    chosen = pages.select(F.col(page).alias("__page")).distinct().orderBy(F.xxhash64("__page")).limit(sample)
    labelled = pages.join(
        F.broadcast(chosen), F.col(page).eqNullSafe(F.col("__page")), "left_semi"
    )
    rows = (
        labelled.select(F.col(html).alias("html"))
        .mapInArrow(_counts, "feature string, inside long, outside long")
        .groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(500).collect()
    )
    words = [r for r in rows if r.feature in _CONTEXTS]
    tags = [r for r in rows if r.feature not in _CONTEXTS]
    weights = dict(_PRIOR)
    for group, least, most in ((words, -1.0, 1.0), (tags, -3.0, -0.05)):
        within = sum(r.inside for r in group) + _PRIOR_ROWS
        beyond = sum(r.outside for r in group) + _PRIOR_ROWS
        for r in group:
            odds = math.log((r.inside + 1) / within) - math.log((r.outside + 1) / beyond)
            prior = _PRIOR.get(r.feature, _PRIOR_TAG)
            seen = r.inside + r.outside
            value = (seen * odds / 4 + _PRIOR_ROWS * prior) / (seen + _PRIOR_ROWS)
            weights[r.feature] = min(most, max(least, value))
    weights["word"] = max(weights["word"], 0.25)
    # a barred block inside the content must not outweigh the words after it
    weights["barred"] = _PRIOR["barred"]
    return weights


def _extract(weights: dict, passed: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = [main_text(page or "", weights) for page in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in passed], pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=[*passed, "text", "n_chars"],
                )

    return run


def extract_main_text(
    pages: DataFrame, page: str = "page_id", html: str = "html", sample: int = SAMPLE, weights: dict | None = None
) -> DataFrame:
    """Rows of ``pages`` (html left out) with text and n_chars."""
    weights = weights or fit_weights(pages, page, html, sample)
    passed = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in passed]).add("text", "string").add("n_chars", "long")
    return pages.select(*passed, F.col(html).alias("__html")).mapInArrow(_extract(weights, passed), schema)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op3_html_extraction": op3_html_extraction}
