"""Main text of web pages: the maximum-scoring run of page tokens.

A page is a sequence of tokens: words and tags. Words score by where they stand (enclosing block, inside a
link, inside boilerplate), tags score below zero; the weights are log-odds counted on labelled pages, those
that mark their own content (``article``, ``main``, ``itemprop=articleBody``). One linear scan finds the
contiguous run with the largest sum. The text is what stands in that run outside boilerplate containers.

Null, empty and wordless pages have an empty text. Unclosed tags, comments and scripts end with the page;
closing tags that nothing opened are ignored; of equal runs the first is taken. Rows are independent, so
repeated rows give repeated results.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.llm import texts

#: Labelled pages used for the weights, by smallest hash of their id.
MOST_PAGES = 2_000

# Fixed element names of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object textarea select button canvas noframes title".split())
OUTSIDE = frozenset("nav footer aside form dialog head menu".split())
CLOSED_BY_BLOCK = frozenset(["p"])
#: Words in class, id and role attributes that name boilerplate.
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent notice notices gdpr popup "
    "modal overlay newsletter subscribe subscription comment comments commentlist disqus reply replies respond sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager share sharing social related recommended recommendations footer header masthead topbar toolbar login signup search widget "
    "contentinfo complementary".split())
_TOKEN = re.compile(
    r'''<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']*+(?:"[^"]*+"|'[^']*+'))*+[^>"']*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>|<[/!?A-Za-z][^>]*+\Z|[^<]++|<''', re.DOTALL)
_NAMED = re.compile(r'''(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?''', re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(attributes: str) -> tuple[set[str], bool]:
    """Lower-case words of class, id and role, and whether the element says that it is the article's body."""
    found: set[str] = set()
    body = False
    if "=" in attributes:
        for name, value in _NAMED.findall(attributes):
            value = value.strip("\"'")
            if name.lower() == "itemprop":
                body |= value.lower() == "articlebody"
            elif name.lower() == "role" and value.lower() == "main":
                body = True
            else:
                found.update(w.lower() for w in _PART.findall(value))
    return found, body


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool, int]]:
    """(feature, text, boilerplate, labelled content, words) in page order; tags have no text.

    Time is proportional to the page's length: an open element carries what words in it need to know.
    """
    # name, boilerplate, content, innermost block, inside a link
    stack: list[tuple[str, bool, bool, str, bool]] = []
    opened: Counter = Counter()
    outermost = ("", False, False, "body", False)
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes = m[1] or m[4] or "", (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        _, off, content, block, link = stack[-1] if stack else outermost
        if not name:
            text = m[0]
            if text[0] == "<" and text[1:2].strip():
                continue
            text = html.unescape(text)
            n = len(text.split())
            if n:
                yield f"word {'off' if off else block}{' a' if link else ''}", text, off, content, n
            else:
                yield "blank", text, off, content, 0
            continue
        if closing:
            if opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                _, off, content, *_ = stack[-1] if stack else outermost
            yield f"tag /{name}" if name in BLOCKS or name in INLINE else "tag other", " " if name in BLOCKS else "", off, content, 0
            continue
        if name in RAW and not attributes.endswith("/"):
            # nothing in it is markup: a "<" of a script would swallow the closing tag
            end = re.compile(rf"</{name}(?![A-Za-z0-9:-])[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCKS and name != "br":
            while stack and (stack[-1][0] in CLOSED_BY_BLOCK):
                opened[stack.pop()[0]] -= 1
            if name == "li" and stack and stack[-1][0] == "li":
                opened[stack.pop()[0]] -= 1
            _, off, content, block, link = stack[-1] if stack else outermost
        marks, body = _marks(attributes)
        body |= name in ("article", "main")
        own = name in OUTSIDE or name == "header" and not content or "hidden" in marks and name not in ("html", "body")
        if name not in ("html", "body", "main", "article", "h1") and not body and marks & HINTS:
            own = True
        yield f"tag {name}" if name in BLOCKS or name in INLINE else "tag other", " " if name in BLOCKS else "", off or own, content, 0
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, off or own, content or body, name if name in BLOCKS else block, link or name == "a"))
            opened[name] += 1


# ------------------------------------------------------------------ weights
def prior(feature: str) -> float:
    """Weight before anything is counted."""
    if feature.startswith("word"):
        return -1.0 if "off" in feature else -0.5 if feature.endswith(" a") else 1.0
    return -0.3


def weight(feature: str, inside: int, outside: int, total_in: int, total_out: int) -> float:
    """Log-odds of a token inside content, pulled towards the prior when it is rare; tags stay negative."""
    odds = math.log((inside + 1) / (total_in + 2)) - math.log((outside + 1) / (total_out + 2))
    seen = inside + outside
    mixed = (odds * seen + 20 * prior(feature)) / (seen + 20)
    if feature.startswith("tag"):
        return min(-0.05, max(mixed, -1.0))
    return min(-0.5, max(mixed, -1.0)) if "off" in feature else max(-1.0, min(mixed, 3.0))


def count(page: str) -> Counter:
    """Of a labelled page: (feature, inside content?) counts; empty for others."""
    found: Counter = Counter()
    labelled = False
    for feature, _, off, content, n in tokens(page):
        if feature != "blank":
            inside = content and not off
            labelled |= inside and n > 0
            found[feature, inside] += n or 1
    return found if labelled else Counter()


def weights(pages: DataFrame, most: int = MOST_PAGES) -> dict[str, float]:
    """Weights of all features (a fixed few hundred at most) from up to ``most`` pages."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("text"))
    ids = texts.written(known.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(most))
    sample = known.join(F.broadcast(ids), "page_id").select("text")

    def run(batches):
        total: Counter = Counter()
        for part in texts.slices(batches):
            for page in part.column("text").to_pylist():
                total.update(count(page))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.int64())], ["feature", "inside", "n"])

    rows = sample.mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o")).collect()
    total_in, total_out = sum(r["i"] for r in rows), sum(r["o"] for r in rows)
    return {r["feature"]: weight(r["feature"], r["i"], r["o"], total_in, total_out) for r in rows}


# ------------------------------------------------------------------ extraction
def main_text(page: str, known: dict[str, float]) -> str:
    """Text of the page's maximum-scoring run, blocks joined by one space."""
    parts = list(tokens(page))
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, (feature, _, _, _, n) in enumerate(parts):
        if feature == "blank":
            continue
        w = known.get(feature)
        total += (prior(feature) if w is None else w) * (n or 1)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i + 1
    return " ".join("".join(text if not off else " " for _, text, off, _, _ in parts[best_from:best_to]).split())


def extract(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    known = weights(pages, most)

    def run(batches):
        for part in texts.slices(batches):
            found = [main_text(p, known) for p in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("text")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
