"""HTML extraction by consensus host paths (operator 2).

Each page is parsed once into a tree of containers and blocks of text. Containers are scored by the text below them; one
is named by its path of tags and generalised classes. Pages vote for their paths with shares of their score, votes are
summed per host in Spark, and the main text is taken from a host's winning path, or where a page lacks it, from the page's
own best container. Only the parsed blocks meet the winners, never the html. Time and memory grow with a page's length,
however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import map_arrow, written

#: Winning paths (a host's name and a number) are sent to every worker up to so many hosts; beyond it blocks and paths meet
#: in a join whose hosts are dealt to SALTS parts each.
HOSTS, SALTS = 200_000, 64
#: Points that a page deals out to its containers.
POINTS = 1000
DECAY = 0.5

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is never text of the page.
RAW = frozenset("script style noscript template textarea title svg math iframe object audio video canvas".split())
UNWANTED = frozenset("nav footer aside form button dialog menu select search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form alertdialog".split())
#: Words of a class or id that tell what isn't the article.
WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus dropdown footer gdpr header hidden links login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies respond rss search share sharing shop sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar tooltip topbar trending widget".split()
)
GOOD = frozenset("article body content entry main page post story text".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "p": BLOCKS - {"body", "html"}, "head": {"body"} | (BLOCKS - {"html"})}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_parts = re.compile(r"[A-Za-z]+|[0-9]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page(NamedTuple):
    """Containers, the first of which is the page itself: number of the parent, hash of the path of names, name. Blocks in
    page order: text, characters of it within links, number of the container."""

    parents: list[int]
    paths: list[int]
    names: list[str]
    texts: list[str]
    linked: list[int]
    at: list[int]


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _attribute.finditer(raw)}


def name_of(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes, or the id where there is none; runs of digits are generalised."""
    label = " ".join(sorted(attrs.get("class", "").split())) or attrs.get("id", "")
    return tag + ("." + re.sub(r"[0-9]+", "#", label).replace(" ", ".") if label else "")


def unwanted(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element isn't part of the article. A header within an article is."""
    if tag in UNWANTED or tag == "header" and not inside or attrs.get("role", "").lower() in ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main") or not ("class" in attrs or "id" in attrs):
        return False
    found = {w.lower() for w in _parts.findall(_camel.sub(" ", attrs.get("class", "") + " " + attrs.get("id", "")))}
    return bool(found & WORDS - ({"header", "byline"} if inside else set()))


class Open(NamedTuple):
    """An open element: its tag, whether text in it is wanted, whether it lies in an article, its container (its own or that
    around it), and where on the stack the nearest element stands that others may end."""

    tag: str
    wanted: bool
    inside: bool
    container: int
    near: int


def parsed(page: str) -> Page:
    """The page's containers, and its wanted blocks of text with white space already made single."""
    out = Page([-1], [0], [""], [], [], [])
    stack = [Open("", True, False, 0, -1)]
    tags: Counter = Counter()
    text: list[str] = []
    links = linked = 0

    def close() -> None:
        nonlocal linked
        if text:
            if stack[-1].wanted:
                joined = " ".join("".join(text).split())
                if joined:
                    out.texts.append(joined)
                    out.linked.append(linked)
                    out.at.append(stack[-1].container)
            text.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal links
        if any(s.tag in BLOCKS for s in stack[k:]):
            close()
        for s in stack[k:]:
            tags[s.tag] -= 1
            links -= s.tag == "a"
        del stack[k:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            shown = html.unescape(raw) if "&" in raw else raw
            text.append(shown)
            if links:
                linked += len(shown)

    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < end:
        m = _token.search(page, at, last) if at < last else None
        if not m:
            rest = page[at:]
            cut = rest.find("<!--")
            add(rest if cut < 0 else rest[:cut])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that never ends
            continue
        tag = tag.lower()
        if closing:
            if tags[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            elif tag in BLOCKS:
                close()
            continue
        if tag in RAW:
            if not raw.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            text.append(" ")
        elif tag in VOID:
            if tag in BLOCKS:
                close()
        else:
            if tag in BLOCKS:
                close()
            while (near := stack[-1].near) > 0 and tag in ENDS.get(stack[near].tag, ()):
                pop(near)
            attrs = attributes(raw) if raw.strip("/ \n\t\r") else {}
            around = stack[-1]
            container = around.container
            if tag in BLOCKS:
                name = name_of(tag, attrs)
                out.parents.append(container)
                out.paths.append(xxhash.xxh3_64_intdigest(name, seed=out.paths[container]) >> 1)
                out.names.append(name)
                container = len(out.names) - 1
            ends = tag in BLOCKS or tag == "head"
            stack.append(Open(tag, around.wanted and not unwanted(tag, attrs, around.inside), around.inside or tag in ("article", "main"), container, len(stack) if ends else around.near))
            tags[tag] += 1
            links += tag == "a"
    close()
    return out


def scores(page: Page) -> np.ndarray:
    """Score of each container: the text below it that isn't linked, less by half with each level in between; articles,
    and classes that speak of content, count more. A block's own element is no container of it unless it is the body
    or a division. Children stand behind their parents, so one pass from the end sums all."""
    total = np.zeros(len(page.names))
    for text, linked, at in zip(page.texts, page.linked, page.at, strict=True):
        if page.names[at].partition(".")[0] not in ("", "body", "html", "div", "section", "article", "main", "td"):
            at = page.parents[at]
        total[at] += max(0, len(text) - 2 * linked)
    for k in range(len(total) - 1, 0, -1):
        total[page.parents[k]] += total[k] * DECAY
    for k, name in enumerate(page.names):
        if total[k]:
            tag, _, label = name.partition(".")
            total[k] *= 4 if tag in ("article", "main") else 2 if label and GOOD & set(re.split(r"[^a-z]+", label.lower())) else 1
    return total


def best(total: np.ndarray) -> int:
    """The container of the highest score; of equal ones the first, which lies around the others or before them."""
    return int(total.argmax())


def below(parents: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which containers are among the roots or lie in one."""
    hit = roots.copy()
    for k in range(1, len(parents)):
        hit[k] |= hit[parents[k]]
    return hit


def extract(parents: np.ndarray, paths: np.ndarray, own: int, texts: list[str], at: np.ndarray, path: int | None) -> tuple[str, bool]:
    """Blocks below containers of the path; where the page has none, below its own best container."""
    if not texts:
        return "", False
    keep = below(parents, paths == path)[at] if path is not None else np.zeros(0, bool)
    shared = bool(keep.any())
    if not shared:
        keep = below(parents, np.arange(len(parents)) == own)[at]
    return "\n\n".join(t for t, k in zip(texts, keep.tolist(), strict=True) if k), shared


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


PARSED = "page_id long, url string, host string, parents binary, paths binary, votes binary, own int, texts array<string>, at binary"


def parse(pages: DataFrame) -> DataFrame:
    """Each page as numbers and its blocks: parents (int32) and paths (int64) of its containers, the votes (int32) that it
    gives each, its own best one, the texts and the container of each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = []
        for page in batch.column("html").to_pylist():
            p = parsed(page or "")
            total = scores(p)
            whole = total.sum()
            votes = np.rint(POINTS * total / whole).astype(np.int32) if whole else np.zeros(len(total), np.int32)
            got.append((np.array(p.parents, np.int32).tobytes(), np.array(p.paths, np.int64).tobytes(), votes.tobytes(), best(total), p.texts, np.array(p.at, np.int32).tobytes()))
        parents, paths, votes, own, texts, at = zip(*got, strict=True)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *(pa.array(x, pa.binary()) for x in (parents, paths, votes)), pa.array(own, pa.int32()), pa.array(texts, pa.list_(pa.string())), pa.array(at, pa.binary())], names=[f.split()[0] for f in PARSED.split(", ")])

    return map_arrow(pages.select("page_id", "url", "host", "html"), run, PARSED, "html")


def winners(pages: DataFrame) -> DataFrame:
    """host, path: the path with most votes on each host; of equal votes the one with the smallest depth, then with the
    smallest hash. Votes of a batch are summed before they are shuffled."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter = Counter()
            for name, parents, paths, given in zip(*(batch.column(c).to_pylist() for c in ("host", "parents", "paths", "votes")), strict=True):
                parents, paths, given = np.frombuffer(parents, np.int32), np.frombuffer(paths, np.int64), np.frombuffer(given, np.int32)
                depth = np.zeros(len(parents), np.int32)
                for k in range(1, len(parents)):
                    depth[k] = depth[parents[k]] + 1
                for k in np.flatnonzero(given):
                    votes[name, int(paths[k]), int(depth[k])] += int(given[k])
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes], pa.int64()), pa.array([k[2] for k in votes], pa.int32()), pa.array(votes.values(), pa.int64())], names=["host", "path", "depth", "n"])

    summed = pages.select("host", "parents", "paths", "votes").mapInArrow(vote, "host string, path long, depth int, n long").groupBy("host", "path").agg(F.sum("n").alias("n"), F.min("depth").alias("depth"))
    return summed.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "depth", "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of df: page_id, url, text, n_chars (code points), shared (whether the host's path gave the text).
    Null or empty html and pages without wanted text give the empty text. Null or odd urls form a host of their own.
    Repeated rows vote and are extracted each; other columns are left out; an empty table gives no rows."""
    pages = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html")).withColumn("host", host(F.col("url")))
    tree = written(parse(pages))
    won = written(winners(tree))
    if won.count() <= HOSTS:
        joined = tree.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = tree.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(c).to_pylist() for c in ("parents", "paths", "own", "texts", "at", "path"))
        got = [extract(np.frombuffer(p, np.int32), np.frombuffer(h, np.int64), own, texts, np.frombuffer(at, np.int32), path) for p, h, own, texts, at, path in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([s for _, s in got], pa.bool_())], names=["page_id", "url", "text", "n_chars", "shared"])

    return map_arrow(joined.select("page_id", "url", "parents", "paths", "own", "texts", "at", "path"), run, "page_id long, url string, text string, n_chars long, shared boolean")
