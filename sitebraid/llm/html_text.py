"""Main text of web pages by consensus of each host's pages.

First every page scores its containers by the paragraphs in them and votes for the generalised tag-class
paths of its best ones. Votes are summed per host and path in Spark, before the shuffle and after it, and
each host keeps its few best paths. Then every page is read again and the text under its host's best path
that it has is returned; a page that has none of them falls back on its own best container.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, slices, write_table

#: Paths a page votes for, paths a host keeps, and the least share of the host's votes that a later one needs.
VOTES_A_PAGE, PATHS_A_HOST, LEAST_SHARE = 3, 4, 0.05
#: Hosts whose paths are broadcast, those with the most pages; pages of the others meet theirs in a join.
BROADCAST_HOSTS = 10_000

# How HTML's elements behave, and what names page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
TO_THE_END = frozenset("script style textarea title".split())  # without an end tag they take the rest of the page
NESTING = frozenset("svg math object template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt td th pre blockquote figcaption caption".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
FURNITURE_TAGS = frozenset("nav footer aside button dialog head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus disclaimer footer gdpr login menu modal nav navbar navigation navi newsletter notice notification overlay pager pagination paywall popup promo promoted promotion related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
HEADERS = frozenset(["header", "masthead", "topbar", "pageheader"])
NEVER_FURNITURE = frozenset(["html", "body", "main", "article"])
CONTENT = frozenset("article body content entry main post story text".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[\d_/-]+")


@lru_cache(maxsize=50_000)
def _kind(tag: str, attributes: str) -> tuple[str, int]:
    """The element's part of a generalised path, and whether it is furniture (2), a header (1) or neither (0)."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of a name counts
    names = (html.unescape(found.get("class", "")) + " " + html.unescape(found.get("id", ""))).split()
    general = sorted({g for n in html.unescape(found.get("class", "")).lower().split() if (g := _DIGITS.sub("", n))})[:3]
    part = tag + "".join("." + g for g in general)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag in NEVER_FURNITURE:
        return part, 0
    if tag in FURNITURE_TAGS or hidden or found.get("role", "").lower() in FURNITURE_ROLES:
        return part, 2
    for n in names:
        words = [w.lower() for w in _SPLIT.findall(n)]
        if words and words[0] in ("has", "with", "no", "is", "non", "without"):
            continue
        if n.lower() in FURNITURE or words and (words[0] in FURNITURE or words[-1] in FURNITURE):
            return part, 2
        if words and (words[0] in HEADERS or words[-1] in HEADERS):
            return part, 1
    return part, int(tag == "header")


#: Least characters of paragraphs in a form that holds the page's text rather than controls.
FORM_TEXT = 140


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile("</" + tag, re.IGNORECASE | re.ASCII)


@lru_cache(maxsize=64)
def _raw_tags(tag: str) -> re.Pattern:
    return re.compile(f"<(/?){tag}(?![a-z0-9-])", re.IGNORECASE | re.ASCII)


def _raw_ends(source: str, tag: str) -> dict[int, int]:
    """Where each hidden element of a tag ends, by where its start tag begins; those that never end are left out.

    Elements that may nest are matched by depth, of the others a further start is where the one before goes on as text.
    """
    ends, open_ = {}, []
    for m in _raw_tags(tag).finditer(source):
        if not m[1]:
            if open_ and tag not in NESTING:
                open_.clear()
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.start()
    return ends


#: Open elements that a start tag may close, by tag.
_CLOSES = {tag: frozenset(open_ for open_, closers in CLOSED_BY.items() if tag in closers) for tag in frozenset().union(*CLOSED_BY.values())}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl tr tbody table blockquote li".split())


class Page:
    """A page's elements and the text blocks that aren't furniture, in page order. Memory and time grow with the source, however deep it nests."""

    def __init__(self, source: str):
        # a block element: its tag, parent, part of a path, a hash of its whole path, and the nearest element at or above it that isn't a list
        self.tags, self.parents, self.parts, self.hashes, self.homes = ["#"], [0], [""], [hash("")], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        stack = [(0, "#", 0, False, False, False)]  # element, tag, furniture, in an article's header, in an article, in a heading
        opened: Counter = Counter()  # open elements by tag
        words: list[str] = []
        links = anchor = 0
        at, pending, form, forms = 0, 0, 0, 0
        in_form: list[int] = []  # the form of each block, 0 for none
        hidden: dict[str, dict[int, int]] = {}

        def flush() -> None:
            nonlocal links
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.blocks.append((pending, text, links))
                    in_form.append(form if opened["form"] else 0)
                words.clear()
            links = 0

        def close(k: int) -> None:
            for s in stack[k:]:
                opened[s[1]] -= 1
            del stack[k:]

        while True:
            found = _TAG.search(source, at)
            stop = found.start() if found else len(source)
            if stop > at and not stack[-1][2]:
                owner, tag, _, in_header, _, in_heading = stack[-1]
                if not in_header or in_heading:
                    text = source[at:stop]
                    text = html.unescape(text) if "&" in text else text
                    if not words:
                        pending = owner
                    words.append(text)
                    if anchor:
                        links += len(text)
            if not found:
                break
            at = found.end()
            name = found[2]
            if name is None:
                continue
            if not found[4]:  # cut off within a tag
                break
            tag = name.lower()
            if found[1]:
                if not opened[tag]:
                    if tag in BLOCKS:
                        flush()
                    continue
                k = len(stack) - 1
                while k > 0 and stack[k][1] != tag:
                    if tag not in BLOCKS and stack[k][1] in BLOCKS:
                        k = 0  # an inline end doesn't close blocks
                        break
                    k -= 1
                if tag in BLOCKS:
                    flush()
                if k > 0:
                    close(k)
                if tag == "a":
                    anchor = max(0, anchor - 1)
                continue
            if tag in BLOCKS:
                flush()
                anchor = 0
            if any(opened[t] for t in _CLOSES.get(tag, ())):
                for k in range(len(stack) - 1, 0, -1):  # ends that HTML lets authors leave out
                    open_tag = stack[k][1]
                    if tag in CLOSED_BY.get(open_tag, ()):
                        close(k)
                        break
                    if open_tag in SCOPES.get(tag, ()) or tag == "p" and open_tag in BLOCKS or open_tag in ("table", "body"):
                        break
            part, kind = _kind(tag, found[3])
            if tag == "br" or tag == "wbr" or tag == "img":
                if words and tag != "wbr":
                    words.append(" ")
            if tag in VOID or found[3].endswith("/") and tag not in BLOCKS and (tag not in RAW or tag in ("svg", "math")) and tag not in ("a", "b", "i", "span", "em", "strong"):
                continue
            owner, _, furniture, in_header, inside, in_heading = stack[-1]
            if tag in RAW:
                if tag in TO_THE_END:
                    end = _raw_end(tag).search(source, at)
                    if not end:
                        break
                    at = end.start()
                else:
                    if tag not in hidden:
                        hidden[tag] = _raw_ends(source, tag)
                    if found.start() not in hidden[tag]:
                        continue  # never closed: what follows is the page's
                    at = max(at, hidden[tag][found.start()])
                stack.append((owner, tag, 2, False, inside, in_heading))
                opened[tag] += 1
                continue
            if tag == "a":
                anchor += 1
            if tag == "form" and not opened["form"]:
                forms += 1
                form = forms
            if tag in BLOCKS:
                self.tags.append(tag)
                self.parents.append(owner)
                self.parts.append(part)
                self.hashes.append(hash((self.hashes[owner], part)))
                self.homes.append(self.homes[owner] if tag in _LISTS else len(self.tags) - 1)
                owner = len(self.tags) - 1
            stack.append((owner, tag, furniture or 2 * (kind == 2 or kind == 1 and not inside), in_header or kind == 1 and inside, inside or tag in ("article", "main"), in_heading or tag in _HEADINGS))
            opened[tag] += 1
        flush()
        if forms:
            self._drop_forms(in_form)

    def _drop_forms(self, in_form: list[int]) -> None:
        """Leaves out the blocks of forms, but for one that is mostly paragraphs and holds more of them than the page around its forms."""
        prose, whole = Counter(), Counter()
        for (owner, text, links), f in zip(self.blocks, in_form, strict=True):
            whole[f] += len(text)
            if self.tags[owner] in LEAVES and links <= 0.5 * len(text):
                prose[f] += len(text)
        kept = {f for f in prose if f == 0 or prose[f] >= FORM_TEXT and 2 * prose[f] > whole[f] and prose[f] > prose[0]} | {0}
        self.blocks = [b for b, f in zip(self.blocks, in_form, strict=True) if f in kept]

    def path(self, i: int) -> str:
        """The parts from the top down to an element."""
        parts = []
        while i:
            parts.append(self.parts[i])
            i = self.parents[i]
        return "".join("/" + p for p in reversed(parts))

    def at_path(self, path: str) -> set[int]:
        """The elements with this path, by its hash; the first of them is compared part by part."""
        parts = path.split("/")[1:]
        wanted = hash("")
        for p in parts:
            wanted = hash((wanted, p))
        found = [i for i, h in enumerate(self.hashes) if h == wanted]
        return set(found) if found and self.path(found[0]) == path else set()

    def ranked(self) -> list[tuple[float, int]]:
        """Containers, best first: what their paragraphs score, more for elements that say they hold content."""
        scores = np.zeros(len(self.tags))
        for owner, text, links in self.blocks:
            n = len(text)
            if links > 0.5 * n:
                continue
            value = 1 + min(n, 2000) / 100 + min(text.count(","), 20) / 4
            if self.tags[owner] in LEAVES:
                owner = self.homes[self.parents[owner]]
            scores[owner] += value
            above = self.parents[owner]
            if owner:
                scores[above] += value / 2
        out = []
        for i in np.flatnonzero(scores).tolist():
            tag, part = self.tags[i], self.parts[i]
            weight = 2.0 if tag == "article" else 1.6 if tag == "main" else 1.0
            if not CONTENT.isdisjoint(_NAMES.findall(part.partition(".")[2])):
                weight *= 1.25
            if tag in ("html", "#"):
                weight *= 0.3
            elif tag == "body":
                weight *= 0.6
            out.append((scores[i] * weight, i))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def text_under(self, roots: set[int]) -> str:
        inside = [i in roots for i in range(len(self.tags))]
        for i in range(1, len(self.tags)):
            inside[i] = inside[i] or inside[self.parents[i]]
        return "\n".join(text for owner, text, _ in self.blocks if inside[owner])

    def extract(self, paths: list[str]) -> str:
        for path in paths:
            roots = self.at_path(path)
            if roots and (text := self.text_under(roots)):
                return text
        best = self.ranked()
        return self.text_under({best[0][1]}) if best else ""


def _host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _narrow(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, pages, paths (best first) of every host; a url that names none counts as the host ''."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text="html"):
            votes: dict[tuple[str, str], list[float]] = {}
            for url, source in zip(column(batch, "url").to_pylist(), column(batch, "html").to_pylist(), strict=True):
                page, host = Page(source), _host(url)
                ranked = page.ranked()[:VOTES_A_PAGE]
                total = sum(s for s, _ in ranked)
                if not ranked:
                    votes.setdefault((host, ""), [0, 0.0])[0] += 1
                for k, (score, i) in enumerate(ranked):
                    held = votes.setdefault((host, page.path(i)), [0, 0.0])
                    held[0] += k == 0
                    held[1] += (k == 0) + score / total
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k][0] for k in keys], pa.int64()), pa.array([votes[k][1] for k in keys], pa.float64())], ["host", "path", "pages", "votes"])

    sums = _narrow(pages).select("url", "html").mapInArrow(vote, "host string, path string, pages long, votes double").groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.round(F.sum("votes"), 6).alias("votes"))
    # a host's paths are ranked from the sums; Spark keeps the best few of each task before it deals them out
    best = sums.where(F.col("path") != "").withColumn("place", F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("place") <= PATHS_A_HOST)
    kept = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path", "votes"))).alias("p"), F.sum("votes").alias("all"))
    kept = kept.select("host", F.expr(f"transform(filter(p, x -> x.place = 1 or x.votes >= {LEAST_SHARE} * all), x -> x.path)").alias("paths"))
    return sums.groupBy("host").agg(F.sum("pages").alias("pages")).join(kept, "host", "left").withColumn("paths", F.coalesce("paths", F.expr("cast(array() as array<string>)")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null html counts as empty and gives an empty text, as does a page without text; repeated rows stay
    repeated; a null or malformed url is the host ''. Paths of the hosts with the most pages are
    broadcast (BROADCAST_HOSTS at most); pages of other hosts meet their paths in a shuffle join.
    """
    narrow = _narrow(pages)
    hosts = write_table(host_paths(narrow), "hosts")
    large = hosts.orderBy(F.desc("pages"), "host").limit(BROADCAST_HOSTS).select("host", "paths").collect()
    known = {r["host"]: list(r["paths"]) for r in large}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text="html"):
            own = column(batch, "paths").to_pylist() if "paths" in batch.schema.names else None
            texts, keep = [], []
            for i, (url, source) in enumerate(zip(column(batch, "url").to_pylist(), column(batch, "html").to_pylist(), strict=True)):
                paths = own[i] if own is not None else known.get(_host(url))
                if paths is not None:
                    keep.append(i)
                    texts.append(Page(source).extract(list(paths)))
            if keep:
                chosen = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([column(chosen, "page_id"), column(chosen, "url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=RESULT)

    schema = "page_id long, url string, text string, n_chars long"
    result = narrow.mapInArrow(read, schema)
    if len(known) < BROADCAST_HOSTS:
        return result

    @F.pandas_udf("string")
    def host_of(urls: pd.Series) -> pd.Series:
        return urls.map(_host)

    rest = narrow.withColumn("host", host_of("url")).join(F.broadcast(hosts.sparkSession.createDataFrame([(h,) for h in known], "host string")), "host", "left_anti").join(hosts.select("host", "paths"), "host")
    return result.unionByName(rest.select("page_id", "url", "html", "paths").mapInArrow(read, schema))
