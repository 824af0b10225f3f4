"""HTML main-text extraction with a host suffix array.

1. A tolerant scan of each page yields its visible blocks in order, each with a role from the markup: ``main`` (inside an article or main element or role), ``drop`` (menus, headers,
   footers, sidebars, notices, adverts, forms, reader comments: by element, role or class words; inside a main element by whole classes and the ids of reader comments only) or ``open`` (undecided). Scripts, styles and other unseen elements are not blocks.
2. Outside the main elements, the tokens of each page's blocks are one stream; all streams of a host are ordered as the suffixes of one text: by host and first
   ``MIN_TOKENS`` tokens. Suffixes with equal first tokens in streams of distinct pages are a long repeated substring, so the tokens that they start are covered. (A
   longer repeat is the union of such runs, so nothing is lost by ordering on the first tokens only.) Pages with the same stream count as one.
3. The text of a page with main blocks is those blocks, whole: the contract keeps all of an article, also sentences that other pages have. A page without any keeps the
   unique runs of its open blocks: covered tokens go.

Step 2 is an aggregation by (host, first tokens) with partial sums, so a host with a third of all pages or a footer on all of them is no hot task; what goes back to pages
are covered positions of pages without main blocks only.

A block ends at a block element; ``br`` is white space. White space in a block becomes one space. Character references are decoded. Nulls: a null html has no text; a null url is
a host of its own (''). Repeated rows each get a row; rows with equal page_id, url and html are one stream. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import spread, table, written
from carrel.llm.wordhash import gram_hashes, word_hashes

MIN_TOKENS = 8

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title textarea select option iframe object svg canvas audio video head".split())
#: Their content is text up to the end tag.
RAW = frozenset("script style title textarea iframe noscript template".split())
MAIN = frozenset(("article", "main"))
DROP = frozenset("nav footer aside form button dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id that mark what is not the article.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments reply replies respond disqus share sharing social related "
    "recommended widget pagination pager toolbar".split()
)
#: Ids that say so inside a main element, where others are anchors made from the article's own words.
DROP_IDS = frozenset("comments disqus disqus_thread respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A new one ends an open one.
CLOSES = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"})}
#: How far the tag that closes a p or li is looked for.
WALLS = frozenset("article main section div nav header footer aside form table ul ol dl body html td th".split())

#: A comment, the start of a tag or a declaration. No part can be matched in two ways.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)|<[!?][^<>]*+>", re.S)
#: Up to the end of a tag, the next tag or a quoted value, and the start of the latter. A quote elsewhere is a character like others.
UNQUOTED = re.compile(r"(?:[^<>=]++|=(?!\s*+[\"']))*+")
OPENING = re.compile(r"=\s*+[\"']")
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
ROLE_MAIN = re.compile(r"main\b", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tag_end(html: str, at: int, failed: set[int]) -> int:
    """Where the ">" of a tag is whose name ends at ``at``, or -1 if the next tag or the end of the page comes first.

    Quoted values are read to their closing quote, whatever their length and content; a quote that is never closed is a character like others. failed has the quotes
    from which no end was found: none is read from twice in vain, so a broken page costs no more than its length.
    """
    seen = []
    while True:
        at = UNQUOTED.match(html, at).end()
        m = OPENING.match(html, at)
        if m is None:
            if html[at : at + 1] == ">":
                return at
            break
        at = m.end()
        if at in failed:
            break
        seen.append(at)
        at = max(at, html.find(html[at - 1], at) + 1)
    failed.update(seen)
    return -1


def attributes_of(text: str) -> list[tuple[str, str]]:
    """(name in lower case, value) of the attributes of a tag."""
    return [(k.lower(), "".join(v).strip()) for k, *v in ATTRIBUTE.findall(text)]


def dropped(name: str, attributes: list[tuple[str, str]], in_main: bool) -> bool:
    """Whether an element's content is not the article's."""
    if name in DROP or name == "header" and not in_main:
        return True
    for k, value in attributes:
        if k == "role" and value.lower() in DROP_ROLES:
            return True
        if in_main:
            if k == "class" and DROP_WORDS & set(value.lower().split()) or k == "id" and name not in HEADINGS and value.lower() in DROP_IDS:
                return True
        elif k in ("class", "id") and name not in ("html", "body") and name not in MAIN and DROP_WORDS & set(WORDS.findall(CAMEL.sub(" ", value).lower())):
            return True
        if k == "aria-hidden" and value.lower() == "true" or k == "hidden":
            return True
    return False


def is_main(name: str, attributes: list[tuple[str, str]]) -> bool:
    return name in MAIN or any(k == "role" and ROLE_MAIN.match(value) for k, value in attributes)


def inline_ends(html: str, name: str) -> dict[int, int]:
    """For the start of each element of a name the place after its end tag, nested ones of that name passed over; one that is never closed has none."""
    opened, out = [], {}
    for m in re.finditer(rf"</{re.escape(name)}\s*+>|<{re.escape(name)}(?=[\s/>])", html, re.I):
        if html[m.start() + 1] != "/":
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def blocks(html: str) -> list[tuple[str, str]]:
    """(role, text) of the visible blocks of a page in order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether it drops, whether it is main
    text: list[str] = []
    drops = mains = 0

    def flush() -> None:
        if text:
            t = " ".join(unescape("".join(text)).split())
            text.clear()
            if t:
                out.append(("drop" if drops else "main" if mains else "open", t))

    def pop() -> None:
        nonlocal drops, mains
        _, d, m = stack.pop()
        drops, mains = drops - d, mains - m

    at = 0
    failed: set[int] = set()
    ends: dict[str, dict[int, int]] = {}
    while at < len(html):
        m = TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        end = tag_end(html, m.end(), failed) if m[2] else m.end()
        if end < 0:  # no tag
            text.append(html[at : m.end()])
            at = m.end()
            continue
        if m.start() > at:
            text.append(html[at : m.start()])
        at = end
        if not m[2]:
            continue
        name, rest = m[2].lower(), html[m.end() : end]
        at += 1
        if name in BLOCKS:
            flush()
        if m[1]:
            if name in BLOCKS or name in DROP:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        while len(stack) > i:
                            pop()
                        break
                    if name in ("p", "li") and stack[i][0] in WALLS:
                        break
            continue
        if name == "br":
            text.append(" ")
        if name in VOID or rest.endswith("/"):
            continue
        if name in UNSEEN:
            if name == "head":
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if end is not None:
                at = end.end()
            elif name in RAW:
                break
            continue
        if name in BLOCKS or name in DROP:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES and name in CLOSES[stack[i][0]]:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in WALLS:
                    break
            if name not in BLOCKS:
                flush()
            attributes = attributes_of(rest)
            d, a = dropped(name, attributes, mains > 0), is_main(name, attributes)
            stack.append((name, d, a))
            drops, mains = drops + d, mains + a
        elif dropped(name, attributes_of(rest), mains > 0):  # an inline element
            if name not in ends:
                ends[name] = inline_ends(html, name)
            at = max(at, ends[name].get(m.start(), at))
    flush()
    return out


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return (m[1].rpartition("@")[2] if m else "").lower()


STREAM = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("has_main", pa.bool_()), ("text", pa.string()), ("host", pa.string()), ("stream", pa.int64()),
    ("blocks", pa.list_(pa.string())), ("open", pa.list_(pa.bool_())), ("prefixes", pa.list_(pa.int64())),
])
STREAM_DDL = "page_id long, url string, has_main boolean, text string, host string, stream long, blocks array<string>, open array<boolean>, prefixes array<long>"


def prefixes(texts: list[str], n: int) -> np.ndarray:
    """For each token of a stream of blocks the hash of the n tokens that start there; none for the last n - 1."""
    h, _ = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    return gram_hashes(h, n).view(np.int64)


def scanned(min_tokens: int):
    """Step 1, for mapInArrow over (page_id, url, html). Pages with main blocks carry their text, the others their blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                found = blocks(html or "")
                main = [t for r, t in found if r == "main"]
                around = [(r == "open", t) for r, t in found if r != "main"]
                p = prefixes([t for _, t in around], min_tokens)
                whole, _ = word_hashes([" ".join(t for _, t in around).encode("utf-8", "surrogatepass")])
                stream = int(gram_hashes(whole, len(whole)).view(np.int64)[0]) if len(whole) else 0
                rows.append({
                    "page_id": page, "url": url, "has_main": bool(main), "text": "\n".join(main) if main else None, "host": host(url), "stream": stream,
                    "blocks": None if main else [t for _, t in around], "open": None if main else [o for o, _ in around], "prefixes": p.tolist(),
                })
            yield pa.RecordBatch.from_pylist(rows, STREAM)

    return task


def unique_runs(texts: list[str], is_open: list[bool], starts: list[int], n: int) -> str:
    """The open blocks of a stream without the tokens that the covered suffixes start."""
    size = sum(len(t.split()) for t in texts)
    covered = np.zeros(size, bool)
    for s in starts:
        covered[s : s + n] = True
    out, at = [], 0
    for t, o in zip(texts, is_open, strict=True):
        tokens = t.split()
        kept = [x for x, c in zip(tokens, covered[at : at + len(tokens)], strict=True) if not c]
        at += len(tokens)
        if o and kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def main_text(pages: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """page_id, url, text for every row of pages(page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(scanned(min_tokens), STREAM_DDL)
    p = written(p.withColumn("row", F.monotonically_increasing_id()), "html-streams")
    suffixes = p.select("host", "stream", "row", "has_main", F.posexplode("prefixes").alias("place", "prefix"))
    repeated = suffixes.groupBy("host", "prefix").agg(F.min("stream").alias("lo"), F.max("stream").alias("hi"), F.min("has_main").alias("has_main"))
    repeated = repeated.filter("lo < hi AND NOT has_main").select("host", "prefix")  # those that a page without main blocks has
    covered = suffixes.filter("NOT has_main").join(repeated, ["host", "prefix"], "left_semi")
    covered = covered.groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("starts"))  # places in one page
    rest = p.filter("NOT has_main").select("row", "page_id", "url", "blocks", "open").join(covered, "row", "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("blocks", "open", "starts")]
            text = [unique_runs(b, o, s or [], min_tokens) for b, o, s in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    rest = rest.mapInArrow(task, "page_id long, url string, text string")
    return p.filter("has_main").select("page_id", "url", "text").unionByName(rest)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).withColumn("n_chars", F.length("text").cast("long"))


def suffix_array_runs(streams: dict[int, list[str]], n: int) -> dict[int, list[int]]:
    """Starts of covered runs of n tokens by a plain suffix array with longest common prefixes over one host's streams; for tests."""
    tokens, of = [], []
    for page, s in streams.items():
        tokens += [(0, t) for t in s] + [(1, str(page))]  # an end mark of its own for each page
        of += [page] * (len(s) + 1)
    order = sorted(range(len(tokens)), key=lambda i: tokens[i : i + 200])
    begin = {p: of.index(p) for p in streams}
    out = defaultdict(set)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and tokens[order[to] : order[to] + n] == tokens[order[at] : order[at] + n]:
            to += 1
        group = order[at:to]
        if len({of[i] for i in group}) > 1 and all(t[0] == 0 for t in tokens[group[0] : group[0] + n]) and len(tokens[group[0] : group[0] + n]) == n:
            for i in group:
                out[of[i]].add(i - begin[of[i]])
        at = to
    return {p: sorted(out[p]) for p in streams}


#: Article elements of pages whose only markup inside is headings, paragraphs, breaks and inline marks; for DuckDB.
OP9_SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(x, '</?(?:p|h1)>')) AS s, generate_subscripts(string_split_regex(x, '</?(?:p|h1)>'), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(s, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS t FROM b)
SELECT a.page_id, a.url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text,
  CAST(coalesce(length(string_agg(t, chr(10) ORDER BY i) FILTER (t <> '')), 0) AS BIGINT) AS n_chars
FROM a LEFT JOIN c USING (page_id) GROUP BY a.page_id, a.url"""
