"""Main text of web pages by differencing pages with near URLs.

Each page is cut into lines (blocks). The pages of a host are reduced to distinct lists
of lines, which are put in order of (host, path) over many tasks. Each list is compared
with the neighbour whose path shares the longer beginning with its own: lines are
aligned by a longest common subsequence, and shared lines are template in all copies. Differencing alone is wrong in both directions where markup is plain: text
that a site repeats inside its articles would go, and adverts or menus that change
from page to page would stay. So it decides the lines that no element claims; lines
in an article are kept, lines in menus, headers, footers, asides, forms and the like
are not. Names of adverts, comments, teasers and the like (``APART``) drop what they
mark. Other class or id names are hints: they never mark an article or what holds one,
and a line that they mark inside an article goes only if the neighbour has it too.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from html.parser import HTMLParser
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import settle
from .common import slices
from .ordered import in_order

#: Fixed values of HTML: elements without content, and those that end a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul").split())
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - frozenset("option select caption tbody td tfoot th thead tr html body".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
TEMPLATE = frozenset("nav header footer aside form button select textarea menu dialog".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id names (split at everything but letters) that mark template.
NAMED = frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer header menu nav navbar navigation newsletter notice notices popup promo promoted related "
    "replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget").split())
#: Those of them that mark what is never part of an article, as first or last word of a name.
APART = frozenset((
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus newsletter popup promo promoted related replies respond share sharing social sponsor sponsored subscribe").split())
#: Words that make a name a setting of the element instead of what it holds.
SETTING = frozenset("has no with without is hide show enabled disabled open closed allow".split())
REPLIES = frozenset("comment comments replies respond disqus".split())

#: HINT: in an article, below a name that marks template. SIDE: such a name outside articles.
KEEP, DROP, OPEN, HINT, SIDE = 1, -1, 0, 2, -2
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_SPACE = re.compile(r"\s+")
_NOT_LETTERS = re.compile(r"[^a-z]+")


class _Lines(HTMLParser):
    """Lines of a page and what its markup says of each: KEEP, DROP, OPEN, HINT or SIDE."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, bool]] = []
        # Element, verdict inside, is seen, number of the innermost hint or 0, whether it is apart.
        self.stack: list[tuple[str, int, bool, int, bool]] = []
        self.open: Counter = Counter()  # elements of the stack by tag
        self.text: list[str] = []
        self.around = [0]  # hint around each hint
        self.void = {0}  # hints on elements that hold an article, and so all around them

    def _state(self) -> tuple[int, bool, int, bool]:
        return self.stack[-1][1:] if self.stack else (OPEN, True, 0, False)

    def _end_line(self):
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if line:
            verdict, _, hint, apart = self._state()
            self.found.append((line, verdict, hint, apart))

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and self.open["p"]:
            self.handle_endtag("p")
        if tag in BLOCK:
            self._end_line()
        if tag in VOID:
            self.text.append(" " if tag == "br" else "")
            return
        verdict, seen, hint, apart = self._state()
        seen = seen and tag not in UNSEEN
        if tag in ("html", "body") or verdict == DROP:
            pass
        elif self._claimed(attrs) or tag in TEMPLATE and (tag != "header" or verdict != KEEP):
            verdict = DROP
        elif tag in MAIN:
            apart = apart or self._marks(attrs, REPLIES)
            if apart and verdict == KEEP:
                verdict = DROP
            elif verdict != KEEP:
                # What holds an article is no template, whatever hints its name gives.
                while hint not in self.void:
                    self.void.add(hint)
                    hint = self.around[hint]
                verdict, hint = KEEP, 0
        elif self._marks(attrs, APART):
            verdict, apart = (DROP if verdict == KEEP else verdict), True
        elif self._hinted(attrs):
            self.around.append(hint)
            hint = len(self.around) - 1
        self.stack.append((tag, verdict, seen, hint, apart))
        self.open[tag] += 1

    @staticmethod
    def _claimed(attrs) -> bool:
        return any(n == "hidden" or n == "role" and (v or "").lower().strip() in ROLES for n, v in attrs)

    @staticmethod
    def _given(attrs) -> list[list[str]]:
        """The words of each class or id name that is no setting."""
        found = [_NOT_LETTERS.split(name) for n, v in attrs if n in ("class", "id") for name in (v or "").lower().split()]
        return [words for words in found if not SETTING.intersection(words)]

    def _marks(self, attrs, words) -> bool:
        return any(given[0] in words or given[-1] in words for given in self._given(attrs))

    def _hinted(self, attrs) -> bool:
        return any(NAMED.intersection(given) for given in self._given(attrs))

    def handle_endtag(self, tag):
        if tag in VOID or not self.open[tag]:
            return
        if tag in BLOCK:
            self._end_line()
        while self.stack:
            top = self.stack[-1][0]
            if top in BLOCK and top != tag:
                self._end_line()
            self.stack.pop()
            self.open[top] -= 1
            if top == tag:
                return

    def handle_data(self, data):
        if self._state()[1]:
            self.text.append(data)

    def close(self):
        super().close()
        self._end_line()

    def lines(self) -> list[tuple[str, int]]:
        """What is apart goes, unless the page has nothing else: a wrapper of the whole
        page may have such a name."""
        rest = {verdict for _, verdict, _, apart in self.found if not apart and verdict != DROP}
        marked = {KEEP: HINT, OPEN: SIDE}

        def said(verdict, hint, apart):
            if apart and (verdict == KEEP and KEEP in rest or verdict == OPEN and rest):
                return DROP
            return verdict if hint in self.void else marked.get(verdict, verdict)

        return [(t, said(v, hint, apart)) for t, v, hint, apart in self.found]


def lines_of(html: str) -> list[tuple[str, int]]:
    """(line, verdict) in page order; white space inside a line is one space."""
    parser = _Lines()
    # The library's parser fails on marked sections, and reads a tag cut off at the end as text.
    parser.feed(_CUT_TAG.sub("", html).replace("<![", "<!x["))
    parser.close()
    return parser.lines()


def shared_lines(mine: list, other: list) -> list[bool]:
    """Which of my lines a longest common subsequence matches with the other page's.

    Equal beginnings and ends are matched first, which keeps the subsequence longest.
    """
    n, m = len(mine), len(other)
    head = 0
    while head < min(n, m) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and mine[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    out = [i < head or i >= n - tail for i in range(n)]
    a, b = mine[head:n - tail], other[head:m - tail]
    for i in _longest(a, b):
        out[head + i] = True
    return out


def _longest(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Bit j of a row's number is clear where line j of ``b`` makes the subsequence with the
    lines of ``a`` so far longer; a row is a few operations on such numbers. Every s-th of
    n rows is kept, s = sqrt(n), and the rows between are made anew on the way back, so
    memory is about 2 s numbers of len(b) bits, however often lines repeat.
    """
    common = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in common]
    a, b = [a[i] for i in at], [x for x in b if x in common]
    n, m = len(a), len(b)
    if not n:
        return []
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)

    def bits(x) -> int:
        mask = bytearray(m // 8 + 1)
        for j in places[x]:
            mask[j // 8] |= 1 << j % 8
        return int.from_bytes(mask, "little")

    often = {x: bits(x) for x, js in places.items() if len(js) ** 2 > m}
    full = (1 << m) - 1

    def rows(row: int, lines: list) -> list[int]:
        out = [row]
        for x in lines:
            hit = row & (often[x] if x in often else bits(x))
            row = (row + hit | row - hit) & full
            out.append(row)
        return out

    step = math.isqrt(n - 1) + 1
    kept = [full]
    for start in range(0, n - step, step):
        kept.append(rows(kept[-1], a[start:start + step])[-1])
    found, j = [], m
    for k in range(len(kept) - 1, -1, -1):
        made = rows(kept[k], a[k * step:(k + 1) * step])
        for i in range(len(made) - 1, 0, -1):
            # The last place at or before j where this row grows, by the clear bits below.
            j = (~made[i] & (1 << j) - 1).bit_length()
            if not j:
                return found[::-1]
            if made[i - 1] >> j - 1 & 1:  # not yet in the row before: here they match
                found.append(at[k * step + i - 1])
                j -= 1
    return found[::-1]


def main_text(lines: list[tuple[str, int]], other: list[tuple[str, int]]) -> str:
    """The lines to keep, given those of the neighbour, joined by newlines.

    Without a neighbour nothing speaks against a name in an article, so its lines go.
    Outside articles a name decides if the page has an article, else differencing.
    """
    shared = shared_lines([t for t, _ in lines], [t for t, _ in other])
    return _kept(lines, shared, not other)


def _kept(lines: list[tuple[str, int]], shared: list[bool], alone: bool) -> str:
    article = _has_article(lines)

    def stays(verdict, same):
        if verdict == HINT:
            return not alone and not same
        return verdict == KEEP or not same and (verdict == OPEN or verdict == SIDE and not article)

    return "\n".join(t for (t, v), s in zip(lines, shared) if stays(v, s))


def _has_article(lines) -> bool:
    return any(v in (KEEP, HINT) for _, v in lines)


def _undecided(lines) -> bool:
    """Whether differencing decides any of the lines."""
    return any(v in (OPEN, HINT) for _, v in lines) or not _has_article(lines) and any(v == SIDE for _, v in lines)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: from
    there up to ? # or the end. Both empty for null or without ://."""
    own = F.coalesce(url, F.lit(""))
    at = F.instr(own, "://")
    rest = F.when(at > 0, F.substring(own, at + 3, F.length(own))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page.

    A null page is empty; a page without lines to keep has an empty text. A page whose
    host has no other content is compared with none. Pages of a host with equal lines are
    compared as one, with the nearest URL of other content.
    """
    host, path = host_and_path(F.col(url))
    own = pages.select(host.alias("host"), path.alias("path"), F.col(key).alias("key"), F.col(url).alias("url"),
                       F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = own.schema["key"].dataType
    parsed = settle(own.mapInArrow(_parse, T.StructType([
        *(f for f in own.schema.fields if f.name != "html"), T.StructField("lines", T.ArrayType(T.StringType())),
        T.StructField("verdicts", T.ArrayType(T.ByteType())), T.StructField("mark", T.StringType()),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("open", T.BooleanType())])), "page_lines")
    contents = parsed.where(F.size("hashes") > 0).groupBy("host", "mark").agg(
        F.min("path").alias("path"), F.max("open").alias("open"), F.first("hashes").alias("hashes"))
    dealt, bucket, side, _ = in_order(settle(contents, "page_contents"), ["host", "path", "mark"], before=True, after=True)
    shared = settle(dealt.mapInArrow(_difference(bucket, side), "host string, mark string, shared array<boolean>, alone boolean"),
                    "shared_lines")
    schema = T.StructType([
        T.StructField(key, kind), T.StructField(url, T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def write(batches):
        for batch in batches:
            texts = []
            for row in batch.select(["lines", "verdicts", "shared", "alone"]).to_pylist():
                lines = list(zip(row["lines"], row["verdicts"]))
                texts.append(_kept(lines, row["shared"] or [False] * len(lines), bool(row["alone"])))
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return parsed.drop("path", "hashes", "open").join(shared, ["host", "mark"], "left").select(
        "key", "url", "lines", "verdicts", "shared", "alone").mapInArrow(write, schema)


def _parse(batches):
    """Lines of each page, what markup says of them, a hash of all and of each line.

    Only the 64-bit hashes of lines are shuffled and aligned.
    """
    for batch in batches:
        for part in slices(batch, "html"):
            lines = [lines_of(t) for t in part.column("html").to_pylist()]
            texts = [[t for t, _ in page] for page in lines]
            yield pa.RecordBatch.from_arrays([
                *(part.column(n) for n in part.schema.names if n != "html"), pa.array(texts, pa.list_(pa.string())),
                pa.array([[v for _, v in page] for page in lines], pa.list_(pa.int8())),
                pa.array([xxhash.xxh3_128_hexdigest("\n".join(t)) for t in texts], pa.string()),
                pa.array([[xxhash.xxh3_64_intdigest(x) - 2**63 for x in t] for t in texts], pa.list_(pa.int64())),
                pa.array([_undecided(page) for page in lines], pa.bool_())],
                names=[*(n for n in part.schema.names if n != "html"), "lines", "verdicts", "mark", "hashes", "open"])


def _difference(bucket: str, side: str):
    """Which lines each content shares with its neighbour, where that decides any."""
    def nearest(page, before, after):
        near = [p for p in (before, after) if p is not None and p["host"] == page["host"]]
        return max(near, key=lambda p: len(commonprefix([p["path"], page["path"]])), default=None)

    def result(done):
        return pa.RecordBatch.from_arrays([
            pa.array([p["host"] for p, _, _ in done], pa.string()), pa.array([p["mark"] for p, _, _ in done], pa.string()),
            pa.array([s for _, s, _ in done], pa.list_(pa.bool_())), pa.array([a for _, _, a in done], pa.bool_())],
            names=["host", "mark", "shared", "alone"])

    def run(batches):
        rows = (row for batch in batches for i in range(0, batch.num_rows, 100) for row in batch.slice(i, 100).to_pylist())
        before = page = None
        done: list = []
        for row in itertools.chain(rows, [None]):
            if page is not None:
                after = row if row is not None and row[bucket] == page[bucket] else None
                if page[side] == 0 and page["open"]:
                    other = nearest(page, before, after)
                    done.append((page, shared_lines(page["hashes"], other["hashes"] if other else []), other is None))
                before = page if after is not None else None
            page = row
            if len(done) >= 500:
                yield result(done)
                done = []
        if done:
            yield result(done)

    return run
