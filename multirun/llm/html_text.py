"""Main text of pages: differencing against the nearest page of the host, with structure as the guard.

A page becomes lines, one per visible block, boilerplate included. Pages are ordered by host and path. Each is
paired with the nearest page on either side whose text is not the same as its own, the one whose path agrees
with its own for longer (the one before on ties); copies are looked past, since a page less its copy is nothing.
The pair's lines are aligned by a longest common subsequence, and shared lines are deleted: what two different
pages of a host share is the host's, not the page's. The alignment runs on every page that has a partner, and
``n_shared`` counts the lines it deleted.

Structure says the rest. Lines inside an article or main element are guarded: a passage that two articles share
is still text of both. Lines in navigation, headers and footers of the page, asides, forms, and elements whose
class, id or role names an advert, a notice, a menu, a sidebar or comments are left out where the paired page
does not share them (an advert or a comment is rarely the same on two pages). An article shows in what is left
open before it and in a form or header around it, not inside any other element left out: teasers in an aside
and comments are no text of the page. A main element shows wherever it stands.

Pages are dealt to ranges of host, path and id, so a host of any size is spread over tasks. The page next to
each range, and the nearest one of another content, also travel to it, as guests that are compared with and
give no row; a page so has the partner that it has in the whole table, however many tasks there are.

Cases: null or empty html has no text; a null URL has an empty host and path; unclosed elements end with
their parents; broken references stay as written; a page with no other page but copies on its host keeps all its
lines; pages that repeat an id are ordered by their content where all else is equal; an empty table gives no
rows. A page that only nearly repeats another is no copy of it and may be its partner.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multirun.llm.common import bounded_sample, small_batches
from multirun.llm.urls import host, path

#: Elements that begin and end a block, that hold no text of the page, and that have no end (fixed values of HTML).
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("aside button dialog footer form head header menu nav select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OWN = frozenset(["article", "main"])
#: Left-out elements that may hold a whole page; an article inside one of them is not left out.
WRAPPING = frozenset(["form", "head", "header"])
#: Words of a class, id or role that name what is not the article (fixed values).
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|"
    r"popup|promo|promoted|related|search|share|sidebar|social|sponsor(?:ed)?|subscribe)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|iframe|svg|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def ended(html: str) -> set[int]:
    """Where elements begin that an end tag of their own ends."""
    out: set[int] = set()
    stack: list[tuple[str, int]] = []
    for m in _TOKEN.finditer(html):
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if any(t == name for t, _ in stack):
                while stack[-1][0] != name:
                    stack.pop()
                out.add(stack.pop()[1])
        elif name not in VOID and not m[4].endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((name, m.start()))
    return out


class Line(NamedTuple):
    text: str
    #: Inside an article or main element.
    own: bool
    #: Inside an element that is left out by its name, class, id or role.
    left_out: bool


def lines(html: str | None) -> list[Line]:
    """All visible blocks of a page in order; of one block, what is left out follows the rest."""
    out: list[Line] = []
    held: tuple[list[str], list[str]] = ([], [])
    stack: list[tuple[str, bool, int, bool]] = []  # open elements, whether each began what is left out, where, and whether it counts as own
    skipping = own = 0
    closed: set[int] | None = None

    def close():
        for left_out, part in enumerate(held):
            if part:
                if line := " ".join(unescape("".join(part)).split()):
                    out.append(Line(line, own > 0, bool(left_out)))
                part.clear()

    def pop():
        nonlocal skipping, own
        _, left_out, _, counted = stack.pop()
        skipping -= left_out
        own -= counted

    at, html = 0, html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held[skipping > 0].append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close()
        if m[2]:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name in OWN and not own and skipping:
            # an article begins: nothing merely left open before it can hide it, but what is ended after it does
            closed = ended(html) if closed is None else closed
            if name == "main" or not any(x[1] and x[0] not in WRAPPING and x[2] in closed for x in stack):
                while skipping:
                    pop()
        left_out = name in DROPPED and not (own and name == "header")
        if not left_out and m[4] and name not in ("html", "body"):
            left_out = any(NOT_ARTICLE.search(a or b or c) for a, b, c in _NAMED.findall(m[4]))
        if name == "p" and stack and stack[-1][0] == "p":
            pop()
        counted = name in OWN and not skipping
        stack.append((name, left_out, m.start(), counted))
        skipping += left_out
        own += counted
    if at < len(html):
        held[skipping > 0].append(html[at:])
    close()
    return out


#: Bits of alignment rows held at once; longer pairs are aligned in halves.
ALIGN_BITS = 1 << 26


def _rows(a: list[str], places: dict[str, int], full: int, every: bool) -> list[int]:
    """Bit rows of the alignment after each line of ``a`` (or the last alone): a zero bit at k says that line k of ``b`` lengthens the match."""
    row, rows = full, [full]
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        if every:
            rows.append(row)
    return rows if every else [row]


def _places(b: list[str]) -> dict[str, int]:
    """Bits of the lines of ``b``, set in bytes so that a long list costs its length once per distinct line."""
    at: dict[str, list[int]] = {}
    for k, x in enumerate(b):
        at.setdefault(x, []).append(k)
    out = {}
    for x, ks in at.items():
        bits = bytearray((ks[-1] >> 3) + 1)
        for k in ks:
            bits[k >> 3] |= 1 << (k & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with every prefix of ``b``."""
    n = len(b)
    row = _rows(a, _places(b), (1 << n) - 1, False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n + 7 >> 3, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory of ALIGN_BITS and the lines."""
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    return {at[i] for i in _shared([a[i] for i in at], [x for x in b if x in both])}


def _shared(a: list[str], b: list[str]) -> set[int]:
    if len(a) > 1 and len(a) * len(b) > ALIGN_BITS:
        # the place of ``b`` where the best match of the first half of ``a`` and that of the second meet
        half = len(a) // 2
        k = int(np.argmax(_prefix_lengths(a[:half], b) + _prefix_lengths(a[half:][::-1], b[::-1])[::-1]))
        return shared(a[:half], b[:k]) | {half + i for i in shared(a[half:], b[k:])}
    rows = _rows(a, _places(b), (1 << len(b)) - 1, True)
    out, i, k = set(), len(a), len(b)
    length = lambda i, k: k - (rows[i] & (1 << k) - 1).bit_count()
    while i and k:
        n = length(i, k)
        if n == 0:
            break
        if length(i - 1, k) == n:
            i -= 1
        elif length(i, k - 1) == n:
            k -= 1
        else:
            out.add(i - 1)
            i, k = i - 1, k - 1
    return out


def text_of(own: list[Line], other: list[Line] | None) -> tuple[str, int]:
    """Text of the lines that the paired page does not share and structure does not leave out, and how many lines the alignment deleted."""
    gone = shared([x.text for x in own], [x.text for x in other]) if other else set()
    gone = {k for k in gone if own[k].left_out or not own[k].own}
    return " ".join(x.text for k, x in enumerate(own) if not x.left_out and k not in gone), len(gone)


OUT = "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint"
#: Sampled keys per task that the tasks' ranges are cut by (on the driver, about 100 bytes each).
SAMPLE_KEYS = 40
KEY = "h string, p string, i bigint, x bigint"
ENDS = f"b int, c binary, {KEY}"
DEALT = f"b int, guest boolean, {KEY}, url string, html string"
KEY_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64()]


def _key(h: str, p: str, i: int | None, *x: int) -> tuple:
    """Host, path and id, ordered as Spark orders them: null ids first; then the content's hash, where it is given."""
    return h, p, i is not None, i or 0, *x


def content(page: list[Line]) -> bytes:
    """Names the lines that structure leaves; equal for copies, whatever their markup, address or adverts."""
    return hashlib.sha256("\n".join(x.text for x in page if not x.left_out).encode("utf-8", "surrogatepass")).digest()[:16]


def cut_keys(keys: list[tuple], ranges: int) -> list[tuple]:
    """Keys that cut the sampled ones into about equal ranges; each is the first of its range."""
    found = sorted(set(keys))
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def outer(found: list[tuple]) -> list[tuple]:
    """Of ``(key, content, ...)`` from a range's end inwards: the first, and the first of another content."""
    return found[:1] + [x for x in found if x[1] != found[0][1]][:1]


def _ends(cuts: list[tuple]):
    """At both ends of each range, a task's outermost page and its outermost page of another content."""

    def f(batches):
        low: dict[int, list[tuple]] = {}
        high: dict[int, list[tuple]] = {}
        for b in batches:
            for h, p, i, x, t in zip(*(b.column(k) for k in range(5)), strict=True):
                row = h.as_py(), p.as_py(), i.as_py(), x.as_py()
                key = _key(*row)
                at = bisect_right(cuts, key[:4])
                mine, yours = low.get(at, []), high.get(at, [])
                # a page between two of two contents at either end is at no end
                if len(mine) == len(yours) == 2 and mine[1][0] <= key <= yours[1][0]:
                    continue
                one = key, content(lines(t.as_py())), row
                low[at] = outer(sorted([*mine, one], key=lambda x: x[0]))
                high[at] = outer(sorted([*yours, one], key=lambda x: x[0], reverse=True))
        rows = [(at, c, *row) for side in (low, high) for at, found in side.items() for _, c, row in found]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.binary(), *KEY_TYPES], strict=True)], names=["b", "c", "h", "p", "i", "x"])

    return f


def guests_of(ends: list[tuple[int, list[tuple], list[tuple]]]) -> dict[tuple, list[int]]:
    """Ranges that a page travels to. ``ends`` has ``(range, first, last)``, with ``outer`` pages of both ends.

    A range gets the nearest page before and after it and the nearest of another content than that one's, from
    however far: a page at the range's end, and its copies, so meet the page next to them that is no copy.
    """
    guests: dict[tuple, list[int]] = {}
    ends = sorted(ends, key=lambda e: e[0])
    for order, side in ((ends, 2), (ends[::-1], 1)):
        near: list[tuple] = []
        for e in order:
            for key, _ in near:
                guests.setdefault(key, []).append(e[0])
            near = outer([*e[side], *near])
    return guests


def _dealt(cuts: list[tuple], guests: dict[tuple, list[int]]):
    """Every page with its range, and guests once more for each range they travel to; equal ones once a task."""

    def f(batches):
        sent: set = set()
        for b in batches:
            take, ranges, guest = [], [], []
            for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                key = _key(*row)
                take.append(k)
                ranges.append(bisect_right(cuts, key[:4]))
                guest.append(False)
                for to in guests.get(key, ()):
                    if (to, key) not in sent:
                        sent.add((to, key))
                        take.append(k)
                        ranges.append(to)
                        guest.append(True)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), pa.array(guest, pa.bool_()), *(b.column(c).take(at) for c in range(6))], names=["b", "guest", "h", "p", "i", "x", "url", "html"]
            )

    return f


def _paired(batches) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for at, guest, h, p, i, u, t in zip(*(b.column(k) for k in range(7)), strict=True):
                yield (at.as_py(), h.as_py()), p.as_py(), lines(t.as_py()), None if guest.as_py() else (i.as_py(), u.as_py())

    ready: list[tuple] = []

    def batch():
        cols = list(zip(*ready, strict=True)) or [[]] * 6
        ready.clear()
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    kept = lambda page: [x.text for x in page if not x.left_out]
    # copies that follow each other are held until the page after them is known: their lines once, and before, the page before them
    copies: list[tuple] = []
    before = None

    def finish(after):
        near = [x for x in (before, after) if x is not None and x[0] == copies[0][0]]
        made: tuple = (None, None, None)
        for _, p, own, out in copies:
            if out is not None:
                best = max(near, key=lambda x: len(commonprefix([x[1], p])), default=None)
                if made[0] is not own or made[1] is not best:
                    made = own, best, text_of(own, best and best[2])
                text, n_shared = made[2]
                ready.append((*out, text, len(text), len(own), n_shared))
            if len(ready) >= 500:
                yield batch()

    for r in rows():
        if copies and r[0] == copies[0][0] and kept(r[2]) == kept(copies[-1][2]):
            copies.append((*r[:2], copies[-1][2] if r[2] == copies[-1][2] else r[2], r[3]))
            continue
        if copies:
            yield from finish(r)
            before = copies[-1]
        copies = [r]
    if copies:
        yield from finish(None)
    yield batch()


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    small_batches(pages.sparkSession)
    u = F.col("url")
    # the hash orders pages that repeat an id
    p = pages.select(host(u).alias("h"), path(u).alias("p"), F.col("page_id").cast("bigint").alias("i"), F.xxhash64("html").alias("x"), "url", "html")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = p.select("h", "p", "i")
    sample = bounded_sample(keys.withColumn("_r", F.xxhash64("h", "p", "i")), "_r", SAMPLE_KEYS * n)[0].collect()
    cuts = cut_keys([_key(r["h"], r["p"], r["i"]) for r in sample], n)
    # two rows per range and end; a content's first and last page of a range are enough to find them
    key = F.struct("h", "p", "i", "x")
    found = p.select("h", "p", "i", "x", "html").mapInArrow(_ends(cuts), ENDS).groupBy("b", "c").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    side = lambda k: F.sort_array(F.collect_list(F.struct(k, "c")), k == "first")
    found = found.groupBy("b").agg(F.slice(side("first"), 1, 2).alias("first"), F.slice(side("last"), 1, 2).alias("last")).collect()
    guests = guests_of([(r["b"], *([(_key(*e[k]), bytes(e["c"])) for e in r[k]] for k in ("first", "last"))) for r in found])
    rows = p.mapInArrow(_dealt(cuts, guests), DEALT).repartitionById(n, "b").sortWithinPartitions("b", "h", "p", "i", "x")
    return rows.select("b", "guest", "h", "p", "i", "url", "html").mapInArrow(_paired, OUT)
