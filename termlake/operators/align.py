"""Hierarchical many-to-many alignment of passages.

Sections of a record pair are mapped by their names; the paragraphs of a mapped
section are aligned by monotone dynamic programming, and within each paragraph
bead its sentences are.  A bead joins none, one or two units of either side
(:data:`BEADS`); its cost grows with the difference of lengths and falls with the
numbers, units and formulae that both sides have.  Units without a counterpart stay
as beads of their own, and a bead tells the best other place for its left units
if that is nearly as good.

One row, a section of a record pair, is one alignment: time and memory are its
units times the band, ``2 * band + 1`` cells a unit around the diagonal, whatever
the lengths.  All costs are whole numbers, so ties are broken alike everywhere
(the first bead of :data:`BEADS` wins).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (left units, right units) and the cost of the kind alone, in hundredths of a nat.
BEADS = ((1, 1, 12), (1, 0, 460), (0, 1, 460), (2, 1, 310), (1, 2, 310), (2, 2, 450))
BAND = 32
#: The beads with left units, by their number and then the most right units first, as rows of a table see them.
STEPS = tuple(sorted((x for x in BEADS if x[0]), key=lambda x: (x[0], -x[1])))
PLACE = {x[:2]: k for k, x in enumerate(STEPS)}
BY_LEFT = tuple((a, slice(min(k), max(k) + 1)) for a in (1, 2) if (k := [k for k, x in enumerate(STEPS) if x[0] == a]))
ALONE = next(kind for a, b, kind in BEADS if (a, b) == (0, 1))
#: Cost by squared length difference in standard deviations, and its cap.
SPREAD, CAP = 6.8, 1200
#: What a shared anchor takes off, and how many count.
ANCHOR, ANCHORS = 150, 3
#: An alternative is told if the whole alignment through it costs at most this much more.
ALTERNATIVE = 300
FAR = np.int64(1) << 40
#: Left units that a pair has at most to share a table with others, and cells of such a table.
ROWS, CELLS = 200, 100_000
#: Characters of the rows that are aligned together.
TOGETHER = 1_000_000
# numbers, and words of two symbols or more; the first character stands outside of the alternatives, so other places are passed over at once
_ANCHOR = re.compile(r"[\dA-Z](?:(?<=\d)\d*(?:[.,]\d+)*|(?<=\b[A-Z])[a-z]?\d*(?:[A-Z][a-z]?\d*)+\b)")

BEAD = (
    "level string, parent int, bead int, left_from int, left_to int, right_from int, right_to int, kind string, cost int, "
    "other_from int, other_to int, other_extra int"
)


def paragraphs(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentences(paragraph: str) -> list[str]:
    """A paragraph cut behind full stops, question and exclamation marks that white space follows."""
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", paragraph)) if s]


def anchors(text: str) -> set[str]:
    """Numbers, identifiers and formulae of a passage; they are written alike in every language."""
    return {m.replace(",", ".") for m in _ANCHOR.findall(text)}


class Passages:
    """Sentences and anchors of passages; equal passages are read once."""

    def __init__(self) -> None:
        self.cut: dict[str, list[str]] = {}
        self.held: dict[str, set[str]] = {}

    def anchors(self, text: str) -> set[str]:
        """The anchors of a sentence or of a paragraph that was read: none has white space, so a paragraph has those of its sentences."""
        found = self.held.get(text)
        if found is None:
            found = self.held[text] = anchors(text)
        return found

    def sentences(self, paragraph: str) -> list[str]:
        found = self.cut.get(paragraph)
        if found is None:
            found = self.cut[paragraph] = sentences(paragraph)
            if paragraph not in self.held:
                self.held[paragraph] = set().union(*(self.anchors(x) for x in found))
        return found


@dataclass(slots=True)
class Bead:
    left: tuple[int, int]
    right: tuple[int, int]
    cost: int
    other: tuple[int, int] | None = None
    extra: int | None = None


class Aligner:
    """The banded table of one pair of unit sequences."""

    def __init__(self, left: list[str], right: list[str], band: int = BAND, read: Passages | None = None):
        read = read or Passages()
        self.n, self.m, self.band = len(left), len(right), band
        if not self.n or not self.m:
            return
        slope = self.m / self.n if self.n else 1.0
        # wide enough that neighbouring rows overlap, whatever the slope
        self.width = min(2 * band + 2 + int(2 * slope), self.m + 1)
        self.low = np.array([min(max(int(i * slope) - self.width // 2, 0), max(self.m - self.width + 1, 0)) for i in range(self.n + 1)])
        self.low[self.n] = max(self.m - self.width + 1, 0)
        self.size_l = np.concatenate([[0], np.cumsum([len(x) for x in left])]).astype(np.int64)
        self.size_r = np.concatenate([[0], np.cumsum([len(x) for x in right])]).astype(np.int64)
        self.ratio = float(self.size_r[-1]) / float(self.size_l[-1]) if self.size_l[-1] and self.size_r[-1] else 1.0
        where: dict[str, list[int]] = {}
        for j, text in enumerate(right):
            for a in read.anchors(text):
                where.setdefault(a, []).append(j)
        # shared anchors of a left unit with the right units that a bead of its row or of the next one can reach
        self.reach = self.width + 6 + int(2 * slope)
        self.shared = np.zeros((self.n + 1, self.reach), dtype=np.int64)
        for i, text in enumerate(left):
            lo = int(self.low[i + 1]) - 2
            for a in read.anchors(text):
                held = where.get(a, ())
                for j in held[bisect_left(held, lo) : bisect_left(held, lo + self.reach)]:
                    self.shared[i, j - lo] += 1

        self._costs()

    def _costs(self) -> None:
        """Cost of the bead of each kind of STEPS that ends at each cell of the band; FAR where it does not fit.

        Rows have a margin of FAR to both sides, so a row seen from another one is a slice.
        """
        n, w = self.n, self.width
        self.pad = 3 + int(np.abs(np.diff(self.low)).max(initial=0)) * 2
        self.at = self.low.tolist()
        self.own = slice(self.pad, self.pad + w)
        i, j = np.arange(n + 1)[:, None], self.low[:, None] + np.arange(w)
        anchored = bool(self.shared.any())
        self.cost = np.full((n + 1, len(STEPS), w + 2 * self.pad), FAR)
        for k, (a, b, kind) in enumerate(STEPS):
            cost = kind
            if b:
                l = (self.size_l[i] - self.size_l[np.maximum(i - a, 0)]).astype(np.float64) * self.ratio  # noqa: E741
                r = (self.size_r[j] - self.size_r[np.maximum(j - b, 0)]).astype(np.float64)
                cost = kind + np.minimum(np.rint(50 * ((r - l) ** 2 / (SPREAD * np.maximum((l + r) / 2, 1.0)))), CAP).astype(np.int64)
                if anchored:
                    cost -= ANCHOR * np.minimum(self._anchors(i, j, a, b), ANCHORS)
            self.cost[:, k, self.own] = np.where((j >= b) & (i >= a), cost, FAR)

    def _anchors(self, i: np.ndarray, j: np.ndarray, a: int, b: int) -> np.ndarray:
        """Shared anchors of left units i-a..i and right units j-b..j, for every cell."""
        total = np.zeros(j.shape, dtype=np.int64)
        for back in range(1, a + 1):
            u = np.maximum(i - back, 0)
            for d in range(b):
                at = j - b + d - (self.low[np.minimum(u + 1, self.n)] - 2)
                total += np.where((at >= 0) & (at < self.reach) & (i >= back), self.shared[u, np.clip(at, 0, self.reach - 1)], 0)
        return total

    def forward(self) -> np.ndarray:
        """Least cost from the start to every cell of the band."""
        table, steps = np.full((self.n + 1, self.width + 2 * self.pad), FAR), ALONE * np.arange(self.width)
        # a row as seen from the places two, one and none behind
        seen = np.lib.stride_tricks.sliding_window_view(table, table.shape[1] - 2, axis=1)
        table[0, self.own] = steps
        options = np.empty((len(STEPS), self.width), dtype=np.int64)
        for i in range(1, self.n + 1):
            for a, kinds in BY_LEFT:
                if i >= a:
                    first = self.pad + self.at[i] - self.at[i - a] - 2
                    np.add(seen[i - a, : kinds.stop - kinds.start, first : first + self.width], self.cost[i, kinds, self.own], out=options[kinds])
            best = options[: kinds.stop if i >= a else kinds.start].min(axis=0)
            # beads of the right side alone run along the row: their cost is the same for every unit
            best -= steps
            np.minimum.accumulate(best, out=best)
            np.add(best, steps, out=table[i, self.own])
        return table

    def backward(self) -> np.ndarray:
        """Least cost from every cell of the band to the end."""
        table, steps = np.full((self.n + 1, self.width + 2 * self.pad), FAR), ALONE * np.arange(self.width)[::-1]
        options = np.empty((len(STEPS), self.width), dtype=np.int64)
        for i in range(self.n, -1, -1):
            best = table[i, self.own]
            if i == self.n:
                best[self.m - self.at[i]] = 0
            else:
                for k, (a, b, _) in enumerate(STEPS[: len(STEPS) if i + 2 <= self.n else BY_LEFT[0][1].stop]):
                    first = self.pad + self.at[i] + b - self.at[i + a]
                    np.add(table[i + a, first : first + self.width], self.cost[i + a, k, first : first + self.width], out=options[k])
                np.min(options[: k + 1], axis=0, out=best)
            best -= steps
            back = best[::-1]
            np.minimum.accumulate(back, out=back)
            best += steps
        return table

    def beads(self, alternatives: bool = True) -> list[Bead]:
        """The beads of the least cost, in order, with the best other place of the left units of each."""
        if not self.n or not self.m:
            alone = {(a, b): kind for a, b, kind in BEADS}
            return [Bead((i, i + 1), (0, 0), alone[1, 0]) for i in range(self.n)] + [Bead((0, 0), (j, j + 1), alone[0, 1]) for j in range(self.m)]
        ahead = self.forward()
        i, j, out = self.n, self.m, []
        cell = lambda i, j: self.pad + j - int(self.low[i])
        total = int(ahead[i, cell(i, j)])
        while i or j:
            here = ahead[i, cell(i, j)]
            for a, b, kind in BEADS:
                if i < a or j < b or not 0 <= cell(i - a, j - b) < ahead.shape[1]:
                    continue
                cost = self.cost[i, PLACE[a, b], cell(i, j)] if a else kind
                if ahead[i - a, cell(i - a, j - b)] + cost == here:
                    out.append(Bead((i - a, i), (j - b, j), int(cost)))
                    i, j = i - a, j - b
                    break
            else:
                raise AssertionError("no bead leads to a cell of the path")
        out.reverse()
        if alternatives:
            self._alternatives(ahead, total, out)
        return out

    def _alternatives(self, ahead: np.ndarray, total: int, found: list[Bead]) -> None:
        behind = self.backward()
        for bead in found:
            if bead.left[1] - bead.left[0] != 1:
                continue
            i = bead.left[1]
            best, place = ALTERNATIVE + 1, None
            for a, b, _ in BEADS:
                if a != 1 or not b:
                    continue
                first = self.pad + self.at[i] - b - self.at[i - 1]
                through = ahead[i - 1, first : first + self.width] + self.cost[i, PLACE[a, b], self.own]
                through += behind[i, self.own]
                if bead.right[1] - bead.right[0] == b and 0 <= bead.right[1] - self.at[i] < self.width:
                    through[bead.right[1] - self.at[i]] = FAR
                at = int(through.argmin())
                if (extra := int(through[at]) - total) < best:
                    best, place = extra, (self.at[i] + at - b, self.at[i] + at)
            if place:
                bead.other, bead.extra = place, best


class Tables:
    """Whole tables of several pairs of unit sequences at once, one row of all of them after another.

    Each is filled out to the longest; a cell depends on none outside of its own pair's
    table.  The beads are those of :class:`Aligner` where its band holds the whole table.
    """

    def __init__(self, pairs: list[tuple[list[str], list[str]]], read: Passages):
        self.pairs = pairs
        self.n, self.m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
        count, n, m = len(pairs), int(self.n.max()), int(self.m.max())
        self.shape = (n + 1, count, m + 1)
        size_l, size_r = np.zeros((n + 1, count), dtype=np.int64), np.zeros((count, m + 1), dtype=np.int64)
        shared = np.zeros((n, count, m), dtype=np.int64)
        for k, (left, right) in enumerate(pairs):
            size_l[1 : len(left) + 1, k] = [len(x) for x in left]
            size_r[k, 1 : len(right) + 1] = [len(x) for x in right]
            where: dict[str, list[int]] = {}
            for j, text in enumerate(right):
                for a in read.anchors(text):
                    where.setdefault(a, []).append(j)
            if where:
                for i, text in enumerate(left):
                    for a in read.anchors(text):
                        for j in where.get(a, ()):
                            shared[i, k, j] += 1
        size_l, size_r = np.cumsum(size_l, axis=0), np.cumsum(size_r, axis=1)
        both = (size_l[-1] > 0) & (size_r[:, -1] > 0)
        ratio = np.where(both, size_r[:, -1] / np.maximum(size_l[-1], 1), 1.0)
        anchored = bool(shared.any())
        self.cost = {}
        for a, b, kind in BEADS:
            if not (a and b):
                self.cost[a, b] = kind
            elif n >= a and m >= b:
                l = ((size_l[a:] - size_l[:-a]).astype(np.float64) * ratio)[:, :, None]  # noqa: E741
                r = (size_r[:, b:] - size_r[:, :-b]).astype(np.float64)
                cost = kind + np.minimum(np.rint(50 * ((r - l) ** 2 / (SPREAD * np.maximum((l + r) / 2, 1.0)))), CAP).astype(np.int64)
                if anchored:
                    cost -= ANCHOR * np.minimum(sum(shared[u : n - a + u + 1, :, v : m - b + v + 1] for u in range(a) for v in range(b)), ANCHORS)
                self.cost[a, b] = cost  # of the beads that end at row a + i and column b + j

    def forward(self) -> np.ndarray:
        rows, _, width = self.shape
        table, steps = np.full(self.shape, FAR), self.cost[0, 1] * np.arange(width)
        table[0, :, 0] = 0
        for i in range(rows):
            best = table[i]
            for a, b, _ in BEADS:
                if a and i >= a and b < width:
                    cost = self.cost[a, b] if not b else self.cost[a, b][i - a]
                    np.minimum(best[:, b:], table[i - a, :, : width - b] + cost, out=best[:, b:])
            best -= steps
            np.minimum.accumulate(best, axis=1, out=best)
            best += steps
        return table

    def backward(self) -> np.ndarray:
        rows, _, width = self.shape
        table, steps = np.full(self.shape, FAR), self.cost[0, 1] * np.arange(width)
        table[self.n, np.arange(len(self.n)), self.m] = 0
        for i in range(rows - 1, -1, -1):
            best = table[i]
            for a, b, _ in BEADS:
                if a and i + a < rows and b < width:
                    cost = self.cost[a, b] if not b else self.cost[a, b][i]
                    np.minimum(best[:, : width - b], table[i + a, :, b:] + cost, out=best[:, : width - b])
            best += steps
            best[:] = np.minimum.accumulate(best[:, ::-1], axis=1)[:, ::-1]
            best -= steps
        return table

    def beads(self) -> list[list[Bead]]:
        ahead = self.forward()
        found = [self._path(ahead[:, k].tolist(), k) for k in range(len(self.pairs))]
        self._alternatives(ahead, found)
        return found

    def _path(self, ahead: list[list[int]], k: int) -> list[Bead]:
        i, j, out = int(self.n[k]), int(self.m[k]), []
        while i or j:
            for a, b, _ in BEADS:
                if i < a or j < b:
                    continue
                cost = int(self.cost[a, b][i - a, k, j - b]) if a and b else self.cost[a, b]
                if ahead[i - a][j - b] + cost == ahead[i][j]:
                    out.append(Bead((i - a, i), (j - b, j), cost))
                    i, j = i - a, j - b
                    break
            else:
                raise AssertionError("no bead leads to a cell of the path")
        out.reverse()
        return out

    def _alternatives(self, ahead: np.ndarray, found: list[list[Bead]]) -> None:
        behind, each = self.backward(), np.arange(len(found))
        total = ahead[self.n, each, self.m][:, None]
        best, place = np.full((self.shape[0], len(found)), ALTERNATIVE + 1), {}
        for a, b, _ in BEADS:
            if a != 1 or not b or b >= self.shape[2]:
                continue
            through = ahead[:-1, :, : self.shape[2] - b] + self.cost[a, b] + behind[1:, :, b:] - total
            own = [(x.left[0], k, x.right[0]) for k, beads in enumerate(found) for x in beads if x.left[1] - x.left[0] == 1 and x.right[1] - x.right[0] == b]
            if own:
                through[tuple(np.array(own).T)] = FAR
            at = np.argmin(through, axis=2)
            least = np.take_along_axis(through, at[:, :, None], axis=2)[:, :, 0]
            for i, k in zip(*(x.tolist() for x in np.nonzero(least < best[1:])), strict=True):
                best[i + 1, k] = least[i, k]
                place[i + 1, k] = (int(at[i, k]), int(at[i, k]) + b), int(least[i, k])
        for k, beads in enumerate(found):
            for bead in beads:
                if bead.left[1] - bead.left[0] == 1 and (bead.left[1], k) in place:
                    bead.other, bead.extra = place[bead.left[1], k]


def align_many(pairs: list[tuple[list[str], list[str]]], band: int = BAND, read: Passages | None = None) -> list[list[Bead]]:
    """The beads of each pair of unit sequences, as :class:`Aligner` finds them."""
    read = read or Passages()
    out: list = [None] * len(pairs)
    whole = []
    for k, (left, right) in enumerate(pairs):
        n, m = len(left), len(right)
        if n and left == right or n == m == 1 and left[0] and right[0]:
            # Equal sides: against half of the sum of its units' own costs a 1-2 or 2-1 bead costs 217 more at least, a 2-2 bead
            # 276 and a unit alone 454; a way off the diagonal takes two of them, which is more than ALTERNATIVE allows.
            # One unit on each side: lengths agree by the ratio, and apart they cost more.
            held = [len(read.anchors(x) if x == y else read.anchors(x) & read.anchors(y)) for x, y in zip(left, right, strict=True)]
            out[k] = [Bead(at := (i, i + 1), at, BEADS[0][2] - ANCHOR * min(x, ANCHORS)) for i, x in enumerate(held)]
        elif n and m and n < ROWS and m + 1 <= 2 * band + 2 + int(2 * (m / n)):
            whole.append(k)
        else:
            out[k] = Aligner(left, right, band, read).beads()
    # pairs of about the same size share a table
    whole.sort(key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(whole):
        end, width = at, 0
        while end < len(whole):
            width = max(width, len(pairs[whole[end]][1]) + 1)
            if end > at and (end + 1 - at) * (len(pairs[whole[end]][0]) + 1) * width > CELLS:
                break
            end += 1
        for k, beads in zip(whole[at:end], Tables([pairs[k] for k in whole[at:end]], read).beads(), strict=True):
            out[k] = beads
        at = end
    return out


def align_units(left: list[str], right: list[str], band: int = BAND) -> list[tuple]:
    """The beads of paragraphs and, in each bead with both sides, of its sentences, as rows of BEAD."""
    return align_rows([(left, right)], band)[0]


def align_rows(pairs: list[tuple[list[str], list[str]]], band: int = BAND) -> list[list[tuple]]:
    """:func:`align_units` of several pairs, whose tables are filled side by side."""
    read = Passages()
    for left, right in pairs:
        for x in left:
            read.sentences(x)
        for x in right:
            read.sentences(x)
    found = align_many(pairs, band, read)
    inner, of = [], []
    for r, ((left, right), beads) in enumerate(zip(pairs, found, strict=True)):
        for k, p in enumerate(beads):
            if p.left[0] < p.left[1] and p.right[0] < p.right[1]:
                inner.append(tuple([s for t in side for s in read.sentences(t)] for side in (left[slice(*p.left)], right[slice(*p.right)])))
                of.append((r, k))
    within = dict(zip(of, align_many(inner, band, read), strict=True))
    out = []
    for r, beads in enumerate(found):
        rows = []
        for k, p in enumerate(beads):
            rows.append(("paragraph", None, k, p))
            rows += [("sentence", k, q, s) for q, s in enumerate(within.get((r, k), ()))]
        out.append([
            (level, parent, k, *b.left, *b.right, f"{b.left[1] - b.left[0]}-{b.right[1] - b.right[0]}", b.cost, *(b.other or (None, None)), b.extra)
            for level, parent, k, b in rows
        ])
    return out


def align_sections(sections: DataFrame, keys: list[str], left: str = "left_units", right: str = "right_units", band: int = BAND) -> DataFrame:
    """keys and the beads of each row, which is a section of a record pair with its paragraphs on both sides (arrays of strings).

    A null array is a section that this side has not: the units of the other side are
    kept as unmatched; null units are empty.  Repeated rows are aligned again;
    an empty table gives no rows.
    """
    at = {k: sections.schema[k].dataType.simpleString() for k in keys}
    names = [x.split()[0] for x in BEAD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if n in ("level", "kind") else pa.int32() for n in names]
        for batch in batches:
            pairs, first, size = [], 0, 0
            for r, (a, b) in enumerate(zip(batch.column("_left").to_pylist(), batch.column("_right").to_pylist(), strict=True)):
                pairs.append(([x or "" for x in a or []], [x or "" for x in b or []]))
                size += sum(len(x) for side in pairs[-1] for x in side)
                if size < TOGETHER and r + 1 < batch.num_rows:
                    continue
                found = align_rows(pairs, band)
                rows = [x for beads in found for x in beads]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    each = pa.array(np.repeat(np.arange(first, r + 1), [len(beads) for beads in found]))
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(each) for k in keys] + columns, [*keys, *names])
                pairs, first, size = [], r + 1, 0

    schema = ", ".join(f"`{k}` {t}" for k, t in at.items()) + ", " + BEAD
    # an alignment takes far longer than moving its row, and a scan may be one task
    parts = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sections.select(*keys, F.col(left).alias("_left"), F.col(right).alias("_right")).repartition(parts, *keys)
    return rows.mapInArrow(run, schema)


def map_sections(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sections of both sides (keys, section, text) by name: a full outer join, as a section may have no counterpart."""
    a = left.select(*keys, "section", paragraphs(F.col("text")).alias("left_units"))
    b = right.select(*keys, "section", paragraphs(F.col("text")).alias("right_units"))
    return a.join(b, [*keys, "section"], "full_outer")
