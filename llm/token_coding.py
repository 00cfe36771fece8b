"""An adaptive context-mixing range coder for token ids.

The ids of a text stream are cut into blocks of ``BLOCK`` ids.  Every block starts
from the same empty model and has its own checksum, so blocks are coded and read
independently.  All blocks of a frame are coded side by side, one id each a step, by
array operations over the blocks (lanes); no step picks lanes out but to move words.

A frame names the ids that it has, and the phrases of ids that come often, by falling
frequency: pairs of neighbours in a block are joined to one symbol, in ``PASSES``
passes.  The symbols' ranks are coded.  Predictions of a rank: order 2 (the rank that
lately followed the last two), order 1 (followed the last one), each with a
confidence, and order 0.  Whether the candidate (order 2's where it has seen the
context, else order 1's) is right is coded with a probability mixed in the logistic
domain from what both contexts' confidences have been worth so far; the mixing
weights follow the error.  If it is wrong, the rank is coded by order 0: its bit
length by an adaptive distribution under the bit length of the rank before, the next
four bits by one under the bit length, lower bits evenly.  Contexts learn at every
step, confidences, weights and distributions at every second one.  A range coder of
48 bits writes 16-bit words; carries are added up when a lane ends.  All results are
whole numbers that any machine reads as another wrote them.

A frame: magic, lengths and checksum of the head; the head (block size, pieces of
documents as id, number of ids and whether it goes on in the next frame; symbols,
words and checksum of each block; the ids of each symbol, and the ids without a
symbol of their own as they come); the words of all blocks.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK = 8192
LANES = 2048
MAGIC = b"TCM2"
#: Passes that join pairs, pairs joined in one, the least times that a pair comes, and symbols (in bits) that are joined.
PASSES = 2
PAIRS = 16_000
FEW = 12
_JOINED = 11
#: Ids that have a symbol of their own; all others share the one after them.
RANKED = 16_000
#: Ids whose pairs are joined at once, about.
_PART = 1 << 22
#: Steps after which lanes that have ended are left out.
_STRETCH = 128
_BITS = 14
_ONE = 1 << _BITS
#: The range stays between 2^32 and 2^48.
_LEAST = 1 << 32
#: Slots a lane of the tables of contexts, in bits.
_SLOTS = 10
_RATE = 5
_GAP = 40
_LEARN = 12
_MIX = 1 << 15
_EDGE = 2047
_K1, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_D = np.arange(-_EDGE, _EDGE + 1)
#: Logistic function of d / 256 in 12 bits, and its inverse.
SQUASH = np.clip(np.array([round(4096 / (1 + math.exp(-int(d) / 256))) for d in _D]), 8, 4088)
STRETCH = np.array([min(max(round(256 * math.log((p + 0.5) / (4095.5 - p))), -_EDGE), _EDGE) for p in range(4096)], dtype=np.int32)
_J = np.arange(16)
#: What the ends of a distribution's 16 parts move to: nearly all mass on the part seen, some on every other.
_TARGET = np.where(_J[None, :] < _J[:, None], (_J + 1) * _GAP, _ONE - (15 - _J) * _GAP).astype(np.int16)
_FLAT = ((_J + 1) * (_ONE // 16)).astype(np.int16)
_BYTES = np.uint64(0x0101010101010101)
#: A distribution of 16 ends as one item, so that numpy moves whole rows.
_ROW = np.dtype("V32")
_WHOLE = _TARGET.reshape(-1).view(_ROW)
#: Of a rank plus one: bit length less one, the next bits (four at most), the number of bits below.
_V = np.maximum(np.arange(1 << 16), 1)
_CLASS = (np.frexp(_V)[1] - 1).astype(np.uint8)
_BELOW = np.maximum(np.arange(16) - 4, 0)
_NEXT = ((_V - (1 << _CLASS.astype(np.int64))) >> _BELOW[_CLASS]).astype(np.uint8)


class _Writer:
    """Range encoders of many lanes; a lane's words, carries not yet passed on, are in out from its first place to at."""

    def __init__(self, lanes: int, room: int):
        self.lows = np.zeros(lanes, np.int64)
        self.ranges = np.full(lanes, (1 << 48) - 1, np.int64)
        self.out = np.zeros((lanes, room), np.uint32)
        self.at = np.arange(lanes, dtype=np.int64) * room

    def first(self, n: int, words: int) -> None:
        """From now on only the first n lanes are coded; so many words at most are written in each before the next call."""
        self.low, self.range = self.lows[:n], self.ranges[:n]
        lanes, had = self.out.shape
        used = self.at - np.arange(lanes, dtype=np.int64) * had
        if int(used.max(initial=0)) + words > had:
            more = had // 2 + words
            self.out = np.pad(self.out, ((0, 0), (0, more)))
            self.at = used + np.arange(lanes, dtype=np.int64) * (had + more)

    def flag(self, p: np.ndarray, wrong: np.ndarray) -> np.ndarray:
        r = self.range >> 12
        self.low += p * wrong * r
        np.multiply(np.abs(p - (wrong << 12)), r, out=self.range)
        return wrong

    def part(self, flat: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = at + value
        start = flat.take(at - 1, mode="wrap") & (_ONE - 1)
        r = self.range >> _BITS
        self.low += start * r
        np.multiply(flat.take(at) - start, r, out=self.range)
        return value

    def even(self, bits: np.ndarray, value: np.ndarray) -> np.ndarray:
        self.range >>= bits
        self.low += value * self.range
        return value

    def move(self) -> None:
        small = (self.range < _LEAST).nonzero()[0]
        flat = self.out.reshape(-1)
        while len(small):
            low, at, width = self.low[small], self.at[small], self.range[small] << 16
            flat[at] = low >> 32
            self.at[small] = at + 1
            self.low[small] = (low & 0xFFFFFFFF) << 16
            self.range[small] = width
            small = small[width < _LEAST]

    def end(self) -> list[np.ndarray]:
        self.first(len(self.lows), 3)
        flat = self.out.reshape(-1)
        for _ in range(3):
            flat[self.at] = self.low >> 32
            self.low = (self.low & 0xFFFFFFFF) << 16
            self.at += 1
        over = self.out >> 16
        while over.any():
            self.out &= 0xFFFF
            self.out[:, :-1] += over[:, 1:]
            over = self.out >> 16
        used = self.at - np.arange(len(self.at)) * self.out.shape[1]
        return [row[:n].astype("<u2") for row, n in zip(self.out, used, strict=True)]


class _Reader:
    """Range decoders of many lanes; code is what is left above low."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words = np.concatenate([words, np.zeros(1, np.uint16)]).astype(np.uint16)
        self.at = starts.astype(np.int64)
        self.ranges = np.full(len(starts), (1 << 48) - 1, np.int64)
        self.codes = np.zeros(len(starts), np.int64)
        for _ in range(3):
            self.codes = self.codes << 16 | self.words.take(self.at, mode="clip")
            self.at += 1

    def first(self, n: int, words: int) -> None:
        self.range, self.code = self.ranges[:n], self.codes[:n]

    def flag(self, p: np.ndarray, wrong: None) -> np.ndarray:
        r = self.range >> 12
        bound = p * r
        wrong = (self.code >= bound).astype(np.int64)
        self.code -= bound * wrong
        np.multiply(np.abs(p - (wrong << 12)), r, out=self.range)
        return wrong

    def part(self, flat: np.ndarray, at: np.ndarray, value: None) -> np.ndarray:
        r = self.range >> _BITS
        # both are below 2^53 and the quotient below 2^15, so it is exact when cut
        target = np.minimum(self.code / r, _ONE - 1).astype(np.int16)
        # sixteen truth bytes a row, added up in two machine words
        below = (flat.view(_ROW).take(at >> 4).view(np.int16).reshape(-1, 16) <= target[:, None]).view(np.uint64)
        value = ((below[:, 0] + below[:, 1]) * _BYTES >> np.uint64(56)).view(np.int64)
        at = at + value
        start = flat.take(at - 1, mode="wrap") & (_ONE - 1)
        self.code -= start * r
        np.multiply(flat.take(at) - start, r, out=self.range)
        return value

    def even(self, bits: np.ndarray, value: None) -> np.ndarray:
        self.range >>= bits
        value = np.minimum((self.code / self.range).astype(np.int64), (1 << bits) - 1)
        self.code -= value * self.range
        return value

    def move(self) -> None:
        small = (self.range < _LEAST).nonzero()[0]
        while len(small):
            at, width = self.at[small], self.range[small] << 16
            self.code[small] = self.code[small] << 16 | self.words.take(at, mode="clip")
            self.at[small] = at + 1
            self.range[small] = width
            small = small[width < _LEAST]


def _run(coder: _Writer | _Reader, lengths: np.ndarray, n_ranks: int, ranks: np.ndarray | None) -> np.ndarray:
    """Codes one rank of every lane a step; lanes are sorted by falling length.  ranks is [step, lane] to write, None to read."""
    lanes, steps = len(lengths), int(lengths[0])
    out = np.zeros((steps, lanes), np.uint16) if ranks is None else ranks
    # tables of order 2 and, in the second half, of order 1: a rank and its confidence (0 to 7) for each slot of a lane
    kept = np.uint16 if n_ranks <= 8192 else np.uint32
    held = np.zeros(2 * lanes << _SLOTS, kept)
    base = (np.arange(2 * lanes, dtype=np.int64) << _SLOTS).reshape(2, -1)
    # what confidences have been worth, apart for whether both orders tell the same
    trusted = (65535 * (np.arange(8) + 0.2) / (np.arange(8) + 2)).astype(np.int32)
    sure = np.tile(trusted, 4 * lanes)
    places = (np.arange(2 * lanes, dtype=np.int64) * 16).reshape(2, -1)
    weight = np.full((2, lanes), _MIX, np.int32)
    # distributions: the first one is whole and stands for nothing coded; then 16 a lane under the last length, 16 under the length
    flat = np.concatenate([np.full(16, _ONE, np.int16), np.tile(_FLAT, lanes * 32)])
    rows = flat.view(_ROW)
    lane_rows = (np.arange(2 * lanes, dtype=np.int64) * 16 + 1).reshape(2, -1)
    last, before, kind = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.zeros(lanes, np.int64)
    for step in range(steps):
        if not step % _STRETCH:
            n = int(np.searchsorted(-lengths, -step, side="left"))
            coder.first(n, _STRETCH * 3 + 4)
            base, places, lane_rows, weight = (x[:, :n].copy() for x in (base, places, lane_rows, weight))
            last, before, kind = last[:n], before[:n], kind[:n]
            key, seen, parts = np.empty((2, n), np.uint32), np.empty((2, n), np.int64), np.empty((2, n), np.int64)
        np.multiply(last, _K1, out=key[1])
        np.multiply(before, _K2, out=key[0])
        key[0] += key[1]
        slot = (base + (key >> np.uint32(32 - _SLOTS))).reshape(-1)
        entry = held.take(slot).reshape(2, -1)
        guesses, trust = entry >> 3, entry & 7
        guess = np.where(trust[0] > 0, guesses[0], guesses[1])
        place = places + (trust + ((guesses[0] == guesses[1]).view(np.uint8) << 3))
        chance = sure.take(place)
        stretched = STRETCH.take(chance >> 4)
        mixed = weight * stretched
        p = SQUASH.take((mixed[0] + mixed[1] >> 16) + _EDGE, mode="clip")
        now = None if ranks is None else ranks[step, :n]
        wrong = coder.flag(p, None if now is None else (guess != now).astype(np.int64))
        if step & 1:
            goal = (4096 - (wrong << 12)).astype(np.int32)
            weight += stretched * ((goal - p.astype(np.int32)) * _LEARN) >> 16
            sure[place.reshape(-1)] = (chance + ((goal << 4) - chance >> 5)).reshape(-1)
        np.add(lane_rows[0], kind, out=seen[0])
        asked = seen[0] * wrong << 4
        if now is None:
            kind = coder.part(flat, asked, None)
            coder.move()
            kind = np.where(wrong > 0, kind, _CLASS.take(guess + np.int64(1), mode="clip"))
            np.add(lane_rows[1], kind, out=seen[1])
            part = coder.part(flat, seen[1] * wrong << 4, None)
            bits = _BELOW.take(kind) * wrong
            rest = coder.even(bits, None)
            found = np.where(wrong > 0, (1 << kind) + (part << bits) + rest - 1, guess).astype(np.uint32)
            out[step, :n] = found
            if step & 1:
                parts[1] = _NEXT.take(found + np.int64(1), mode="clip")
        else:
            value = now + np.int64(1)
            kind = _CLASS.take(value).astype(np.int64)
            coder.part(flat, asked, kind * wrong)
            coder.move()
            np.add(lane_rows[1], kind, out=seen[1])
            parts[1] = _NEXT.take(value)
            coder.part(flat, seen[1] * wrong << 4, parts[1] * wrong)
            bits = _BELOW.take(kind) * wrong
            coder.even(bits, value & (1 << bits) - 1)
            found = now.astype(np.uint32)
        coder.move()
        if step & 1:
            parts[0] = kind
            which = seen.reshape(-1)
            ends = rows.take(which, mode="clip").view(np.int16)
            ends += _WHOLE.take(parts.reshape(-1)).view(np.int16) - ends >> _RATE
            rows.put(which, ends.view(_ROW), mode="clip")
        weaker = np.where(trust > 2, entry - 2, (found << 3 | 1).astype(kept))
        held[slot] = np.where(guesses == found, entry + (trust < 7), weaker).reshape(-1)
        last, before = found, last
    return out


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]], np.ndarray]:
    """The symbol of every id, the ids of each symbol, and the ids that share the last symbol as they come."""
    if len(ids) and int(ids.max()) < 1 << 20:
        known, at = np.arange(int(ids.max()) + 1), ids
        counts = np.bincount(ids)
    else:
        known, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.zeros(len(counts), np.int32)
    place[order] = np.minimum(np.arange(len(order)), RANKED)
    symbols = place.take(at)
    names = [(i,) for i in known[order[:RANKED]].tolist()]
    if len(order) <= RANKED:
        return symbols, names, ids[:0]
    return symbols, [*names, (0,)], ids[symbols == RANKED]


def _joined(parts: list[tuple[np.ndarray, np.ndarray]], names: list[tuple[int, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Symbols and what opens a block, in parts, after one pass; the names of new symbols are appended."""
    many = (1 << _JOINED) - 1
    counts = sum(np.bincount(symbols, minlength=len(names)) for symbols, _ in parts)
    counts[RANKED : RANKED + 1] = 0
    order = np.argsort(-counts, kind="stable")[: min(many, np.count_nonzero(counts))]
    place = np.full(len(names), many, np.int32)
    place[order] = np.arange(len(order))

    def pairs(symbols: np.ndarray) -> np.ndarray:
        small = place.take(symbols)
        return small[:-1] << _JOINED | small[1:]

    times = sum(np.bincount(pairs(symbols), minlength=1 << 2 * _JOINED) for symbols, _ in parts).reshape(1 << _JOINED, -1)
    times[many], times[:, many] = 0, 0
    times = times.reshape(-1)
    often = (times >= FEW).nonzero()[0]
    often = often[np.argsort(-times[often], kind="stable")][: min(PAIRS, (1 << 16) - 2 - len(names))]
    table = np.zeros(1 << 2 * _JOINED, np.uint16)
    table[often] = np.arange(1, len(often) + 1)
    done = []
    for symbols, opens in parts:
        found = table.take(pairs(symbols))
        good = (found > 0) & ~opens[1:]
        # of pairs that overlap, every second one
        at = np.arange(len(good), dtype=np.int32)
        taken = (good & ((at - np.maximum.accumulate(np.where(good, np.int32(-1), at))) & 1 == 1)).nonzero()[0]
        symbols[taken] = found[taken].astype(np.int32) + (len(names) - 1)
        keep = np.ones(len(symbols), bool)
        keep[taken + 1] = False
        done.append((symbols[keep], opens[keep]))
    names += [names[a] + names[b] for a, b in zip(order[often >> _JOINED].tolist(), order[often & many].tolist(), strict=True)]
    return done


def _phrases(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]], np.ndarray, int]:
    """Ranks of the symbols, symbols of each block, the ids of each rank, the ids without a symbol, and the rank they share."""
    symbols, names, rest = _ranked(ids)
    opens = np.zeros(len(ids), bool)
    opens[::BLOCK] = True
    # pairs never reach over two blocks, so parts of blocks bound what is held besides the ids
    size = max(1, _PART // BLOCK) * BLOCK
    parts = [(symbols[lo : lo + size], opens[lo : lo + size]) for lo in range(0, len(ids), size)]
    for _ in range(PASSES):
        parts = _joined(parts, names)
    counts = sum(np.bincount(symbols, minlength=len(names)) for symbols, _ in parts)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.zeros(len(names), np.uint16)
    place[order] = np.arange(len(order))
    lengths = np.concatenate([np.diff(np.append(opens.nonzero()[0], len(opens))) for _, opens in parts])
    ranks = np.concatenate([place.take(symbols) for symbols, _ in parts])
    return ranks, lengths, [names[k] for k in order.tolist()], rest, int(place[RANKED]) if len(rest) else 0


def encode(ids: np.ndarray, pieces: list[tuple[int | None, int, bool]]) -> bytes:
    """One frame of ids (uint32); pieces are (document, number of ids, goes on) in order."""
    words: list[np.ndarray] = []
    lengths, names, rest, shared = np.zeros(0, np.int64), [], ids[:0], 0
    if len(ids):
        ranks, lengths, names, rest, shared = _phrases(ids)
        lanes = np.argsort(-lengths, kind="stable")
        grid = np.zeros((len(lengths), int(lengths.max())), np.uint16)
        ends = np.cumsum(lengths)
        for row, k in zip(grid, lanes.tolist(), strict=True):
            row[: lengths[k]] = ranks[ends[k] - lengths[k] : ends[k]]
        coder = _Writer(len(lengths), grid.shape[1] + 400)
        _run(coder, lengths[lanes], len(names), np.ascontiguousarray(grid.T))
        words = coder.end()
    sums = [zlib.crc32(ids[lo : lo + BLOCK].astype("<u4").tobytes()) for lo in range(0, len(ids), BLOCK)]
    head = b"".join(
        [
            struct.pack("<IQQQQQQ", BLOCK, len(ids), len(pieces), len(lengths), len(names), len(rest), shared),
            np.array([0 if d is None else d for d, _, _ in pieces], "<i8").tobytes(),
            np.array([n for _, n, _ in pieces], "<u4").tobytes(),
            np.array([(d is None) + 2 * on for d, _, on in pieces], "u1").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.array([len(w) for w in words], "<u4").tobytes(),
            np.array(sums, "<u4").tobytes(),
            np.array([len(x) for x in names], "<u4").tobytes(),
            rest.astype("<u4").tobytes(),
            np.array([i for x in names for i in x], "<u4").tobytes(),
        ]
    )
    head = zlib.compress(head)
    body = b"".join(w.tobytes() for w in words)
    return MAGIC + struct.pack("<IQI", len(head), len(body), zlib.crc32(head)) + head + body


def decode(raw: memoryview, at: int) -> tuple[np.ndarray, list[tuple[int | None, int, bool]], int]:
    """Ids and pieces of the frame at a place, and the place behind it; every checksum is held against what was read."""
    if bytes(raw[at : at + 4]) != MAGIC:
        raise ValueError(f"no frame at {at}")
    n_head, n_body, check = struct.unpack_from("<IQI", raw, at + 4)
    at += 20
    packed = raw[at : at + n_head]
    if zlib.crc32(packed) != check:
        raise ValueError(f"the head of the frame at {at - 20} does not match its checksum")
    head = zlib.decompress(packed)
    form = "<IQQQQQQ"
    block, total, n_pieces, n_lanes, n_names, n_rest, shared = struct.unpack_from(form, head)
    where = struct.calcsize(form)
    parts = []
    for kind, n in (("<i8", n_pieces), ("<u4", n_pieces), ("u1", n_pieces), ("<u4", n_lanes), ("<u4", n_lanes), ("<u4", n_lanes), ("<u4", n_names), ("<u4", n_rest)):
        parts.append(np.frombuffer(head, kind, n, where))
        where += parts[-1].nbytes
    docs, counts, flags, lengths, sizes, sums, spans, rest = parts
    at += n_head
    ids = np.zeros(0, np.uint32)
    if n_lanes:
        words = np.frombuffer(raw[at : at + n_body], "<u2")
        named = np.frombuffer(head, "<u4", int(spans.sum()), where)
        lengths = lengths.astype(np.int64)
        lanes = np.argsort(-lengths, kind="stable")
        # the words of the blocks follow one another in the order of the lanes
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
        grid = np.ascontiguousarray(_run(_Reader(words, starts), lengths[lanes], n_names, None).T)
        place = np.argsort(lanes)
        ranks = np.concatenate([grid[place[k], :n] for k, n in enumerate(lengths.tolist())])
        spans = spans.astype(np.int32)
        opens = np.cumsum(spans, dtype=np.int32) - spans
        long = spans.take(ranks, mode="clip")
        if (held := int(long.sum(dtype=np.int64))) != total:
            raise ValueError(f"the blocks of the frame before {at + n_body} have {held} ids and not {total}")
        begins = np.cumsum(long, dtype=np.int32) - long
        opens, named, ids = opens.take(ranks, mode="clip") - begins, named.astype(np.uint32), np.empty(total, np.uint32)
        for lo in range(0, len(ranks), _PART):
            places = np.repeat(opens[lo : lo + _PART], long[lo : lo + _PART])
            first = int(begins[lo])
            places += np.arange(first, first + len(places), dtype=np.int32)
            ids[first : first + len(places)] = named.take(places)
        if n_rest:
            ids[begins[ranks == shared]] = rest
    for k, s in enumerate(sums.tolist()):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != s:
            raise ValueError(f"block {k} of the frame does not match its checksum")
    pieces = [(None if f & 1 else d, n, bool(f & 2)) for d, n, f in zip(docs.tolist(), counts.tolist(), flags.tolist(), strict=True)]
    return ids, pieces, at + n_body
