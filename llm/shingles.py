"""Word and shingle hashing kernels (numpy, whole texts, no per-word Python loop).

Words are runs of bytes other than space and ``\\x09-\\x0D``; A-Z is lower-cased
on bytes, so multi-byte characters are left alone.  A shingle is five
consecutive words; a text with one to four words has one shingle, the whole
sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed by a digest.
DIGEST_BYTES = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_BASES = {"f": _P, "i": pow(_P, -1, 2**64)}
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.full(size, _BASES[kind], dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes between words where only letters, digits and non-ASCII characters count.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[128:] = False
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def word_spans(raw: np.ndarray, cuts: np.ndarray, gap: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words never cross a byte in cuts."""
    word = ~gap[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums; of long spans from a digest.

    A polynomial modulo 2**64 cannot tell some words of 1,024 letters and more apart
    (Thue-Morse words and their complements), whatever its base; shorter words don't collide so.
    """
    n = len(raw)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_MIX[raw] * _power("f", n), out=prefix[1:])
    size = end - start
    out = mix64((prefix[end] - prefix[start]) * _power("i", n + 1)[start] + size.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(size > DIGEST_BYTES).tolist():
        out[i] = int.from_bytes(blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive word hashes."""
    n = len(words) - k + 1
    out = words[:n].copy()
    for i in range(1, k):
        out = mix64(out * _STEP + words[i : i + n])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    s = np.sort(values)
    keep = np.empty(len(s), dtype=bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets into them; null is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def text_words(texts: pa.Array, lower: bool = True, gap: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text of an array, in order."""
    for i, words, _, _ in text_word_spans(texts, lower, gap):
        yield i, words


def text_word_spans(
    texts: pa.Array, lower: bool = True, gap: np.ndarray = _IS_SPACE
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, start bytes, end bytes) of every text of an array, in order."""
    raw, off = text_buffer(texts)
    for lo, hi in chunks(off):
        part = raw[off[lo] : off[hi]]
        cuts = off[lo : hi + 1] - off[lo]
        if not len(part):
            none = np.zeros(0, dtype=np.int64)
            for i in range(lo, hi):
                yield i, none.astype(np.uint64), none, none
            continue
        if lower:
            part = _LOWER[part]
        start, end = word_spans(part, cuts, gap)
        words = hash_words(part, start, end)
        at = np.searchsorted(start, cuts)
        for i in range(lo, hi):
            a, b = at[i - lo], at[i - lo + 1]
            yield i, words[a:b], start[a:b] - cuts[i - lo], end[a:b] - cuts[i - lo]


def shingle_set(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's words."""
    if len(words) == 0:
        return words
    if len(words) < k:
        return combine(words, len(words)) ^ np.uint64(len(words))
    return distinct(combine(words, k))
