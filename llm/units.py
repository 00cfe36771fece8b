"""Cutting texts at safe boundaries and encoding the cut units with public tokenizers.

A *unit* ends before a space that follows a character that is no white space
nor the model's own space mark.  A sentencepiece BPE merges only into pieces of
its vocabulary, so such a point is safe when no piece has the mark after another
character; that is checked against the vocabulary when the model is loaded, and
the model's normaliser must keep spaces as they are.  So the ids of a text are
the ids of its units, one after the other.  Units recur, which is why each
Python worker keeps the ids of those it met lately, over the tasks that it
serves, in two generations of bounded size.  Where the check fails the whole
text is the only unit.

Byte-level BPE splits text into words itself and is fast enough on whole texts.
Where ids of many texts are wanted at once, its texts are cut before every space as
well: a space between two characters that are no white space opens a word of the
pattern, whatever stands before it, so different words are encoded once a column.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CALL_BYTES = 1 << 18
#: Units of a generation; a worker holds two.
CACHE_UNITS = 250_000
CHUNK_BYTES = 1 << 20
MARK = "▁"
LONG_WORD = 10_000
#: How byte-level BPE files split text into words (a public fixed pattern).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ("", "a bc.,!", " don't we'll  I'M 12 3,4  \n\n x\t\r\n", "Über ça señor ßẞ ǅ \u00a0\u3000 漢字 かな 😀👍🏽 \u0301e\u0301 ١٢ Ⅷ²", "x" * 300 + "  ")
_ODD = re.compile(r"\s |▁ ")
_CUT = re.compile(r"(?<=[^\s▁]) ")
#: White space (of Unicode, for RE2) before a space or at the end: such a text is not cut at spaces.
_LOOSE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}](?: |\z)"


def tokenizer_path(name: str) -> str:
    """Where the named public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(text: str) -> list[str]:
    """The units of a text without the space that opens each but the first."""
    return _CUT.split(text) if text[:1] == " " or _ODD.search(text) else text.split(" ")


class SentencePieceUnits:
    """Ids of units by the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = self.model.encode("a  b", out_type=str)
        self.safe = plain[0].startswith(MARK) and "".join(plain) == f"{MARK}a{MARK}{MARK}b" and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.alone = self.model.encode("a ")[len(self.model.encode("a")) :]

    def encode(self, units: list[str], first: bool) -> list[list[int]]:
        """The dummy prefix that the library puts before a text stands for the unit's space."""
        ids = self.model.encode(units, num_threads=1)
        if not first:
            ids = [self.alone if not u else i for u, i in zip(units, ids, strict=True)]
        return ids


class TokenizersTexts:
    """Ids of texts as the tokenizers library gives them for a .json file.

    For byte-level BPE files the ids of plain texts come from tiktoken, with the
    vocabulary read from the same file: it applies the same merges several times
    faster.  Texts with a special string, texts with a very long word, and files
    of another kind or for which a probe differs go to the tokenizers library.
    """

    safe = False

    def __init__(self, path: str):
        # the library's own thread pool would take the cores of other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.plain = self._same_merges(path)
        if self.plain and any(self.plain.encode_ordinary(x) != self._whole(x) for x in PROBES):
            self.plain = None

    def _same_merges(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kinds = file.get("pre_tokenizer") or {}
        if file.get("normalizer") or kinds.get("type") != "ByteLevel" or kinds.get("add_prefix_space"):
            return None
        import tiktoken

        # bytes that print as themselves, then the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.lengths[list(ranks.values())] = list(map(len, ranks))
        return tiktoken.Encoding("texts", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def encode_text(self, text: str) -> list[int]:
        if self.plain is None or any(s in text for s in self.special) or len(text) > LONG_WORD and max(map(len, text.split()), default=0) > LONG_WORD:
            return self._whole(text)
        return self.plain.encode_ordinary(text)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has; null is empty."""
        column = pc.fill_null(column, "")
        whole = pc.match_substring_regex(column, _LOOSE).to_numpy(zero_copy_only=False)
        for x in self.special:
            whole |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        for i in (pc.binary_length(column).to_numpy() > LONG_WORD).nonzero()[0].tolist():
            whole[i] = whole[i] or max(map(len, column[i].as_py().split()), default=0) > LONG_WORD
        if self.plain is None:
            whole[:] = True
        # the texts that are not cut stand as one first word each
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", column), " ")
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        codes = words.indices.to_numpy().copy()
        first = offsets[:-1]
        ids, counts = self._words(words.dictionary)
        opening = [self.encode_text(column[i].as_py() if w else words.dictionary[int(codes[f])].as_py()) for i, (w, f) in enumerate(zip(whole.tolist(), first.tolist(), strict=True))]
        # the ids of the first words follow those of all others
        counts = np.concatenate([counts, np.fromiter(map(len, opening), np.int64, len(opening))]).astype(np.int32)
        begins = np.cumsum(counts, dtype=np.int32) - counts
        codes[first] = len(words.dictionary) + np.arange(len(first))
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(opening), np.uint32)])
        long = counts.take(codes)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(long, dtype=np.int64)])
        where = np.repeat(begins.take(codes) - ends[:-1].astype(np.int32), long)
        where += np.arange(len(where), dtype=np.int32)
        return ids.take(where), np.diff(ends.take(offsets))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each word, one after the other, and how many each has."""
        if not len(words) or self.plain is None:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = self.plain.encode_to_numpy(" " + joined, disallowed_special=())
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        told = np.searchsorted(np.cumsum(self.lengths.take(ids)), ends) + 1
        return ids, np.diff(told, prepend=0)


def load(path: str) -> SentencePieceUnits | TokenizersTexts:
    """The library for a file: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        return SentencePieceUnits(path)
    if path.endswith(".json"):
        return TokenizersTexts(path)
    raise ValueError("a .model or .json vocabulary file is needed")


class Encoder:
    """Encodes Arrow string arrays; keep turns a unit's ids into what is kept of them."""

    def __init__(self, path: str, keep: Callable[[list[int]], object]):
        self.units = load(path)
        self.keep = keep
        # units that open a text, and all others: known lately, known before that
        self.known: list[dict] = [{}, {}]
        self.past: list[dict] = [{}, {}]

    def _learn(self, wanted: set[str], first: bool) -> dict:
        """Makes all wanted units known, encoding new ones in calls of about equal bytes."""
        if len(self.known[first]) > CACHE_UNITS:
            self.past[first], self.known[first] = self.known[first], {}
        known, past = self.known[first], self.past[first]
        wanted = wanted - known.keys()
        again = wanted & past.keys()
        known.update((u, past[u]) for u in again)
        new = list(wanted - again)
        sizes = np.cumsum(np.fromiter(map(len, new), dtype=np.int64, count=len(new)) + 1)
        lo = 0
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CALL_BYTES)))
            call = new[lo:hi]
            known.update(zip(call, map(self.keep, self.units.encode(call, first)), strict=True))
            lo = hi
        return known

    def texts(self, column: pa.Array) -> Iterator[tuple[str, list]]:
        """(text, what is kept of each unit in order) for every row; null is empty."""
        if isinstance(self.units, TokenizersTexts):
            for x in column:
                text = x.as_py() or ""
                yield text, [self.keep(self.units.encode_text(text))]
            return
        lo = 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
        while lo < len(column):
            base = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES)))
            yield from self._chunk([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
            lo = hi

    def _chunk(self, texts: list[str]) -> Iterator[tuple[str, list]]:
        parts = [cut(t) if self.units.safe else [t] for t in texts]
        opening = self._learn({p[0] for p in parts}, True)
        wanted: set[str] = set()
        for p in parts:
            wanted.update(p)
        rest = self._learn(wanted, False)
        for t, p in zip(texts, parts, strict=True):
            out = list(map(rest.__getitem__, p))
            out[0] = opening[p[0]]
            yield t, out


@lru_cache(maxsize=2)
def worker_encoder(path: str, keep: Callable[[list[int]], object]) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return Encoder(path, keep)
