"""Byte-level BPE ids of many texts at once.

Texts are cut into the tokenizer's pieces by array operations over code points; a piece
already met is looked up by hash, and only new pieces go through the merge table. The
ids equal those of tokenizers' encode(text, add_special_tokens=False); texts that hold
a special token's string are left to that library.
"""

from __future__ import annotations

import itertools
import json
import sys
import unicodedata

import numpy as np

from .common import Powers, mix

_U = np.uint64
_POWERS = Powers(0xA0761D6478BD642F)
_SLOTS, _POOL_IDS = 1 << 21, 8 << 20
SEGMENT_CHARS = 1 << 18
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[_WHITE] = SPACE
    return table


def piece_starts(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pieces of one text begin: contractions, then runs of one class with a space before."""
    n = len(codes)
    kind = table[codes]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    blank = codes == 32
    white = kind == SPACE
    ahead = np.zeros(n, bool)
    ahead[:-1] = ~white[1:]
    last = white & ahead  # the last white character of a run that text follows
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = (last & blank)[:-1]
    start &= ~joined
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        marks = marks[start[marks]]
        marks = marks[marks + 1 < n]
        one = codes[np.minimum(marks + 1, n - 1)]
        two = np.where(marks + 2 < n, codes[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        for i, k in zip(marks[size > 0].tolist(), size[size > 0].tolist(), strict=True):
            start[i + 1 : i + k] = False
            if i + k < n:
                # a space that text follows begins its own piece anyway
                start[i + k] = True
    return np.flatnonzero(start)


class Encoder:
    """Holds the cache of one Python worker."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        # byte-level vocabularies write each byte as one printable character
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in made["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in special}
        self.special = sorted(special)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow = path, None
        self.table = _classes()
        self.width = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int32)
        self.size = np.zeros(_SLOTS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        ids, counts, plain = [], np.zeros(len(texts), np.int64), []
        out: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                if self.slow is None:
                    from tokenizers import Tokenizer

                    self.slow = Tokenizer.from_file(self.path)
                out[i] = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
            elif text:
                plain.append(i)
        at = 0
        while at < len(plain):
            to, chars = at, 0
            while to < len(plain) and (to == at or chars + len(texts[plain[to]]) <= SEGMENT_CHARS):
                chars += len(texts[plain[to]])
                to += 1
            part = plain[at:to]
            for i, x in zip(part, self._plain([texts[i] for i in part]), strict=True):
                out[i] = x
            at = to
        for i in range(len(texts)):
            if i in out:
                counts[i] = len(out[i])
                ids.append(out[i])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        starts, base = [], 0
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        firsts = []
        for c in codes:
            s = piece_starts(c, self.table)
            firsts.append(len(s))
            starts.append(s + base)
            base += len(c)
        start, flat = np.concatenate(starts), np.concatenate(codes)
        end = np.append(start[1:], len(flat))
        up, down = _POWERS(len(flat) + 1)
        run = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat.astype(np.uint64) + _U(1)) * up[:-1], out=run[1:])
        key = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
        slot = (key & _U(_SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        lost = np.flatnonzero((self.keys[slot] != key) | (size == 0))
        if len(lost):
            found, index, inverse = np.unique(key[lost], return_index=True, return_inverse=True)
            first = lost[index]
            new_at, new_size = self._learn("".join(texts), start[first], end[first])
            at[lost], size[lost] = new_at[inverse], new_size[inverse]
            # one piece a slot: the latest stays
            to = slot[first]
            self.keys[to], self.at[to], self.size[to] = found, new_at, new_size
            # pieces of one slot in one call: what is read back must be one of them as a whole
            same = self.keys[to] == found
            self.at[to[same]], self.size[to[same]] = new_at[same], new_size[same]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        if self.used > _POOL_IDS:
            self.reset()
        cut = ends[np.cumsum(firsts) - 1]
        return np.split(ids, cut[:-1])

    def _learn(self, text: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        single = self.fast._core_bpe.encode_single_piece
        pool = [single(text[s:e].encode()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        size = np.fromiter(map(len, pool), np.int32, len(pool))
        ids = np.fromiter(itertools.chain.from_iterable(pool), np.uint32, int(size.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = (np.cumsum(size) - size + self.used).astype(np.int32)
        self.used += len(ids)
        return at, size


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


if sys.maxunicode != 0x10FFFF:
    raise ImportError("wide code points are needed")
