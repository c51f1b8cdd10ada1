"""Which of many values does a text hold, anywhere in it? In time that grows with the text, not with the number of values.

A value of n bytes, 2^j <= n < 2^(j+1), is two windows of 2^j bytes: one from its start (head) and one to its end. Windows of
all places of a text are hashed by doubling, so a place is looked at further only if a value's head stands there; head, length
and last window then name the value, and a digest of the bytes confirms it. An index holds 28 bytes a value, not its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

_FIRST, _SECOND, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
#: Bytes of text whose windows are hashed at once. Longer texts are taken in pieces that overlap by the longest value.
PIECE = 1 << 17


def _mixed(a, b):
    made = a * _FIRST
    made ^= b * _SECOND
    made ^= made >> _HALF
    made *= _FIRST
    made ^= made >> _HALF
    return made


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64), np.arange(256, 0, -1).astype(np.uint64))


def _levels(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of the windows of 1, 2, 4, ... bytes at every place that has one."""
    made = _BYTES[data]
    for level in range(most + 1):
        if not len(made):
            return
        yield made
        made = _mixed(made[: -(1 << level)], made[1 << level :])


def _check(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little")


def fingerprints(values: Sequence[bytes]) -> dict[str, np.ndarray]:
    """size, head, tail and check of each value, none of them empty."""
    sizes = np.array([len(v) for v in values], np.int64)
    out = {"size": sizes, "head": np.zeros(len(values), np.uint64), "tail": np.zeros(len(values), np.uint64), "check": np.array([_check(v) for v in values], np.uint64)}
    starts = np.cumsum(sizes) - sizes
    level_of = np.frexp(sizes)[1] - 1
    for level, made in enumerate(_levels(np.frombuffer(b"".join(values), np.uint8), int(level_of.max(initial=0)))):
        mine = level_of == level
        out["head"][mine], out["tail"][mine] = made[starts[mine]], made[starts[mine] + sizes[mine] - (1 << level)]
    return out


class _Level:
    """The values of 2^level up to 2^(level+1) bytes."""

    def __init__(self, level: int, size: np.ndarray, head: np.ndarray, tail: np.ndarray, check: np.ndarray):
        self.width = 1 << level
        order = np.lexsort((size, head))
        new = np.ones(len(order), bool)
        head_s, size_s = head[order], size[order]
        new[1:] = (head_s[1:] != head_s[:-1]) | (size_s[1:] != size_s[:-1])
        heads, self.sizes = head_s[new], size_s[new]  # the lengths that each head comes with
        self.heads, self.first = np.unique(heads, return_index=True)
        self.count = np.diff(np.append(self.first, len(heads)))
        bits = min(22, max(12, 4 + len(self.heads).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.heads >> self.shift] = True
        keys = _mixed(_mixed(head, tail), size.astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.check = keys[order], check[order]

    def places(self, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, size) of every place where a head stands, for each length that the head comes with."""
        at = np.flatnonzero(self.maybe[made >> self.shift])
        which = np.searchsorted(self.heads, made[at])
        which[which == len(self.heads)] = 0
        same = self.heads[which] == made[at]
        at, which = at[same], which[same]
        times = self.count[which]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), self.sizes[np.repeat(self.first[which], times) + within]


class Index:
    """Distinct values, by their fingerprints."""

    def __init__(self, size: np.ndarray, head: np.ndarray, tail: np.ndarray, check: np.ndarray):
        level_of = np.frexp(size)[1] - 1
        self.levels = {int(k): _Level(int(k), size[m], head[m], tail[m], check[m]) for k in np.unique(level_of) for m in [level_of == k]}
        self.longest = int(size.max(initial=0))

    def counts(self, texts: Sequence[bytes]) -> list[int]:
        """How many of the values each text holds."""
        out = [0] * len(texts)
        if not self.levels:
            return out
        group, held = [], 0
        for n, text in enumerate(texts):
            if len(text) > PIECE:
                seen: set = set()
                for at in range(0, len(text), PIECE):
                    seen.update(self._found([text[at : at + PIECE + self.longest - 1]])[0])
                out[n] = len(seen)
                continue
            group.append(n)
            held += len(text)
            if held >= PIECE:
                self._count(texts, group, out)
                group, held = [], 0
        self._count(texts, group, out)
        return out

    def _count(self, texts: Sequence[bytes], group: list[int], out: list[int]) -> None:
        for n, found in zip(group, self._found([texts[n] for n in group])):
            out[n] = len(found)

    def _found(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """The values of each text, as (level, number)."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        whole = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        for level, made in enumerate(_levels(np.frombuffer(whole, np.uint8), max(self.levels))):
            if level not in self.levels:
                continue
            mine = self.levels[level]
            at, size = mine.places(made)
            text = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[text] if len(at) else np.zeros(0, bool)
            at, size, text = at[inside], size[inside], text[inside]
            keys = _mixed(_mixed(made[at], made[at + size - mine.width]), size.astype(np.uint64))
            number = np.searchsorted(mine.keys, keys)
            number[number == len(mine.keys)] = 0
            same = mine.keys[number] == keys
            at, size, text, number = at[same], size[same], text[same], number[same]
            _, once = np.unique(text * len(mine.keys) + number, return_index=True)
            for n, which, a, b in zip(text[once].tolist(), number[once].tolist(), at[once].tolist(), (at + size)[once].tolist()):
                if _check(whole[a:b]) == int(mine.check[which]):
                    found[n].append((level, which))
        return found
