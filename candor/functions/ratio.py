"""difflib's sequence ratio of long texts, with the same result in less time."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

#: Texts whose runs of rare characters are longer than this are left to difflib.
LONGEST_RUN = 24


class Later:
    """A later text, which earlier ones are compared with.

    difflib leaves characters out that are popular in a later text of 200 or more: a block is the first longest run of
    rare ones that both texts have, and what is equal beside it. Runs of rare characters are short, so for each length
    from the longest down their places are looked up, where difflib goes over both texts again for each block.
    """

    def __init__(self, text: str):
        self.text, self.matcher, self.places = text, None, {}
        self.rare = None
        if len(text) >= 200:
            most = len(text) // 100 + 1
            self.rare = re.compile("[" + "".join(re.escape(c) for c, k in Counter(text).items() if k <= most) + "]+") if min(Counter(text).values()) <= most else re.compile(r"(?!)")
            self.runs = [(m.start(), m.end()) for m in self.rare.finditer(text)]
            self.longest = max((b - a for a, b in self.runs), default=0)
            if self.longest > LONGEST_RUN:
                self.rare = None

    def _at(self, size: int) -> dict[str, list[int]]:
        """Places of each run of so many rare characters, also inside of longer ones."""
        if size not in self.places:
            self.places[size] = _grams(self.text, self.runs, size)
        return self.places[size]

    def ratio(self, text: str) -> float:
        """SequenceMatcher(None, text, self.text).ratio()."""
        if self.rare is None:
            if self.matcher is None:
                self.matcher = difflib.SequenceMatcher(None)
                self.matcher.set_seq2(self.text)
            self.matcher.set_seq1(text)
            return self.matcher.ratio()
        a, b = text, self.text
        runs = [(m.start(), m.end()) for m in self.rare.finditer(a)]
        levels = []
        for size in range(min(self.longest, max((y - x for x, y in runs), default=0)), 0, -1):
            there = self._at(size)
            here = sorted((i, there[g]) for g, at in _grams(a, runs, size).items() if g in there for i in at)
            if here:
                levels.append((size, [i for i, _ in here], [at for _, at in here]))
        total, queue = 0, [(0, len(a), 0, len(b))]
        while queue:
            alo, ahi, blo, bhi = queue.pop()
            i, j, k = _longest(levels, alo, ahi, blo, bhi)
            back = _equal(a, b, i, j, min(i - alo, j - blo), -1)
            i, j, k = i - back, j - back, k + back
            k += _equal(a, b, i + k, j + k, min(ahi - i - k, bhi - j - k), 1)
            if k:
                total += k
                if alo < i and blo < j:
                    queue.append((alo, i, blo, j))
                if i + k < ahi and j + k < bhi:
                    queue.append((i + k, ahi, j + k, bhi))
        return 2.0 * total / (len(a) + len(b))


def _grams(text: str, runs: list[tuple[int, int]], size: int) -> dict[str, list[int]]:
    out = {}
    for x, y in runs:
        for i in range(x, y - size + 1):
            out.setdefault(text[i : i + size], []).append(i)
    return out


def _longest(levels, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The first longest run of rare characters in both ranges; an empty one stands at their starts."""
    for size, starts, places in levels:
        if size > ahi - alo or size > bhi - blo:
            continue
        for t in range(bisect_left(starts, alo), bisect_right(starts, ahi - size)):
            at = places[t]
            p = bisect_left(at, blo)
            if p < len(at) and at[p] <= bhi - size:
                return starts[t], at[p], size
    return alo, blo, 0


def _equal(a: str, b: str, i: int, j: int, most: int, way: int) -> int:
    """How many characters are equal from i and j on, or before them, at most."""
    done, step = 0, 8
    while done < most:
        step = min(step, most - done)
        x, y = (i + done, j + done) if way > 0 else (i - done - step, j - done - step)
        if a[x : x + step] == b[y : y + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
            most = min(most, done + 4 * step + 3)
    return done
