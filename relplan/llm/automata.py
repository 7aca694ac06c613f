"""Suffix automata of reference shards, and the matching statistics of texts streamed through them.

Texts are lists of whole numbers.  An automaton holds every substring of its
shard; a text that streams through it learns, at each unit, how long a suffix of
what it has read occurs in the shard.  The shard's own texts learn the same of
all that came before them while the automaton grows: the suffix link of a new
state is the longest suffix that was there already.

Shards are bounded by their number of units, as an automaton takes some 300 bytes
for each; a longer text is cut into pieces that overlap by one unit less than
the strings in question.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Units of a reference shard.
SHARD = 1 << 17

Automaton = tuple[list[dict[int, int]], list[int], list[int]]


def built(texts: Iterable[list[int]]) -> tuple[Automaton, list[int]]:
    """The automaton of the texts, and for each unit the longest suffix read that ended earlier too."""
    nexts: list[dict[int, int]] = [{}]
    link, length, matched = [-1], [0], []
    for text in texts:
        last = 0
        for unit in text:
            known = nexts[last].get(unit)
            reach = length[last] + 1
            if known is None:
                state = len(nexts)
                nexts.append({})
                length.append(reach)
                link.append(0)
                p = last
                while p >= 0 and unit not in nexts[p]:
                    nexts[p][unit] = state
                    p = link[p]
                if p >= 0:
                    known, short = nexts[p][unit], length[p] + 1
                    if length[known] != short:
                        known = _split(nexts, link, length, p, unit, known, short)
                    link[state] = known
                    matched.append(short)
                else:
                    matched.append(0)
                last = state
            else:
                if length[known] != reach:
                    known = _split(nexts, link, length, last, unit, known, reach)
                matched.append(reach)
                last = known
    return (nexts, link, length), matched


def _split(nexts: list[dict[int, int]], link: list[int], length: list[int], p: int, unit: int, old: int, reach: int) -> int:
    """A state for the strings of ``old`` of up to ``reach`` units, which now end in more places than the longer ones."""
    state = len(nexts)
    nexts.append(nexts[old].copy())
    length.append(reach)
    link.append(link[old])
    link[old] = state
    while p >= 0 and nexts[p].get(unit) == old:
        nexts[p][unit] = state
        p = link[p]
    return state


def statistics(automaton: Automaton, text: list[int]) -> list[int]:
    """For each unit, the longest suffix of what was read that occurs in the automaton's texts."""
    nexts, link, length = automaton
    state, reach, out = 0, 0, []
    for unit in text:
        while state and unit not in nexts[state]:
            state = link[state]
            reach = length[state]
        to = nexts[state].get(unit)
        if to is None:
            reach = 0
        else:
            state = to
            reach += 1
        out.append(reach)
    return out


def repeated(codes: np.ndarray, start: np.ndarray, count: np.ndarray, span: int, shard: int = SHARD) -> np.ndarray:
    """For texts in their order, which of their strings of ``span`` units occur earlier, in a text before or at an earlier place.

    Text i is codes[start[i] : start[i] + count[i] + span - 1] and has count[i] strings; they follow each other in the result.
    """
    step = max(1, shard - span + 1)
    pieces = -(-count // step)
    of = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, n = start[of] + nth * step, np.minimum(step, count[of] - nth * step)
    out = np.zeros(int(n.sum()), bool)
    ends = np.cumsum(n)
    lo = 0
    units = n + span - 1
    while lo < len(n):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(units[lo:]), shard, "right")))
        own = [codes[a : a + u].tolist() for a, u in zip(at[lo:hi].tolist(), units[lo:hi].tolist(), strict=True)]
        automaton, matched = built(own)
        matched = np.array(matched, np.int64)
        before = np.cumsum(units[lo:hi]) - units[lo:hi]
        for i in range(lo, hi):
            out[ends[i] - n[i] : ends[i]] |= matched[before[i - lo] + span - 1 : before[i - lo] + units[i]] >= span
        for i in range(hi, len(n)):
            here = slice(ends[i] - n[i], ends[i])
            if not out[here].all():
                out[here] |= np.array(statistics(automaton, codes[at[i] : at[i] + units[i]].tolist())[span - 1 :]) >= span
        lo = hi
    return out
