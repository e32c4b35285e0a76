"""Recompression: the locally consistent parse behind substring deduplication.

A round first names maximal runs of one symbol, then names pairs: symbols fall into a
left and a right half by a bit of their name, and a left symbol followed by a right one
becomes a new symbol.  A name is a fingerprint of what it stands for, so it is global: all
executors give equal runs and pairs equal names.

Whether a symbol exists depends only on the words in its context [low, high), which each
round widens by the neighbours it looked at; a symbol at a text's edge depends on the
edge and has no finite context.  So a window that contains a symbol's whole context has
that symbol wherever the window occurs.

Rounds go on up to one symbol a text.  What a symbol stands for are the words [first, end),
so two places of one high symbol are a repeat of that many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import Rolling, mix

#: Rounds of the low symbols that anchor windows; a context must fit into a window.
ROUNDS = 2
#: Rounds at which a text counts as parsed even if it isn't one symbol yet: a text of n words
#: takes about 4 * log(n).  Higher symbols would only say again what lower ones say.
MOST_ROUNDS = 80
FAR = 1 << 40
_PAIR = np.uint64(0x9FB21C651E98DF25)
_RUN = np.uint64(0xD6E8FEB86659FD93)


def _runs(name: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and name of the maximal runs of one symbol."""
    joined = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
    start = np.flatnonzero(np.concatenate(([True], ~joined)))
    end = np.append(start[1:], len(name))
    size = (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        return start, end, np.where(size > 1, mix(name[start] * _RUN + size), name[start])


def _pairs(name: np.ndarray, text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols' halves, which of them open a pair, which close one, and the names of the pairs they open."""
    with np.errstate(over="ignore"):
        half = (mix(name + np.uint64(level * 2 + 1)) >> np.uint64(40)) & np.uint64(1)
        meets = (half[:-1] == 0) & (half[1:] == 1) & (text[1:] == text[:-1])
        paired = mix(name * _PAIR + np.append(name[1:], np.uint64(0)))
    return half, np.append(meets, False), np.concatenate(([False], meets)), paired


def parse(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """name, low, high, first of the symbols after some rounds.  `h`: word hashes; `doc`: the
    text of each word.  Contexts at a text's edge reach beyond FAR."""
    n = len(h)
    name, first, text = h, np.arange(n), doc
    low, high = np.arange(n), np.arange(1, n + 1)
    for level in range(rounds):
        if not len(name):
            break
        start, end, named = _runs(name, text)
        after = np.minimum(end, len(name) - 1)
        left = (start > 0) & (text[start - 1] == text[start])
        right = (end < len(name)) & (text[after] == text[start])
        low, high = np.where(left, low[start - 1], -FAR), np.where(right, high[after], FAR)
        name, first, text = named, first[start], text[start]
        half, opens, closes, paired = _pairs(name, text, level)
        same = text[1:] == text[:-1]
        near_low = np.concatenate(([-FAR], np.where(same, low[:-1], -FAR)))
        near_high = np.append(np.where(same, high[1:], FAR), FAR)
        # what a symbol looked at: the right neighbour if it could open a pair, else the left one
        reach_low = np.where(half == 1, np.minimum(low, near_low), low)
        reach_high = np.where(half == 0, np.maximum(high, near_high), high)
        name = np.where(opens, paired, name)
        low = np.where(opens, np.minimum(low, np.append(low[1:], 0)), reach_low)
        high = np.where(opens, np.maximum(high, near_high), reach_high)
        keep = ~closes
        name, low, high, first, text = name[keep], low[keep], high[keep], first[keep], text[keep]
    return name, low, high, first


def high_symbols(h: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """name, first, end of the symbols of `least` words or more, round by round, a symbol in
    the round that makes it."""
    name, first, text = h, np.arange(len(h)), doc
    texts = len(np.unique(doc))
    for level in range(MOST_ROUNDS):
        if len(name) <= texts:
            return
        start, _, named = _runs(name, text)
        new = named != name[start]
        name, first, text = named, first[start], text[start]
        _, opens, closes, paired = _pairs(name, text, level)
        name = np.where(opens, paired, name)
        keep = ~closes
        name, first, text, new = name[keep], first[keep], text[keep], (new | opens)[keep]
        end = np.append(first[1:], len(h))
        some = new & (end - first >= least)
        if some.any():
            yield name[some], first[some], end[some]


def anchors(h: np.ndarray, doc: np.ndarray, roll: Rolling, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window (`window` words of one text): its start, its anchor's key, its anchor's place.

    The key is the least one among the symbols whose contexts lie within the window (the last of
    equal ones), where a symbol's key hashes its name and the words of its context.  It depends on
    the window's words alone.  Windows without such a symbol (long runs) are their own anchors.
    """
    n = len(h)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    name, low, high, _ = parse(h, doc)
    fits = (low >= 0) & (high <= n) & (high - low <= window)
    name, low, high = name[fits], low[fits], high[fits]
    with np.errstate(over="ignore"):
        key = mix(roll.of(low, high) ^ (name * _RUN))
    order = np.lexsort((-low, key))
    key, low, high = key[order], low[order], high[order]
    # symbol s covers the starts high - window .. low: two runs of 2**j starts.  The least symbols
    # of such runs are handed down to the runs half as long.
    count = n - window + 1
    begin, stop = np.maximum(high - window, 0), np.minimum(low, count - 1) + 1
    exponent = np.frexp(np.maximum(stop - begin, 1))[1] - 1
    none = len(key)
    best = np.full(count, none)
    for j in range(int(exponent.max(initial=0)), -1, -1):
        at = np.flatnonzero((exponent == j) & (stop > begin))
        np.minimum.at(best, begin[at], at)
        np.minimum.at(best, stop[at] - (1 << j), at)
        if j:
            half = 1 << (j - 1)
            best[half:] = np.minimum(best[half:], best[:-half].copy())
    starts = np.flatnonzero(doc[:count] == doc[window - 1 :])
    best = best[starts]
    alone = best == none
    at = np.where(alone, 0, best)
    if none:
        found, place = key[at], low[at]
    else:
        found, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    if alone.any():
        found[alone] = roll.of(starts[alone], starts[alone] + window)
        place[alone] = starts[alone]
    return starts, found, place
