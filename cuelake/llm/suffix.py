"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

At the top level (byte symbols) a bucket is handled as a few array operations: all suffixes
that stand in a bucket induce their predecessors at once, those that fall in the same bucket
form the next wave.  The string of sorted leftmost-smaller substrings has as many symbols as
names; written in digits it is sorted by the same procedure, level by level.
"""

from __future__ import annotations

import numpy as np

END, SEPARATOR, SHIFT = 0, 1, 2
#: strings of fewer names are sorted faster name by name
SCANNED = 40_000


def smaller_type(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol must be the only smallest."""
    step = np.diff(t.astype(np.int64))
    turns = np.append(np.flatnonzero(step), len(t) - 1)
    rising = np.append(step[turns[:-1]] > 0, True)
    return rising[np.searchsorted(turns, np.arange(len(t)))]


def leftmost_smaller(is_small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_small[1:] & ~is_small[:-1]) + 1


def _append(sa: np.ndarray, at: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Put suffixes, in order, at the ends ``at`` of their buckets, going right (step 1) or left (-1)."""
    n = len(suffixes)
    if n == 0:
        return
    order = symbols.argsort(kind="stable")
    s = symbols[order]
    first = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
    sizes = np.empty_like(first)
    sizes[:-1] = first[1:] - first[:-1]
    sizes[-1] = n - first[-1]
    own = s[first]
    sa[np.repeat(at[own] - step * first, sizes) + step * np.arange(n)] = suffixes[order]
    at[own] += step * sizes


def induce(t: np.ndarray, is_small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes (or of their leading substrings) from an order of the leftmost-smaller ones."""
    sizes = np.bincount(t, minlength=symbols)
    stop = np.cumsum(sizes)
    start = stop - sizes
    sa = np.full(len(t), -1, np.int32)
    tail = stop - 1
    _append(sa, tail, t[lms][::-1], lms[::-1].astype(np.int32), -1)
    head, seeds = start.copy(), tail + 1
    for c in range(symbols):  # larger ones, from the left
        if not sizes[c]:
            continue
        done = start[c]
        waves = [(done, head[c])]
        seeded = False
        while True:
            a, b = waves.pop()
            if a == b:
                if seeded:
                    break
                seeded, (a, b) = True, (seeds[c], stop[c])
            before = head[c]
            cur = sa[a:b]
            cur = cur[cur > 0] - 1
            cur = cur[~is_small[cur]]
            _append(sa, head, t[cur], cur, 1)
            waves.append((before, head[c]))
    for c in range(symbols):  # the seeds go, they are placed again
        if seeds[c] < stop[c]:
            sa[max(seeds[c], head[c]) : stop[c]] = -1
    tail = stop - 1
    for c in range(symbols - 1, -1, -1):  # smaller ones, from the right
        if not sizes[c]:
            continue
        b = stop[c]
        larger = False
        while True:
            a = tail[c] + 1
            if a == b:
                if larger:
                    break
                larger, a, b = True, start[c], head[c]
                block = sa[a:b]
                nxt = tail[c] + 1
            else:
                block = sa[a:b]
                nxt = a
            cur = block[::-1]
            cur = cur[cur > 0] - 1
            cur = cur[is_small[cur]]
            _append(sa, tail, t[cur], cur, -1)
            b = nxt
    # the end symbol's suffix has no larger neighbour that induces it
    sa[0] = len(t) - 1
    return sa


def words_of(t: np.ndarray) -> np.ndarray:
    """Four symbols from each place on, as one number; places after the end count as 0."""
    x = np.concatenate([t.astype(np.uint64), np.zeros(3, np.uint64)])
    n = len(t)
    return x[:n] | x[1 : n + 1] << np.uint64(16) | x[2 : n + 2] << np.uint64(32) | x[3 : n + 3] << np.uint64(48)


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the first ``length`` symbols from a and from b on are the same."""
    same, live, off = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        rest = np.minimum(length[live] - off, 4).astype(np.uint64)
        shift = (np.uint64(4) - rest) * np.uint64(16)
        ok = (words[a[live] + off] ^ words[b[live] + off]) << shift == 0
        same[live[~ok]] = False
        off += 4
        live = live[ok & (length[live] > off)]
    return same


def _scan(s: list[int], symbols: int) -> list[int]:
    """Induced sorting of a list of names whose last is the only smallest, one symbol at a time."""
    n = len(s)
    if n == 1:
        return [0]
    small = [True] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    count = [0] * symbols
    for c in s:
        count[c] += 1
    start, stop, total = [], [], 0
    for c in count:
        start.append(total)
        total += c
        stop.append(total)

    def spread(order: list[int]) -> list[int]:
        sa = [-1] * n
        at = stop[:]
        for i in reversed(order):
            c = s[i]
            at[c] -= 1
            sa[at[c]] = i
        at = start[:]
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not small[j]:
                c = s[j]
                sa[at[c]] = j
                at[c] += 1
        at = stop[:]
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and small[j]:
                c = s[j]
                at[c] -= 1
                sa[at[c]] = j
        return sa

    after = dict(zip(lms, [*lms[1:], n - 1], strict=True))
    names, name, last = {}, -1, None
    for i in spread(lms):
        if i in after:
            key = tuple(s[i : after[i] + 1])
            if key != last:
                name, last = name + 1, key
            names[i] = name
    if name + 1 == len(lms):
        order = sorted(lms, key=names.__getitem__)
    else:
        order = [lms[k] for k in _scan([names[i] for i in lms], name + 1)]
    return spread(order)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols (uint16) that end with the only END."""
    symbols = int(t.max()) + 1
    if len(t) == 1:
        return np.zeros(1, np.int32)
    is_small = smaller_type(t)
    lms = leftmost_smaller(is_small)
    sa = induce(t, is_small, lms, symbols)
    flag = np.zeros(len(t), bool)
    flag[lms] = True
    order = sa[flag[sa]].astype(np.int64)
    length = np.zeros(len(t), np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    same[at] = _equal(words_of(t), a[at], b[at], length[a[at]])
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] + 1 < len(lms):
        names = np.zeros(len(t), np.int64)
        names[order] = name
        order = lms[_order_of(names[lms], int(name[-1]) + 1, len(t))]
    return induce(t, is_small, order, symbols)


def _order_of(names: np.ndarray, count: int, above: int) -> np.ndarray:
    """Suffix order of the string of names: the same induced sorting, one level down.

    Many names are written as two digits each, which keeps their order and the number of buckets small.
    A short string, or one that would not get shorter by that, is scanned name by name.
    """
    m = len(names)
    if count <= max(512, m // 400):
        coded, step = names + 1, 1
    else:
        base = int(count**0.5) + 1
        coded, step = np.stack([names // base, names % base], axis=1).ravel() + 1, 2
    if m < SCANNED or step * m + 1 > 0.8 * above or coded.max() >= 1 << 16:
        return np.array(_scan(names.tolist(), count))
    sa = suffix_array(np.append(coded, END).astype(np.uint16))
    sa = sa[(sa < step * m) & (sa % step == 0)]
    return sa // step


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """In text order: the common prefix of each suffix with the one before it in the array, up to ``most``
    (rounded up to a multiple of four); where ``wanted`` is given, 0 for suffixes it leaves out."""
    words = words_of(t)
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(t), np.int32)
    live, off = np.flatnonzero(before >= 0 if wanted is None else (before >= 0) & wanted), 0
    while off < most and len(live):
        x, y = live + off, before[live] + off
        inside = (x < len(t)) & (y < len(t))
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        whole = differ == 0
        rest = differ[~whole]
        out[live[~whole]] = off + ((rest & np.uint64(0xFFFF)) == 0).astype(np.int32) + ((rest & np.uint64(0xFFFFFFFF)) == 0) + ((rest & np.uint64(0xFFFFFFFFFFFF)) == 0)
        live = live[whole]
        out[live] = off + 4
        off += 4
    return out
