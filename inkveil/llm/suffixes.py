"""Suffix array by Lyndon groups, in linear time.

A suffix's longest prefix that is a Lyndon word ends where the next smaller
suffix starts. Suffixes are first grouped by these prefixes: groups are taken in
descending order, and each of their members lengthens the prefix of the nearest
suffix before it that lies in a lower group. Then the order within the groups is
read off from left to right. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: bytes, end: int = 0) -> np.ndarray:
    """The places of ``symbols`` by rising suffix.

    ``symbols`` may hold several strings, each closed by the symbol ``end``,
    which must be less than all others and stand last. Closing symbols differ
    from each other: one that stands earlier is less.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    if symbols[-1] != end:
        raise ValueError("the last symbol must be the closing one")
    group, members, below, prev, groups = _grouped(symbols, end)
    return _emitted(symbols, end, group, members, below, prev, groups)


def _grouped(symbols: bytes, end: int) -> tuple[list[int], list[list[int]], list[int], list[int], int]:
    """Each place's group, the groups' members (old ones too) and next lower groups, each place's previous smaller one, and the highest group."""
    values = np.frombuffer(symbols, np.uint8)
    order = np.argsort(values, kind="stable")
    found, starts = np.unique(values[order], return_index=True)
    members = [x.tolist() for x in np.split(order, starts[1:])]
    names = np.zeros(256, np.int64)
    names[found] = np.arange(len(found))
    group = names[values].tolist()
    size = [len(x) for x in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    top = len(members) - 1
    n = len(symbols)
    # a place that is still in a lower group stops the search; the closing symbols' group (0) is never taken
    done = bytearray(n)
    prev = list(range(-1, n - 1))
    at = top
    while at > 0:
        mine = members[at]
        if size[at] != len(mine):
            mine = members[at] = [i for i in mine if group[i] == at]
        for i in mine:
            done[i] = 1
        if len(mine) == 1:
            i = mine[0]
            j = prev[i]
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and (old := group[j]) and size[old] > 1:
                size[old] -= 1
                new = len(members)
                members.append([j])
                size.append(1)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new  # there is one: the group at hand lies above
                group[j] = new
            at = below[at]
            continue
        counts: dict[int, int] = {}
        for i in mine:
            j = prev[i]
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and group[j]:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in counts.items():
                moved.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                parts = moved[times, old]
                if len(parts) == size[old]:
                    continue  # all that is left moves, to the same place
                size[old] -= len(parts)
                new = len(members)
                members.append(parts)
                size.append(len(parts))
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new
                for j in parts:
                    group[j] = new
        at = below[at]
    highest = top
    while above[highest] >= 0:
        highest = above[highest]
    return group, members, below, prev, highest


def _emitted(symbols: bytes, end: int, group: list[int], members: list[list[int]], below: list[int], prev: list[int], highest: int) -> np.ndarray:
    n = len(symbols)
    sizes = np.bincount(np.array(group), minlength=len(members))
    chain = []
    at = highest
    while at >= 0:
        chain.append(at)
        at = below[at]
    chain = np.array(chain[::-1])
    starts = np.zeros(len(members), np.int64)
    starts[chain] = np.r_[0, np.cumsum(sizes[chain])[:-1]]
    free = starts.tolist()
    out = [-1] * n
    placed = bytearray(n)
    for k, i in enumerate(members[0]):
        out[k] = i
        placed[i] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return np.array(out, np.int64)
