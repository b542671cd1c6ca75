"""Suffix array by linear grouping of Lyndon prefixes."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of s, whose last symbol must be its unique least.

    Suffixes are grouped by first symbol. Groups are taken in descending order; each
    member's previous smaller suffix, the nearest before it in a lower group, is its parent, and
    parents are moved behind the rest of their own group by the number of
    members they have. After that a group holds the suffixes with one Lyndon prefix, and one pass
    in ascending order emits each group's members: the suffix before an emitted one, and its
    chain of parents, are next in their groups.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        if s[i] != s[order[first]]:
            first = k
        place[i], start[i] = k, first
        size[first] += 1
    before = [-1] * n
    high = n
    while high > 0:
        low = start[order[high - 1]]
        members = order[low:high]
        if len(members) > 1:
            members.sort()
        children: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and start[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                children[j] = children.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in children.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[c]:
                g = start[j]
                m = moved.get(g, 0)
                last = g + size[g] - 1 - m
                other, at = order[last], place[j]
                order[at], order[last], place[other], place[j] = other, j, at, last
                moved[g] = m + 1
            for g, m in moved.items():
                size[g] -= m
                if size[g]:
                    new = g + size[g]
                    size[new] = m
                    for k in range(new, new + m):
                        start[order[k]] = new
                else:
                    size[g] = m
        high = low
    found = [-1] * n
    free = list(range(n))
    placed = bytearray(n)
    found[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = found[k] - 1
        while j >= 0 and not placed[j]:
            g = start[j]
            found[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return found
