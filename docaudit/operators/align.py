"""Alignment of two sequences in linear memory: longest common subsequences by Myers' O(ND) search from both ends, anchors where that would take too long.

``matching`` gives the common elements that stay. Elements that only one side has are left out first. What is left is
split at its equal ends and, as long as the two sides differ in few elements, by the middle of a shortest edit script, so
the result is a longest common subsequence. A stretch in which more than ``MOST_STEPS`` edits would have to be tried is split at
anchors instead (patience): the longest rising run of elements that both sides hold equally often, the n-th one of each
matched with the n-th one there. Without anchors it is split where the search came furthest. Time is bounded by ``MOST_STEPS`` steps
for each element, memory by the sequences.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Sequence

MOST_STEPS = 400


def rising(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _anchors(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of equal elements, rising on both sides, of those that both sides hold equally often."""
    in_a, in_b = Counter(a), Counter(b)
    own = {x for x, n in in_a.items() if in_b[x] == n}
    places: dict[tuple, int] = {}
    seen: Counter = Counter()
    for j, x in enumerate(b):
        if x in own:
            places[x, seen[x]] = j
            seen[x] += 1
    seen.clear()
    pairs = []
    for i, x in enumerate(a):
        if x in own:
            pairs.append((i, places[x, seen[x]]))
            seen[x] += 1
    return [pairs[k] for k in rising([j for _, j in pairs])]


def _middle(a: Sequence, b: Sequence, most: int) -> tuple[int, int, bool]:
    """A point on a shortest edit script, near its middle; or, after ``most`` steps, the furthest point reached, and that it is no such point."""
    n, m = len(a), len(b)
    delta = n - m
    odd = delta & 1
    ahead, back = {1: 0}, {1: 0}
    for d in range(min(most, (n + m + 1) // 2) + 1):
        for k in range(-d, d + 1, 2):
            x = ahead.get(k + 1, -1) if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            ahead[k] = x
            if odd and -d < delta - k < d and x + back.get(delta - k, -1) >= n:
                return x, y, True
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            y = x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x += 1
                y += 1
            back[k] = x
            if not odd and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n:
                return n - x, m - y, True
    k, x = max(((k, x) for k, x in ahead.items() if x <= n and 0 <= x - k <= m), key=lambda s: 2 * s[1] - s[0])
    return x, x - k, False


def matching(a: Sequence[Hashable], b: Sequence[Hashable], most: int = MOST_STEPS) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], rising on both sides."""
    shared = set(a) & set(b)
    at_a, at_b = ([i for i, x in enumerate(s) if x in shared] for s in (a, b))
    codes = {x: i for i, x in enumerate(shared)}
    p, q = [codes[a[i]] for i in at_a], [codes[b[j]] for j in at_b]
    out: list[tuple[int, int]] = []
    todo = [(0, len(p), 0, len(q))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and p[i] == q[j]:
            out.append((i, j))
            i += 1
            j += 1
        while i < i_end and j < j_end and p[i_end - 1] == q[j_end - 1]:
            i_end -= 1
            j_end -= 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        x, y, best = _middle(p[i:i_end], q[j:j_end], most)
        if not best and (pairs := _anchors(p[i:i_end], q[j:j_end])):
            last_i, last_j = i, j
            for s, t in pairs:
                out.append((i + s, j + t))
                todo.append((last_i, i + s, last_j, j + t))
                last_i, last_j = i + s + 1, j + t + 1
            todo.append((last_i, i_end, last_j, j_end))
        elif (x, y) in ((0, 0), (i_end - i, j_end - j)):
            # nothing matches up to here: one of the two first elements has no partner
            todo.append((i + 1, i_end, j, j_end) if i_end - i > j_end - j else (i, i_end, j + 1, j_end))
        else:
            todo += [(i, i + x, j, j + y), (i + x, i_end, j + y, j_end)]
    return sorted((at_a[i], at_b[j]) for i, j in out)


def opcodes(a: Sequence[Hashable], b: Sequence[Hashable], most: int = MOST_STEPS) -> list[tuple[bool, int, int, int, int]]:
    """(equal, i, i_end, j, j_end): stretches that stay and stretches that differ, in order."""
    out: list[tuple[bool, int, int, int, int]] = []
    i = j = 0
    start = (0, 0)
    for x, y in [*matching(a, b, most), (len(a), len(b))]:
        if (x, y) == (i, j) and x < len(a) and y < len(b):
            i, j = i + 1, j + 1
            continue
        if (i, j) != start:
            out.append((True, start[0], i, start[1], j))
        if (x, y) != (i, j):
            out.append((False, i, x, j, y))
        start = (x, y)
        i, j = x + 1, y + 1
    return out
