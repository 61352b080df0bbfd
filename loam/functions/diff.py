"""Shortest edit scripts of two lists of lines, in linear space, and their hunks."""

from __future__ import annotations

from itertools import count


def _middle(a, b, lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> tuple[int, int, int]:
    """(edits, x, y): a point on a shortest path from (lo_a, lo_b) to (hi_a, hi_b), found from both ends at once."""
    n, m = hi_a - lo_a, hi_b - lo_b
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead.get(k + 1, -1) if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            y = x - k
            while x < n and y < m and a[lo_a + x] == b[lo_b + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if (n - m) % 2 and abs(n - m - k) <= d - 1 and x + back.get(n - m - k, -1) >= n:
                return 2 * d - 1, lo_a + x, lo_b + y
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            y = x - k
            while x < n and y < m and a[hi_a - 1 - x] == b[hi_b - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if (n - m) % 2 == 0 and abs(n - m - k) <= d and x + ahead.get(n - m - k, -1) >= n:
                return 2 * d, hi_a - x, hi_b - y
    raise AssertionError("paths from both ends always meet")


def matches(old: list, new: list) -> list[tuple[int, int]]:
    """The pairs of places of a longest common subsequence, ascending."""
    # Lines of one side alone match nothing, whatever the script: only the others are searched.
    both = set(old) & set(new)
    at_a, at_b = ([i for i, x in enumerate(side) if x in both] for side in (old, new))
    a, b = [old[i] for i in at_a], [new[i] for i in at_b]
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((at_a[lo_a], at_b[lo_b]))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((at_a[hi_a], at_b[hi_b]))
        if lo_a < hi_a and lo_b < hi_b:
            edits, x, y = _middle(a, b, lo_a, hi_a, lo_b, hi_b)
            if edits > 1:
                todo += [(lo_a, x, lo_b, y), (x, hi_a, y, hi_b)]
            else:  # one line more on one side, past the common ends: nothing is left to match
                todo += [(lo_a, x, lo_b, y), (x, hi_a, y, hi_b)] if (x, y) not in ((lo_a, lo_b), (hi_a, hi_b)) else []
    return sorted(out)


def hunks(old: list[str], new: list[str], context: int = 2) -> tuple[float, list[tuple[int, int, int, int, str]]]:
    """(ratio, hunks): twice the lines in common by all lines (1 for two empty lists), and (first old line, how many, first
    new line, how many, lines marked ' ', '-' or '+') for each hunk, with up to `context` common lines around changes. First
    lines count from 1; changes not more than twice the context apart share a hunk."""
    common = matches(old, new)
    ratio = 2 * len(common) / (len(old) + len(new)) if old or new else 1.0
    marked, i, j = [], 0, 0
    for x, y in [*common, (len(old), len(new))]:
        marked += [("-", k, j) for k in range(i, x)] + [("+", x, k) for k in range(j, y)]
        if x < len(old):
            marked.append((" ", x, y))
        i, j = x + 1, y + 1
    changed = [p for p, (mark, _, _) in enumerate(marked) if mark != " "]
    out, group = [], count()
    held: dict[int, list[int]] = {}
    for p, before in zip(changed, [None, *changed]):
        if before is None or p - before > 2 * context + 1:
            g = next(group)
        held.setdefault(g, []).append(p)
    for places in held.values():
        part = marked[max(0, places[0] - context) : places[-1] + context + 1]
        lines = [mark + (new[y] if mark == "+" else old[x]) for mark, x, y in part]
        n_old, n_new = sum(mark != "+" for mark, _, _ in part), sum(mark != "-" for mark, _, _ in part)
        out.append((part[0][1] + (n_old > 0), n_old, part[0][2] + (n_new > 0), n_new, "\n".join(lines)))
    return ratio, out
