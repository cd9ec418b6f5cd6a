"""Word alignment of two texts: as few edits as possible, in memory that grows with the words and not with their product."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

#: An aligned stretch: equal, replace, delete (only in the first) or insert (only in the second), and its ends in both.
Step = tuple[str, int, int, int, int]


def _reach(a: Sequence[Hashable], b: Sequence[Hashable], x: int, y: int) -> int:
    """How many words are equal from a[x] and b[y] on."""
    n = 0
    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
        n += 1
    return n


def _back(a: Sequence[Hashable], b: Sequence[Hashable], x: int, y: int) -> int:
    """How many words are equal before a[x] and b[y]."""
    n = 0
    while n < x and n < y and a[x - n - 1] == b[y - n - 1]:
        n += 1
    return n


def _grown(front: dict[int, int], n: int, m: int, ahead: bool) -> dict[int, int]:
    """The furthest places on each diagonal (y - x) with one edit more, before equal words are walked."""
    out: dict[int, int] = {}
    for k, x in front.items():
        # an edit replaces (same diagonal), inserts (y moves) or deletes (x moves)
        for own, at in ((k, x + 1), (k + 1, x), (k - 1, x + 1)) if ahead else ((k, x - 1), (k - 1, x), (k + 1, x - 1)):
            y = at + own
            if 0 <= at <= n and 0 <= y <= m and (own not in out or (at > out[own] if ahead else at < out[own])):
                out[own] = at
    return out


def middle(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[int, int]:
    """A place (x, y) on a way of fewest edits, about half of them before it.

    Ways from both ends grow by one edit in turn, each keeping its furthest place on every diagonal, until two meet.
    """
    n, m = len(a), len(b)
    front = {0: _reach(a, b, 0, 0)}
    back = {m - n: n - _back(a, b, n, m)}
    while True:
        for ahead in (True, False):
            for k in front.keys() & back.keys():
                if front[k] >= back[k]:
                    return front[k], front[k] + k
            if ahead:
                front = {k: x + _reach(a, b, x, x + k) for k, x in _grown(front, n, m, True).items()}
            else:
                back = {k: x - _back(a, b, x, x + k) for k, x in _grown(back, n, m, False).items()}


def alignment(a: Sequence[Hashable], b: Sequence[Hashable]) -> Iterator[Step]:
    """Steps that turn a into b with the fewest words replaced, deleted and inserted.

    The problem is cut at a middle place again and again; only the furthest places of one cut are held at a time.
    """
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        lead = _reach(a[i:i2], b[j:j2], 0, 0)
        if lead:
            yield "equal", i, i + lead, j, j + lead
            i, j = i + lead, j + lead
        tail = _back(a[i:i2], b[j:j2], i2 - i, j2 - j)
        i2, j2 = i2 - tail, j2 - tail
        if tail:
            todo.append((i2, i2 + tail, j2, j2 + tail))
        if i < i2 and j < j2:
            if i2 - i == 1 and j2 - j == 1:
                yield "replace", i, i2, j, j2
            else:
                x, y = middle(a[i:i2], b[j:j2])
                todo += [(i + x, i2, j + y, j2), (i, i + x, j, j + y)]
        elif i < i2:
            yield "delete", i, i2, j, j2
        elif j < j2:
            yield "insert", i, i2, j, j2


def edits(steps: Iterator[Step]) -> int:
    """The number of words replaced, deleted and inserted."""
    return sum(max(i2 - i, j2 - j) for op, i, i2, j, j2 in steps if op != "equal")
