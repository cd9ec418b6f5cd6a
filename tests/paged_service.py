"""A service for tests: fails now and then, and repeats rows of other pages."""

from collections import Counter

TOTAL, ASKED = 537, Counter()


def fetch(offset, length):
    ASKED[offset] += 1
    if offset // 10 % 3 == 1 and ASKED[offset] < 3:
        raise OSError("busy")
    first = max(0, offset - 7)
    rows = [(k, {"n": k, "word": None if k % 11 == 0 else f"w{k}", "other": 1}) for k in range(first, min(TOTAL, offset + length + 3))]
    if offset // 10 % 5 == 2 and ASKED[offset] < 2:
        rows = rows[:-5]  # an answer that was cut
    return TOTAL, rows + rows[:4]


def gone(offset, length):
    raise OSError("gone")
