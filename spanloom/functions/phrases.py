"""Words, phrases and literals in texts: one scan for any number of them, with offsets into the text as it is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick

_ONE = str.maketrans({"ı": "i", "ſ": "s", "ς": "σ"})
#: Stands for any digit among required literals.
_DIGIT = "\0"
_FIGURE = re.compile(r"\d")


def folded(text: str) -> str:
    """A text in small letters, character by character, so that offsets into it are offsets into the text."""
    return text.replace("İ", "i").lower().translate(_ONE)


def _inner(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end."""
    return not (start and _inner(text[start - 1]) and _inner(text[start])) and not (end < len(text) and _inner(text[end - 1]) and _inner(text[end]))


@lru_cache(maxsize=16)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """An automaton of folded words; each knows its number.  Kept by the worker."""
    out = ahocorasick.Automaton()
    for k, w in enumerate(words):
        if w not in out:
            out.add_word(w, (k, len(w)))
    if not len(out):
        return None
    out.make_automaton()
    return out


class Phrases:
    """Lists of words and phrases; each list finds what a pattern of its entries in their order, as whole words, finds."""

    def __init__(self, lists: list[list[str]]) -> None:
        self.owners: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(lists):
            for place, w in enumerate(words):
                if w:
                    self.owners.setdefault(folded(w), []).append((k, place))

    def automaton(self) -> Callable[[str], Iterator[tuple[int, int, int]]]:
        """A function from a folded text to (list, start, end): from the left, without overlaps inside one list."""
        words = tuple(self.owners)
        trie, owners = _automaton(words), [self.owners[w] for w in words]

        def found(low: str) -> Iterator[tuple[int, int, int]]:
            hits: dict[int, list[tuple[int, int, int]]] = {}
            for last, (k, size) in trie.iter(low) if trie is not None else ():
                start = last + 1 - size
                if whole(low, start, last + 1):
                    for own, place in owners[k]:
                        hits.setdefault(own, []).append((start, place, last + 1))
            for own, each in hits.items():
                free = 0
                for start, _, end in sorted(each):
                    if start >= free:
                        yield own, start, end
                        free = end

        return found


def required(pattern: str) -> frozenset[str] | None:
    """Folded literals of which every match of a pattern has at least one; None if no such set can be told."""
    parser = re._parser  # the pattern as the compiler reads it

    def best(sets: list[frozenset[str]]) -> frozenset[str] | None:
        return max(sets, key=lambda s: (min(len(x) * (x != _DIGIT) for x in s), -len(s)), default=None)

    def need(items) -> frozenset[str] | None:
        sets, run = [], ""
        for op, value in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL" and value != 10:  # a literal ends with its line
                run += folded(chr(value))
                continue
            if run:
                sets.append(frozenset([run]))
                run = ""
            inner = None
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                inner = need(value[2])
            elif name == "SUBPATTERN":
                inner = need(value[3])
            elif name == "ASSERT":
                inner = need(value[1])
            elif name == "ATOMIC_GROUP":
                inner = need(value)
            elif name == "BRANCH":
                parts = [need(x) for x in value[1]]
                inner = frozenset().union(*parts) if all(parts) else None
            elif name == "IN" and all((str(a), str(b)) == ("CATEGORY", "CATEGORY_DIGIT") or (str(a) == "RANGE" and b == (48, 57)) for a, b in value):
                inner = frozenset([_DIGIT])
            if inner:
                sets.append(inner)
        return best(sets)

    return need(parser.parse(pattern))


def digits_in(pattern: str) -> int:
    """How many digits every match of a pattern has at least."""

    def count(items) -> int:
        n = 0
        for op, value in items:
            name = str(op)
            if name == "IN":
                n += all((str(a), str(b)) == ("CATEGORY", "CATEGORY_DIGIT") or (str(a) == "RANGE" and b == (48, 57)) for a, b in value)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                n += value[0] * count(value[2])
            elif name == "SUBPATTERN":
                n += count(value[3])
            elif name == "ATOMIC_GROUP":
                n += count(value)
            elif name == "BRANCH":
                n += min(count(x) for x in value[1])
        return n

    return count(re._parser.parse(pattern))


def within_lines(pattern: str) -> bool:
    """Whether a pattern matches in a line by itself what it matches in the whole text: nothing in it can meet a line feed."""

    def stays(items) -> bool:
        for op, value in items:
            name = str(op)
            if name in ("LITERAL", "ANY"):
                ok = value != 10
            elif name == "IN":
                kinds = [(str(a), b) for a, b in value]
                ok = all((a == "LITERAL" and b != 10) or (a == "RANGE" and not b[0] <= 10 <= b[1]) or (a == "CATEGORY" and str(b) in ("CATEGORY_DIGIT", "CATEGORY_WORD")) for a, b in kinds)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                ok = stays(value[2])
            elif name == "SUBPATTERN":
                ok = not value[1] and stays(value[3])
            elif name == "ATOMIC_GROUP":
                ok = stays(value)
            elif name == "BRANCH":
                ok = all(stays(x) for x in value[1])
            elif name in ("ASSERT", "ASSERT_NOT"):
                ok = stays(value[1])
            else:
                ok = name == "AT" and str(value) in ("AT_BOUNDARY", "AT_NON_BOUNDARY")
            if not ok:
                return False
        return True

    parsed = re._parser.parse(pattern)
    return not parsed.state.flags & (re.DOTALL | re.MULTILINE) and stays(parsed)


class Prefilter:
    """Which of some patterns can match a text at all, by their required literals, and in which of its lines."""

    def __init__(self, patterns: list[str]) -> None:
        self.always, self.digit, self.by_word = [], [], {}
        for k, pattern in enumerate(patterns):
            words = required(pattern)
            if words is None:
                self.always.append(k)
                continue
            for w in words:
                (self.digit if w == _DIGIT else self.by_word.setdefault(w, [])).append(k)
        within = [within_lines(p) for p in patterns]
        parts = lambda own: (frozenset(k for k in own if within[k]), frozenset(k for k in own if not within[k]))
        self.figures = parts(self.digit)
        self.short = {w: parts(own) for w, own in self.by_word.items() if len(w) < 3}
        self.words = tuple(w for w in self.by_word if len(w) >= 3)
        self.owners = [parts(self.by_word[w]) for w in self.words]
        self.least = [re._parser.parse(p).getwidth()[0] for p in patterns]
        self.digits = [digits_in(p) for p in patterns]
        if any("\n" in w for w in self.by_word):
            raise ValueError("a required literal goes over a line feed")
        #: Agents ask the same again and again: what some thousand short lines have is kept.
        self.short_line = lru_cache(maxsize=1 << 13)(self.line)

    def line(self, low: str) -> tuple[frozenset[int], frozenset[int], int]:
        """Patterns of which a folded line has a literal: those that stay in a line, and the others; and how many digits it has."""
        figures = len(_FIGURE.findall(low))
        inside, across = (set(self.figures[0]), set(self.figures[1])) if figures else (set(), set())
        own = [x for w, x in self.short.items() if w in low]
        if (trie := _automaton(self.words)) is not None:
            own += [self.owners[k] for k in {k for _, (k, _) in trie.iter(low)}]
        for stay, go in own:
            inside |= stay
            across |= go
        return frozenset(inside), frozenset(across), figures

    def places(self, low: str, lines: set[int] | None = None) -> list[tuple[int, int, int]]:
        """(pattern, start, end): where in a folded text each pattern may match.

        A pattern that cannot meet a line feed is looked for in the lines that have one of its literals (and are of ``lines``, if these
        are given), another in the whole text.
        """
        everywhere, by_line, figures, ends, at = set(self.always), {}, [], [], 0
        for n, line in enumerate(low.split("\n")):
            inside, across, found = self.short_line(line) if len(line) < 200 else self.line(line)
            at += len(line)
            ends.append(at)
            at += 1
            figures.append(found)
            everywhere |= across
            if inside:
                by_line[n] = inside
        every = sum(figures)
        out = [(k, 0, len(low)) for k in everywhere if self.digits[k] <= every]
        for line, own in by_line.items():
            if lines is not None and line not in lines:
                continue
            start, end = ends[line - 1] + 1 if line else 0, ends[line]
            out += [(k, start, end) for k in own if end - start >= self.least[k] and self.digits[k] <= figures[line]]
        return out

    def rules(self, low: str) -> list[int]:
        """Numbers of the patterns that a folded text may match, in order."""
        return sorted({k for k, _, _ in self.places(low)})
