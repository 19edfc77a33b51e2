"""Words and phrases that are said again at once, found for many texts in one pass.

Words become numbers, by sums over their characters from which those of glued words follow too.
Places where equal numbers stand as a repeat has them are candidates; only there the exact rule is
tried. So a text without repeats costs one look at its characters. White space and marks between
copies stay in the text; where thousands of copies follow each other the exact rule has to read
what they leave again and again.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Characters that are handled at once; a longer text is handled whole.
CHUNK_CHARS = 1 << 20
# A phrase has two to five words, so a match spans ten at most.
PHRASE_WORDS = range(2, 6)
SPAN = 12

# A phrase that is said again at once, at the place where it begins; a word said
# four or more times in a row, the last copies may be glued together and need no word end.
PHRASE = re.compile(r"(\w+\s+\w+(?:\s+\w+){0,3})[.,;!?\s]*(\1)\b", re.IGNORECASE)
FOUR_WORDS = re.compile(r"(\w+)\s+\1\s+\1\s+(?:\1)+")
A_WORD = re.compile(r"\w+")

# Kinds of characters.
OTHER, WORD, SPACE, PUNCT, UNKNOWN = range(5)
_kinds = np.full(0x110000, UNKNOWN, np.uint8)

# What ignoring case takes for equal: one character for one. The letters that
# Python's lower() makes two of, or different ones at a word's end.
ONE_TO_ONE = {"\u0130": "i", "\u03a3": "\u03c3"}

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def kinds_of(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds[codes]
    new = kinds == UNKNOWN
    if new.any():
        for code in np.unique(codes[new]).tolist():
            c = chr(code)
            _kinds[code] = (
                WORD if c.isalnum() or c == "_" else SPACE if c.isspace() else PUNCT if c in ".,;!?" else OTHER
            )
        kinds = _kinds[codes]
    return kinds


def powers(base: np.uint64, n: int) -> np.ndarray:
    made = np.ones(n, np.uint64)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            made[done : 2 * done] = made[: min(done, n - done)] * step
            done, step = 2 * done, step * step
    return made


class Words:
    """Words of several texts laid out after each other: start, stop; number (of its characters)
    and shift (what to multiply a word's number by that is glued behind it); spaced, parted: whether
    only white space, or that and punctuation, stands between a word and the next."""

    def __init__(self, texts: list[str], ignore_case: bool):
        joined = "\0".join([*texts, ""])
        if ignore_case:
            joined = lowered(joined)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = kinds_of(codes)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (kinds == WORD).view(np.int8), [0]])))
        self.start, self.stop = edges[::2], edges[1::2]
        up = powers(BASE, len(codes) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[:-1])])
        down = powers(INVERSE, len(codes) + 1)
        self.number = (sums[self.stop] - sums[self.start]) * down[self.start]
        self.shift = up[self.stop - self.start]
        gap = lambda kind: self._between(kinds == kind)
        self.parted = gap(OTHER) == 0
        self.spaced = self.parted & (gap(PUNCT) == 0)
        self.first = np.cumsum([0, *(len(t) + 1 for t in texts)])

    def _between(self, which: np.ndarray) -> np.ndarray:
        if not which.any():
            return np.zeros(max(len(self.start) - 1, 0), np.int32)
        total = np.concatenate([[0], np.cumsum(which, dtype=np.int32)])
        return total[self.start[1:]] - total[self.stop[:-1]]


def lowered(text: str) -> str:
    """As ignoring case sees the text, of the same length."""
    for letter, small in ONE_TO_ONE.items():
        text = text.replace(letter, small)
    return text.lower()


def likely_begins(text: str, end: int) -> list[int]:
    """Where words begin before `end` at which a phrase may be said again, by whole words alone."""
    text = lowered(text)
    begins = [m.start() for m in A_WORD.finditer(text, 0, end)]
    names = A_WORD.findall(text)
    found = []
    for i, begin in enumerate(begins):
        name = names[i]
        for k in PHRASE_WORDS:
            second = i + 2 * k - 2
            if second >= len(names):
                break
            glued = names[i + k - 1].endswith(name) and names[i + k - 1] == names[second] + name
            if glued or names[i + k] == name and names[i : i + k] == names[i + k : second + 2]:
                found.append(begin)
                break
    return found


def word_begins(text: str) -> list[int]:
    return [m.start() for m in A_WORD.finditer(text)]


def all_of(*tests: tuple[np.ndarray, int, int], n: int) -> np.ndarray:
    """Places i < n at which each test holds from i + a to i + b - 1. tests: (values, a, b)."""
    found = np.ones(max(n, 0), bool)
    for values, a, b in tests:
        for k in range(a, b):
            found &= values[k : k + len(found)]
    return found


def phrase_places(words: Words) -> np.ndarray:
    """Words at which a phrase may begin that is said again: none is missed, some have none."""
    x, n = words.number, len(words.number)
    found = np.zeros(n, bool)
    for k in PHRASE_WORDS:
        # Copies apart: words i to i + k - 1 are those from i + k on.
        if n >= 2 * k:
            same = x[:-k] == x[k:]
            if same.any():
                found[: n - 2 * k + 1] |= all_of(
                    (same, 0, k), (words.spaced, 0, k - 1), (words.parted, k - 1, k), (words.spaced, k, 2 * k - 1),
                    n=n - 2 * k + 1,
                )
        # Glued: the last word of the phrase and the first of its copy are one.
        if n >= 2 * k - 1:
            m = n - 2 * k + 2
            glued = x[k - 1 : k - 1 + m] == x[2 * k - 2 : 2 * k - 2 + m] + words.shift[2 * k - 2 : 2 * k - 2 + m] * x[:m]
            if glued.any():
                inner = x[: -(k - 1)] == x[k - 1 :]
                found[:m] |= glued & all_of((inner, 1, k - 1), (words.spaced, 0, 2 * k - 2), n=m)
    return np.flatnonzero(found)


def repeat_places(words: Words) -> np.ndarray:
    """Words that are said three times with only white space between, and after."""
    x, n = words.number, len(words.number)
    if n < 4:
        return np.zeros(0, np.int64)
    return np.flatnonzero(all_of((x[:-1] == x[1:], 0, 2), (words.spaced, 0, 3), n=n - 3))


def without_second_copies(text: str, start: list[int], places: list[int]) -> str:
    """The second copy of the leftmost repeated phrase goes, until none is left. start: of each
    word; places: words at which a phrase may be said again.

    What lies more than SPAN words back cannot be in a match any more and does not move again.
    After a cut only words up to there can begin a match that was not found before; all later ones
    are at places found before."""
    out: list[str] = []
    at = 0  # of the text, from here on it is as it was
    ahead = lambda w: start[w] if w < len(start) else len(text)
    for word in places:
        if start[word] < at:
            continue
        upto = word + SPAN
        near = text[start[word] : ahead(upto)]
        hit = PHRASE.match(near)
        if not hit:
            continue
        back = start[max(word - SPAN, 0)]
        if back > at:
            out.append(text[at:back])
        before = text[max(back, at) : start[word]]
        while out and back <= at and len(begins := word_begins(before)) <= SPAN:
            before = out.pop() + before
        if len(begins := word_begins(before)) > SPAN:
            out.append(before[: begins[-SPAN]])
            before = before[begins[-SPAN] :]
        near = before + near
        gone = tuple(p + len(before) for p in hit.span(2))
        whole = 0  # of `near`, from here on it is the text as it was
        while gone:
            near = near[: gone[0]] + near[gone[1] :]
            whole = max(gone[0], whole - (gone[1] - gone[0]))
            while upto < len(start) and len(word_begins(near[whole:])) < SPAN:
                near += text[start[upto] : ahead(upto + SPAN)]
                upto += SPAN
            hits = (PHRASE.match(near, p) for p in likely_begins(near, whole))
            gone = next((hit.span(2) for hit in hits if hit), None)
        out.append(near[:whole])
        at = ahead(upto) - (len(near) - whole)
    out.append(text[at:])
    return "".join(out)


def squashed(text: str, start: list[int], places: list[int]) -> str:
    """Words said four or more times in a row are said once."""
    out, at = [], 0
    for word in places:
        if start[word] >= at and (hit := FOUR_WORDS.match(text, start[word])):
            out += [text[at : start[word]], hit[1]]
            at = hit.end()
    return "".join([*out, text[at:]])


def in_chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= CHUNK_CHARS:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def rewritten(column: pa.Array, ignore_case: bool, find, rewrite) -> pa.Array:
    texts = column.to_pylist()
    for a, b in in_chunks(texts):
        some = [t or "" for t in texts[a:b]]
        words = Words(some, ignore_case)
        found = find(words)
        if not len(found):
            continue
        text_of = np.searchsorted(words.first, words.start[found], side="right") - 1
        for k in np.unique(text_of).tolist():
            low, high = np.searchsorted(words.start, words.first[k : k + 2])
            start = (words.start[low:high] - words.first[k]).tolist()
            texts[a + k] = rewrite(some[k], start, (found[text_of == k] - low).tolist())
    return pa.array(texts, pa.string())


def drop_second_copies(column: pa.Array) -> pa.Array:
    return rewritten(column, True, phrase_places, without_second_copies)


def squash_words(column: pa.Array) -> pa.Array:
    return rewritten(column, False, repeat_places, squashed)
