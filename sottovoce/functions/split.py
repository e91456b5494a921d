"""Where to cut a text that is too long for a cue.

Every run of white space is a place to cut, better or worse by the word before it. The lengths of all heads are summed
once, so a piece's choice is among the places that its capacity reaches.
"""

import re
from bisect import bisect_right
from itertools import accumulate

from sottovoce.functions.text import TAGS, WIDE

#: Marks after which a sentence ends, and marks and endings after which a clause ends.
SENTENCE_MARKS = ".?!。？！"
CLAUSE_MARKS = ",;、"
CLAUSE_ENDINGS = ("고", "며", "는데", "지만", "면서", "다가", "거나")

_TAG, _WIDE, _BREAK, _BLANKS = re.compile(TAGS), re.compile(f"[{WIDE}]"), re.compile(r"[\r\n]"), re.compile(r"\s+")


def weighted(text: str, wide: float, other: float) -> float:
    """What ``weighted_chars`` gives for a text."""
    plain = _BREAK.sub("", _TAG.sub("", text))
    n = 0 if plain.isascii() else len(_WIDE.findall(plain))
    return n * wide + (len(plain) - n) * other


def _lengths(text: str, wide: float, other: float) -> list[float]:
    """Weighted length of every head of the text; markup and line breaks have none."""
    each = [other] * len(text)
    if not text.isascii():
        for c in _WIDE.finditer(text):
            each[c.start()] = wide
    for c in _BREAK.finditer(text):
        each[c.start()] = 0.0
    for tag in _TAG.finditer(text):
        each[tag.start() : tag.end()] = [0.0] * len(tag[0])
    return list(accumulate(each, initial=0.0))


def _places(text: str) -> tuple[list[int], list[int], list[int]]:
    """(first blank, first character after, rank) of the places within the text: 0 after a sentence, 1 after a clause, 2 elsewhere."""
    found = [m.span() for m in _BLANKS.finditer(text)]
    at, after = [f[0] for f in found], [f[1] for f in found]
    return at, after, [0 if text[a - 1] in SENTENCE_MARKS else 1 if text[a - 1] in CLAUSE_MARKS or text.endswith(CLAUSE_ENDINGS, 0, a) else 2 for a in at]


def pieces(text: str, capacity: float, wide: float = 1.0, other: float = 1.0) -> list[str]:
    """A text in pieces of at most the capacity: of the places in reach the best rank, then the nearest to the middle of
    what is left; what no place divides stays whole. Markup with a blank in it is measured piece by piece."""
    text = text.strip()
    if not text:
        return []
    heads, (at, after, rank) = _lengths(text, wide, other), _places(text)
    reached = [heads[a] for a in at]
    # Sums of other weights than these depend on where they begin.
    torn = any(_BLANKS.search(tag) for tag in _TAG.findall(text)) or (1024 * wide) % 1 > 0 or (1024 * other) % 1 > 0
    length = (lambda a, b: _lengths(text[a:b], wide, other)[-1]) if torn else (lambda a, b: heads[b] - heads[a])
    out, start = [], 0
    while length(start, len(text)) > capacity:
        low = bisect_right(at, start)
        if torn:
            reach = [k for k in range(low, len(at)) if length(start, at[k]) <= capacity]
        else:
            reach = range(low, bisect_right(reached, heads[start] + capacity))
        if not reach:
            break
        # Doubled, so that the middle is a whole number.
        middle = len(text) + start
        best = min(reach, key=lambda k: (rank[k], abs(2 * at[k] - middle), at[k]))  # noqa: B023
        out.append(text[start : at[best]])
        start = after[best]
    return [*out, text[start:]]
