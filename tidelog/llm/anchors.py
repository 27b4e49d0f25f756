"""Content-defined anchors: places that every copy of a long enough string chooses alike.

Of the W = length - GRAM + 1 grams in a window of `length` bytes, the window's anchor is the one
with the least hash, the first such if several tie. Equal windows so have equal anchors at equal
offsets, and each window start belongs to exactly one anchor. Many texts are handled at once, end to end;
windows that reach into the next one don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from tidelog.llm.common import mix64, prefix_sums

#: Window starts that are handled at once; longer texts go in pieces, short ones together.
PIECE, TOGETHER = 1 << 20, 1 << 17
#: Bits of a place among those that are handled at once; hashes are compared by the bits above.
PLACE_BITS = 21


def sliding_min(x: np.ndarray, width: int, done: int = 1) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling; each of x is that of `done` neighbours already."""
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def placed(hashes: np.ndarray) -> np.ndarray:
    """Hashes (below 2^43) with their places, so that the least one is the first such if several tie."""
    return hashes << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)


def owners(least: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first start, last start) of the runs of given starts that have one anchor; least: of each window."""
    if not len(starts):
        return starts, starts, starts
    place = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    edge = np.flatnonzero(place[1:] != place[:-1])
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(place) - 1]])
    return place[first], starts[first], starts[last]


def owned_starts(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of `width` hashes with their ranges of window starts."""
    least = sliding_min(placed(hashes), width)
    return owners(least, np.arange(len(least)))


def _pieces(texts: list[bytes], longest: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text, start in it, bytes) of pieces of texts, in lists of about TOGETHER bytes; a piece overlaps the next by a window less one byte."""
    owner: list[int] = []
    begin: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text)), PIECE):
            parts.append(text[start : start + PIECE + longest - 1] if len(text) > PIECE else text)
            owner.append(i)
            begin.append(start)
            size += len(parts[-1])
            if size >= TOGETHER:
                yield owner, begin, parts
                owner, begin, parts, size = [], [], [], 0
    if parts:
        yield owner, begin, parts


def anchors(
    texts: list[bytes], lengths: tuple[int, ...], gram: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, anchor hash, context hash, anchor place, first start, last start) over all windows of the texts, for each length.

    The last bit of an anchor's hash is the place of its length among the (one or two) lengths. The context runs from the first start to
    the end of the last window; its hash also covers its size and the anchor's place in it. A length beyond the text's has no windows.
    wanted tells from an array of anchor hashes which of them to go on with.
    """
    for owner, begin, parts in _pieces(texts, max(lengths)):
        sizes = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(data) < min(lengths):
            continue
        sums, inverse = prefix_sums(data)
        with np.errstate(over="ignore"):
            grams = mix64((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
        room = np.repeat(ends, sizes) - np.arange(len(data))
        if max(sizes) > PIECE:  # the windows from PIECE on are the next piece's
            room[np.arange(len(data)) - np.repeat(ends - sizes, sizes) >= PIECE] = 0
        owner, begin = np.array(owner, np.int64), np.array(begin, np.int64) - (ends - sizes)
        least, done = placed(grams >> np.uint64(PLACE_BITS)), 1
        for level, length in sorted(enumerate(lengths), key=lambda x: x[1]):
            starts = np.flatnonzero(room >= length)
            if not len(starts):
                break
            least, done = sliding_min(least, length - gram + 1, done), length - gram + 1
            places, first, last = owners(least, starts)
            # the least of many hashes is small: spread again, so that its upper bits tell anchors apart
            h = (mix64(grams[places], level) & ~np.uint64(1) | np.uint64(level)).view(np.int64)
            if wanted is not None:
                places, first, last, h = (x[some] for some in [wanted(h)] for x in (places, first, last, h))
            with np.errstate(over="ignore"):
                content = mix64((sums[last + length] - sums[first]) * inverse[first], 2 + level)
                c = mix64(content + mix64((last - first << 32 | places - first).astype(np.uint64), 4)).view(np.int64)
            piece = np.searchsorted(ends, first, side="right")
            shift = begin[piece]
            yield owner[piece], h, c, places + shift, first + shift, last + shift
