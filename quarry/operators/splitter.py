"""Recursive character splitter (P6) as a small per-text helper.

Behaviour of the public recursive splitter with its defaults, which the
reference uses: separators tried in order, the separator is kept at the start
of the following piece, lengths are ``len`` (code points), merged chunks are
stripped and blank ones dropped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence


Span = tuple[int, int]


def split_spans(
    text: str | None,
    chunk_size: int,
    chunk_overlap: int,
    separators: Sequence[str] = ("\n\n", "\n", " ", ""),
) -> list[Span]:
    """``(start, end)`` of every chunk: pieces tile the text and a chunk is a
    run of pieces without white space at its ends, so it is ``text[start:end]``."""
    if chunk_overlap > chunk_size:
        raise ValueError("chunk_overlap must not exceed chunk_size")
    if not text:
        return []
    return _split(text, 0, len(text), tuple(separators), chunk_size, chunk_overlap)


def split_text(
    text: str | None,
    chunk_size: int,
    chunk_overlap: int,
    separators: Sequence[str] = ("\n\n", "\n", " ", ""),
) -> list[str]:
    return [text[a:b] for a, b in split_spans(text, chunk_size, chunk_overlap, separators)]


def _pieces(text: str, start: int, end: int, sep: str) -> list[Span]:
    """The pieces of ``text[start:end]``, each but the first with its separator
    in front; empty ones are left out."""
    if sep == "":
        return [(i, i + 1) for i in range(start, end)]
    cuts, at = [start], text.find(sep, start, end)
    while at >= 0:
        cuts.append(at)
        at = text.find(sep, at + len(sep), end)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], end]) if a < b]


def _split(text: str, start: int, end: int, separators: tuple, size: int, overlap: int) -> list[Span]:
    sep = separators[-1]
    deeper: tuple = ()
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if text.find(s, start, end) >= 0:
            sep = s
            deeper = separators[i + 1 :]
            break
    chunks: list[Span] = []
    small: list[Span] = []
    for a, b in _pieces(text, start, end, sep):
        if b - a < size:
            small.append((a, b))
            continue
        chunks.extend(_merge(text, small, size, overlap))
        small = []
        if deeper:
            chunks.extend(_split(text, a, b, deeper, size, overlap))
        else:
            chunks.append((a, b))
    chunks.extend(_merge(text, small, size, overlap))
    return chunks


def _emit(text: str, window, out: list[Span]) -> None:
    if not window:
        return
    start, end = window[0][0], window[-1][1]
    while start < end and text[start].isspace():
        start += 1
    while start < end and text[end - 1].isspace():
        end -= 1
    if start < end:
        out.append((start, end))


def _merge(text: str, pieces: list[Span], size: int, overlap: int) -> list[Span]:
    out: list[Span] = []
    window: deque = deque()
    total = 0
    for piece in pieces:
        n = piece[1] - piece[0]
        if total + n > size and window:
            _emit(text, window, out)
            while total > overlap or (total + n > size and total > 0):
                total -= window[0][1] - window[0][0]
                window.popleft()
        window.append(piece)
        total += n
    _emit(text, window, out)
    return out
