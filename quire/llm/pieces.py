"""Splitting oversized texts: rolling-hash landmarks that snap to natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most characters of a piece, most characters repeated from the piece before, least new characters of a piece but the last.
LIMIT, OVERLAP, LEAST = 2400, 200, 1100
#: Characters under the rolling hash; one position in 2^MASK_BITS is a landmark; how far a landmark may snap.
WINDOW, MASK_BITS, SNAP = 32, 8, 400

_PARAGRAPH = regex.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*")
_LINE = regex.compile(r"\r\n|\n|\r|\x85| | ")
_SENTENCE = regex.compile(r"(?<=[.!?…;:][\"'”’»)\]]*)\s+|(?<=[。！？；])")
_WORD = regex.compile(r"\s+")


def landmarks(text: str) -> np.ndarray:
    """Positions p, ascending, whose WINDOW characters before p hash to a landmark.

    The hash depends on these characters only, so an edit moves no landmark beyond its window.
    """
    n = len(text)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        c = (c + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        c ^= c >> np.uint64(29)
        h = np.zeros(n - WINDOW + 1, np.uint64)
        m = np.uint64(0x5851F42D4C957F2D)
        for k in range(WINDOW):
            h = h * m + c[k : n - WINDOW + 1 + k]
        h ^= h >> np.uint64(32)
    return WINDOW + np.flatnonzero((h & np.uint64(2**MASK_BITS - 1)) == 0)


def cuts(text: str, most: int, least: int = LEAST, snap: int = SNAP) -> list[int]:
    """Ends of the new parts of the pieces: each part has at most ``most`` characters.

    Of the window from ``least`` to ``most`` characters after the last cut the first landmark is
    taken (the end of the window where there is none) and moved to the nearest natural boundary
    within ``snap``: a paragraph's end, else a line's, else a sentence's, else a word's. Where none
    of these is near, the nearest in the whole window counts; a text without any is cut as it is,
    but not before a combining mark.
    """
    marks, levels = landmarks(text), None
    out, at, n = [], 0, len(text)
    while n - at > most:
        if levels is None:
            levels = [np.array([m.end() for m in p.finditer(text)], np.int64) for p in (_PARAGRAPH, _LINE, _SENTENCE, _WORD)]
        lo, hi = at + least, at + most
        i = np.searchsorted(marks, lo)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= hi else hi
        cut = None
        for reach in (snap, most):
            a, b = max(lo, mark - reach), min(hi, mark + reach)
            for ends in levels:
                near = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b, "right")]
                if len(near):
                    cut = int(near[np.argmin(np.abs(near - mark))])
                    break
            if cut is not None:
                break
        if cut is None:
            cut = mark
            while cut > lo and regex.match(r"\p{M}|‍|️", text[cut]):
                cut -= 1
        out.append(cut)
        at = cut
    return [*out, n]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the pieces; a piece starts with up to ``overlap`` last characters of the one before.

    The overlap begins at a word where one begins in it. text[end of the piece before : end] are
    the new characters, so the text comes back from them.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    out, last = [], 0
    for end in cuts(text, limit - overlap, min(least, (limit - overlap) // 2)):
        start = max(0, last - overlap)
        if start:
            word = _WORD.search(text, start - 1, last)
            start = word.end() if word and word.end() < last else start
        out.append((start, end))
        last = end
    return out


def _split(limit: int, overlap: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "item_id", "piece", "start", "fresh", "text"]
        for b in batches:
            rows, held = [], 0
            for kind, item, text in zip(*(b.column(c).to_pylist() for c in ("kind", "item_id", "text"))):
                last = 0
                for k, (s, e) in enumerate(pieces(text, limit, overlap, least), 1):
                    rows.append((kind, item, k, s, last - s, text[s:e]))
                    held, last = held + e - s, e
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names)

    return run


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(kind, item_id, piece, start, fresh, text) of the rows (kind, item_id, text) over ``limit`` characters.

    Pieces are numbered from 1, ``start`` is the place of the piece in the text and ``fresh`` the
    number of leading characters it repeats. Null, empty and shorter texts give no row: the filter
    runs before any text reaches Python. A row is cut by itself, so rows repeated under one id give
    their pieces again; callers reduce them first.
    """
    over = df.select("kind", F.col("item_id").cast("string").alias("item_id"), "text").where(F.length("text") > limit)
    return over.mapInArrow(_split(limit, overlap, least), "kind string, item_id string, piece int, start int, fresh int, text string")
