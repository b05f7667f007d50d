"""Affine-gap local alignment of two byte sequences, one vectorised row per residue."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOW = -(10**12)
#: Cells of the largest table that is kept whole (12 bytes each).
CELLS = 1 << 21


@dataclass
class Segment:
    """One alignment; positions are 1-based and inclusive, gaps are ``-``."""

    score: int
    q_from: int
    q_to: int
    d_from: int
    d_to: int
    identities: int
    gaps: int
    q_aligned: str
    d_aligned: str


def _rows(x: np.ndarray, y: np.ndarray, table: np.ndarray, open_: int, more: int, local: bool, begin: int | None = None):
    """Rows (best, ending with a gap in y, ending with a gap in x) of the alignment table.

    ``begin`` is what a gap in y costs to open at the origin.  The arrays are written anew for
    every row.
    """
    size, first = len(y) + 1, open_ + more
    # Every value lies within this of zero, so 32 bits nearly always do.
    furthest = (len(x) + size) * max(int(np.abs(table).max(initial=1)), first, 1)
    kind, low = (np.int32, -(1 << 30)) if furthest < 1 << 29 else (np.int64, LOW)
    slope = more * np.arange(size, dtype=kind)
    row = np.zeros(size, kind)
    if not local:  # anchored at the origin
        row[1:] = -open_ - slope[1:]
    down, across = np.full(size, low, kind), np.full(size, low, kind)
    across[1:] = row[1:]
    if begin is not None:
        down[0] = -begin
    yield row, down, across
    scores = table.astype(kind)
    kinds = set(x.tolist())
    # One gain per residue and place of y, where few residues repeat.
    known = {residue: scores[residue, y] for residue in kinds} if len(kinds) <= 32 else None
    fresh, spare = np.empty(size, kind), np.empty(size, kind)
    for residue in x.tolist():
        np.subtract(row, first, out=spare)
        np.subtract(down, more, out=down)
        np.maximum(down, spare, out=down)
        np.add(row[:-1], scores[residue, y] if known is None else known[residue], out=fresh[1:])
        fresh[0] = down[0]
        np.maximum(fresh, down, out=fresh)
        if local:
            np.maximum(fresh, 0, out=fresh)
        # A gap along y opened at k and ending at j costs first + more * (j - k - 1).
        np.add(fresh, slope, out=spare)
        np.maximum.accumulate(spare, out=spare)
        np.subtract(spare[:-1], slope[1:], out=across[1:])
        across[1:] -= open_
        np.maximum(fresh, across, out=row)
        yield row, down, across


def best_end(
    x: np.ndarray, y: np.ndarray, table: np.ndarray, open_: int, more: int, local: bool = True, stop: int | None = None
) -> tuple[int, int, int]:
    """(score, residues of x, residues of y) where the best alignment ends; the first of equals.

    ``stop`` is a score that is known to be the best: no row after it is computed.
    """
    best, end_x, end_y = 0, 0, 0
    for i, (row, _, _) in enumerate(_rows(x, y, table, open_, more, local)):
        at = int(row.argmax())
        if row[at] > best:
            best, end_x, end_y = int(row[at]), i, at
            if best == stop:
                break
    return best, end_x, end_y


def traceback(
    x: np.ndarray, y: np.ndarray, table: np.ndarray, open_: int, more: int, begin: int | None = None, end: int | None = None
) -> tuple[str, str]:
    """An optimal global alignment of both sequences, as two strings, in linear space.

    ``begin`` and ``end`` are what a gap in y costs to open at the first and last place.  Tables
    of more than ``CELLS`` cells are cut at the middle row, where the best way crosses it: the
    rows from the start and from the end meet either in a pair of places or inside a gap in y,
    which is then opened once.
    """
    begin, end = (open_ if cost is None else cost for cost in (begin, end))
    if len(x) < 2 or (len(x) + 1) * (len(y) + 1) <= CELLS:
        return _dense_traceback(x, y, table, open_, more, begin, end)
    middle = len(x) // 2
    for row, down, _ in _rows(x[:middle], y, table, open_, more, False, begin):
        pass
    for back, back_down, _ in _rows(x[middle:][::-1], y[::-1], table, open_, more, False, end):
        pass
    met, inside = row + back[::-1], down + back_down[::-1] + open_
    cut, gap = int(met.argmax()), int(inside.argmax())
    free = inside[gap] > met[cut]
    if free:
        cut = gap
    left = traceback(x[:middle], y[:cut], table, open_, more, begin, 0 if free else open_)
    right = traceback(x[middle:], y[cut:], table, open_, more, 0 if free else open_, end)
    return left[0] + right[0], left[1] + right[1]


def _dense_traceback(
    x: np.ndarray, y: np.ndarray, table: np.ndarray, open_: int, more: int, begin: int, end: int
) -> tuple[str, str]:
    rows = ([part.copy() for part in three] for three in _rows(x, y, table, open_, more, False, begin))
    best, down, across = (np.stack(part) for part in zip(*rows, strict=True))
    i, j, left, right = len(x), len(y), [], []
    state = "down" if i and down[i, j] + open_ - end >= best[i, j] else "best"
    while i or j:
        if state == "best":
            if i and j and best[i, j] == best[i - 1, j - 1] + table[x[i - 1], y[j - 1]]:
                i, j = i - 1, j - 1
                left.append(x[i])
                right.append(y[j])
                continue
            state = "down" if i and best[i, j] == down[i, j] else "across"
        if state == "down":
            i -= 1
            left.append(x[i])
            right.append(45)
            if down[i + 1, j] != down[i, j] - more:
                state = "best"
        else:
            j -= 1
            left.append(45)
            right.append(y[j])
            if across[i, j + 1] != across[i, j] - more:
                state = "best"
    return bytes(left[::-1]).decode("latin-1"), bytes(right[::-1]).decode("latin-1")


def segments(q: str, d: str, diagonals: list[int], table: np.ndarray, open_: int, more: int, least: int) -> list[Segment]:
    """Alignments of at least ``least`` that a seeded diagonal can be part of, best first.

    An alignment with g gap positions scores at most ``len(q) * best - open - g * more``,
    so all that pass through a diagonal lie within that reach of it; overlapping stretches
    of ``d`` are searched as one.  After the best alignment of a stretch, what lies before
    and behind it in ``d`` is searched again.
    """
    x, y = (np.frombuffer(s.encode("latin-1"), np.uint8) for s in (q, d))
    if not len(x) or not len(y):
        return []
    top = int(table[np.unique(x)].max())
    reach = len(y) if more == 0 else max(0, (len(x) * top - open_ - least) // more)
    regions: list[list[int]] = []
    for diagonal in sorted(set(diagonals)):
        a, b = max(0, diagonal - reach), min(len(y), diagonal + len(x) + reach)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(b, regions[-1][1])
        elif b > a:
            regions.append([a, b])
    found: list[Segment] = []
    while regions:
        a, b = regions.pop()
        if (b - a) * top < least:
            continue
        score, end_x, end_y = best_end(x, y[a:b], table, open_, more)
        if score < max(least, 1):
            continue
        # With this score the alignment has so many gap places at most.
        spare = end_y if more == 0 else max(0, (end_x * top - open_ - score) // more)
        back_x, back_y = x[:end_x][::-1], y[a + max(0, end_y - end_x - spare) : a + end_y][::-1]
        _, size_x, size_y = best_end(back_x, back_y, table, open_, more, local=False, stop=score)
        q_from, d_from = end_x - size_x, a + end_y - size_y
        left, right = traceback(x[q_from:end_x], y[d_from : a + end_y], table, open_, more)
        same = sum(m == n for m, n in zip(left, right, strict=True))
        gaps = left.count("-") + right.count("-")
        found.append(Segment(score, q_from + 1, end_x, d_from + 1, a + end_y, same, gaps, left, right))
        regions += [[a, d_from], [a + end_y, b]]
    return sorted(found, key=lambda s: (-s.score, s.d_from, s.q_from))
