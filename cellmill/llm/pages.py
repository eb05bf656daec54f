"""Running text of scanned pages: columns, adverts and headlines told apart by the line boxes."""

from __future__ import annotations

import re

#: Marks that divide columns run together in one line: a bar between blanks, or several blanks.
COLUMN_MARK = re.compile(r" +\| +| {2,}")
#: An advert stands in from its column by about 20 pixels; lines of text by at most 4.
INDENT = 12
#: A new column starts at least so many pixels right of the last one's left edge.
COLUMN_GAP = 150


def reading_order(text: str, x0, y0, x1):
    """Pieces of the page in reading order, column by column, adverts left out.

    Returns (pieces, inner): ``inner`` tells that columns were run together, so that adverts of
    the inner ones have no box of their own and may still be among the pieces. Without one box
    a line the lines are returned as they are.
    """
    lines = text.split("\n")
    n = len(lines)
    if x0 is None or len(x0) != n or n < 2:
        return lines, False
    parts = [COLUMN_MARK.split(line.strip(" |")) if ("  " in line or " | " in line) else None for line in lines]
    most = max([len(p) for p in parts if p] or [1])
    inner = most > 1 and sum(p is not None and len(p) > 1 for p in parts) >= 2
    left = min(x0)
    placed = []
    if inner:
        most = min(most, 6)
        pitch = max(1.0, (max(x1) - left) / most)
        for i, line in enumerate(lines):
            p = parts[i] if parts[i] is not None else [line]
            if len(p) == 1:
                placed.append((min(most - 1, int((x0[i] - left) / pitch + 0.5)), y0[i], i, 0, p[0], x0[i]))
                continue
            width, at, last = (x1[i] - x0[i]) / max(1, len(line)), 0, -1
            for k, piece in enumerate(p):
                at = max(line.find(piece, at), 0)
                col = k if len(p) == most else min(most - 1, max(last + 1, int((x0[i] + at * width - left) / pitch + 0.5)))
                placed.append((col, y0[i], i, k, piece, x0[i] if k == 0 else None))
                at += len(piece)
                last = col
    else:
        starts = []
        for v in sorted(set(x0)):
            if not starts or v - starts[-1] > COLUMN_GAP:
                starts.append(v)
        for i, line in enumerate(lines):
            col = len(starts) - 1
            while col and x0[i] < starts[col]:
                col -= 1
            placed.append((col, y0[i], i, 0, line, x0[i]))
    base: dict[int, int] = {}
    for col, _, _, _, _, x in placed:
        if x is not None and x < base.get(col, 1 << 30):
            base[col] = x
    placed.sort(key=lambda p: p[:4])
    return [p[4] for p in placed if p[5] is None or p[5] - base[p[0]] < INDENT], inner
