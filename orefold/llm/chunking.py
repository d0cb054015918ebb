"""Oversized chunks cut at natural boundaries by recursive bisection."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.operators.snapshots import current_rows

#: Tokens a piece may have, UTF-16 code units a token stands for, and tokens shared where a line is too long to share.
MAX_TOKENS, UNITS, INLINE_TOKENS = 512, 4, 32

PIECES_SCHEMA = (
    "chunk_id string, snapshot_no int, chunk_kind string, piece_no int, n_pieces int, start_line int, end_line int, "
    "n_tokens int, shared_lines int, shared_tokens int, shared_chars int, text string"
)


def utf16_units(text: str | Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def chunk_size(text: str = "text", estimate: str = "token_estimate") -> Column:
    """Tokens of a chunk: a quarter of its UTF-16 length, rounded up; without text, the estimate; null without both."""
    return F.when(F.col(text).isNotNull(), F.ceil(utf16_units(text) / F.lit(float(UNITS)))).otherwise(F.col(estimate)).cast("long")


class _Text:
    """Positions, lengths and cut points of one text; positions are code points."""

    def __init__(self, text: str) -> None:
        self.text = text
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.n = len(cps)
        self.at = np.concatenate(([0], np.cumsum(1 + (cps > 0xFFFF)))) if (cps > 0xFFFF).any() else np.arange(self.n + 1)
        lf, cr = cps == 10, cps == 13
        ends = np.flatnonzero(lf | (cr & ~np.append(lf[1:], False))) + 1
        self.starts = np.concatenate(([0], ends)).tolist()  # line starts; a last line may be empty
        if self.starts[-1] == self.n and self.n:
            self.starts.pop()
        self.strength = self._strengths()
        self.inside_crlf = set((np.flatnonzero(cr & np.append(lf[1:], False)) + 1).tolist())

    def _strengths(self) -> list[tuple[bool, int, int]]:
        """How good a cut before each line is: after something finished rather than not, then the fewer braces are open the better, then after a
        blank line, a closed block or an ended statement."""
        out, depth, lines = [(False, 0, 0)], 0, [self.text[a:b].strip() for a, b in zip(self.starts, [*self.starts[1:], self.n])]
        for line, after in zip(lines, lines[1:]):
            depth = max(0, depth + line.count("{") - line.count("}"))
            kind = 3 if not line else 2 if line[-1] == "}" else 1 if line[-1] in ";{.:!?" else 0
            out.append((kind > 0 and not after.startswith("{"), -depth, kind))
        return out

    def units(self, a: int, b: int) -> int:
        return int(self.at[b] - self.at[a])

    def back(self, p: int, units: int) -> int:
        """The position at most `units` before p, not between a carriage return and its line feed."""
        q = int(np.searchsorted(self.at, self.at[p] - units))
        return q + (q in self.inside_crlf)

    def line_of(self, p: int) -> int:
        return bisect_right(self.starts, p) - 1

    number = line_of  # of the line at p, from 0

    def line_at(self, p: int) -> int | None:
        """The line that starts at p."""
        k = self.line_of(p)
        return k if self.starts[k] == p else None

    def start_of(self, k: int) -> int:
        return self.starts[k] if k < len(self.starts) else self.n

    def line_cut(self, a: int, b: int) -> int | None:
        """The strongest start of a line in the middle half of [a, b), else the nearest to the middle."""
        half = self.units(a, b) / 2
        middle = self.at[a] + half
        off = lambda k: abs(self.at[self.starts[k]] - middle)
        lines = range(bisect_right(self.starts, a), bisect_left(self.starts, b))
        if not lines:
            return None
        inner = [k for k in lines if off(k) <= half / 2]
        return self.starts[max(inner, key=lambda k: (self.strength[k], -off(k))) if inner else min(lines, key=off)]

    def inline_cut(self, a: int, b: int) -> int:
        """A cut inside a line: near the middle after a separator or a space, else at the middle."""
        mid = min(max(int(np.searchsorted(self.at, self.at[a] + self.units(a, b) / 2)), a + 1), b - 1)
        reach = max((b - a) // 8, 1)
        for marks in (";,{})", " \t　"):
            spots = [p for p in range(max(a + 1, mid - reach), min(b - 1, mid + reach) + 1) if self.text[p - 1] in marks]
            if spots:
                return min(spots, key=lambda p: abs(p - mid))
        return mid + (mid in self.inside_crlf and mid + 1 < b)


class _Even:
    """The same for a chunk without text: its tokens are taken as spread evenly over its lines; positions are tokens. Where there are more lines
    than tokens, the lines of a token count as one."""

    def __init__(self, size: int, lines: int) -> None:
        self.n, self.lines, self.real = size, min(lines, size), lines

    def number(self, p: int) -> int:
        return p * self.real // self.n

    def units(self, a: int, b: int) -> int:
        return (b - a) * UNITS

    def back(self, p: int, units: int) -> int:
        return max(0, p - units // UNITS)

    def line_of(self, p: int) -> int:
        return p * self.lines // self.n

    def start_of(self, k: int) -> int:
        return -(-k * self.n // self.lines)

    def line_at(self, p: int) -> int | None:
        k = self.line_of(p)
        return k if self.start_of(k) == p else None

    def line_cut(self, a: int, b: int) -> int | None:
        middle = (a + b) // 2
        k = self.line_of(middle)
        near = [p for p in (self.start_of(k), self.start_of(k + 1)) if a < p < b]
        return min(near, key=lambda p: abs(p - middle)) if near else None

    def inline_cut(self, a: int, b: int) -> int:
        return (a + b) // 2


def _shared_from(t: _Text | _Even, cut: int, limit: int, least: int = 0) -> tuple[int, int]:
    """Where the text shared with the piece before `cut` starts, not before `least`, and how many whole lines it has (0: part of a line).

    Two lines are shared, or the only one there is, where the line that follows fits the piece with them, so that no piece has to end inside a line
    that fits; else one line where that does; else INLINE_TOKENS, as where the cut is inside a line. Of a line that is itself too large a part has to fit.
    """
    room = min(INLINE_TOKENS * UNITS, limit // 2)
    k = t.line_at(cut) if cut < t.n else None
    if k is not None:
        follows = t.units(cut, min(t.start_of(k + 1), t.n))
        room_for = follows if follows + room <= limit else room
        for lines in range(min(2, k), 0, -1):
            start = t.start_of(k - lines)
            if start >= least and t.units(start, cut) + room_for <= limit:
                return start, lines
    return max(least, t.back(cut, room)), 0


def _bisect(t: _Text | _Even, limit: int) -> list[tuple[int, int, int, int]]:
    """Pieces in order as (start, core start, end, whole lines shared) of at most `limit` units: cut at the strongest boundary near the
    midpoint, again for halves that exceed the limit with what they share, then the shared parts attached."""
    todo, cores = [(0, t.n)], []
    while todo:
        a, b = todo.pop()
        shared = t.units(_shared_from(t, a, limit)[0], a) if a else 0
        if t.units(a, b) + shared <= limit or b - a <= 1:
            cores.append((a, b))
            continue
        c = t.line_cut(a, b)
        c = t.inline_cut(a, b) if c is None else c
        todo += [(c, b), (a, c)]
    out: list[tuple[int, int, int, int]] = []
    for a, b in cores:  # only what the piece in front has is shared
        out.append((*_shared_from(t, a, limit, out[-1][0]), a, b) if out else (0, 0, a, b))
    out = [(start, a, b, lines) for start, lines, a, b in out]
    return out


def bisect_text(text: str, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int]]:
    """Pieces of a text in order as (start, core start, end, whole lines shared), positions in code points.

    Every piece has at most max_tokens tokens with what it shares with the piece before; the cores joined are the text; a text that fits is
    one piece. Two whole lines are shared wherever the next line fits with them, else one, and 32 tokens at cuts inside a line (see _shared_from).
    """
    return _bisect(_Text(text), max_tokens * UNITS)


def _pieces(row: tuple, max_tokens: int) -> Iterator[tuple]:
    chunk, snapshot, kind, text, size, first, last = row
    first = 1 if first is None else first
    if text is None:  # impossible lines count as one
        t: _Text | _Even = _Even(size, last - first + 1 if last is not None and last >= first else 1)
    else:
        t = _Text(text)
    pieces = _bisect(t, max_tokens * UNITS)
    for i, (start, core, end, lines) in enumerate(pieces):
        yield (
            chunk, snapshot, kind, i, len(pieces), first + t.number(start), first + t.number(max(start, end - 1)), -(-t.units(start, end) // UNITS), lines, -(-t.units(start, core) // UNITS),
            None if text is None else core - start, None if text is None else text[start:end],
        )


def split_oversized(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Current chunks above max_tokens as ordered pieces of at most max_tokens (PIECES_SCHEMA).

    Only the texts of oversized rows are shuffled. Null, empty and small chunks, and those without text and estimate, have no
    pieces; a null start_line counts as 1; a null or impossible end_line is taken from the text, or else the chunk counts as one line.
    Of repeated and superseded rows the current one counts; other columns are ignored; an empty table gives no rows.
    """
    sized = chunks.withColumn("__size", chunk_size())
    kept = sized.withColumn("__text", F.when(F.col("__size") > max_tokens, F.col("text")))
    now = current_rows(kept, ["chunk_id", "snapshot_no"], ["__size", "__text", "chunk_kind", "start_line", "end_line"])
    large = now.where(F.col("__size") > max_tokens).select("chunk_id", "snapshot_no", "chunk_kind", "__text", "__size", "start_line", "end_line")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PIECES_SCHEMA.split(", ")]
        whole = lambda x: None if x is None or x != x else int(x)
        for pdf in batches:
            rows = []
            for chunk, snapshot, kind, text, size, first, last in zip(*(pdf[c] for c in pdf.columns)):
                rows += _pieces((chunk, whole(snapshot), kind, text, int(size), whole(first), whole(last)), max_tokens)
            yield pd.DataFrame(rows, columns=names).astype({"snapshot_no": "Int32", "shared_chars": "Int32"})

    return large.mapInPandas(cut, PIECES_SCHEMA)
