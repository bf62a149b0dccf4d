"""The k best of many pairs, scored by blocks: one matrix product for each block of queries and block of rows.

Rows are packed into blocks where they are, blocks of queries are broadcast,
and a task keeps the ``k`` best of each query over all of its blocks, so that
nothing but these leaves it.  Products only say which pairs can be among the
best; what is returned is added up in the order of the components and rounded
from its decimal digits, as Spark's own expressions do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A score that is null ranks after all others, and one that is not a number before them.
NULL_SCORE, NAN_SCORE = -1e300, np.inf

#: Places of a rounded score.
PLACES = 6
_UNIT = 10**PLACES

#: Of a unit of the last place: sums in another order differ by less.
_UNSURE = 1e-5


def rounded(values: np.ndarray, exact=None) -> np.ndarray:
    """Half up to six places; ``exact`` gives the values of those (by number) that are so near to a half that a product can't tell."""
    scaled = values * _UNIT
    low = np.floor(scaled)
    out = np.where(np.abs(scaled) < 2.0**52, np.floor(scaled + 0.5) / _UNIT, values)
    with np.errstate(invalid="ignore"):
        unsure = np.flatnonzero(np.abs(scaled - low - 0.5) < _UNSURE)
    if len(unsure):
        true = values[unsure] if exact is None else exact(unsure)
        digits = Decimal(1).scaleb(-PLACES)
        out[unsure] = [float(Decimal(repr(float(x))).quantize(digits, ROUND_HALF_UP)) for x in true]
    return out


class Best:
    """The ``k`` best items of each of ``n`` queries so far: score descending, then the smaller item.

    With ``merge`` an item that comes again counts with its best score.
    """

    def __init__(self, n: int, k: int, kind: pa.DataType, merge: bool = False):
        self.k, self.merge = k, merge
        self.floor = np.full(n, -np.inf)
        self.table = pa.table({"q": pa.array([], pa.int32()), "s": pa.array([], pa.float64()), "i": pa.array([], kind)})
        self.waiting: list[pa.Table] = []
        self.rows, self.room = 0, max(100_000, 2 * n * k)

    def candidates(self, scores: np.ndarray, queries: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in a matrix of scores (``queries`` by items) that can be among the best; minus infinity never is."""
        floor = self.floor[queries]
        found = scores >= (floor - slack)[:, None]
        found &= scores > -np.inf
        if np.count_nonzero(found) > 2 * self.k * len(queries) and scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            floor = np.maximum(floor, np.partition(scores, at, axis=1)[:, at])
            found &= scores >= (floor - slack)[:, None]
        return np.nonzero(found)

    def add(self, queries: np.ndarray, scores: np.ndarray, items: pa.Array) -> None:
        self.waiting.append(pa.table({"q": pa.array(queries, pa.int32()), "s": pa.array(scores, pa.float64()), "i": items}))
        self.rows += len(queries)
        if self.rows > self.room:
            self.settle()

    def settle(self) -> pa.Table:
        """Merges what has been added; the table of the best."""
        if not self.waiting:
            return self.table
        every = pa.concat_tables([self.table, *self.waiting]).combine_chunks()
        if self.merge:
            every = every.group_by(["q", "i"]).aggregate([("s", "max")]).rename_columns(["q", "i", "s"]).select(["q", "s", "i"])
        every = every.take(pc.sort_indices(every, [("q", "ascending"), ("s", "descending"), ("i", "ascending")]))
        q = every["q"].to_numpy()
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
        kept = np.flatnonzero(place < self.k)
        last = np.flatnonzero(place == self.k - 1)
        self.floor[q[last]] = every["s"].to_numpy()[last]
        self.table, self.waiting, self.rows = every.take(pa.array(kept)).combine_chunks(), [], 0
        return self.table


def same_items(queries: pa.Array, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a query and an item that are equal."""
    codes = pa.concat_arrays([queries.cast(items.type), items]).dictionary_encode().indices.to_numpy()
    mine, theirs = codes[: len(queries)], codes[len(queries) :]
    order = np.argsort(mine, kind="stable")
    first, last = np.searchsorted(mine[order], theirs, "left"), np.searchsorted(mine[order], theirs, "right")
    counts = last - first
    columns = np.repeat(np.arange(len(theirs)), counts)
    offsets = np.arange(len(columns)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[np.repeat(first, counts) + offsets], columns


@dataclass(frozen=True)
class Measure:
    """Cosine of two vectors to six places, null without a direction.

    With ``damping``, which is added to the product of their lengths, it is
    never null.  With ``platt`` (a, b) what counts is the calibrated cosine.
    """

    damping: float | None = None
    platt: tuple[float, float] | None = None

    def _of(self, dots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            cosine = dots / (lengths if self.damping is None else lengths + self.damping)
        cosine[np.isnan(cosine)] = NAN_SCORE
        if self.damping is None:
            cosine[lengths == 0] = NULL_SCORE
        return cosine

    def _calibrated(self, cosine: np.ndarray) -> np.ndarray:
        if self.platt is None:
            return cosine
        a, b = self.platt
        with np.errstate(all="ignore"):
            z = np.clip(-(a * cosine + b), -500.0, 500.0)
        # As in rules.platt, what is missing counts as the lowest.
        return 1 / (1 + np.exp(np.where((cosine == NULL_SCORE) | (cosine == NAN_SCORE), 500.0, z)))

    def missing(self, shape: tuple[int, int]) -> np.ndarray:
        """Scores of pairs that can't be compared."""
        return rounded(self._calibrated(np.full(shape, NULL_SCORE)).ravel()).reshape(shape)

    def near(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Scores of all pairs before they are rounded, by a matrix product."""
        with np.errstate(all="ignore"):
            return self._calibrated(self._of(a @ b.T, np.outer(la, lb)))

    def exact(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Rounded scores of pairs of rows."""
        with np.errstate(all="ignore"):
            dots, lengths = np.einsum("ij,ij->i", a, b), la * lb
        values = self._of(dots, lengths)
        out = rounded(values, lambda some: self._of(ordered_sum(a[some] * b[some]), lengths[some]))
        return out if self.platt is None else rounded(self._calibrated(out))


#: What rounding can move a score by, before and after calibration.
SLACK = 2.0 / _UNIT


def ordered_sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first component to the last."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(ordered_sum(x * x))


# Packed blocks

BLOCK_FIELDS = "width int, vectors binary"


def packed(batches: Iterator[pa.RecordBatch], ids: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """One row for each block of at most ``rows`` vectors of one width: the columns ``ids`` as arrays, ``width`` and ``vectors``.

    Vectors that are null or have null components are in a block without a
    matrix, whose width is -1.
    """
    held, n = [], 0
    for batch in batches:
        for at in range(0, len(batch), rows):
            some = batch.slice(at, rows)
            if n + len(some) > rows:
                yield from _blocks(held, ids)
                held, n = [], 0
            held.append(some)
            n += len(some)
    if n:
        yield from _blocks(held, ids)


def _blocks(held: list[pa.RecordBatch], ids: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    vectors = table["v"].combine_chunks() if table["v"].num_chunks != 1 else table["v"].chunk(0)
    width = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    holes = pc.list_parent_indices(vectors).filter(pc.is_null(pc.list_flatten(vectors))).to_numpy(zero_copy_only=False)
    width[holes] = -1
    for w in np.unique(width):
        at = pa.array(np.flatnonzero(width == w))
        flat = b"" if w < 0 else np.ascontiguousarray(pc.list_flatten(vectors.take(at)).to_numpy(zero_copy_only=False), np.float64).tobytes()
        columns = [pa.array([table[c].take(at).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ids]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([int(w)], pa.int32()), pa.array([flat], pa.binary())], names=[*ids, "width", "vectors"])


def matrix(width: int, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, width) if width >= 0 else np.zeros((n, 0))
