"""Best-fit packing of token pieces into sequences by swap-based local search.

Documents are encoded once; their pieces (only documents longer than a sequence are cut) are stored in the shared folder.
There are fewer lengths than a sequence has tokens, so the packing is made of their counts alone, however many pieces there
are: a pattern is a multiset of lengths that share a bin, and it stands for as many bins as are alike. The start is best
fit decreasing. The local search then drains the emptiest bins: it moves a piece to another underfull bin, exchanges one
piece for one shorter piece or one for two shorter ones, in as many bins of a pattern as both sides have, always so that
the sum of squared fills grows, until the bins are as few as the lengths allow or no step is left. Last, the pieces of each
length, numbered in the order of rows, are dealt to the patterns' places.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import make_importable, materialise, text_or_empty
from twinweave.llm.token_store import pieces_of
from twinweave.llm.tokens import default_vocabulary
from twinweave.plans.ranks import global_row_number

#: Lengths of a bin, longest first, with how often it holds them.
Pattern = tuple[tuple[int, int], ...]


def _changed(pattern: Pattern, *changes: tuple[int, int]) -> Pattern:
    """The pattern with lengths added or, by a negative number, taken away."""
    held = Counter(dict(pattern))
    for length, n in changes:
        held[length] += n
    return tuple(sorted(((x, k) for x, k in held.items() if k), reverse=True))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Bins by pattern: longest pieces first, each in the fullest bin that has room; bins that are alike are filled together."""
    room: dict[int, dict[Pattern, int]] = {}
    spaces: list[int] = []

    def put(pattern: Pattern, space: int, bins: int) -> None:
        if bins and space not in room:
            room[space] = {}
            insort(spaces, space)
        if bins:
            room[space][pattern] = room[space].get(pattern, 0) + bins

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                pattern = next(iter(room[space]))
                bins = room[space][pattern]
            else:
                space, pattern, bins = capacity, (), left
            each = min(space // length, left)
            taken = min(bins, left // each)
            if pattern:
                room[space][pattern] -= taken
                if not room[space][pattern]:
                    del room[space][pattern]
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
            put(_changed(pattern, (length, each)), space - each * length, taken)
            left -= taken * each
    return {pattern: n for found in room.values() for pattern, n in found.items()}


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: the lengths' sum, and no two lengths over half a bin in one."""
    return max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))


class _Search:
    """Local search over the underfull bins of a packing by pattern; deterministic."""

    def __init__(self, packing: dict[Pattern, int], capacity: int):
        import numpy as np

        self.capacity, self.steps, self.live = capacity, 0, 0
        self.patterns: list[Pattern] = []
        self.number: dict[Pattern, int] = {}
        self.bins = np.zeros(0, np.int64)
        self.fill = np.zeros(0, np.int64)
        #: For each pattern's lengths, and for its pairs of lengths: the pattern, the sum, and the lengths.
        self.ones, self.twos = np.zeros((0, 4), np.int64), np.zeros((0, 4), np.int64)
        self._new: list[Pattern] = []
        for pattern, n in sorted(packing.items()):
            self._add(pattern, n)
        self._settle()

    def _add(self, pattern: Pattern, n: int) -> None:
        import numpy as np

        if not pattern:
            return
        self.live += n
        if pattern not in self.number:
            self.number[pattern] = len(self.patterns)
            self.patterns.append(pattern)
            self._new.append(pattern)
            if len(self.patterns) > len(self.bins):
                grown = np.zeros(max(64, 2 * len(self.bins)), np.int64)
                self.bins, self.fill = (np.concatenate([old, grown]) for old in (self.bins, self.fill))
            self.fill[self.number[pattern]] = sum(x * k for x, k in pattern)
        self.bins[self.number[pattern]] += n

    def _settle(self) -> None:
        """Enter the lengths of new patterns."""
        import numpy as np

        one, two = [], []
        for pattern in self._new:
            at = self.number[pattern]
            if self.fill[at] == self.capacity:
                continue
            one += [(at, x, x, 0) for x, _ in pattern]
            two += [(at, x + y, x, y) for i, (x, k) in enumerate(pattern) for y, _ in (pattern[i:] if k > 1 else pattern[i + 1 :])]
        self._new = []
        self.ones, self.twos = (np.concatenate([old, np.array(new, np.int64).reshape(-1, 4)]) for old, new in ((self.ones, one), (self.twos, two)))

    def _best(self, sizes, rows, donor: int, least: int):
        """Gain, size and row of the exchange that takes most, above ``least``, out of the donor; the target has room for it and
        ends fuller than the donor was."""
        import numpy as np

        at = rows[:, 0]
        open_ = (self.bins[at] > 0) & ((at != donor) | (self.bins[at] > 1))
        rows, at = rows[open_], at[open_]
        if not len(rows):
            return least, 0, None
        gain = sizes[:, None] - rows[None, :, 1]
        room = self.capacity - self.fill[at]
        fits = (gain <= room) & (gain > np.maximum(least, self.fill[donor] - self.fill[at]))
        best = int(np.where(fits, gain, 0).argmax())
        i, j = divmod(best, len(rows))
        return (int(gain[i, j]), int(sizes[i]), rows[j]) if fits[i, j] else (least, 0, None)

    def _apply(self, donor: int, target: int, out: int, back: tuple[int, ...]) -> None:
        """One piece from the donor's bins to the target's, and others back, in as many bins as both have."""
        n = int(self.bins[donor]) // 2 if donor == target else int(min(self.bins[donor], self.bins[target]))
        for at in (donor, target):
            self.bins[at] -= n
            self.live -= n
        self._add(_changed(self.patterns[donor], (out, -1), *((x, 1) for x in back)), n)
        self._add(_changed(self.patterns[target], (out, 1), *((x, -1) for x in back)), n)
        self._settle()
        self.steps += 1

    def _step(self, donor: int) -> bool:
        """The move, or else the exchange, that takes most out of the donor."""
        import numpy as np

        sizes = np.array([x for x, _ in self.patterns[donor]])
        count = len(self.patterns)
        fill = self.fill[:count]
        other = (self.bins[:count] > 0) & (fill < self.capacity)
        other[donor] &= self.bins[donor] > 1
        targets = np.flatnonzero(other)
        for size in sizes.tolist():
            some = targets[(fill[targets] + size <= self.capacity) & (fill[targets] + size > fill[donor])]
            if len(some):
                self._apply(donor, int(some[fill[some].argmax()]), size, ())
                return True
        gain, out, row = self._best(sizes, self.ones, donor, 0)
        back = (int(row[2]),) if row is not None else ()
        target = int(row[0]) if row is not None else -1
        _, more, row = self._best(sizes, self.twos, donor, gain)
        if row is not None:
            out, target, back = more, int(row[0]), (int(row[2]), int(row[3]))
        if target < 0:
            return False
        self._apply(donor, target, out, back)
        return True

    def run(self, least: int) -> None:
        """Sweep over the underfull patterns, emptiest first, until the bins are as few as ``least`` or no step is left."""
        import numpy as np

        changed = True
        while changed and self.live > least:
            changed = False
            count = len(self.patterns)
            open_ = np.flatnonzero((self.bins[:count] > 0) & (self.fill[:count] < self.capacity))
            for donor in open_[np.argsort(self.fill[open_], kind="stable")].tolist():
                while self.bins[donor] and self.live > least and self._step(donor):
                    changed = True
                if self.live <= least:
                    break

    def packing(self) -> dict[Pattern, int]:
        return {pattern: int(self.bins[at]) for pattern, at in self.number.items() if self.bins[at]}


def improve(packing: dict[Pattern, int], capacity: int) -> dict[Pattern, int]:
    """A packing of the same lengths with as many bins or fewer, each step of it growing the squared fill."""
    counts: Counter[int] = Counter()
    for pattern, n in packing.items():
        for length, k in pattern:
            counts[length] += k * n
    search = _Search(packing, capacity)
    search.run(least_bins(counts, capacity))
    return search.packing()


def pack_counts(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Bins by pattern for so many pieces of each length (1 to capacity): best fit decreasing, then local search."""
    return improve(best_fit_decreasing(counts, capacity), capacity)


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from twinweave.llm.tokens import encoder

        enc = encoder(path)
        for batch in batches:
            for rows in pieces_of(batch, column=2):
                out: list[list] = [[], [], [], [], [], []]
                keys, ids = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                for key, doc, data in zip(keys, ids, enc.encode(rows.column(2).to_pylist(), end_id), strict=True):
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        for column, value in zip(out, (key, doc, piece, at // 4, len(own) // 4, own), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["row_id", "doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """row_id, doc_id, piece, start, length, ids (little-endian unsigned 32-bit), written once to the shared folder.

    row_id tells rows apart that repeat a doc_id.
    """
    make_importable(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    pieces = rows.mapInArrow(_cut(vocabulary or default_vocabulary(), end_id, capacity), "row_id long, doc_id long, piece int, start long, length long, ids binary")
    return materialise(pieces, "pieces")


def _places(packing: dict[Pattern, int]):
    """Rows (length, first piece, sequence, in one bin, offset) that tell where the pieces of each length go, in their order: from the
    first piece on, so many in each bin, from the offset on, in one sequence after the other."""
    import numpy as np

    rows, begun, sequence = [], Counter(), 0
    for pattern, bins in sorted(packing.items()):
        offset = 0
        for length, k in pattern:
            rows.append((length, begun[length], sequence, k, offset))
            begun[length] += k * bins
            offset += k * length
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(places, before):
    """Pieces (row_id, piece, length, place) with their sequence and offset. ``before``: shorter pieces, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        starts = before[places[:, 0]] + places[:, 1]
        for batch in batches:
            place = batch.column(3).to_numpy()
            row = places[np.searchsorted(starts, place, side="right") - 1]
            nth = place - before[row[:, 0]] - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * row[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sequence), pa.array(offset)], ["row_id", "piece", "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """row_id, piece, sequence_id, offset for each piece. The counts of lengths and the patterns, which are what the driver holds,
    don't grow with the pieces; those are numbered in the order of length, row and piece, and find their places by number."""
    import numpy as np

    make_importable(pieces.sparkSession)
    sizes = pieces.select("row_id", "piece", "length")
    whole = sizes.where(F.col("length") == capacity).select("row_id", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = {r.length: r.n for r in sizes.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return whole
    each = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        each[length + 1] = n
    numbered = global_row_number(sizes.where(F.col("length") < capacity), ["length", "row_id", "piece"], "place")
    short = numbered.select("row_id", "piece", "length", (F.col("place") - 1).alias("place"))
    places = _places(pack_counts(counts, capacity))
    return whole.unionByName(short.mapInArrow(_placed(places, np.cumsum(each)), "row_id long, piece int, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    Null texts count as empty: one piece with only the end id; texts are encoded whole, however long. Rows that repeat a
    doc_id are packed each for itself; equal lengths go in the order of rows.
    Other columns are not read; an empty table gives an empty table.
    """
    pieces = token_pieces(docs, id_col, text_col, vocabulary, end_id, capacity)
    placed = pack_pieces(pieces, capacity)
    return pieces.join(placed, ["row_id", "piece"]).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def packed_digests(docs: DataFrame, **options) -> DataFrame:
    """``pack_documents`` with the crc32 of each piece's ids in their place; the ids themselves aren't shuffled."""
    capacity = options.get("capacity", 2048)
    pieces = token_pieces(docs, **options)
    digests = pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(pack_pieces(pieces, capacity), ["row_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
