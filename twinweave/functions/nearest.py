"""Best rows and counts of better rows over batches of vectors: float32 products rule pairs out, doubles settle the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Right rows of a tile, its scores, pairs settled at a time, pairs kept before they are merged, and the rounding of a float32.
TILE_ROWS, TILE_SCORES, PAIRS, PENDING, EPS = 8_192, 1 << 21, 1 << 11, 1 << 20, 2.0**-23
#: Scores of a tile's part, and the right rows of these: they stay in a core's cache while they are looked through.
PART_SCORES, PART_COLS = 1 << 18, 512
#: Right rows whose scores are made whole for a first floor (later tiles have as many as were met before, so few pairs reach a
#: floor that is still low), and the steps of a component in ``manhattan``.
FIRST_ROWS, STEPS = 512, 31


def prepared(v: np.ndarray, metric: str) -> np.ndarray:
    """Rows as the metric compares them: of unit length for ``cosine``."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v


def pair_scores(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows with rows, pair by pair, so that equal pairs have equal scores wherever they stand."""
    if metric == "euclidean":
        return 1 - np.sqrt(((x - y) ** 2).sum(1))
    return 1 - np.abs(x - y).sum(1) if metric == "manhattan" else (x * y).sum(1)


def settled(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    return np.concatenate([pair_scores(x[rows[i : i + PAIRS]], y[cols[i : i + PAIRS]], metric) for i in range(0, len(rows), PAIRS)] or [np.zeros(0)])


def _down(floor: np.ndarray) -> np.ndarray:
    """A column of float32 that is not above ``floor``."""
    return np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]


class Bounds:
    """Left rows and what tiles of right rows are held against. ``scores`` gives each pair a score and each row the most that
    it is off; ``may_reach`` tells which pairs may have a score of ``floor`` by row plus ``extra`` by column."""

    def __init__(self, x: np.ndarray, metric: str):
        self.x, self.metric, width = x, metric, x.shape[1]
        self.x32, self.squares = x.astype(np.float32), (x**2).sum(1)
        self.norms, self.eps = np.sqrt(self.squares), 2 * (width + 8) * EPS
        if metric == "manhattan":
            # Held within bounds and cut to whole steps, components come no further apart than by what is cut off.
            self.middle = x.mean(0)
            self.step = max(6 * float(np.sqrt(((x - self.middle) ** 2).mean())) / STEPS, 1e-300)
            self.steps, self.rest = self._cut(x)
            self.room = None

    def _cut(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.clip((v - self.middle) / self.step + STEPS / 2, 0, STEPS)
        whole = np.rint(held)
        return np.ascontiguousarray(whole.astype(np.int8).T), np.abs(held - whole).sum(1)

    def tile(self, y: np.ndarray) -> dict:
        out = {"y": y, "y32": y.astype(np.float32).T, "squares": (y**2).sum(1)}
        out["norm"] = float(np.sqrt(out["squares"].max()))
        if self.metric == "manhattan":
            out["steps"], rest = self._cut(y)
            out["rest"] = rest.max()
        return out

    def scores(self, at: slice, tile: dict, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.x[at], tile["y"]
        reach = self.norms[at] + tile["norm"]
        if self.metric == "euclidean":
            return 1 - np.sqrt(np.maximum(0, self.squares[at, None] + tile["squares"][None] - 2 * (x @ y.T))) - extra, 1e-6 * (1 + reach)
        if self.metric == "manhattan":
            return np.stack([1 - np.abs(y - row).sum(1) for row in x]) - extra, 1e-9 * (1 + reach)
        found = self.x32[at] @ tile["y32"]
        if extra.any():
            found -= extra.astype(np.float32)
        return found, self.eps * (self.norms[at] * tile["norm"] + np.abs(extra).max())

    def may_reach(self, at: slice, tile: dict, floor: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.metric == "manhattan":
            return self._may_reach(at, tile, floor, extra)
        parts = [(self._may_reach(at, part, floor, extra[cols]), cols.start) for cols, part in _parts(tile)]
        return np.concatenate([rows for (rows, _), _ in parts]), np.concatenate([found + start for (_, found), start in parts])

    def _may_reach(self, at: slice, tile: dict, floor: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.metric in ("inner", "cosine"):
            found, off = self.scores(at, tile, extra)
            return _marked(found >= _down(floor - off - EPS * np.abs(floor)))
        most = np.maximum(1 - floor - extra.min(), 0)
        if self.metric == "manhattan":
            apart = self._steps_apart(at, tile)
            reach = 1 + self.norms[at] + tile["norm"]
            whole = np.floor((most + 1e-9 * reach) / self.step + self.rest[at] + tile["rest"] + 1e-3)
            rows, cols = _marked(apart <= np.minimum(whole, np.iinfo(apart.dtype).max).astype(apart.dtype)[:, None])
            near = self._apart32(at, tile, rows, cols) <= (most + self.eps * (most + np.sqrt(len(self.steps)) * reach))[rows]
            return rows[near], cols[near]
        found = self.x32[at] @ tile["y32"]
        found -= (tile["squares"] / 2).astype(np.float32)
        floor = (self.squares[at] - most**2) / 2
        return _marked(found >= _down(floor - self.eps * (self.norms[at] + tile["norm"]) ** 2))

    def _apart32(self, at: slice, tile: dict, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Distances by ``manhattan`` in float32."""
        x, y, out = self.x32[at], tile["y32"].T, np.empty(len(rows), np.float32)
        for i in range(0, len(rows), PAIRS):
            apart = x[rows[i : i + PAIRS]]
            apart -= y[cols[i : i + PAIRS]]
            out[i : i + PAIRS] = np.abs(apart, out=apart).sum(1)
        return out

    def _steps_apart(self, at: slice, tile: dict) -> np.ndarray:
        left, right = self.steps[:, at], tile["steps"]
        total = np.zeros((left.shape[1], right.shape[1]), np.uint32 if len(left) * STEPS >= 1 << 16 else np.uint16)
        if self.room is None or self.room.shape[2] != right.shape[1]:
            self.room = np.empty((8, 32, right.shape[1]), np.int8)
        for i in range(0, left.shape[1], 32):
            for k in range(0, len(left), 8):  # 8 * STEPS fit a byte
                some = left[k : k + 8, i : i + 32, None]
                apart = np.subtract(some, right[k : k + 8, None], out=self.room[: some.shape[0], : some.shape[1]])
                apart = np.abs(apart, out=apart).view(np.uint8)
                while len(apart) > 1:
                    half = len(apart) // 2
                    apart[:half] += apart[-half:]
                    apart = apart[: len(apart) - half]
                total[i : i + 32] += apart[0]
        return total


def _all_differ(whole: np.ndarray) -> bool:
    marks = np.random.default_rng(0).integers(1 << 62, size=whole.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return len(np.unique((np.ascontiguousarray(whole).view(np.uint64) * marks).sum(1, dtype=np.uint64))) == len(whole)


def distinct(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first row, by id, of each group of equal ones is, and each row's place among those."""
    if _all_differ(v):
        return np.arange(len(ids)), np.arange(len(ids))
    _, group = np.unique(v, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    return order[np.flatnonzero(np.diff(group[order], prepend=-1))], group


def first_copies(ids: np.ndarray, y: np.ndarray, bias: np.ndarray, most: int) -> np.ndarray:
    """The rows of a batch but those that are preceded, by id, by ``most`` equal ones."""
    whole = np.column_stack([y, bias])
    if _all_differ(whole):
        return np.arange(len(ids))
    _, group = np.unique(whole, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    nth = np.arange(len(ids)) - np.searchsorted(group[order], group[order])
    return order[nth < most]


def _row_tiles(n: int, width: int, scores: int = TILE_SCORES) -> Iterator[slice]:
    step = max(1, scores // max(1, width))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def _parts(tile: dict) -> Iterator[tuple[slice, dict]]:
    """A tile's right rows, PART_COLS at a time."""
    for start in range(0, len(tile["y"]), PART_COLS):
        cols = slice(start, min(start + PART_COLS, len(tile["y"])))
        yield cols, tile | {"y": tile["y"][cols], "y32": tile["y32"][:, cols], "squares": tile["squares"][cols]}


def _marked(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few that are true, sought by eight at a time."""
    flat = marks.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    near = np.flatnonzero(flat[:whole].reshape(-1, 8)[words])
    found = np.concatenate([words[near >> 3] * 8 + (near & 7), whole + np.flatnonzero(flat[whole:])])
    return np.divmod(found, marks.shape[1])


class Nearest:
    """The ``k`` best right rows of each left row so far, by ``scale`` times the score less both biases, then by id.

    With ``others``, rows of the same id and those at a distance of 1e-9 or less don't count.
    """

    def __init__(self, ids, x, bias, k: int, metric: str, scale: float = 1.0, others: bool = False, tile_rows: int = TILE_ROWS):
        self.ids, self.bias, self.k, self.metric, self.scale, self.others = ids, bias, k, metric, scale, others
        self.tile_rows = min(tile_rows, TILE_ROWS)
        self.x = prepared(x, metric)
        self.bounds = Bounds(self.x, metric)
        self.best, self.best_ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.met = 0

    def add(self, ids, y, bias) -> None:
        kept = first_copies(ids, y, bias, self.k + self.others)
        ids, y, bias = ids[kept], prepared(y[kept], self.metric), bias[kept]
        at, pending, waiting = 0, [], 0
        while at < len(ids):
            rough = bool(np.isneginf(self.best[:, -1]).any())
            upto = at + min(self.tile_rows, FIRST_ROWS if rough else max(FIRST_ROWS, self.met))
            cols = slice(at, upto)
            for rows, found in self._candidates(y[cols], ids[cols], bias[cols] / self.scale, rough):
                scores = self.scale * settled(self.x, y[cols], rows, found, self.metric) - self.bias[rows] - bias[cols][found]
                keep = scores >= self.best[rows, -1]
                if self.others:
                    keep &= (1 - scores > 1e-9) & (self.ids[rows] != ids[cols][found])
                pending.append((rows[keep], ids[cols][found[keep]], scores[keep]))
                waiting += len(pending[-1][0])
                if waiting > PENDING:
                    pending, waiting = self._merge(pending), 0
            if self.met < TILE_ROWS:
                pending, waiting = self._merge(pending), 0
            self.met += min(upto, len(ids)) - at
            at = upto
        self._merge(pending)

    def _candidates(self, y, ids, extra, rough: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        tile = self.bounds.tile(y)
        # Tiles for a first floor are small, and steps of ``manhattan`` are bytes: both are looked at whole.
        whole = rough or self.metric == "manhattan"
        for at in _row_tiles(len(self.x), len(y)) if whole else _row_tiles(len(self.x), min(len(y), PART_COLS), PART_SCORES):
            floor = (self.best[at, -1] + self.bias[at]) / self.scale
            if rough:
                scores, off = self.bounds.scores(at, tile, extra)
                sure = np.where((scores < 1 - 2e-5) & (self.ids[at, None] != ids[None]), scores, -np.inf) if self.others else scores
                if self.k <= len(y):
                    floor = np.maximum(floor, np.partition(sure, len(y) - self.k, axis=1)[:, len(y) - self.k] - off)
                rows, cols = _marked(scores >= (floor - off - EPS * np.abs(np.where(np.isfinite(floor), floor, 0)))[:, None])
            else:
                rows, cols = self.bounds.may_reach(at, tile, floor, extra)
            yield rows + at.start, cols

    def _merge(self, pending: list) -> list:
        rows, ids, scores = (np.concatenate(c) for c in zip(*pending, strict=True)) if pending else ([], [], [])
        if len(rows):
            met = np.unique(rows)
            rows = np.concatenate([np.repeat(met, self.k), rows])
            scores, ids = np.concatenate([self.best[met].ravel(), scores]), np.concatenate([self.best_ids[met].ravel(), ids])
            order = np.lexsort((ids, -scores, rows))
            taken = order[np.searchsorted(rows[order], met)[:, None] + np.arange(self.k)]
            self.best[met], self.best_ids[met] = scores[taken], ids[taken]
        return []

    def result(self) -> tuple[np.ndarray, ...]:
        """Left id, right id, score and rank, row by row."""
        rows, nth = np.nonzero(self.best > -np.inf)
        return self.ids[rows], self.best_ids[rows, nth], self.best[rows, nth], nth + 1


class Mutual:
    """Each left row's best right row so far and each right row's best left row, by ``inner`` or ``cosine`` and then by id, from
    the same products. Rows with a component that is not finite take no part."""

    def __init__(self, ids, x, metric: str, tile_rows: int = TILE_ROWS):
        sound = np.isfinite(x).all(1)
        self.given, x = ids[sound], x[sound]
        first, self.place = distinct(self.given, x)
        self.ids, self.x, self.metric, self.tile_rows = self.given[first], prepared(x[first], metric), metric, min(tile_rows, TILE_ROWS)
        self.bounds = Bounds(self.x, metric)
        self.best, self.best_ids = np.full(len(first), -np.inf), np.full(len(first), np.iinfo(np.int64).max)
        self.back = []

    def add(self, ids, y, bias=None) -> None:
        sound = np.isfinite(y).all(1)
        ids, y = ids[sound], y[sound]
        first, place = distinct(ids, y)
        firsts, y = ids[first], prepared(y[first], self.metric)
        best, best_ids = np.full(len(first), -np.inf), np.full(len(first), np.iinfo(np.int64).max)
        for at in range(0, len(first), self.tile_rows):
            cols = slice(at, at + self.tile_rows)
            self._meet(firsts[cols], y[cols], best[cols], best_ids[cols])
        self.back.append((best_ids[place], ids, best[place]))

    def _meet(self, ids, y, best, best_ids) -> None:
        tile, none = self.bounds.tile(y), np.zeros(len(y))
        for at in _row_tiles(len(self.x), len(y)):
            found, off = self.bounds.scores(at, tile, none)
            off = 2 * off.max()
            # Only rows and columns whose greatest product may pass their best are looked at pair by pair.
            top = found.max(1)
            hot = np.flatnonzero(top >= self.best[at] - off)
            rows, cols = _marked(found[hot] >= _down(np.maximum(top[hot], self.best[at][hot]) - off))
            rows = hot[rows]
            _lift(self.best[at], self.best_ids[at], rows, ids[cols], settled(self.x[at], y, rows, cols, self.metric))
            top = found.max(0)
            hot = np.flatnonzero(top >= best - off)
            rows, cols = _marked(found[:, hot] >= _down(np.maximum(top[hot], best[hot]) - off).T)
            cols = hot[cols]
            _lift(best, best_ids, cols, self.ids[at][rows], settled(self.x[at], y, rows, cols, self.metric))

    def result(self) -> tuple[np.ndarray, ...]:
        """Left id, right id, score, and whether the left row is the right row's best, not the other way round."""
        parts = [(self.given, self.best_ids[self.place], self.best[self.place]), *self.back]
        one, two, scores = (np.concatenate(c) for c in zip(*parts, strict=True))
        there = scores > -np.inf
        return one[there], two[there], scores[there], (np.arange(len(one)) >= len(self.given))[there]


def _lift(best: np.ndarray, best_ids: np.ndarray, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Takes over, place by place, the best of new rows where it is better, or equal with a lower id."""
    order = np.lexsort((ids, -scores, at))
    order = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    at, ids, scores = at[order], ids[order], scores[order]
    better = (scores > best[at]) | ((scores == best[at]) & (ids < best_ids[at]))
    best[at[better]], best_ids[at[better]] = scores[better], ids[better]


class Better:
    """How many right rows so far are better than each left row's answer; ties within 1e-12 go by id if ``by_id``."""

    def __init__(self, x, golds, answers, answer_bias, metric: str, scale: float, by_id: bool, tile_rows: int = TILE_ROWS):
        self.golds, self.metric, self.scale, self.by_id = golds, metric, scale, by_id
        self.x, self.tile_rows, self.near = prepared(x, metric), min(tile_rows, TILE_ROWS), 1e-12 / scale
        self.own = settled(self.x, prepared(answers, metric), np.arange(len(x)), np.arange(len(x)), metric) - answer_bias / scale
        self.bounds, self.n = Bounds(self.x, metric), np.zeros(len(x), np.int64)

    def add(self, ids, y, bias) -> None:
        y = prepared(y, self.metric)
        for first in range(0, len(ids), self.tile_rows):
            cols = slice(first, first + self.tile_rows)
            tile, extra = self.bounds.tile(y[cols]), bias[cols] / self.scale
            for at in _row_tiles(len(self.x), min(len(extra), PART_COLS), PART_SCORES):
                for part_cols, part in _parts(tile):
                    self._count(at, part, ids[cols][part_cols], extra[part_cols])

    def _count(self, at: slice, tile: dict, ids: np.ndarray, extra: np.ndarray) -> None:
        scores, off = self.bounds.scores(at, tile, extra)
        own = self.own[at]
        off = off + self.near + EPS * np.abs(own)
        may, above = scores >= _down(own - off), (own + off).astype(scores.dtype)
        if np.count_nonzero(may) * 64 < may.size:  # few: each is looked at for itself
            rows, found = _marked(may)
            sure = scores[rows, found] > above[rows]
            self.n[at] += np.bincount(rows[sure], minlength=len(own))
            rows, found = rows[~sure], found[~sure]
        else:
            sure = scores > above[:, None]
            self.n[at] += np.count_nonzero(sure, axis=1)
            rows, found = _marked(sure ^ may)
        apart = settled(self.x[at], tile["y"], rows, found, self.metric) - extra[found] - own[rows]
        other, golds = ids[found], self.golds[at][rows]
        better = (apart > self.near) | ((np.abs(apart) <= self.near) & (other < golds)) if self.by_id else apart > self.near
        self.n[at] += np.bincount(rows[better & (other != golds)], minlength=len(own))
