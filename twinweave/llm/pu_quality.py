"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; unlabelled text is any training document. The class prior of the
unlabelled text is estimated by the best-bin bound: over thresholds of a cross-fitted positive-versus-unlabelled
classifier, the least ratio of the unlabelled to the positive share above it. A logistic model over text statistics then minimises the
non-negative unbiased risk, so its sigmoid is the probability of a good text. Fitting uses bounded, hash-chosen samples;
scoring reads every whole text.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import bucket_of, make_importable, text_or_empty

MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
BINS = 8
#: Byte classes whose shares are features: each string's bytes, then lower, upper, digit, non-ASCII, other.
CLASSES = (" ", "\n", ".", ",", "!", "?", "|", "*#%&$@", "_-=+~^", "\"'`", "()[]{}<>", ":;/\\")


def _byte_classes():
    import numpy as np

    table = np.full(256, len(CLASSES) + 4, np.uint8)
    for i, chars in enumerate(CLASSES):
        table[np.frombuffer(chars.encode(), np.uint8)] = i
    for i, span in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256))):
        table[list(span)] = len(CLASSES) + i
    return table


N_CLASSES = len(CLASSES) + 5
N_FEATURES = N_CLASSES + 7


def text_features(text: str, table):
    """Byte-class shares, then word and line statistics of the whole text."""
    import numpy as np

    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(N_FEATURES, np.float32)
    if len(data):
        out[:N_CLASSES] = np.bincount(table[data], minlength=N_CLASSES) / len(data)
    words = text.split()
    lines = text.split("\n")
    n = len(words)
    if n:
        same = sum(map(operator.eq, words, words[1:]))
        distinct = len(set(words))
        out[N_CLASSES:] = (np.log1p(n), len(text) / n, same / n, distinct / n, np.log1p(distinct) / np.log1p(n), 1 - len(set(lines)) / len(lines), n / len(lines) / 100)
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _byte_classes()
    for batch in batches:
        rows = [text_features(t.as_py(), table).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "x"])


@dataclass(frozen=True)
class PuModel:
    edges: object  # features x bins - 1
    weights: object
    bias: float
    prior: float

    def scores(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(binned(x, self.edges) @ self.weights + self.bias, -30, 30)))


def binned(x, edges):
    """Cumulative indicators: one for each edge that a feature passes."""
    return (x[:, :, None] > edges[None, :, :]).reshape(len(x), -1).astype("float32")


def _descend(positive, unlabelled, prior: float | None, steps: int = 300, rate: float = 0.05, decay: float = 1e-3):
    """Adam on the logistic risk; with a prior, on the non-negative risk of positives and unlabelled rows."""
    import numpy as np

    w, b = np.zeros(positive.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)

    def slope(x, d):
        return np.append(x.T @ d, d.sum()) / len(x)

    for step in range(1, steps + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        if prior is None:
            grad = slope(positive, sigmoid(zp) - 1) + slope(unlabelled, sigmoid(zu))
        else:
            negative = loss(-zu).mean() - prior * loss(-zp).mean()
            rest = slope(unlabelled, sigmoid(zu)) - prior * slope(positive, sigmoid(zp))
            # Below zero the negative part is overfitted: step back along it instead.
            grad = prior * slope(positive, sigmoid(zp) - 1) + rest if negative >= 0 else -rest
        grad = (grad + decay * np.append(w, 0)).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        w, b = w - move[:-1], b - move[-1]
    return w, b


#: The best-bin ratio bounds the prior from above; the risk takes this share of it, since too high a prior calls junk good.
PRIOR_SHARE = 0.85


def estimate_prior(positive_scores, unlabelled_scores) -> float:
    """Least ratio of the unlabelled to the positive share above a threshold: an upper bound of the class prior."""
    import numpy as np

    ratios = [(unlabelled_scores >= t).mean() / (positive_scores >= t).mean() for t in np.quantile(positive_scores, np.linspace(0, 0.9, 46))]
    return float(min(max(min(ratios), 0.05), 0.99))


def _cross_scores(positive, unlabelled):
    """Scores of a positive-versus-unlabelled classifier, each half of the rows by the model of the other half."""
    import numpy as np

    out = [np.zeros(len(positive)), np.zeros(len(unlabelled))]
    halves = [np.arange(len(x)) % 2 for x in (positive, unlabelled)]
    for k in (0, 1):
        parts = [x[h != k] if (h != k).any() else x for x, h in zip((positive, unlabelled), halves, strict=True)]
        w, b = _descend(*parts, None, steps=150)
        for scores, x, h in zip(out, (positive, unlabelled), halves, strict=True):
            scores[h == k] = x[h == k] @ w + b
    return out


def fit_pu(positive, unlabelled) -> PuModel:
    """``positive`` and ``unlabelled``: feature rows."""
    import numpy as np

    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    tails = np.quantile(both, [0.005, 0.02, 0.98, 0.995], axis=0).T
    edges = np.sort(np.concatenate([edges, tails], axis=1), axis=1)
    p, u = binned(positive, edges), binned(unlabelled, edges)
    prior = PRIOR_SHARE * estimate_prior(*_cross_scores(p, u))
    w, b = _descend(p, u, prior)
    return PuModel(edges, w, float(b), prior)


def _first_ids(rows: DataFrame, most: int) -> list[int]:
    return [r[0] for r in rows.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> PuModel | None:
    """Fit on at most ``max_positive`` labelled and ``max_unlabelled`` other training rows; None without positives."""
    import numpy as np

    make_importable(docs.sparkSession)
    ids = set(_first_ids(labels.where((F.col("quality") == 1) & train), max_positive))
    other = set(_first_ids(docs.where(train), max_unlabelled))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).where(F.col("doc_id").isin(sorted(ids | other)))
    # One row an id, so that what reaches the driver stays bounded where ids repeat.
    each = rows.mapInArrow(_feature_rows, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))
    found = sorted((r.doc_id, bytes(r.x)) for r in each.collect())
    positive = [np.frombuffer(x, np.float32) for i, x in found if i in ids]
    unlabelled = [np.frombuffer(x, np.float32) for i, x in found if i in other]
    return fit_pu(np.stack(positive), np.stack(unlabelled)) if positive and unlabelled else None


def _score(model: PuModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = _byte_classes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                x = np.stack([text_features(t.as_py(), table) for t in rows.column(rows.num_columns - 1)])
                score = model.scores(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(score.astype(np.float64))], [*rows.schema.names[:-1], "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3, **limits: int) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null texts count as empty; empty texts are scored by their statistics, all 0; texts are read whole, however long. Without positives every score is 0.5.
    Labels that are null are not used; ids with several labels count as good if one of them is. Repeated rows and ids are
    scored each for itself; other columns are not read; an empty table gives an empty table.
    """
    held_out = bucket_of("doc_id") % 5 == 0 if held_out is None else held_out
    model = train_quality(docs, labels, ~held_out, **limits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty("text").alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: PuModel | None, column: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = _byte_classes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                x = np.stack([text_features(t.as_py() or "", table) for t in rows.column(column)])
                yield rows.filter(pa.array(model.scores(x) >= threshold)) if model else rows

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3, **limits: int) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; only the training sample is shuffled.

    Null texts count as empty; each row is judged for itself, whatever its id; without positives all rows stay.
    """
    held_out = bucket_of("doc_id") % 5 == 0 if held_out is None else held_out
    model = train_quality(docs, labels, ~held_out, **limits)
    return docs.mapInArrow(_keep(model, docs.columns.index("text"), threshold), docs.schema)
