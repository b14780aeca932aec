"""Hard-negative mining by a full sort of each anchor's scores, in blocks.

Components are quantised to integers, so scores are exact and every block of rows gives the same ones. Rows and anchors
are dealt to blocks by hash; a task multiplies one block of rows with one block of anchors and, anchor by anchor, sorts
all scores by score and id (lexsort). A first pass keeps each anchor's best rows of its own label in the block; the best
of all blocks are its positives. A second pass sorts the same blocks again: a binary search finds the place of each
positive's upper limit, and the next rows of another label down to the lower limit are read from there. The best of all
blocks are the negatives. A block gives at most ``positives`` and ``positives * negatives`` rows an anchor, so no anchor's
scores ever meet in one place, whatever the size of the table or the share of a label.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinweave.llm._common import make_importable, materialise

#: Rows of a block: as many as give each of ROW_BLOCKS tasks work, within these bounds; and anchors of a block.
LEAST_ROWS, MOST_ROWS, ROW_BLOCKS, ANCHORS = 512, 1 << 15, 64, 4096
#: Scores that a task holds at a time.
SCORES = 1 << 21
SCALE = 256
#: Quantised components are held within these bounds, scores within those of a long.
MOST_COMPONENT, MOST_SCORE = 1 << 53, (1 << 63) - 1


def _quantised(vectors: pa.ChunkedArray):
    """Rows of floor(SCALE * x) as doubles, padded with zeros to the longest."""
    import numpy as np

    whole = vectors.combine_chunks()
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        with np.errstate(over="ignore"):
            flat = np.floor(SCALE * whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        return np.clip(flat, -MOST_COMPONENT, MOST_COMPONENT).reshape(len(sizes), -1)
    rows = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) for v in whole]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    with np.errstate(over="ignore"):
        for place, row in zip(out, rows, strict=True):
            place[: len(row)] = np.clip(np.floor(SCALE * row), -MOST_COMPONENT, MOST_COMPONENT)
    return out


def integer_scores(left, right):
    """Inner products of whole-numbered rows: exact, as int64."""
    import numpy as np

    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    most = width * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if most < 2.0**53:
        return (left @ right.T).astype(np.int64)
    if most < 2.0**62:
        return left.astype(np.int64) @ right.astype(np.int64).T
    big = [[sum(x * y for x, y in zip(a, b, strict=True)) for b in map(_integers, right)] for a in map(_integers, left)]
    return np.array([[max(-MOST_SCORE, min(MOST_SCORE, x)) for x in row] for row in big], dtype=np.int64).reshape(len(left), len(right))


def _integers(row) -> list[int]:
    return [int(x) for x in row]


def _sides(table: pa.Table):
    """Rows and anchors of a block, each sorted by id, then by number: the order that breaks ties."""
    import pyarrow.compute as pc

    table = table.sort_by([("id", "ascending"), ("uid", "ascending")])
    anchor = table.column("anchor")
    return table.filter(pc.invert(anchor)), table.filter(anchor)


def _sorted_scores(rows: pa.Table, anchors: pa.Table):
    """For each anchor: its place, its scores from high to low, and the rows that have them; ties by the rows' order."""
    import numpy as np

    right, at = _quantised(rows.column("vector")), np.arange(rows.num_rows)
    step = max(1, SCORES // max(1, rows.num_rows))
    for first in range(0, anchors.num_rows, step):
        scores = integer_scores(_quantised(anchors.column("vector").slice(first, step)), right)
        for place, own in enumerate(scores, first):
            order = np.lexsort((at, -own))
            yield place, own[order], order


def _best_positives(positives: int):
    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        rows, anchors = _sides(table)
        uid, label, ids = (rows.column(c).to_numpy() for c in ("uid", "label", "id"))
        own_uid, own_label = anchors.column("uid").to_numpy(), anchors.column("label").to_numpy()
        out: list[list] = [[], [], [], []]
        for place, scores, order in _sorted_scores(rows, anchors):
            same = np.flatnonzero((label[order] == own_label[place]) & (uid[order] != own_uid[place]))[:positives]
            for column, values in zip(out, (np.full(len(same), own_uid[place]), uid[order[same]], ids[order[same]], scores[same]), strict=True):
                column.append(values)
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for n, c in zip(("anchor_uid", "uid", "id", "score"), out, strict=True)})

    return run


def _best_negatives(negatives: int, low: int, high: int):
    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        rows, anchors = _sides(table)
        uid, label, ids = (rows.column(c).to_numpy() for c in ("uid", "label", "id"))
        own_uid, own_label, goals = anchors.column("uid").to_numpy(), anchors.column("label").to_numpy(), anchors.column("goals").to_pylist()
        out: list[list] = [[], [], [], [], []]
        for place, scores, order in _sorted_scores(rows, anchors):
            other = np.flatnonzero(label[order] != own_label[place])
            falling = -scores[other]
            for goal in goals[place]:
                # score <= floor(high * goal / 100) and score >= ceil(low * goal / 100), in whole numbers of any size
                upper, lower = high * goal["score"] // 100, -(-low * goal["score"] // 100)
                if upper < lower:
                    continue
                begin = int(np.searchsorted(falling, -upper, side="left"))
                taken = other[begin : begin + negatives]
                taken = taken[scores[taken] >= lower]
                for column, values in zip(out, (np.full(len(taken), own_uid[place]), np.full(len(taken), goal["uid"]), uid[order[taken]], ids[order[taken]], scores[taken]), strict=True):
                    column.append(values)
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for n, c in zip(("anchor_uid", "positive_uid", "uid", "id", "score"), out, strict=True)})

    return run


def _usable(vector: Column) -> Column:
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & real, F.lit(False))


def _met(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int) -> DataFrame:
    """Every block of rows beside every block of anchors, keyed by (row_block, anchor_block)."""
    row_blocks = max(1, -(-n // min(MOST_ROWS, max(LEAST_ROWS, n // ROW_BLOCKS))))
    anchor_blocks = max(1, -(-n_anchors // ANCHORS))
    goals = "array<struct<uid:long,score:long>>"
    deal = lambda blocks: F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.withColumn("anchor", F.lit(False)).withColumn("goals", F.lit(None).cast(goals)).withColumn("row_block", deal(row_blocks)).withColumn("anchor_block", every(anchor_blocks))
    right = anchors.withColumn("anchor", F.lit(True)).withColumn("anchor_block", deal(anchor_blocks)).withColumn("row_block", every(row_blocks))
    return left.unionByName(right).groupBy("row_block", "anchor_block")


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its positives: anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the columns of ``rows``. Scores are integer inner products of floor(256 * component).
    An anchor's positives are its first ``positives`` other rows of the same label; a positive's negatives are the first
    ``negatives`` rows of other labels with ``low`` % to ``high`` % of its score. Higher scores come first, ties by
    smaller id. Anchors without positives, and positives without such rows, give no row.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. A shorter vector counts
    as if zeros followed. Rows that repeat an id are rows of their own, as anchors too; among them ties are broken by a
    number of the stored row. Components beyond 2**53 after scaling are held there, scores at the ends of a long. Other
    columns are not read unless ``is_anchor`` does; an empty table gives an empty table.
    """
    make_importable(rows.sparkSession)
    known = rows.where(_usable(F.col(vector_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    known = materialise(known, "vectors")
    n, n_anchors = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_anchor"), 1))).first()
    rows, anchors = known.drop("is_anchor"), known.where("is_anchor").drop("is_anchor")
    goals = anchors.withColumn("goals", F.array().cast("array<struct<uid:long,score:long>>"))
    partial = _met(rows, goals, n, n_anchors).applyInArrow(_best_positives(positives), "anchor_uid long, uid long, id long, score long")
    best = W.partitionBy("anchor_uid").orderBy(F.desc("score"), "id", "uid")
    found = materialise(partial.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives), "positives")
    goals = found.groupBy("anchor_uid").agg(F.collect_list(F.struct("uid", "score")).alias("goals"))  # at most ``positives`` each
    anchors = anchors.join(goals.withColumnRenamed("anchor_uid", "uid"), "uid")
    partial = _met(rows, anchors, n, n_anchors).applyInArrow(_best_negatives(negatives, low, high), "anchor_uid long, positive_uid long, uid long, id long, score long")
    best = W.partitionBy("anchor_uid", "positive_uid").orderBy(F.desc("score"), "id", "uid")
    taken = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    taken = taken.select("anchor_uid", "positive_uid", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("anchor_uid", F.col("uid").alias("positive_uid"), F.col("id").alias("positive_id"), F.col("nth").alias("positive_rank"), F.col("score").alias("positive_score"))
    names = known.where("is_anchor").select(F.col("uid").alias("anchor_uid"), F.col("id").alias("anchor_id"))
    return taken.join(named, ["anchor_uid", "positive_uid"]).join(names, "anchor_uid").select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
