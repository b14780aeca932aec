import numpy as np
import pytest

import corpus_pipeline
from twinweave.llm import packing, pu_quality, source_mix
from twinweave.llm._common import bucket_of

from .test_exact_mix_secrets import lower
from .test_models import edit_distance
from .test_tokens_packing import ids_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables, thinned to texts short enough for a quadratic check."""
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2500")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages_are_the_agreed_ones():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "mix", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = pu_quality.train_quality(docs, labels, ~(bucket_of("doc_id") % 5 == 0))
    table = pu_quality._byte_classes()
    rows = docs.collect()
    good = [r for r in rows if model.scores(np.stack([pu_quality.text_features(r.text or "", table)]))[0] >= 0.3]
    best = {}
    for r in good:
        best[lower(r.text)] = max(r.doc_id, best.get(lower(r.text), -1))
    exact = sorted((r for r in good if best[lower(r.text)] == r.doc_id), key=lambda r: r.doc_id)
    words = {r.doc_id: (r.text or "").lower().split() for r in exact}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = words[i], words[j]
            longest = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.8 * longest and len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b)) and edit_distance(a, b) <= 0.2 * longest + 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    near = [r for r in exact if find(r.doc_id) == r.doc_id]
    mixed = source_mix.mix_copies(spark.createDataFrame(near, SCHEMA)).where("copies > 0").collect()
    copies = {r.doc_id: r.copies for r in mixed}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = sorted((r.doc_id, k, a, min(2048, n - a)) for r in near for n in [len(ids_of(tokenizer, r.text, 0))] for _ in range(copies.get(r.doc_id, 0)) for k, a in enumerate(range(0, n, 2048)))
    got = corpus_pipeline.run(spark, small).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_stages_on_odd_tables(spark, small, tmp_path):
    """Null and repeated ids, null texts, and extra columns named as the operators name their own; then no rows at all."""
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "pqrst"]
    rows = [(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (8, words[4]), (8, words[4]), (9, None), (None, None), (10, ""), (11, words[2] + " end")]
    extra = ["_copies", "_copy", "_gone", "_stay_id", "_digest", "_uid", "uid", "row_id"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, *range(len(extra))) for i, t in rows], SCHEMA + "".join(f", {c} int" for c in extra))
    stages = {}

    def stored(name, stage):
        def run(docs):
            path = f"file://{tmp_path}/{name}-{docs.count()}"
            stage(spark, docs, small).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        return run

    for name, stage in corpus_pipeline.STAGES:
        stages[name] = stored(name, stage)
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    assert texts(stages["quality"](docs)) <= texts(docs)
    exact = stages["exact dedup"](docs)
    assert texts(exact) == sorted([(0, words[0]), (0, words[1]), (7, words[2]), (7, words[3]), (8, words[4]), (10, ""), (11, words[2] + " end")])
    near = stages["near dedup"](exact)
    assert texts(near) == sorted([(0, words[0]), (0, words[1]), (7, words[2]), (7, words[3]), (8, words[4]), (10, "")])
    mixed = stages["mix"](near)
    assert near.columns == exact.columns == mixed.columns == docs.columns
    assert {t for _, t in texts(mixed)} <= {t for _, t in texts(near)}
    packed = stages["pack"](docs).collect()
    assert len(packed) == len(rows) and {r.offset for r in packed} >= {0}
    for name, stage in stages.items():
        assert stage(docs.where("false")).count() == 0, name


def test_other_results_outlive_the_pipeline(spark, small):
    """The pipeline deletes its own tables only, and leaves but the last of its stages' tables."""
    import os
    from pathlib import Path

    from twinweave.llm._common import release, shared_dir

    result = source_mix.mix_copies(spark.read.parquet(f"{small}/documents.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"), "twinweave")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, small)
    assert result.count() and rows.count()
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["pipeline-pack"]
    release(spark)
    assert not any(x.startswith("pipeline") for x in os.listdir(folder))
