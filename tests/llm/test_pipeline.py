"""The corpus pipeline, stage by stage, against brute force; and over tables that may break it."""

import pytest

import corpus_pipeline
from gridloom.llm import decontaminate, mixing, quality, sharding
from tests.llm import data
from tests.llm.test_operators import leaks, near_classes


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("pipeline"))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Documents before and after each stage."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect(), after.columns
        docs = after
    return out


def test_columns_stay(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    for name, (_, _, after) in list(stages.items())[:-1]:
        assert after == columns, name
    assert set(stages["shard"][2]) == set(columns) | {"shard", "virtual_slot", "map_version"}


def test_quality_drops_what_scores_low(spark, sf, stages):
    before, after, _ = stages["quality"]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = quality.score_texts([(r.text or "").encode() for r in before], *model)
    assert sorted(map(repr, after)) == sorted(repr(r) for r, s in zip(before, scores) if s >= quality.THRESHOLD)
    assert len(after) < len(before)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_dedup"]
    classes = near_classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({c for c in classes.values() if c is not None})


def test_leaks_are_cut(spark, sf, stages):
    before, after, _ = stages["decontaminate"]
    items = [("" if r.item_id is None else str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text is not None]
    found = list(leaks([(r.doc_id, r.text) for r in before], items))
    assert any(f[5] for f in found) and not any(f[5] for f in leaks([(r.doc_id, r.text) for r in after], items))
    clean = [repr(r) for r, f in zip(before, found) if not f[5]]
    assert sorted(clean) == sorted(repr(r) for r in after if repr(r) in set(clean))
    assert len(after) == sum(f[2] <= 0.5 * f[1] for f in found)


def test_mix_samples_by_probability(spark, stages):
    before, after, _ = stages["mix"]
    schema = "doc_id long, text string, lang string, source string"
    p = mixing.probabilities(spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source) for r in before], schema))
    kept = p.filter(mixing.chance(p.doc_id) < p.probability).count()
    assert len(after) == kept


def test_shards_are_even_where_sizes_allow(stages):
    before, after, _ = stages["shard"]
    assert sorted(map(repr, (r.doc_id for r in before))) == sorted(map(repr, (r.doc_id for r in after)))
    sizes = {}
    for r in after:
        sizes[r.shard] = sizes.get(r.shard, 0) + len((r.text or "").encode()) + 1
    assert max(sizes.values()) <= max(sum(sizes.values()) / corpus_pipeline.SHARDS * 1.5, max(len((r.text or "").encode()) for r in after) * 1.1) and sharding.SLOTS == 4096


def test_run_equals_the_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == len(stages["shard"][1])
    assert decontaminate.WINDOW == 10


def test_empty(spark, tmp_path_factory):
    assert corpus_pipeline.run(spark, data.write(spark, tmp_path_factory.mktemp("none"), empty=True)).collect() == []
