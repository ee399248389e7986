"""The pipeline's stages on a small table of files, one after the other."""

from collections import Counter

import pytest

import corpus_pipeline
from vantalog.llm import decontaminate, simhash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], sf_dir).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == columns for d in seen[:-1]) and seen[-1].columns == [*columns, "shard", "slot"]
    _, calm, lone, clean, mixed, sharded = ({(r.doc_id, r.text) for r in d.collect()} for d in seen)
    assert calm >= lone >= clean >= mixed == sharded
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(seen[1]).collect()}
    assert {d for d, _ in lone} == set(groups.values())
    hit = {r.doc_id for r in decontaminate.find(seen[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect() if r.spans}
    assert {d for d, _ in clean} == {d for d, _ in lone} - hit
    assert Counter(r.doc_id for r in seen[4].collect()) == Counter(r.doc_id for r in seen[5].collect())
    sizes = Counter(r.shard for r in seen[5].collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[5].count()
