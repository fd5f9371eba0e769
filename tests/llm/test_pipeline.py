"""The pipeline's stages on a small table, each against the plain operators."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from tests.llm.conftest import prose
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_minhash import brute as classes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(21)
    at = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(r, 30)) for i in range(5)]
    rows = []
    for i in range(160):
        text, grade = prose(r, r.randint(30, 120)), 1
        if i % 4 == 0:
            text, grade = " ".join(f"{w}%%%" for w in text.split(" ")), 0
        elif i % 9 == 1:
            text = next((t for _, t, g in rows if g), text)
        elif i % 9 == 2:
            text += " " + items[i % 5][1]
        elif i % 9 == 3 and len(rows) > 3:
            text, grade = rows[-1][1].rsplit(" ", 1)[0], rows[-1][2]
        rows.append((i, text, grade))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], COLUMNS).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, _, g in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", rows, items


def test_stages(spark, table, tmp_path):
    at, rows, items = table
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        seen[name] = ([tuple(r)[:2] for r in before.collect()], docs)
    good = {i for i, _, g in rows if g}
    ids = lambda name: {r["doc_id"] for r in seen[name][1].collect()}
    assert ids("quality") == good
    last = {}
    for i, t in seen["exact"][0]:
        last[t] = max(last.get(t, i), i)
    assert ids("exact") == set(last.values())
    assert ids("near") == set(classes(seen["near"][0]).values())
    assert ids("decontamination") == {r[0] for r in contaminated(seen["decontamination"][0], items) if not r[4]}
    assert ids("packing") == ids("decontamination")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, at).collect()} == ids("packing")


def test_empty_table(spark, table, tmp_path):
    at, *_ = table
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        assert docs.collect() == []
        docs = spark.createDataFrame([], docs.schema)
