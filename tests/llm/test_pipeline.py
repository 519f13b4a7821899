"""The pipeline's stages in a row over a small corpus, each judged on its own input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tripledger.llm import decontaminate, jaccard, toxicity
from tripledger.llm.common import stored
from tripledger.llm.jaccard import Likeness

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw, n):
    return " ".join(draw.choice(["the", "of", "and", "tion", "ing", "re"]) + str(draw.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Tables with toxic documents, copies, benchmark passages and personal data."""
    folder = tmp_path_factory.mktemp("tables")
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(240):
        text = prose(draw, draw.randrange(20, 90))
        if k % 6 == 0:
            text += f" zlurp{draw.choice('abcdef')} zlurp{draw.choice('abcdef')} zlurp{draw.choice('abcdef')}"
        rows.append((k, text))
        labels.append((k, 1, int(k % 6 == 0)))
    passage = prose(draw, 14)
    rows += [(300, rows[1][1]), (301, rows[1][1] + " end"), (302, f"before {passage} after"), (303, "write to a@b.example now"),
             (304, None), (305, ""), (None, prose(draw, 30))]
    docs = [(k, t, "en", "src0", len(t or "")) for k, t in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_in_turn(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "personal data", "best-fit packing"
    ]
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, docs = [{r.doc_id for r in start.collect()}], start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == start.columns, name
        kept.append({r.doc_id for r in docs.collect()})
    toxic = {k for k in range(0, 240, 6)}
    assert len(kept[1] & toxic) <= 2 and len((kept[0] - toxic) - kept[1]) <= 3
    # Of 1, 300 and 301 the first one left stays; nothing else goes.
    assert kept[1] - kept[2] == (kept[1] & {1, 300, 301}) - {min(kept[1] & {1, 300, 301})}
    assert kept[2] - kept[3] == {302} & kept[2]
    assert kept[4] == kept[3]
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert texts[303][0] == "write to [EMAIL] now" and texts[303][1] == len(texts[303][0])
    before = {r.doc_id: r.text for r in start.collect()}
    assert all(texts[k][0] == before[k] for k in texts if k != 303)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == kept[4]
    assert last.where("length * 4 <> octet_length(ids)").count() == 0


def test_run_gives_the_last_stage(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"} <= set(found.columns)
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_over_an_empty_table_and_clashing_columns(spark, sf_dir):
    names = ["score", "found", "row", "head", "spans", "spans_row", "ordered", "label", "token"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert toxicity.acceptable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0)).count() == docs.count()
    assert jaccard.first_of_each(docs.limit(5), Likeness()).columns == docs.columns
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.decontaminate(docs, items).where("score <> 'score' OR row <> 'row'").count() == 0
