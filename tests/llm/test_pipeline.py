import corpus_pipeline
from pyspark.sql import functions as F

from monthloom.llm.queries import ORACLE, QUERIES
from monthloom.sources.store import cut_lineage


def test_stages_on_documents(spark, sf_dir, small):
    docs, counts = small, [small.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == small.columns
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[4]
    run = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "n_tokens", F.hash("ids").alias("h")]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, last.select(*key).collect()))


def test_stages_on_odd_tables(spark, sf_dir, odd, none, clashing):
    for start in (odd, none, clashing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, sf_dir), f"test-odd-{name}")
        docs.collect()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
