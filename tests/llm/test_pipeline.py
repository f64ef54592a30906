import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from quern.llm.common import table, written

    frames = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], SF), "test-stage"))
    return frames


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for frame in stages[:-1]:
        assert frame.columns == stages[0].columns and frame.dtypes == stages[0].dtypes


def test_quality_stage_drops_what_it_scores_low(spark, stages):
    from quern.llm import quality
    from quern.llm.common import table

    scored = quality.score(stages[0], quality.train(stages[0], table(spark, SF, "labels"))).toPandas()
    assert {r.doc_id for r in stages[1].collect()} == set(scored[scored["predicted"] == 1]["doc_id"])


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    from tests.llm.test_near_copies import brute_kept

    rows = stages[2].collect()
    assert sorted(r.doc_id for r in stages[3].collect()) == brute_kept([(r.doc_id, r.text) for r in rows])


def test_mixing_stage_uses_every_document(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}


def test_encoding_stage_matches_library(stages):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    key = lambda i, t: (i, hashlib.sha256(",".join(map(str, library.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest())
    assert sorted((r.doc_id, r.ids_sha256) for r in stages[5].collect()) == sorted(key(r.doc_id, r.text) for r in stages[4].collect())


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).exceptAll(stages[5]).count() == 0


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "a", 0), (None, "one two three four five six", "en", None, 3), (7, "w " * 50_000, "en", "a", 9), (7, "w " * 50_000, "en", "a", 9)], schema)
    for docs in (odd.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * max(1, docs.count()), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from quern.llm.common import written

    held = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = held()
    out = written(spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).count(), "test-shuffled")
    until = time.time() + 10
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before and out.count() == 50_000


def test_stages_release_the_tables_their_results_do_not_need(spark):
    from quern.llm import line_dedup, near_copies
    from quern.llm.common import table
    from quern.sources import scratch

    docs = table(spark, SF, "documents")
    for stage, needed in ((line_dedup.dedup_lines, ["line-numbers"]), (near_copies.keep_one, ["near-copies-gone", "near-copies-rows"])):
        before = set(scratch._made)
        out = stage(docs)
        assert sorted(path.rsplit("/", 1)[1].rsplit("-", 1)[0] for made in scratch._made if made not in before for path in made[1:]) == needed
        assert 0 < out.count() <= docs.count()
