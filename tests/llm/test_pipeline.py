import corpus_pipeline
from stockyard.llm.queries import trains

from .helpers import FOLDER, awkward, documents, lower, words
from .test_near import brute
from .test_mixing import water


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "tokenize"]


def test_each_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    named = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in named.collect()) == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    single = corpus_pipeline.exact_dedup(spark, named, FOLDER).collect()
    last = {}
    for r in named.collect():
        last[lower(r.text)] = max(r.doc_id, last.get(lower(r.text), -1))
    assert sorted(r.doc_id for r in single) == sorted(last.values())
    df = spark.createDataFrame(single, docs.schema)
    apart = corpus_pipeline.near_dedup(spark, df, FOLDER)
    assert sorted(r.doc_id for r in apart.collect()) == [i for i, _, _, kept in brute([(r.doc_id, r.text) for r in single], 5) if kept]
    mix = corpus_pipeline.mix_sources(spark, apart, FOLDER)
    sizes, got = {}, {}
    for r in apart.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in mix.collect():
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
    for source, target in water(sizes).items():
        assert target - 3500 <= got.get(source, 0) <= target + 1e-6
    assert named.columns == df.columns == apart.columns == mix.columns == docs.columns


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and all(r.agreed and r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_rows_without_letters_and_copies(spark):
    docs = awkward(spark)
    named = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in named.where("doc_id is not null").collect()) == [1, 2, 2, 6, 8, 9, 10]
    single = corpus_pipeline.exact_dedup(spark, named, FOLDER)
    assert sorted(r.doc_id for r in single.collect()) == [2, 8, 9, 10] and single.columns == docs.columns
    unowned = documents(spark, [(None, "Alone here", "en", "a"), (None, "alone here", "en", "a"), (4, "other", "en", "a")])
    assert corpus_pipeline.exact_dedup(spark, unowned, FOLDER).count() == 2
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), FOLDER).collect() == [], name


def test_other_texts_of_an_id_stay(spark):
    words = [f"w{k}" for k in range(60)]
    base, other = " ".join(words), " ".join(words[::-1])
    docs = documents(spark, [(5, "alpha beta", "en", "a"), (9, "Alpha beta", "en", "a"), (5, "gamma delta", "en", "a"), (9, "Alpha beta", "en", "a")])
    got = corpus_pipeline.exact_dedup(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(5, "gamma delta"), (9, "Alpha beta")]
    rows = [(8, base + " end", "en", "a"), (8, other, "en", "a"), (3, base, "en", "a"), (None, other + " x", "en", "a"), (None, "short", "en", "a")]
    rows += [(4, "", "en", "a"), (4, None, "en", "a"), (7, "very own words are here", "en", "a"), (7, "very own words are here", "en", "a")]
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows), FOLDER).collect()
    assert len(got) == 6 and {r.text for r in got if r.doc_id == 3} == {base}
    assert sorted(r.text or "" for r in got if r.doc_id != 3)[:2] == ["", ""]
    assert sum(r.text in (other, other + " x") for r in got) == 1 and sum(r.doc_id == 7 for r in got) == 1


def test_training_folds(spark):
    assert spark.range(1000).withColumnRenamed("id", "doc_id").where(~trains(5)).count() > 100
