"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import exact, language, mixing, near, neighbours, pages, periodic, pieces, ppm, private, spelling, tokenfiles, toxicity
from stockyard.llm.registry import QUERIES, SQL, fold, query, table
from stockyard.session import run_folder, store

__all__ = ["QUERIES", "SQL"]

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def word_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_MODEL)


def trains(folds: int):
    """Rows to learn from: all but fold 0; rows without an id are never held out."""
    return (fold(folds=folds) != 0) | fold(folds=folds).isNull()


def held_out(folds: int):
    return F.coalesce(fold(folds=folds) == 0, F.lit(False)).alias("held_out")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(trains(5)))
    scored = docs.select("doc_id", held_out(5), toxicity.score(model, spark).alias("t"))
    return scored.select(
        "doc_id",
        "held_out",
        "t.score",
        (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
        "t.similarity",
        "t.neighbours",
    )


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    encoded = docs.select("doc_id", pieces.encode(piece_model(), with_ids=False).alias("e"))
    return encoded.select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256", "e.agreed")


@query(
    "op3_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents)
    SELECT doc_id,
           max(doc_id) OVER g AS keep_id,
           count(*) OVER g AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           text_sha256
    FROM d
    WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.members(table(spark, folder, "documents"), keep="largest")


#: The query's key. A deployment passes its own secret.
EXAMPLE_KEY = b"an example key"


@query("op4_pseudonyms")
def op4_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hidden = docs.select("doc_id", private.pseudonymise(EXAMPLE_KEY).alias("p"))
    return hidden.select("doc_id", "p.text", "p.n_private", "p.kinds")


@query("op5_html_text")
def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model, words = ppm.fit(docs.where(trains(10)))
    scored = ppm.score(docs, model, words)
    return scored.select("doc_id", held_out(10), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_mixing")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    measured = mixing.measure(docs).select(F.struct(F.col("id").alias("doc_id")).alias("doc"), "id", "source", "size", "block")
    measured = store(measured, "mix-sizes")
    rows = mixing.assign(measured, mixing.plan(measured))
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        "shards",
    )


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.members(table(spark, folder, "documents"), width=4, percent=80)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(trains(5)))
    named = docs.select("doc_id", held_out(5), language.identify(model, spark).alias("l"))
    return named.select("doc_id", "held_out", "l.lang_pred", "l.score", "l.ambiguous", "l.runner_up")


@query("op11_token_files")
def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = run_folder(spark, "token-files")
    tokenfiles.write(table(spark, folder, "documents"), path, word_model(), end_id=2)
    return tokenfiles.read(spark, path, with_ids=False)


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(table(spark, folder, "documents"), min_length=6, min_count=5, damaged=199)
    return spelling.variants(words, ratio=5)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, folder, "documents"), rewrite=periodic.planted)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
