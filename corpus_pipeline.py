"""From raw documents to token ids: a pipeline of five corpus operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; all but
the last return the columns that it was given. `run` writes each stage's result to the
shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm import exact, language, mixing, near, pieces
from stockyard.llm.queries import piece_model, trains
from stockyard.operators.sizing import is_small
from stockyard.session import store

ORACLE_SQL = None


#: Names of columns that stages add and drop again.
_TEXT, _KEY, _ROW = "__text_sha256", "__row_key", "__row"
#: Keys of rows whose id is null or repeats begin here; doc_ids lie below.
_OWN_KEYS = 1 << 62


#: Rows of a batch that goes to Python.
_BATCH_ROWS = 1000
#: Distinct units that a worker remembers here, beside what the earlier stages have left of an executor's memory.
_REMEMBERED = 100_000


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in small batches from here on, so a task holds a few MB of them.

    This is set on the session, since results are computed after a stage has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= _BATCH_ROWS:
        spark.conf.set(name, str(_BATCH_ROWS))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of `docs` that `dropped`, with some of their columns, does not list; a short list goes to every task, a long one is shuffled."""
    names = dropped.columns
    listed = store(dropped.select(*[F.col(c).alias(f"dropped{k}") for k, c in enumerate(names)]).distinct(), "dropped")
    listed = F.broadcast(listed) if is_small(listed) else listed
    same = F.lit(True)
    for k, name in enumerate(names):
        same &= docs[name].eqNullSafe(listed[f"dropped{k}"])
    return docs.join(listed, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: those without text or without a letter, and those of which no trigram tells any languages apart.

    The model learns from the documents' own `lang`, with the folds of the query. A text whose two nearest codewords
    lie close together stays; the operator's `ambiguous` only flags it. Repeated rows, ids and nulls in other columns
    make no difference; very long texts count as others; an empty table gives an empty one.
    """
    _small_batches(spark)
    model = language.fit(docs.where(trains(5)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), language.identify(model, spark).alias("l"))
    chance = 1.0 / max(1, len(model.languages))
    named = (F.col("l.lang_pred") != language.UNKNOWN) & (F.col("l.score") > chance + 1e-6 if len(model.languages) > 1 else F.lit(True))
    return rows.where(named).select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z lower-cased, null as empty) the one with the largest id stays; of its repeated rows, one.

    Rows are told apart by id and text, so another text of the same id stays. A row without an id stays if no row
    with an id has its text. An empty table gives an empty one.
    """
    _small_batches(spark)
    keyed = docs.withColumn(_TEXT, F.sha2(exact.normalised().cast("binary"), 256))
    rows = store(exact.members(docs, keep="largest").withColumnRenamed("text_sha256", _TEXT), "exact-members")
    owns = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rest = _without(keyed, rows.where(~owns).select("doc_id", _TEXT))
    again = store(rows.where(owns & ~F.col("kept")).select(F.col(_TEXT).alias("again")).distinct(), "repeated-owners")
    if again.isEmpty():
        return rest.drop(_TEXT)
    single = rest.join(again, rest[_TEXT] == again["again"], "left_anti")
    first = rest.join(again, rest[_TEXT] == again["again"], "left_semi").dropDuplicates([_TEXT])
    return single.unionByName(first).drop(_TEXT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id: five words a shingle, similarity 0.8.

    Rows whose id is null or repeats get keys of their own above all ids, so their other texts are told apart and one
    row of each group stays. Rows without a word are in no group and all stay. An empty table gives an empty one.
    """
    _small_batches(spark)
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    ids = store(ids.select(F.col("doc_id").alias("again"), F.lit(True).alias("own")), "repeated-ids")
    if ids.isEmpty():
        return _without(docs, near.members(docs, width=5, percent=80).where("not kept").select("doc_id"))
    listed = F.broadcast(ids) if is_small(ids) else ids
    keyed = docs.withColumn(_ROW, F.monotonically_increasing_id())
    keyed = keyed.join(listed, keyed["doc_id"].eqNullSafe(listed["again"]), "left")
    key = F.when(listed["own"], keyed[_ROW] + _OWN_KEYS).otherwise(keyed["doc_id"].cast("long"))
    keyed = store(keyed.select(*[docs[c] for c in docs.columns], key.alias(_KEY)), "keyed-documents")
    dropped = near.members(keyed.select(F.col(_KEY).alias("doc_id"), "text"), width=5, percent=80).where("not kept")
    return _without(keyed, dropped.select(F.col("doc_id").alias(_KEY))).drop(_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by their target weights; a document stands in it once per copy drawn."""
    return mixing.mixed(docs).select("doc.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and whether decoding gives the text back."""
    _small_batches(spark)
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), pieces.encode(piece_model(), remembered=_REMEMBERED).alias("e"))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "e.ids",
        "e.n_tokens",
        "e.ids_sha256",
        "e.decoded_sha256",
        "e.agreed",
        (F.col("e.decoded") == F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
