"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import re
import zlib

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def fold(doc_id, folds=5):
    return zlib.crc32(str(doc_id).encode()) % folds


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source); two columns have names that results use as well."""
    full = [(i, t, g, s, None if t is None else len(t), "x", None) for i, t, g, s in rows]
    return spark.createDataFrame(full, DOCUMENTS + ", score string, kept int").repartition(3)


def awkward(spark):
    long = " ".join(f"word{i} and more" for i in range(30_000))
    return documents(
        spark,
        [
            (1, "The cat sat on the mat", "en", "a"),
            (2, "the cat sat on the MAT", "en", "b"),
            (2, "the cat sat on the MAT", "en", "b"),
            (3, None, None, None),
            (4, "", "en", None),
            (5, "   \t\n ", "de", "a"),
            (6, long, "de", "b"),
            (7, "12345 !!! ???", "fr", "a"),
            (None, "The cat sat on the mat", "en", "a"),
            (8, "Ünïcödé ﬁ 😀 straße  ▁ zwei drei", "de", None),
            (9, "x", "es", "c"),
            (10, long, None, "b"),
        ],
    )
