import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from stockyard.llm import pieces
from stockyard.llm.queries import QUERIES, piece_model

from .helpers import FOLDER, awkward


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(piece_model())


def both(vocabulary, text):
    ids, n, sha, decoded, decoded_sha, agreed = next(vocabulary.encode_batch([text], True))
    wanted = vocabulary.library.encode(text or "")
    assert ids == wanted and n == len(wanted) and agreed
    assert sha == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
    assert decoded == vocabulary.library.decode(wanted) == vocabulary.decode(wanted)
    assert decoded_sha == hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text_as_the_library(vocabulary, text):
    both(vocabulary, text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list(" \n\t▁aeinrst<>s/éß😀\x00_.")), max_size=60))
def test_spaces_as_the_library(vocabulary, text):
    both(vocabulary, text)


def test_long_and_special(vocabulary):
    for text in (None, "", " ", "a" * 5000, "ab" * 3000, " " * 999, "▁" * 40, "<s>x</s><unk><0x0A>", "straße\n\nzwei  drei"):
        both(vocabulary, text)


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    own = pieces.Pieces(piece_model())
    for n in range(30):
        both(own, f"some words {n} more {n * n} words and a{'b' * 60}")
        assert len(own.known) <= 40


def test_whole_texts(spark, vocabulary):
    got = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = vocabulary.library.encode(row.text or "")
        assert got[row.doc_id].agreed and got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_awkward_rows(spark, vocabulary):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text", pieces.encode(piece_model()).alias("e")).collect()
    assert len(rows) == 12
    for row in rows:
        assert row.e.ids == vocabulary.library.encode(row.text or "") and row.e.agreed
        assert row.e.decoded == vocabulary.library.decode(row.e.ids)
    assert docs.where("false").select(pieces.encode(piece_model()).alias("e")).collect() == []


def test_slices_bound_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE_ROWS", 3)
    monkeypatch.setattr(pieces, "SLICE_BYTES", 10)
    texts = pa.array(["a" * 4, "b" * 4, "c" * 4, None, "", "", "", "d" * 50, "é" * 6, "e"])
    parts = [part.to_pylist() for part in pieces.slices(texts)]
    assert [t for part in parts for t in part] == texts.to_pylist()
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10) for p in parts)
    assert list(pieces.slices(texts.slice(0, 0))) == []


def test_pipeline_remembers_fewer_units_with_the_same_ids(spark, vocabulary, monkeypatch):
    asked = []
    encode = pieces.encode
    monkeypatch.setattr(pieces, "encode", lambda *a, **named: asked.append(named.get("remembered")) or encode(*a, **named))
    docs = awkward(spark)
    rows = corpus_pipeline.tokenize(spark, docs, FOLDER).collect()
    assert 0 < asked[0] <= pieces.REMEMBERED // 4
    texts = sorted(r.text or "" for r in docs.collect())
    assert sorted(r.ids for r in rows) == sorted(vocabulary.library.encode(t) for t in texts)
    few = docs.select("text", encode(piece_model(), remembered=5).alias("e")).collect()
    assert all(r.e.ids == vocabulary.library.encode(r.text or "") and r.e.agreed for r in few)


def test_a_merge_looks_up_only_the_pairs_beside_it(vocabulary):
    """All pairs of a unit are looked up once, then two for each merge."""
    own = pieces.Pieces(piece_model())
    asked, find = [], own.pairs.find
    own.pairs.find = lambda keys: asked.append(len(keys)) or find(keys)
    units = ["▁considerations", "▁zqxj", "straße", "▁" * 9, "日本語", "a", "▁international"]
    joined, odd = own.merge_all(units)
    assert joined == [",".join(map(str, vocabulary.merge(u))) for u in units] and odd == {}
    symbols = sum(map(len, units))
    assert sum(asked) <= (symbols - len(units)) + 2 * (symbols - sum(j.count(",") + 1 for j in joined if j))
