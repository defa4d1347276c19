import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stockyard.llm import repair, tokenfiles
from stockyard.llm.queries import QUERIES, word_model
from stockyard.session import run_folder

from .helpers import FOLDER, awkward, documents

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(rows):
    """Rows of (doc_id, text), in order, to (doc_id, start, n_tokens, ids_crc32), by the library on whole texts."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(2, 5))
def test_grammar_gives_every_span_back(ids, least):
    ids = np.array(ids, np.int64)
    rules, symbols = repair.compress(ids, 4, least)
    assert (repair.expand(symbols, rules, 4) == ids).all()
    shard = repair.Shard(4, np.array([len(ids)]), rules, repair.lengths_of(rules, 4), symbols)
    back = repair.Shard.from_bytes(shard.to_bytes())
    rng = random.Random(len(ids))
    for _ in range(10):
        lo = rng.randint(0, len(ids))
        hi = rng.randint(lo, len(ids))
        assert (back.span(lo, hi) == ids[lo:hi]).all()


def test_no_frequent_pair_is_left():
    rng = random.Random(5)
    words = [[rng.randrange(50) for _ in range(rng.randint(1, 6))] for _ in range(40)]
    ids = np.array([x for _ in range(2000) for x in rng.choice(words)])
    rules, symbols = repair.compress(ids, 50, 8)
    left = {}
    for pair in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True):
        left[pair] = left.get(pair, 0) + 1
    assert max(n for (a, b), n in left.items() if a != b) < 8
    assert len(symbols) < 2100  # a symbol for each of the 2000 words, hardly more
    assert (repair.expand(symbols, rules, 50) == ids).all()
    long = repair.compress(np.zeros(100_000, np.int64), 1, 8)
    assert len(long[1]) < 20 and (repair.expand(long[1], long[0], 1) == 0).all()


def test_damaged_shards_are_refused():
    data = repair.Shard.of(np.arange(20), np.array([20])).to_bytes()
    for bad in (data[:-1], data + b"x", b"XXXX" + data[4:]):
        with pytest.raises(ValueError):
            repair.Shard.from_bytes(bad)


def test_query_equals_the_library(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = [tuple(r) for r in QUERIES["op11_token_files"](spark, FOLDER).orderBy("doc_id").collect()]
    assert got == expected([tuple(r) for r in rows])


def test_awkward_rows(spark):
    path = run_folder(spark, "token-files")
    docs = awkward(spark)
    tokenfiles.write(docs, path, word_model(), end_id=2, shard_ids=3000)
    got = tokenfiles.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected([(r.doc_id, texts[r.doc_id]) for r in got])
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in got)
    assert spark.read.parquet(path).count() > 1


def test_shards_hold_many_documents_and_are_fetched_by_id(spark):
    rng = random.Random(3)
    rows = [(i * 7, " ".join(rng.choice(["alpha", "beta's", "ΣΊΣΥΦΟΣ", "x<|endoftext|>y", "7,5%", "ét z"]) for _ in range(40)), None, None) for i in range(300)]
    path = run_folder(spark, "token-files")
    tokenfiles.write(documents(spark, rows), path, word_model(), end_id=2, shard_ids=2000)
    shards = spark.read.parquet(path).collect()
    assert len(shards) > 5 and max(r.n_docs for r in shards) > 5
    all_rows = expected([r[:2] for r in rows])
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read(spark, path, with_ids=False).collect())
    assert got == all_rows
    some = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.fetch(spark, path, [0, 14, 700, 2093, 1]).collect())
    assert some == [r for r in all_rows if r[0] in (0, 14, 700, 2093)]


def test_empty_table_and_other_tokenizers(spark):
    path = run_folder(spark, "token-files")
    tokenfiles.write(documents(spark, []), path, word_model(), end_id=2)
    assert tokenfiles.read(spark, path).collect() == []
    whole = public_tokenizers.path("byte_bpe_50k.json")  # its tokens begin with white space
    assert not tokenfiles.by_units(whole) and tokenfiles.by_units(word_model())
    path = run_folder(spark, "token-files")
    tokenfiles.write(documents(spark, [(1, "two  words\n", None, None)]), path, whole, end_id=2)
    ids = Tokenizer.from_file(whole).encode("two  words\n", add_special_tokens=False).ids
    assert tokenfiles.read(spark, path).first().ids == [*ids, 2]
