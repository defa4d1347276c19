import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stockyard.llm import mixing
from stockyard.llm.queries import QUERIES

from .helpers import FOLDER, awkward, documents, words


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def taken(docs, settings=mixing.Settings()):
    measured = mixing.measure(docs, settings)
    rows = mixing.assign(measured, mixing.plan(measured, settings))
    return rows.select("id", "source", "size", "source_size", "target", "shards").collect()


def made(spark, counts, seed=0):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))), "en", source))
            i += 1
    return documents(spark, rows)


def check(docs, near=None):
    rows = taken(docs)
    given = [(r.doc_id, r.source, len(words(r.text))) for r in docs.collect()]
    assert Counter((r.id, r.source, r.size) for r in rows) == Counter(given)
    sizes = defaultdict(int)
    for _, source, size in given:
        sizes[source] += size
    wanted, got = water(dict(sizes)), defaultdict(int)
    for r in rows:
        assert len(r.shards) <= 2 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        got[r.source] += r.size * len(r.shards)
    for source, target in wanted.items():
        assert got[source] <= target + 1e-6
        if near is not None:
            assert target - got[source] <= near
    return rows


@pytest.mark.parametrize("counts", [{"a": 400, "b": 30, "c": 50, "d": 40}, {"z": 3, "y": 300, None: 200, "é": 90, "Z": 20}])
def test_targets_are_met(spark, counts):
    check(made(spark, counts), near=60)


def test_reruns_agree(spark):
    docs = made(spark, {"a": 200, "b": 60, None: 40})
    first = {(r.id, tuple(r.shards)) for r in taken(docs)}
    assert first == {(r.id, tuple(r.shards)) for r in taken(docs.repartition(7, "text"))}


def test_shards_get_equal_blocks_and_each_copy_once(spark):
    docs = made(spark, {"a": 600, "b": 300, "c": 300})
    settings = mixing.Settings(blocks=16, levels=2)
    blocks = mixing.plan(mixing.measure(docs, settings), settings).blocks.collect()
    per_shard = Counter(s for r in blocks for s in r.shards)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) == 4
    for r in blocks:
        assert len(r.shards) == r.passes + (r.extra or r.partial)
    mix = mixing.mixed(docs, settings)
    copies = mix.groupBy("doc.doc_id", "copy").count()
    assert copies.where("count > 1").isEmpty()


def test_awkward_rows(spark):
    rows = check(awkward(spark).where("doc_id is not null"))
    assert {r.size for r in rows if r.id in (3, 4, 5)} == {0}
    assert len(taken(awkward(spark))) == 12
    assert taken(awkward(spark).where("false")) == []
    assert taken(awkward(spark).where("doc_id in (3, 4, 5)"))[0].target == 0


def test_mix_keeps_columns(spark):
    mix = mixing.mixed(awkward(spark))
    assert mix.columns == ["doc", "copy", "shard", "position"]
    assert mix.select("doc.*").columns == awkward(spark).columns


def test_written_shards(spark, tmp_path):
    mix = mixing.mixed(made(spark, {"a": 50, "b": 50}))
    mixing.write_shards(mix, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mix.count()


def test_no_python_in_the_plan(spark):
    df = QUERIES["op8_mixing"](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.where(F.col("taken") > 2 * F.col("size")).isEmpty()
