from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.mixing import mix, schedule
from graphloom.llm.topk import top_k


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {str(i): (i + 1) ** 1.5 for i in range(12)}, {"a": 2**0.5, "b": 3.14159, "c": 1e-3}])
def test_never_a_whole_block_off(weights):
    """By the slots themselves, up to where the first source runs out, at a length a period of shares would not fit."""
    total, n_blocks = sum(weights.values()), 200_000
    rows = {s: int(n_blocks * w / total) + 2 for s, w in weights.items()}
    taken = dict.fromkeys(weights, 0)
    for t, (s, block, slot, _) in enumerate(islice(schedule(rows, weights, 1), n_blocks), 1):
        assert (block, slot) == (taken[s], t - 1)
        taken[s] += 1
        if t % 101 == 0 or t > n_blocks - 100:
            assert all(abs(n - weights[x] * t / total) < 1 + 1e-6 for x, n in taken.items())


def test_all_rows_in_gapless_order(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", None) for i in range(5000)] + [(None, None, None), (7, "hot", None), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, count string")
    out = mix(df, block_rows=16).collect()
    assert sorted(r.mix_position for r in out) == list(range(len(rows)))
    assert sorted(((r.doc_id, r.source) for r in out), key=repr) == sorted(((a, b) for a, b, _ in rows), key=repr)
    blocks = {}
    for r in out:
        blocks.setdefault((r.mix_source, r.mix_block), []).append(r.mix_position)
    assert all(max(p) - min(p) == len(p) - 1 <= 15 for p in blocks.values())
    assert mix(df.limit(0)).count() == 0
    assert mix(df, {"hot": 3, "s0": 1}).count() == len(rows)
    names = ("share", "slots", "at", "hash", "bucket", "buckets", "before", "nth", "start", "row", "key", "mix_row", "mix_slot", "mix_block")
    clash = mix(df.selectExpr("doc_id", "source", *(f"'mine' as {n}" for n in names)), block_rows=16)
    assert len(set(clash.columns)) == len(clash.columns)
    assert {r.share + r.at + r.start for r in clash.collect()} == {"mine" * 3} and clash.filter("mix_slot = 0").count() == 16


@pytest.mark.parametrize("weights", [{"a": 0.9, **{f"b{i}": 0.0111 for i in range(9)}}, {"hot": 1500.0, **{f"s{i:04}": 0.5 + i % 3 for i in range(1200)}}])
def test_order_follows_the_given_weights(spark, weights):
    total, n_blocks = sum(weights.values()), 30_000
    blocks = {s: int(n_blocks * w / total) + 2 for s, w in weights.items()}
    rows = spark.createDataFrame(list(blocks.items()), "source string, n long").selectExpr("source", "explode(sequence(1, n)) as doc_id")
    order = [r.source for r in mix(rows, weights, block_rows=1).orderBy("mix_position").select("source").collect()]
    assert len(order) == sum(blocks.values())
    taken = dict.fromkeys(weights, 0)
    for t, s in enumerate(order[:n_blocks], 1):
        taken[s] += 1
        if t % 997 == 0 or t == n_blocks:
            assert all(abs(n - weights[x] / total * t) < 1.001 for x, n in taken.items())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    data = [(int(i), [float(np.float32(x)) for x in v * s]) for i, (v, s) in enumerate(zip(rng.normal(size=(700, 8)), rng.lognormal(0, 1, 700)))]
    data += [(1000 + i, data[i][1]) for i in range(60)] + [(2000, None), (2001, [1.0] * 7 + [None]), (2002, [float("nan")] * 8), (2003, []), (2004, [0.0] * 8), (2050, [0.0] * 8), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as score", "'x' as v", "3 as rank")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    q = {i: np.floor(256 * np.float32(v).astype(float)) for i, v in data if v and None not in v and np.isfinite(v).all()}
    want = []
    for i in q:
        if i % 50 == 0:
            scored = sorted((-int(q[j] @ q[i]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
