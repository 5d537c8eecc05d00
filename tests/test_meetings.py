"""The shared step of all pair operators, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orefield.operators import meeting, recommend, similarity
from orefield.operators.meeting import Meetings


def brute(rows):
    by, out = {}, {}
    for v, k, x in rows:
        if v is not None and k is not None:
            by.setdefault(v, []).append((k, x))
    for each in by.values():
        for (a, x), (b, y) in itertools.permutations(each, 2):
            if a < b:
                n, *s = out.get((a, b), (0, 0.0, 0.0, 0.0))
                out[a, b] = (n + 1, s[0] + x, s[1] + y, s[2] + x * y)
    return out


def test_numbers_keep_their_value_when_encoded():
    arrays = [np.array(x, np.int64) for x in ([], [5], [-(2**63), 2**63 - 1], range(300), [2**40, 2**40 + 70_000])]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, meeting.decoded(meeting.encoded(arrays)), strict=True))


@pytest.mark.parametrize("words", [5, 1000])
def test_values_of_very_many_keys_are_dealt_out(monkeypatch, words):
    """Here a value of 400 keys is taken apart; no job, flush or sum holds more than a few hundred pairs."""
    for name, v in {"JOB": 300, "CHUNK": 16, "FLUSH": 500, "PASS": 200, "_ROWS": 50}.items():
        monkeypatch.setattr(meeting, name, v)
    dice = random.Random(1)
    rows = sorted({(7, k * 3 - 500) for k in range(400)} | {(dice.randrange(60), dice.randrange(-50, 50)) for _ in range(900)} | {(99, 1)})
    rows = [(v, k, float(dice.randrange(words))) for v, k in rows]
    cols = lambda part: pa.RecordBatch.from_pydict({"by": pa.array([r[0] for r in part], pa.int64()), "key": pa.array([r[1] for r in part], pa.int64()), "bits": pa.array(np.array([r[2] for r in part]).view(np.int64)), "m0": pa.array([1] * len(part)), "m1": pa.array([0] * len(part))})
    jobs = [j for b in meeting._jobs(iter([cols(rows[i : i + 37]) for i in range(0, len(rows), 37)])) for j in b.to_pylist()]
    assert sum(j["groups"] for j in jobs) == len({r[0] for r in rows}) and max(j["work"] for j in jobs) <= 600
    dealt = pa.RecordBatch.from_pylist([j for j in jobs if j["work"]])
    sent = pa.Table.from_batches(list(meeting._sent(iter([dealt]), 3, True)))
    got = {}
    for k in range(3):
        for r in meeting._summed(sent.filter(pa.compute.equal(sent["bucket"], k)), True, None).to_pylist():
            assert (r["a"], r["b"]) not in got and r["met"] == r["n"]
            got[r["a"], r["b"]] = (r["n"], r["sx"], r["sy"], r["sxy"])
    assert got == brute(rows)


def test_keys_of_any_type_and_nulls(spark):
    rows = [(v, k, 1.0) for v, k in (("x", "a"), ("x", "b"), ("x", None), (None, "a"), (None, "b"), ("y", "a"), ("y", "b"), ("y", "c"), ("z", None))]
    one = Meetings(spark.createDataFrame([r[:2] for r in rows], "v string, k string"), "k", "v")
    assert {(r.a, r.b): r.n for r in one.pairs().collect()} == {k: v[0] for k, v in brute(rows).items()} and one.groups == 3
    assert Meetings(spark.createDataFrame([], "v int, k int"), "k", "v").pairs().isEmpty()


def test_repeated_ratings_count_as_often_as_in_a_join(spark):
    rows = [(1, 1, 2.0), (1, 1, 3.0), (1, 2, 5.0), (2, 1, 1.0), (2, 2, 4.0)]
    got = {(r.a, r.b): (r.n, r.sx, r.sy, r.sxy) for r in Meetings(spark.createDataFrame(rows, "v int, k int, x double"), "k", "v", "x").pairs(sums=True).collect()}
    assert got == brute(rows)


def test_correlations_without_a_common_value_are_the_default(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("b", 1, None), ("b", 2, None), ("b", 3, 3.0)]
    assert [r.sim for r in similarity.pearson(spark.createDataFrame(rows, "k string, u int, stars double"), "k", "u").collect()] == [1.0]


def test_minhash_of_sets_too_large_to_come_whole(spark):
    """Sets of more than WHOLE rows come by their sketch; their similarity is that of the whole sets all the same."""
    n = meeting.WHOLE + 500
    sets = {1: range(n), 2: range(n - 300), 3: range(n - 50, n + 4), 4: range(n - 40, n)}
    pairs = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v] + [(3, n)], "k int, i int")
    exact = {(r.a, r.b): round(r.sim, 9) for r in similarity.jaccard(pairs, "k", "i", 0.2).collect()}
    assert {(r.a, r.b): round(r.sim, 9) for r in similarity.lsh_jaccard(pairs, "k", "i", 0.2, 120, 1, 3).collect()} == exact and set(exact) == {(1, 2), (3, 4)}
    rated = pairs.distinct().select(F.col("k").alias("business_id"), F.col("i").alias("user_id"), (F.pmod(F.xxhash64("k", "i"), F.lit(5)) + 1.0).alias("stars"))
    model = {(r.a, r.b): (r.n, round(r.sim, 9)) for r in recommend.train(rated, "business_id", "user_id").collect()}
    found = {(r.a, r.b): (r.n, round(r.sim, 9)) for r in recommend.train(rated, "business_id", "user_id", lsh=(120, 1, 3)).collect()}
    assert found.items() <= model.items() and {(1, 2), (3, 4)} <= set(found)
