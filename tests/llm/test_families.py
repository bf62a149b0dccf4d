"""Families of texts that have much in common but are no near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratasift.llm import near_duplicates as nd


def family(n=150, shared=235, share=0.85, seed=1):
    rng = random.Random(seed)
    pool = [rng.getrandbits(64) for _ in range(shared)]
    sets = []
    for i in range(n):
        own = set(rng.sample(pool, int(share * shared)))
        if i % 10 == 1:  # a near copy of the one before
            own = set(sets[-1].tolist())
            own.discard(next(iter(own)))
        sets.append(np.array(sorted(own), np.uint64))
    return sets


def true_pairs(sets):
    out = set()
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            if shared >= 0.8 * (len(a) + len(sets[j]) - shared) - 1e-9:
                out.add((j, i))
    return out


def test_few_pairs_of_a_family_are_sent_on(spark):
    sets = family()
    rows = [(i.to_bytes(4, "big"), nd._stored(s)) for i, s in enumerate(sets)]
    hot = spark.createDataFrame(rows, "content binary, shingles binary").withColumn("component", F.col("content"))
    pairs = nd.rare_pairs(nd.rare_shingles(hot, 0.8), 0.8, False).collect()
    got = {(int.from_bytes(r["u"], "big"), int.from_bytes(r["v"], "big")) for r in pairs}
    want = true_pairs(sets)
    assert want <= got and len(want) > 10
    assert len(got) < 0.25 * len(sets) * (len(sets) - 1) / 2


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (0, 1, 10, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        x, y = (np.frombuffer(nd.parities(s), "<u8") for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("n", [1, 2, 24, 25, 60])
def test_buckets_of_all_sizes(spark, n):
    rows = [(7, i.to_bytes(2, "big")) for i in range(n)] * 2 + [(8, b"x"), (8, b"y"), (9, b"z")]
    found = nd.bucket_pairs(spark.createDataFrame(rows, "key long, content binary").repartition(3)).collect()
    pairs = {(r["u"], r["v"]) for r in found if r["v"] is not None}
    marked = {r["u"] for r in found if r["v"] is None}
    assert (b"x", b"y") in pairs
    mine = {(int.from_bytes(u, "big"), int.from_bytes(v, "big")) for u, v in pairs if u != b"x"}
    if n <= nd.PAIRWISE_BUCKET:
        assert mine == {(i, j) for j in range(n) for i in range(j)} and not marked
    else:
        assert mine >= {(0, i) for i in range(1, n)} and mine >= {(i - 1, i) for i in range(2, n)}
        assert len(mine) < 2 * n and len(marked) == n


def test_groups_are_joined_whatever_the_batches():
    import pyarrow as pa

    from stratasift.llm.simhash import groups_of

    rng = random.Random(3)
    for _ in range(200):
        keys = sorted(rng.choices(range(6), k=rng.randrange(0, 40)))
        cuts = sorted(rng.choices(range(len(keys) + 1), k=5))
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(p, pa.int64())], names=["k", "v"]) for p in parts]
        seen = set()
        out = []
        for k, v in groups_of(iter(batches)):
            assert len(k) and k.tolist() == v.tolist() and not seen & set(k.tolist())
            seen |= set(k.tolist())
            out += k.tolist()
        assert out == keys
