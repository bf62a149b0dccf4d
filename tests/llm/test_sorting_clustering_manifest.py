"""Suffix-sorting removal, clustering and the Merkle manifest against plain versions of the same rules."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratasift.llm import kmeans, merkle, suffix_dedup
from stratasift.llm.suffix_sorting import BlindTrie, deep_shallow_sort


# Deep-shallow sorting

STRINGS = st.lists(st.tuples(st.integers(0, 2), st.text("ab\0", max_size=60).map(str.encode)), max_size=40)


@settings(max_examples=60, deadline=None)
@given(STRINGS, st.sampled_from([0, 8, 32]))
def test_sort_orders_and_classes(strings, shallow):
    text = np.frombuffer(b"".join(s for _, s in strings), np.uint8)
    size = np.array([len(s) for _, s in strings], np.int64)
    at = np.cumsum(size) - size
    order, classes = deep_shallow_sort(text, at, size, np.array([g for g, _ in strings], np.int64), shallow)
    got = [strings[i] for i in order.tolist()]
    assert got == sorted(strings)
    for i in range(1, len(got)):
        assert (classes[i] == classes[i - 1]) == (got[i] == got[i - 1])


def test_blind_trie_keeps_order_and_equal_strings():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(500)]
    trie = BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    leaves = trie.classes()
    assert [strings[leaf[0]] for leaf in leaves] == sorted(set(strings))
    assert all(strings[i] == strings[leaf[0]] for leaf in leaves for i in leaf)


# Removal of repeated bytes

DOCS = "doc_id long, text string"


def plain_removal(rows, window=100):
    seen, out = {}, []
    keyed = sorted({(-math.inf if i is None else i, (t or "").encode()) for i, t in rows}, key=lambda r: (r[0], suffix_dedup.xxhash.xxh3_64_intdigest(r[1])))
    results = {}
    for key, text in keyed:
        gone = bytearray(len(text))
        for s in range(len(text) - window + 1):
            part = text[s : s + window]
            if part in seen:
                gone[s : s + window] = b"\1" * window
            else:
                seen[part] = True
        spans = sum(1 for p in range(len(text)) if gone[p] and (p == 0 or not gone[p - 1]))
        results[key, text] = (len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone, strict=True) if not g))
    for i, t in rows:
        out.append((i, *results[-math.inf if i is None else i, (t or "").encode()]))
    return sorted(out, key=str)


def removal(spark, rows, window=100):
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("id", "block", "kept", "n.m", "content"):
        df = df.withColumn(clash, F.lit("clash"))
    found = suffix_dedup.remove_repeated_bytes(df, window=window)
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect()), key=str)


def copied_rows(seed=3, n=120):
    rng = random.Random(seed)
    words = [bytes(rng.choice(b"abcdefgh\xc3") for _ in range(rng.randrange(2, 9))).decode("latin-1") for _ in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))))
        rows.append((i, " ".join(parts)))
    rows += [(n, "ab" * 700), (n + 1, "x" * 450), (n + 2, "y" * 99), (n + 3, "y" * 100), (n + 4, "y" * 101)]
    return rows


ODD = [(None, None), (None, "z" * 150), (7, ""), (8, None), (3, "q" * 130), (3, "q" * 130), (3, "other " * 40)]


def test_removal_equals_plain_version(spark):
    rows = copied_rows() + ODD
    assert removal(spark, rows) == plain_removal(rows)


@pytest.mark.parametrize("limit", [0, 2])
def test_hot_anchors_lose_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "HOT_REGIONS", limit)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    rows = copied_rows(seed=8, n=50) + ODD
    df = spark.createDataFrame(rows, DOCS).select("doc_id", "text").withColumnRenamed("doc_id", "id")
    # Everything in this process, so that the changed limits hold.
    source = [(r["id"], r["text"]) for r in df.collect()]
    assert local_removal(source, 4) == plain_removal(rows)


def local_removal(rows, buckets, window=100):
    """The operator's steps on one machine, block by block."""
    import pyarrow as pa

    blocks, at = [], 0
    while at < len(rows):
        part, size = [], 0
        while at < len(rows) and size < suffix_dedup.BLOCK_BYTES:
            part.append(rows[at])
            size += len((rows[at][1] or "").encode())
            at += 1
        ids = [r[0] for r in part]
        blocks.append((len(blocks), ids, suffix_dedup.Block.packed(ids, [(r[1] or "").encode() for r in part], window)))
    fake = Fake(blocks, suffix_dedup.BLOCK)
    kinds = suffix_dedup.anchor_kinds(suffix_dedup.asked_anchors(fake, window, buckets))
    marks = suffix_dedup.sorted_marks(suffix_dedup.sent_regions(fake, kinds, window, buckets), window)
    found = suffix_dedup.cut_texts(fake, marks, window)
    assert isinstance(found.table, pa.Table)
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in found.table.to_pylist()), key=str)


class Fake:
    """Runs the Arrow functions of a DataFrame in this process."""

    def __init__(self, rows, schema=None):
        import pyarrow as pa

        self.table = rows if isinstance(rows, pa.Table) else pa.Table.from_batches([suffix_dedup._batch(rows, schema)])

    def select(self, *columns):
        return Fake(self.table.select(columns))

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, schema):
        import pyarrow as pa

        batches = list(run(iter(self.table.to_batches())))
        return Fake(pa.Table.from_batches(batches))

    def groupBy(self, key):
        return FakeGroups(self, key)


class FakeGroups:
    def __init__(self, frame, key, other=None):
        self.frame, self.key, self.other = frame, key, other

    def cogroup(self, other):
        return FakeGroups(self.frame, self.key, other)

    def applyInArrow(self, run, schema):
        import pyarrow as pa
        import pyarrow.compute as pc

        def part(frame, value):
            return frame.table.filter(pc.equal(frame.table.column(self.key), value))

        out = []
        values = set(self.frame.table.column(self.key).to_pylist())
        for value in sorted(values):
            tables = [part(self.frame, value)] + ([part(self.other.frame, value)] if self.other else [])
            out.append(run(*tables))
        return Fake(pa.concat_tables(out))


def test_removal_of_nothing(spark):
    assert removal(spark, []) == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_bytes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_long_text_and_slices(spark, monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij ") for _ in range(30_000))
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1000)
    rows = [(2, base[:12_000] + base), (1, base[5_000:9_000]), (9, base[::-1] + base[100:1_100])]
    assert local_removal(rows, 3) == plain_removal(rows)


# Clustering


def plain_clusters(vectors, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(q) for _, q in seeds]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, q in kept:
            members.setdefault(nearest(q)[1], []).append(q)
        for j, rows in members.items():
            centroids[j] = [sum(x) // len(rows) for x in zip(*rows, strict=True)]
    return sorted(((i, nearest(q)[1], nearest(q)[0]) for i, q in kept), key=str)


def made_vectors(kind, n=150):
    rng = random.Random(kind)
    if kind == "ties":  # few different values, so that many distances are equal
        return [(i, [rng.choice([0.0, 0.01, -0.01]) if d < 3 else 0.0 for d in range(64)]) for i in range(n)]
    if kind == "far":
        return [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(5) for _ in range(64)]) for i in range(n)]
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["ties", "far", "groups"])
def test_clusters_equal_plain_version(spark, kind, monkeypatch):
    odd = [(1000, None), (1001, [0.0] * 63), (1002, [None] + [0.0] * 63), (1003, [math.nan] + [0.0] * 63), (1004, [math.inf] * 64), (None, [0.5] * 64), (5, [0.25] * 64)]
    rows = made_vectors(kind) + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("n.m", F.lit(1))
    found, centroids, taken = kmeans.elkan_clusters(df, k=12, rounds=5)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == plain_clusters(rows, 12, 5)
    assert len(centroids) == 12


def test_bounds_save_distances():
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, (20, 64))
    vectors = (centres[rng.integers(0, 20, 3000)] + rng.integers(-20, 20, (3000, 64))).astype(np.int32)
    elkan = kmeans.Elkan(centres.astype(np.int64), None)
    clusters, upper, lower = np.zeros(3000, np.int32), np.full(3000, np.inf), np.zeros((3000, 20), np.float32)
    first = elkan.assign(vectors, clusters, upper, lower)
    moved = centres + 1
    again = kmeans.Elkan(moved.astype(np.int64), centres.astype(np.int64))
    upper, lower = again.carried(clusters, upper, lower)
    assert again.assign(vectors, clusters, upper, lower) < first < 3000 * 20
    exact = ((vectors[:, None, :].astype(np.int64) - moved[None]) ** 2).sum(axis=2)
    assert (clusters == exact.argmin(axis=1)).all()
    assert (lower.astype(np.float64) ** 2 <= exact).all() and (upper**2 >= exact[np.arange(3000), clusters]).all()


def test_clusters_of_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(i, [i * 0.1] * 64) for i in range(3)]
    found, centroids, _ = kmeans.elkan_clusters(spark.createDataFrame(few, schema))
    assert len(centroids) == 3 and sorted(r["distance"] for r in found.collect()) == [0, 0, 0]
    found, centroids, _ = kmeans.elkan_clusters(spark.createDataFrame([(1, None)], schema))
    assert found.collect() == [] and len(centroids) == 0


# Manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, for each leaf its siblings with their sides)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, bool(i & 1)))
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    leaf = {r: sha(*[field(r[c]) for c in (0, 3, 2, 4, 1)]) for r in set(rows)}
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf[r]))
        trees[g] = plain_tree([leaf[r] for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in order])
    out = []
    for g, rest in zip(order, above, strict=True):
        subroot, paths = trees[g]
        out += [(r[0], g, leaf[r], subroot, root, path + rest) for r, path in zip(groups[g], paths, strict=True)]
    return sorted(out, key=str)


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("bits", [1, 2, 8])
@pytest.mark.parametrize("n", [0, 1, 5, 37])
def test_manifest_equals_plain_version(spark, bits, n):
    rows = [(i * 3, f"text é {i}" * (i % 3), ["en", "de", None, "fr"][i * i % 7 % 4], None if i % 5 == 0 else "web", i if i % 4 else None) for i in range(n)]
    if n == 37:
        rows += [(None, None, "en", "a", 1), (6, "other", "en", "a", 1), (6, "other", "en", "a", 1), (6, "x" * 100_000, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCUMENT)
    for clash in ("id", "tree", "at", "path", "n.m", "digest"):
        df = df.withColumn(clash, F.lit("clash"))
    found = merkle.merkle_manifest(df, bits=bits)
    got = [(r["id"], r["group"], r["leaf"], r["subroot"], r["root"], [(s["sibling"], s["left"]) for s in r["path"]]) for r in found.collect()]
    assert sorted(got, key=str) == plain_manifest(rows)


def test_tampering_is_found(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "web", None if i % 11 == 0 else i) for i in range(200)]
    out = merkle.query_of(spark.createDataFrame(rows, DOCUMENT)).collect()
    chosen = {i for i, *_, n in rows if zlib.crc32(str(i).encode()) % 7 == 0 and n is not None}
    assert chosen and {r["doc_id"] for r in out if not r["verified"]} == chosen
    assert len({r["root"] for r in out}) == 1 and all((r["folded_root"] == r["root"]) == r["verified"] for r in out)


def test_manifest_uses_no_python(spark):
    df = spark.createDataFrame([(1, "a", "en", "b", 1)], DOCUMENT)
    plan = merkle.query_of(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
