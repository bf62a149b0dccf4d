"""Stored indexes: equal to the searches without one, pruned, versioned, and never half-written."""

import random

import pytest
from pyspark.sql import functions as F

from stratasift.operators import dense, lexical
from stratasift.operators.lexical_index import LexicalIndex, MappingError
from stratasift.operators.vector_index import VectorIndex, recall
from stratasift.staging import new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    return docs, spark.read.parquet(f"{SF}/benchmark.parquet")


def as_rows(df):
    return sorted((r["query"], r["doc"], r["score"], r["rank"]) for r in df.select("query", "doc", "score", "rank").collect())


def index_of(spark, docs):
    index = LexicalIndex(spark, new_folder(spark, "test-index"))
    index.build(docs)
    return index


def test_search_prunes_and_finds_the_same(spark, corpus, monkeypatch):
    from stratasift.operators import lexical_index

    monkeypatch.setattr(lexical_index, "CELL_DOCS", 8)
    docs, items = corpus
    index = index_of(spark, docs)
    found, report = index.explained_search(items, "item_id", "text", 10)
    exact = lexical.top_k(lexical.bm25_scores(docs.withColumnRenamed("doc", "doc_id"), items, "doc_id", "item_id"), 10)
    assert as_rows(found) == as_rows(exact)
    cells = report.agg(F.count(F.lit(1)).alias("all"), F.count_if("read").alias("read"), F.count_if("first").alias("first")).first()
    assert 0 < cells["first"] < cells["read"] < 0.9 * cells["all"]


def test_only_buckets_of_the_terms_are_read(spark, corpus):
    docs, items = corpus
    index = index_of(spark, docs)
    few = items.limit(1).select("item_id", F.lit("cosmetic the").alias("text"))
    plan = index.search(few, "item_id", "text", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    rows = index._postings(index.manifest(), [3], ["max_tf"])
    assert all("bucket=3" in f for f in rows.inputFiles()) or "bucket" in rows._jdf.queryExecution().executedPlan().toString()


def test_versions_of_documents(spark):
    def docs(rows):
        return spark.createDataFrame(rows, "doc long, text string")

    index = index_of(spark, docs([(1, "apple pear"), (2, "apple apple plum"), (3, "fig"), (4, None)]))
    ask = spark.createDataFrame([("q", "apple")], "query string, text string")

    def found():
        return [r["doc"] for r in index.search(ask, "query", "text", 10).orderBy("rank").collect()]

    assert found() == [2, 1]
    index.replace(docs([(2, "cherry"), (5, "apple")]))
    assert found() == [5, 1]
    terms = {r["term"]: r["df"] for r in index.term_table().collect()}
    assert terms == {"apple": 2, "pear": 1, "fig": 1, "cherry": 1}
    index.archive(spark.createDataFrame([(5,), (99,)], "doc long"))
    assert found() == [1]
    # Archived documents still count in the statistics.
    assert {r["term"]: r["df"] for r in index.term_table().collect()} == terms
    assert {r["doc"]: r["status"] for r in index.statuses().collect()} == {1: "active", 2: "active", 3: "active", 4: "active", 5: "archived"}
    index.replace(docs([(5, "apple"), (1, "nothing")]))
    assert found() == [5]
    visible = spark.createDataFrame([(1,)], "doc long")
    assert index.search(ask, "query", "text", 10, visible=visible).count() == 0


def test_commits_are_checked(spark):
    good = spark.createDataFrame([(1, "a")], "doc long, text string")
    index = index_of(spark, good)
    with pytest.raises(ValueError):
        index.build(good)
    with pytest.raises(MappingError):
        index.replace(spark.createDataFrame([("1", "a")], "doc string, text string"))
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            index.replace(spark.createDataFrame(rows, "doc long, text string"))
    assert len(index.manifest()) == 1
    with pytest.raises(ValueError):
        LexicalIndex(spark, new_folder(spark, "none")).search(good, "doc", "text", 1)


def test_a_commit_without_manifest_is_not_seen(spark, monkeypatch):
    index = index_of(spark, spark.createDataFrame([(1, "apple"), (2, "pear")], "doc long, text string"))
    ask = spark.createDataFrame([("q", "apple")], "query string, text string")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_commit", dies)
        with pytest.raises(RuntimeError):
            index.replace(spark.createDataFrame([(1, "plum")], "doc long, text string"))
    assert [r["doc"] for r in index.search(ask, "query", "text", 5).collect()] == [1]
    # Another kind of commit with the same number does not take over what the lost one has left.
    index.archive(spark.createDataFrame([(2,)], "doc long"))
    assert [r["doc"] for r in index.search(ask, "query", "text", 5).collect()] == [1]
    index.replace(spark.createDataFrame([(1, "plum")], "doc long, text string"))
    assert index.search(ask, "query", "text", 5).count() == 0


def test_empty_index(spark):
    index = index_of(spark, spark.createDataFrame([], "doc long, text string"))
    ask = spark.createDataFrame([("q", "apple")], "query string, text string")
    assert index.search(ask, "query", "text", 5).count() == 0


# Vectors


def test_vector_index_reaches_its_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    asked = e.where("doc % 20 = 0").select(F.col("doc").alias("query"), "vector")
    index = VectorIndex(spark, new_folder(spark, "test-vectors"), 64)
    index.build(e)
    assert index.rows().count() == e.count()
    exact = dense.similarity_top_k(e, asked, 10)
    found = index.search(asked, 10)
    mean = recall(found, exact).agg(F.avg("recall")).first()[0]
    assert mean >= 0.9
    assert index.probes() < len(index.centroids())
    assert as_rows(index.search(asked, 10, probes=len(index.centroids()))) == as_rows(exact)


def test_vector_index_takes_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    rows += [(100, None, 0), (101, [1.0], 0), (102, [float("nan")] * 4, 0), (103, [None] * 4, 0), (104, rows[5][1], 1), (105, [0.0] * 4, 1)]
    e = spark.createDataFrame(rows, "doc long, vector array<double>, owner long")
    index = VectorIndex(spark, new_folder(spark, "test-vectors"), 4)
    index.build(e, cells=5)
    asked = spark.createDataFrame([(5, rows[5][1]), (200, None)], "query long, vector array<double>")
    best = index.search(asked, 3).collect()
    assert [(r["query"], r["doc"], r["rank"]) for r in best][0] == (5, 104, 1)
    owners = index.search(asked, 5, owner="owner", probes=5).collect()
    assert sorted(r["doc"] for r in owners) == [0, 1, 2]
    assert all(r["doc"] % 2 == 0 for r in index.search(asked, 5, probes=5, where=F.col("doc") % 2 == 0).collect())
    empty = VectorIndex(spark, new_folder(spark, "test-vectors"), 4)
    empty.build(e.where("doc = 101"))
    assert empty.search(asked, 3).count() == 0


def test_blocks_find_what_expressions_find(spark, monkeypatch):
    """Blocks smaller than the tables, ties, owners, copies and vectors without a score."""
    from pyspark.sql.window import Window

    from stratasift.functions import rules, vectors

    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 11)
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)], i % 4) for i in range(90)]
    rows += [(200, None, 0), (201, [1.0], 1), (202, [1.0, None, 2.0], 2), (203, [0.0] * 3, 3), (204, [float("nan")] * 3, 1), (205, rows[8][1], 5)]
    e = spark.createDataFrame(rows, "doc long, vector array<float>, owner long").repartition(3)
    asked = e.where("doc % 4 = 0 or doc >= 200").select(F.col("doc").alias("query"), F.col("vector").alias("q"))
    q, v = F.col("q"), F.col("vector")
    forms = {
        dense.Measure(): vectors.cosine(q, v),
        dense.Measure(damping=1e-8): vectors.cosine_damped(q, v),
        dense.Measure(platt=(-1.0, 0.0)): rules.platt(F.round(vectors.cosine(q, v), 6), -1.0, 0.0),
    }
    for measure, score in forms.items():
        pairs = e.join(asked, F.col("doc") != F.col("query")).select("query", "doc", "owner", F.round(score, 6).alias("score"))
        for owner, k in ((None, 9), ("owner", 2)):
            if owner:
                pairs = pairs.groupBy("query", F.col("owner").alias("doc")).agg(F.max("score").alias("score"))
            w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
            wanted = pairs.select("query", "doc", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
            found = dense.similarity_top_k(e, asked.withColumnRenamed("q", "vector"), k, measure, owner)
            assert sorted(map(repr, found.select("query", "doc", "score", "rank").collect())) == sorted(map(repr, wanted.collect()))


def test_searches_score_no_pair_by_expressions(spark):
    """A pair for each row of a join is what made large searches too slow."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    plan = dense.similarity_top_k(e, e.where("doc % 20 = 0").withColumnRenamed("doc", "query"), 10)._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_blocks_of_terms_find_what_pairs_find(spark, corpus, monkeypatch):
    """Blocks, chunks and matrices smaller than the tables, documents that may not be found, and ids that occur twice."""
    from stratasift.operators import term_blocks

    docs, items = corpus
    docs = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "!")], "doc long, text string")).repartition(3)
    monkeypatch.setattr(term_blocks, "BLOCK_DOCS", 7)
    monkeypatch.setattr(term_blocks, "CHUNK_QUERIES", 9)
    monkeypatch.setattr(term_blocks, "MATRIX", 2000)
    pairs = lexical.bm25_scores(docs, items, "doc", "item_id")
    found = lexical.bm25_top_k(docs, items, 5, "doc", "item_id")
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert as_rows(lexical.top_k(found, 5)) == as_rows(lexical.top_k(pairs, 5))
    some = lexical.bm25_top_k(docs, items, 5, "doc", "item_id", visible=F.col("doc") % 3 == 0)
    assert as_rows(lexical.top_k(some, 5)) == as_rows(lexical.top_k(pairs.where("doc % 3 = 0"), 5))
    twice = docs.unionByName(docs.where("doc = 4").withColumn("text", F.concat("text", F.lit(" more"))))
    assert as_rows(lexical.top_k(lexical.bm25_top_k(twice, items, 5, "doc", "item_id"), 5)) == as_rows(lexical.top_k(lexical.bm25_scores(twice, items, "doc", "item_id"), 5))


def test_evidence_is_rounded_by_its_decimals(spark):
    from stratasift.functions import rules

    row = spark.range(1).select(rules.evidence_score(F.lit(0.7558954999999999)).alias("a"), rules.evidence_score(F.lit(0.7558954)).alias("b")).first()
    assert (row["a"], row["b"]) == (0.755896, 0.755895)
