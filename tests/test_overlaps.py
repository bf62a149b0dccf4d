"""Documents that share words with passages, by blocks: equal to counting every pair."""

import pytest
from pyspark.sql import functions as F

from stratasift.operators import lexical

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("twice", [False, True])
def test_closest_documents_without_barred_pairs(spark, twice):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("d"), "text")
    docs = docs.unionByName(spark.createDataFrame([("none", None), ("", "")], "d string, text string"))
    if twice:
        docs = docs.unionByName(docs.where("d = '7'"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(30)
    words = lexical.text.cjk_and_word_tokens(F.col("text"))
    q = [(r[0], set(r[1])) for r in items.select("item_id", words).collect()]
    d = {r[0]: set(r[1] or []) for r in docs.select("d", words).collect()}
    counts = {i: sorted((-len(w & own), x) for x, own in d.items() if w & own) for i, w in q}
    # The best of each query is barred, and so is a pair of unknown ids.
    barred = [(i, found[0][1]) for i, found in counts.items()] + [(10**6, "7"), (q[0][0], "unknown")]
    for pairs in (None, barred):
        off = set(pairs or [])
        frame = None if pairs is None else spark.createDataFrame(pairs, f"query {items.schema['item_id'].dataType.simpleString()}, doc string")
        found = lexical.top_k(lexical.overlap_top_k(docs.repartition(3), items, 3, "d", "item_id", barred=frame), 3, score="overlap")
        want = [(i, x, -n, k) for i, some in counts.items() for k, (n, x) in enumerate([p for p in some if (i, p[1]) not in off][:3], 1)]
        assert sorted((r["query"], r["doc"], r["overlap"], r["rank"]) for r in found.collect()) == sorted(want)
        if not twice:
            plan = lexical.overlap_top_k(docs, items, 3, "d", "item_id", barred=frame)._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "count(1)" not in plan
