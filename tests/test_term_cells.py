"""The lexical index by parts of cells: one row of a term in a part, and searches equal to scoring all."""

import pyarrow as pa
from pyspark.sql import functions as F

from stratasift.operators import lexical, lexical_index, term_cells
from stratasift.operators.lexical_index import LexicalIndex
from stratasift.staging import new_folder

SF = "/root/testdata/sf0.001"


def test_versions_in_many_parts_are_found_as_by_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "CELL_DOCS", 4)
    monkeypatch.setattr(lexical_index, "PART_DOCS", 32)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc"), "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(40)
    changed = F.col("doc").cast("int") % 3 == 0
    index = LexicalIndex(spark, new_folder(spark, "test-index"))
    index.build(docs.withColumn("text", F.when(changed, F.concat("text", F.lit(" old "), "text")).otherwise(F.col("text"))))
    index.replace(docs.where(changed))
    parts = index.manifest()[0]["parts"]
    assert parts > 1
    one = index._postings(index.manifest(), None, ["ends"]).groupBy("commit", "term", "part").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("cells"))
    assert one.agg(F.max("n")).first()[0] == 1 and one.agg(F.max("cells")).first()[0] > 1
    exact = lexical.bm25_scores(docs.withColumnRenamed("doc", "doc_id"), items, "doc_id", "item_id")
    shown = docs.where(F.col("doc").cast("int") % 4 != 0).select("doc")
    monkeypatch.setattr(lexical_index, "BROADCAST_TERMS", 500)  # several searches
    for visible, all_pairs in ((None, exact), (shown, exact.join(shown, "doc", "left_semi"))):
        found = index.search(items, "item_id", "text", 5, visible, first_cells=1).select("query", "doc", "score", "rank")
        assert sorted(found.collect()) == sorted(lexical.top_k(all_pairs, 5).select("query", "doc", "score", "rank").collect())


def test_a_part_that_is_inverted_in_pieces_loses_nothing(monkeypatch):
    rows = [(d, d % 2, d % 4, 3, ["a", "b" if d % 3 else "a", f"w{d}"]) for d in range(12)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc", "part", "cell", "dl", "words"), r, strict=True)) for r in rows])

    def entries():
        found = []
        for r in pa.Table.from_batches(list(term_cells.inverted([batch.slice(i, 2) for i in range(0, 12, 2)]))).to_pylist():
            assert r["n_words"] == sum(r["tfs"]) and r["ends"][-1] == len(r["docs"])
            for c, begin, end, top, low in zip(r["cells"], [0, *r["ends"]], r["ends"], r["max_tf"], r["min_dl"], strict=False):
                assert (top, low) == (max(r["tfs"][begin:end]), min(r["dls"][begin:end]))
                found += [(r["term"], r["part"], c, d, tf) for d, tf in zip(r["docs"][begin:end], r["tfs"][begin:end], strict=True)]
        return sorted(found)

    whole = sorted({(t, p, c, d, words.count(t)) for d, p, c, _, words in rows for t in words})
    assert entries() == whole
    monkeypatch.setattr(term_cells, "MOST_WORDS", 7)
    assert entries() == whole
