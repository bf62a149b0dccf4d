"""Training-data queries that have SQL equal it on the smallest tables; the pipeline keeps its promises there."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratasift.llm import near_duplicates
from stratasift.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(str([r[c] for c in sorted(columns)]) for r in df.collect())
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted(str([r[i] for i in order]) for r in cursor.fetchall())


def odd_documents(spark, rows):
    """Documents with nulls, an empty and a very long text, repeated rows and columns named like operators' own."""
    good = "\n".join(f"Sentence {i} has the words apple{i} and pear{i * 7} in it." for i in range(12))
    long = "\n".join(f"Line {i} of a long text tells of thing{i} and of number{i}." for i in range(20_000))
    data = [
        (1, good, "en", "a", 1, "x"), (1, good, "en", "a", 1, "x"), (2, None, None, None, None, "x"), (3, "", "en", "a", 0, None),
        (None, good + "\nAnother last line ends it all.", "en", "a", 9, "x"), (4, long, "en", "b", 5, "x"), (5, "short", "en", "a", 5, "x"),
        (6, "\n".join(f"Other {i} words about item{i} and thing{i} here." for i in range(12)) + "\nHome | About | News | Help", "fr", "a", 7, "x"),
    ]
    df = spark.createDataFrame(data[:rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for c in ("n.m", "content", "column_1", "doc", "place", "__text"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("rows", [8, 0])
def test_stages_take_odd_documents(spark, tmp_path, rows):
    docs = odd_documents(spark, rows)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{i}")
        read = spark.read.parquet(f"file://{tmp_path}/{i}")
        if i == 4:
            assert read.count() >= docs.count()
            continue
        assert read.columns == docs.columns and read.schema["n_chars"] == docs.schema["n_chars"]
        docs = read
        kept = docs.collect()
        assert all(r["n.m"] == r["content"] == r["doc"] == "clash" for r in kept)
        if rows and i == 0:
            # The navigation line goes, the document stays.
            assert sorted(str(r["doc_id"]) for r in kept) == ["1", "1", "4", "6", "None"]
            (cleaned,) = [r for r in kept if r["doc_id"] == 6]
            assert "Home" not in cleaned["text"] and cleaned["n_chars"] == len(cleaned["text"])
        if rows and i == 1:
            assert sorted(str(r["doc_id"]) for r in kept) == ["4", "6", "None"]


def test_stages_of_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.select("doc_id").distinct().count() == sizes[-1]
        if i == 1:
            sets = [near_duplicates.shingle_set((r["text"] or "").encode(), 5) for r in docs.collect()]
            sets = [set(s.tolist()) for s in sets]
            for a in range(len(sets)):
                for b in range(a):
                    assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] >= sizes[4]
    rows = docs.collect()
    assert sum(r["length"] for r in rows if r["start"] == 0) > 0
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
