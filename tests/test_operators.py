import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.operators import contracts, corpus, evaluation, extension, fusion, lexical, lifecycle, ops, ranking
from stratasift.plans import governance
from stratasift.sources import readers, sinks


def test_query_without_gold_is_null_and_repeats_do_not_push_ndcg(spark):
    gold = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q2", "z", 1), ("q3", "n", 0)], "query string, doc string, grade int")
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "a", 2), ("q1", "b", 3), ("q2", "y", 1)], "query string, doc string, rank int")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query string")
    r = {x["query"]: x for x in evaluation.score_rankings(gold, ranked, queries).collect()}
    assert r["q1"]["ndcg"] == 1.0 and r["q1"]["rr"] == 1.0 and r["q1"]["recall_3"] == 1.0
    assert r["q2"]["rr"] == 0.0 and r["q2"]["hit_10"] is False
    assert r["q3"]["ndcg"] is None and r["q3"]["recall_1"] is None


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 5)], "k string, v double")
    row = evaluation.floor_percentiles(df, ["k"], "v").first()
    assert row["p50"] == 3.0
    assert df.agg(*evaluation.linear_percentiles(F.col("v"))).first()["p50"] == 2.5


def test_fusion_ties_and_weights(spark):
    rows = [("bm25_es", 1, "b", 1), ("dense_bge", 1, "a", 1), ("dense_bge", 1, "a", 2), ("dense_bge", 1, "c", 3)]
    ranked = spark.createDataFrame(rows, "path string, query int, doc string, rank int")
    even = [r["doc"] for r in fusion.reciprocal_rank_fusion(ranked, {}).orderBy("rank").collect()]
    assert even == ["a", "b", "c"]
    first = fusion.reciprocal_rank_fusion(ranked, fusion.query_weights(True, False)).orderBy("rank").first()
    assert first["doc"] == "b"
    assert fusion.path_weight("dense_bge", {"w_text": 0.3}) == 0.3


def test_archived_source_that_reappears_is_new(spark):
    cur = spark.createDataFrame([(1, "h"), (2, "h"), (3, "x")], "id int, hash string")
    old = spark.createDataFrame([(1, "h", "archived"), (2, "h", "active"), (3, "h", "active"), (4, "h", "active")], "id int, hash string, status string")
    got = {r["id"]: r["change"] for r in corpus.snapshot_diff(cur, old, "id", ["hash"]).collect()}
    assert got == {1: "NEW", 2: "UNCHANGED", 3: "MODIFIED", 4: "DELETED"}


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(i,) for i in range(500)], "i int")
    a = corpus.ordered_digest(df, F.col("i").cast("string")).first()
    b = corpus.ordered_digest(df.orderBy(F.desc("i")).repartition(7), F.col("i").cast("string")).first()
    assert a == b and a["n_rows"] == 500


def test_contract_reasons_are_ordered(spark):
    row = ("s1", " ", "regulation", "easy", True, "simple", "v1", None, [("d", "", "t", 7)], ("a", "m", "t", "human", "DRAFT_UNVERIFIED", "r"))
    (r,) = spark.createDataFrame([row], contracts.GOLDEN_ROW).select(contracts.golden_row_reasons()).first()
    assert r == ["missing_question", "annotation_0_missing_chunk_id", "annotation_not_reviewed", "annotation_0_invalid_relevance_grade"]


def test_missing_sample_is_an_error_before_any_limit(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert contracts.select_samples(df, "id", [2, 1], 1).count() == 1
    with pytest.raises(ValueError):
        contracts.select_samples(df, "id", [1, 9], 1)


def _events(spark, seconds):
    t0 = pd.Timestamp("2024-01-01")
    return spark.createDataFrame(pd.DataFrame({"event_id": range(len(seconds)), "k": 1, "ts": [t0 + pd.Timedelta(seconds=s) for s in seconds]}))


def test_token_bucket_and_sliding_limit(spark):
    e = _events(spark, [0] * 5 + [400])
    allowed = [r["allowed"] for r in ops.token_bucket(e, ["k"], "ts", 2).orderBy("event_id").collect()]
    assert allowed == [True] * 4 + [False, True]
    e = _events(spark, [0, 1, 2, 59, 61])
    allowed = [r["allowed"] for r in ops.sliding_limit(e, ["k"], "ts", 2, 60).orderBy("event_id").collect()]
    assert allowed == [True, True, False, False, True]


def test_lru_evicts_the_least_recent(spark):
    t0 = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"event_id": range(6), "key": list("abacba"), "ts": [t0 + pd.Timedelta(seconds=i) for i in range(6)]})
    out = ops.lru_replay(spark.createDataFrame(rows), F.lit(0), "key", "ts", 2, 100).orderBy("event_id").collect()
    assert [r["hit"] for r in out] == [False, False, True, False, False, False]


def test_epoch_store_seals(spark, tmp_path):
    schema = T.StructType.fromDDL("chunk_id string, content string, doc_version_epoch string")
    store = sinks.EpochStore(spark, f"file://{tmp_path}", schema)
    rows = spark.createDataFrame([("a", "x", "e1")], schema)
    store.replace("e1", rows)
    store.replace("e1", rows.union(spark.createDataFrame([("b", "y", "e1")], schema)))
    assert store.read("e1").count() == 2 and store.read("e2").count() == 0
    store.seal("e1")
    with pytest.raises(sinks.SealedEpochError):
        store.replace("e1", rows)
    with pytest.raises(ValueError):
        store.replace("e3", rows.drop("content"))
    assert sinks.same_rows(store.read("e1"), store.read("e1")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"\xef\xbb\xbf one\r\ntwo \n")
    (tmp_path / "a" / "y.bin").write_bytes(b"no")
    found = readers.discover_sources(spark, f"file://{tmp_path}", ["txt"], [("a/*", 5)], 0).collect()
    assert [(r["relative_path"], r["role_mask"]) for r in found] == [("a/x.txt", 5)]
    assert readers.read_txt(spark, f"file://{tmp_path}").first()["text"] == "one\ntwo"
    with pytest.raises(ValueError):
        readers.supported_suffixes(["exe"])
    (tmp_path / "l.jsonl").write_text('{"ts": 5.0}\n\n{"ts": 500000.0}\nbad\n')
    log = readers.recent_log(spark, f"file://{tmp_path}/l.jsonl", "ts double", 600000.0, 7)
    assert log.where("ts is not null").count() == 2


def test_docx_and_xlsx_blocks(tmp_path, spark):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{table}</w:body></w:document>")
    got = [(r["block_type"], r["text"]) for r in readers.read_blocks(spark, f"file://{tmp_path}", "docx").orderBy("block_order").collect()]
    assert got == [("heading:2", "Title"), ("paragraph", "Body"), ("table", "a | b")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(60))
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>")
    got = [r["block_id"] for r in readers.read_blocks(spark, f"file://{tmp_path}", "xlsx").orderBy("block_order").collect()]
    assert got == ["sheet:0:rows:1-50", "sheet:0:rows:51-60"]


def test_passage_at_the_end_of_a_long_document_is_a_high_risk(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    filler = " ".join(f"f{i}" for i in range(20_000))
    spark.createDataFrame([(1, filler + " " + passage, len(filler) + len(passage) + 1)], "doc_id long, text string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (row,) = governance.lcs_risk(spark, str(tmp_path)).collect()
    assert (row["item_id"], row["doc_id"], row["ratio"], row["level"]) == (7, 1, 1.0, "HIGH")


def test_ordered_folds_equal_the_rules_written_out(spark):
    rng = random.Random(3)
    t0, clock, rows = pd.Timestamp("2024-01-01"), 0, []
    for i in range(400):
        clock += rng.choice([0, 1, 5, 20, 400])
        rows.append((i, rng.randint(0, 2), t0 + pd.Timedelta(seconds=clock), float(rng.randint(1, 60)), f"P{rng.randint(0, 2)}"))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "k", "ts", "cost", "priority"])).repartition(3)
    bucket = {r["event_id"]: r["allowed"] for r in ops.token_bucket(df, ["k"], "ts", 4).collect()}
    window = {r["event_id"]: r["allowed"] for r in ops.sliding_limit(df, ["k"], "ts", 3, 60).collect()}
    held = {r["event_id"]: r["reason"] for r in ops.admission_fold(df, ["k"], "ts", 100.0, 30).collect()}
    for key in range(3):
        mine = [r for r in rows if r[1] == key]
        level, last, accepted, open_ = 8.0, None, [], []
        for i, _, t, cost, priority in mine:
            if last is not None:
                gone = (t - last).total_seconds()
                level = 8.0 if gone > 300 else min(8.0, level + gone * 4 / 60)
            last = t
            assert bucket[i] == (level >= 1)
            level -= level >= 1
            ok = sum((t - a).total_seconds() < 60 for a in accepted) < 3
            assert window[i] == ok
            accepted += [t] * ok
            open_ = [(a, c) for a, c in open_ if (t - a).total_seconds() < 30]
            used = sum(c for _, c in open_)
            p, fits = used / 100.0, used + cost <= 100.0
            if p > 0.95 and priority != "P0":
                want = "critical_p1_queued" if priority == "P1" else "critical_p2_rejected"
            elif 0.90 < p <= 0.95 and priority == "P2":
                want = "soft_stop"
            elif not fits:
                want = "critical_p0_budget" if p > 0.95 else "budget_exceeded"
            elif p > 0.95:
                want = "critical"
            elif p > 0.90:
                want = "downgrade" if priority == "P1" else "admitted"
            elif p > 0.80:
                want = "admitted_with_truncation"
            else:
                want = "admitted_with_tighten" if p > 0.70 else "admitted"
            assert held[i] == want
            if want.startswith(("admitted", "downgrade")) or want == "critical":
                open_.append((t, cost))


def test_two_levels_of_cache(spark):
    t0 = pd.Timestamp("2024-01-01")
    # key, second, public, epoch
    log = [("a", 0, True, 1), ("a", 1, True, 1), ("b", 2, True, 1), ("c", 3, True, 1), ("a", 4, True, 1), ("p", 5, False, 1), ("p", 6, False, 1),
           ("c", 7, True, 1), ("c", 8, True, 2), ("c", 9, True, 2), ("c", 300, True, 2), ("p", 9000, False, 2)]
    rows = pd.DataFrame({"event_id": range(len(log)), "n": 0, "key": [x[0] for x in log], "ts": [t0 + pd.Timedelta(seconds=x[1]) for x in log], "public": [x[2] for x in log], "epoch": [x[3] for x in log]})
    out = ops.two_level_cache(spark.createDataFrame(rows), ["n"], "key", "ts", "public", (2, 100), 3600, "epoch").orderBy("event_id").collect()
    assert [r["served"] for r in out] == ["miss", "L1", "miss", "miss", "L2", "miss", "L2", "L1", "miss", "L1", "L2", "miss"]


def test_states_are_replayed_in_order(spark):
    log = spark.createDataFrame(
        [(1, i, a) for i, a in enumerate(["write", "seal", "validate", "write", "validate", "seal", "write", "activate", "activate"])], "e int, i int, action string"
    )
    got = [(r["state"], r["accepted"]) for r in lifecycle.replay(log, ["e"], ["i"], "action", lifecycle.EPOCH).orderBy("i").collect()]
    assert got == [
        ("staging", True), ("staging", False), ("validated", True), ("staging", True), ("validated", True), ("sealed", True), ("sealed", False), ("active", True), ("active", False),
    ]


def test_vectors_of_another_version_stop_the_build(spark):
    old = spark.createDataFrame([(1, "e1", "v1"), (2, "e1", "v0"), (3, "e1", None)], "doc int, epoch string, version string")
    some = spark.createDataFrame([(1,)], "doc int")
    assert corpus.carry_forward(old, some, "doc", "epoch", "e2", "version", ["v1"]).first()["epoch"] == "e2"
    for bad in (2, 3):
        with pytest.raises(corpus.VersionMismatchError):
            corpus.carry_forward(old, spark.createDataFrame([(bad,)], "doc int"), "doc", "epoch", "e2", "version", ["v1"])


def test_rank_in_few_large_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r["i"]: (r["rank"], r["group_size"]) for r in ranking.distributed_rank(df, ["k"], ["v", "i"]).collect()}
    for key in ("a", "b", None):
        mine = sorted((v, i) for k, v, i in rows if k == key)
        assert all(got[i] == (n, len(mine)) for n, (_, i) in enumerate(mine, 1))


def test_passages_are_found_with_and_without_an_inner_word(spark, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "be", "gamma", "d", "epsilon", "x  y", "line\nbreak"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)] + [None, ""]
    passages = [t[a : a + n] for t in texts[:40] for a, n in [(rng.randint(0, len(t)), rng.randint(0, 25))]] + ["alpha", "", None, "no such", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "p int, passage string")
    want = {(d, p) for d, t in enumerate(texts) for p, s in enumerate(passages) if t is not None and s is not None and s in t}
    for limit in (500_000, 0):
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", limit)
        rows = lexical.containing(docs, asked, "doc", "text", "passage").collect()
        assert len(rows) == len(want) and {(r["doc"], r["p"]) for r in rows} == want


def test_retrievers(spark):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 6)), [float(i % 3), 1.0, float(i)]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc int, text string, vector array<float>")
    queries = docs.where("doc in (3, 8)").withColumnRenamed("doc", "query")
    for name in ("bm25", "dense", "hybrid_rrf"):
        found = extension.retrieve(name, docs, queries, 10).collect()
        assert {r["query"] for r in found} == {3, 8} and len(found) <= 20
        assert sorted(r["rank"] for r in found if r["query"] == 3) == list(range(1, 1 + sum(r["query"] == 3 for r in found)))
    fused = {r["doc"] for r in extension.retrieve("hybrid_rrf", docs, queries, 10).where("query = 3").collect()}
    either = {r["doc"] for n in ("bm25", "dense") for r in extension.retrieve(n, docs, queries, 10).where("query = 3").collect()}
    assert fused <= either
    with pytest.raises(ValueError):
        extension.retrieve("bm25", docs, queries, 9)
    with pytest.raises(ValueError):
        extension.retrieve("nobody", docs, queries, 10)


def test_embedders_scorers_and_schema_differences(spark):
    df = spark.createDataFrame([("ab", "abc"), (None, "x")], "a string, b string")
    rows = df.select(
        extension.embed(F.col("a"), lambda: lambda texts: [[float(len(t))] for t in texts]).alias("v"),
        extension.score_pairs(F.col("a"), F.col("b"), lambda: lambda pairs: [len(x) / len(y) for x, y in pairs]).alias("s"),
    ).collect()
    assert [r["v"] for r in rows] == [[2.0], [0.0]] and rows[0]["s"] == pytest.approx(2 / 3) and rows[1]["s"] == 0
    left = {"type": "object", "properties": {"a": {"type": "string"}, "b": [1, 2]}}
    right = {"type": "object", "properties": {"a": {"type": "long"}, "b": [1], "c": {}}}
    assert extension.schema_diff(left, right) == ["$.properties.c: only on the right", "$.properties.a.type: 'string' and 'long'", "$.properties.b: lengths 2 and 1"]
    assert extension.schema_diff(left, left) == []


def test_concentration_and_agreement_of_paths(spark):
    rng = random.Random(6)
    rows = [(p, q, d, r) for p in ("a", "b", "c") for q in range(6) for r, d in enumerate(rng.sample(range(40), rng.choice([1, 2, 6, 10])), 1)]
    ranked = spark.createDataFrame(rows, "path string, query int, doc int, rank int")
    cluster = {r["doc"]: r["c"] for r in spark.range(40).select(F.col("id").cast("int").alias("doc")).withColumn("c", F.pmod(F.xxhash64("doc"), F.lit(4))).collect()}
    entropy = {r["query"]: r["concentration"] for r in fusion.rank_entropy(ranked).collect()}
    agreement = {r["query"]: r["agreement"] for r in fusion.path_agreement(ranked).collect()}
    for q in range(6):
        sets = {p: {d for a, b, d, _ in rows if (a, b) == (p, q)} for p in "abc"}
        docs = set().union(*sets.values())
        sizes = [sum(cluster[d] == c for d in docs) / len(docs) for c in range(4)]
        want = 0.5 if len(docs) < 4 else 1 + sum(p * math.log2(p) for p in sizes if p) / 2
        assert entropy[q] == pytest.approx(want, abs=1e-6)
        pairs = [(sets[x], sets[y]) for x, y in ("ab", "ac", "bc")]
        assert agreement[q] == pytest.approx(sum(len(x & y) / len(x | y) for x, y in pairs) / 3, abs=1e-6)
