"""Metrics, manifests, blockers, batches, trust claims, approval, answers and images."""

import pytest
from pyspark.sql import functions as F

from stratasift.operators import answering, approval, evidence
from stratasift.sources import images


def test_metrics_reproduce_or_not(spark):
    def t(rows):
        return spark.createDataFrame(rows, "metric string, value double")

    published = t([("recall", 0.5), ("ndcg", 0.7), ("sample_count", 10.0), ("mrr", None), ("gone", 0.1)])
    found = evidence.metric_mismatches(published, t([("recall", 0.509), ("ndcg", 0.72), ("sample_count", 10.005), ("mrr", 0.4)]), 0.01)
    assert {r["metric"]: r["problem"] for r in found.collect()} == {"ndcg": "differs", "sample_count": "differs", "gone": "not_recomputed"}
    with pytest.raises(ValueError):
        evidence.metric_mismatches(published, published, -1)


def test_manifest_problems(spark):
    assets = spark.createDataFrame(
        [("a", "SYNTHETIC", "m"), ("b", "SYNTHETIC", ""), ("c", "NEW", None), (None, "PUBLIC", None), ("d", "", None), ("e", "PUBLIC", "lost"), ("gone", "PUBLIC", None)],
        "path string, class string, marker string",
    )
    tracked = spark.createDataFrame([(p,) for p in ("a", "b", "c", "e", "m", "stray", "stray")], "path string")
    inventory = spark.createDataFrame([(p,) for p in ("a", "b", "c", "gone")], "path string")
    found = sorted((str(r["path"]), r["problem"]) for r in evidence.manifest_problems(assets, tracked, ["SYNTHETIC", "PUBLIC"], inventory).collect())
    assert found == [
        ("None", "incomplete"), ("b", "no_marker"), ("c", "undeclared_class"), ("d", "incomplete"), ("e", "marker_absent"), ("e", "not_in_inventory"),
        ("gone", "missing"), ("m", "undeclared"), ("stray", "undeclared"),
    ]


def test_blockers_keep_their_order(spark):
    runs = spark.createDataFrame([(False, True, True)], "executed boolean, ok boolean, made boolean")
    report = spark.createDataFrame([("verified", 0), ("b", 2), ("a", 1)], "code string, n long")
    rows = evidence.publication_blockers(runs, F.col("ok"), F.col("made"), report).orderBy("place").collect()
    assert [r["blocker"] for r in rows] == ["no_configuration_executed", "synthetic_retriever", "source_approval_not_verified: a×1, b×2"]
    good = spark.createDataFrame([(True, True, False)], "executed boolean, ok boolean, made boolean")
    fine = spark.createDataFrame([("verified", 1)], "code string, n long")
    assert evidence.publication_blockers(good, F.col("ok"), F.col("made"), fine).count() == 0
    nothing = evidence.publication_blockers(good, F.col("ok"), F.col("made"), fine.limit(0)).collect()
    assert [r["blocker"] for r in nothing] == ["source_approval_not_verified: no evidence collected"]


def test_batches_of_the_ring(spark, monkeypatch):
    monkeypatch.setattr(evidence, "RING", 3)
    rows = [("k", i, i, float(10 * i), 10.0) for i in range(5)] + [("z", 0, 4, 0.0, 0.0)]
    found = {r["g"]: r for r in evidence.batch_statistics(spark.createDataFrame(rows, "g string, t int, items int, queue_ms double, inference_ms double"), "g", ["t"], 4).collect()}
    k = found["k"]
    assert (k["n_batches"], k["n_items"], k["fill_rate"], k["queue_p50"], k["queue_p99"], k["delay_p99"]) == (5, 10, 0.75, 30.0, 40.0, 50.0)
    assert found["z"]["utilisation"] == 0.0


def test_trust_needs_a_default(spark):
    df = spark.createDataFrame([("a/b",), ("c/d",), (None,)], "p string")
    claim = evidence.trust_claim(F.col("p"), [("/a/*", "UNTRUSTED")], "MANAGED_INTERNAL")
    assert [r[0] for r in df.select(claim).collect()] == ["UNTRUSTED", "MANAGED_INTERNAL", "MANAGED_INTERNAL"]
    for rules, default in (([], None), ([("x", "SOME")], "UNTRUSTED"), ([], "ANY")):
        with pytest.raises(ValueError):
            evidence.trust_claim(F.col("p"), rules, default)


CHUNK = "chunk_id string, source_id string, epoch string, approval_status string, approval_actor string, approved_content_hash string, content_hash string, trust_class string"


def chunk(i, source="s", epoch="e", status="APPROVED", actor="x", approved="h", content="h", trust="APPROVED_EXTERNAL"):
    return (i, source, epoch, status, actor, approved, content, trust)


def test_a_sound_index_is_verified_and_nothing_else(spark):
    ledger = spark.createDataFrame([("s", "APPROVED", "h")], "source_id string, status string, hash string")
    files = spark.createDataFrame([("s", "h")], "source_id string, hash string")

    def report(rows, gold=("1",), n=None, staged=False):
        chunks = spark.createDataFrame(rows, CHUNK)
        asked = spark.createDataFrame([(g,) for g in gold], "chunk_id string")
        declared = spark.createDataFrame([(len(rows) if n is None else n,)], "n long")
        return {r["code"]: r["n"] for r in approval.approval_report(chunks, ledger, files, asked, "e", declared, staged).collect()}

    good = [chunk("1"), chunk("2")]
    assert report(good) == {"verified": 1}
    assert report(good, staged=True) == {"built_for_staging": 1, "verified": 0}
    assert report(good, n=3) == {"index_read_incomplete": 1, "verified": 0}
    assert report(good, gold=("1", "9")) == {"gold_chunk_not_indexed": 1, "verified": 0}
    assert report([], gold=()) == {"index_is_empty": 1, "verified": 0}
    assert report([*good, chunk("3", epoch="old")]) == {"other_epoch": 1, "gold_chunk_unverified_source": 1, "verified": 0}
    assert report([*good, chunk("3", content="k", approved="k")], gold=()) == {"hash_varies_within_source": 1, "verified": 0}
    assert set(report([*good, chunk("3", source=None)], gold=())) >= {"no_source", "missing_source_id", "not_in_ledger", "source_file_missing"}


def test_answers_rest_on_visible_documents(spark):
    questions = spark.createDataFrame([(1, "red apples", True, True, False), (2, "green pears", False, False, False), (3, "nothing", False, True, True)], "query int, text string, is_regulation boolean, is_complex boolean, conservative boolean")
    recalled = spark.createDataFrame([("bm25_es", 1, 10, 1), ("bm25_es", 1, 11, 2), ("rewrite_variants", 1, 11, 1), ("rewrite_variants", 2, 12, 1), ("bm25_es", 2, 13, 1)], "path string, query int, doc int, rank int")
    fallback = spark.createDataFrame([(1, 14, 1), (1, 10, 2), (2, 12, 1)], "query int, doc int, rank int")
    visible = spark.createDataFrame([(d,) for d in (11, 12, 13)], "doc int")
    bodies = spark.createDataFrame([(d, f"body of {d} " * 9) for d in range(10, 15)], "doc int, body string")
    out = answering.answer_questions(questions, recalled, fallback, visible, bodies, lambda q, b: F.lit(0.9), lambda q, b: b)
    rows = {r["query"]: r for r in out.collect()}
    # Document 10 is hidden and so is the fallback's 14; the simple question doesn't use variants, but falls back on 12.
    assert (rows[1]["n_recalled"], rows[1]["locked"], rows[1]["outcome"]) == (1, "11", "answered")
    assert (rows[2]["n_recalled"], rows[2]["n_fallback"], rows[2]["locked"]) == (2, 1, "12,13")
    assert (rows[3]["n_recalled"], rows[3]["decision"], rows[3]["outcome"], rows[3]["answer"]) == (0, "reject", "rejected_by_evidence_gate", None)


def test_sizes_of_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (70_000).to_bytes(4, "big")
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (2).to_bytes(2, "little") + b"xxxx"
    bmp = b"BM" + bytes(16) + (12).to_bytes(4, "little") + (34).to_bytes(4, "little")
    df = spark.createDataFrame([(png,), (gif,), (bmp,), (b"no",), (b"",), (None,)], "c binary")
    got = [r[0] and tuple(r[0]) for r in df.select(images.image_shape(F.col("c"))).collect()]
    assert got == [("png", 640, 70_000), ("gif", 300, 2), ("bmp", 12, 34), None, None, None]


def test_what_counts_several_times(spark):
    blocks = [("core", 0.7, 40.0, 40.0, 60.0, 61.0), ("edge", 0.9, 0.0, 40.0, 40.0, 61.0), ("small", 0.9, 40.0, 40.0, 60.0, 60.0), ("unsure", 0.69, 40.0, 40.0, 60.0, 80.0), ("", 0.9, 40.0, 40.0, 60.0, 80.0), (None, 0.9, 40.0, 40.0, 60.0, 80.0)]
    df = spark.createDataFrame([(blocks, 100, 100), ([], 100, 100), (None, 100, 100)], f"blocks array<{images.BLOCK}>, w int, h int")
    assert [r[0] for r in df.select(images.weighted_text(F.col("blocks"), F.col("w"), F.col("h"))).collect()] == ["core core core edge small unsure", "", None]


def test_pressure_over_block_borders(spark, monkeypatch):
    from stratasift.operators import ops

    monkeypatch.setattr(ops, "PRESSURE_BLOCK", 7)
    rows = [(n, i, float(i % 5 + n)) for n in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "node int, t int, c double")
    got = {(r["node"], r["t"]): r["pressure"] for r in ops.running_pressure(df, ["t"], F.col("c"), 10.0, 4).collect()}
    want = {(n, i): round(sum(c for m, j, c in rows if m == n and i - 3 <= j <= i) / 10.0, 6) for n, i, _ in rows}
    assert got == want


def test_annotations_of_a_missing_file(spark, tmp_path):
    from stratasift.sources import readers

    with pytest.raises(FileNotFoundError):
        readers.read_annotations(spark, f"file://{tmp_path}/none", "a long")
    (tmp_path / "empty").write_text("")
    assert readers.read_annotations(spark, f"file://{tmp_path}/empty", "a long").count() == 0


def test_chunks_beyond_a_document(spark):
    from stratasift.operators import contracts

    index = spark.createDataFrame([(1, "e", 3), (2, "e", 0)], "doc int, epoch string, n int")
    notes = spark.createDataFrame([(1, "e", 2), (1, "e", 3), (1, "f", 0), (2, "e", 0), (3, "e", 0)], "doc int, epoch string, chunk_index int")
    left = contracts.unresolved_chunks(notes, index, ["doc", "epoch"]).collect()
    assert sorted(map(tuple, left)) == [(1, "e", 3), (1, "f", 0), (2, "e", 0), (3, "e", 0)]
