"""Publications, imports, manifests, scans, extraction, sessions and the feedback cycle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratasift.operators import content_scan, corpus_manifest, extraction
from stratasift.operators.corpus_manifest import CorpusManifest
from stratasift.operators.decision_import import import_decisions
from stratasift.operators.feedback_cycle import FeedbackStore
from stratasift.sources.publication import Publication, PublicationError
from stratasift.staging import new_folder
from stratasift.streaming import dialogues


# Imports

CANDIDATE = "sample_id long, grade int, annotator string, hash string"
DECISION = "sample_id long, verdict string, grade int, reviewer string, hash string"


def imported(spark, decisions, candidates=((1, 0, "ann", "h1"), (2, 1, "ann", "h2"), (3, 1, "bob", "h3")), target=None, apply=True):
    target = target or Publication(spark, new_folder(spark, "test-import"))
    refusals = import_decisions(spark.createDataFrame(list(candidates), CANDIDATE), spark.createDataFrame(decisions, DECISION), target, apply)
    return target, {r["sample_id"]: r["refusal"] for r in refusals.collect()}


def test_good_decisions_are_published_together(spark):
    target, refusals = imported(spark, [(1, "accept", None, "eve", "h1"), (2, "MODIFY", 5, "eve", "h2")])
    assert refusals == {} and target.version() == 1
    assert {r["sample_id"]: r["grade"] for r in target.read("reviewed").collect()} == {1: 0, 2: 5}
    assert [r["sample_id"] for r in target.read("drafts").collect()] == [3]
    assert target.read("rejected").count() == 0
    with pytest.raises(PublicationError):
        target.read("other")


@pytest.mark.parametrize(
    ("bad", "why"),
    [
        ([(1, "ACCEPT", None, "ann", "h1")], "reviewer is the annotator"),
        ([(1, "ACCEPT", None, " ", "h1")], "no named reviewer"),
        ([(1, "ACCEPT", None, None, "h1")], "no named reviewer"),
        ([(1, "ACCEPT", None, "eve", "old")], "signed for another candidate"),
        ([(1, "ACCEPT", None, "eve", None)], "signed for another candidate"),
        ([(1, "PERHAPS", None, "eve", "h1")], "unknown verdict"),
        ([(1, "MODIFY", None, "eve", "h1")], "modified without a value"),
        ([(1, "REJECT", None, "eve", "h1"), (1, "ACCEPT", None, "eve", "h1")], "more than one decision"),
        ([(9, "ACCEPT", None, "eve", "h9")], "no such candidate"),
    ],
)
def test_one_bad_decision_publishes_nothing(spark, bad, why):
    target, _ = imported(spark, [(2, "ACCEPT", None, "eve", "h2")])
    before = sorted(map(tuple, target.read("reviewed").collect()))
    _, refusals = imported(spark, [(3, "REJECT", None, "eve", "h3"), *bad], target=target)
    assert list(refusals.values()) == [why]
    assert target.version() == 1 and sorted(map(tuple, target.read("reviewed").collect())) == before
    assert target.read("rejected").count() == 0


def test_unsigned_rows_are_drafts_and_dry_runs_write_nothing(spark):
    target, refusals = imported(spark, [(1, None, None, None, None), (2, "", None, None, None)])
    assert refusals == {} and target.read("drafts").count() == 3
    target, refusals = imported(spark, [(1, "ACCEPT", None, "eve", "h1")], apply=False)
    assert refusals == {} and target.version() is None


def test_a_publication_that_dies_is_not_seen(spark):
    target = Publication(spark, new_folder(spark, "test-publication"))
    target.publish({"a": spark.range(3)})
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        target.publish({"a": spark.range(5), "b": broken})
    assert target.version() == 1 and target.read("a").count() == 3
    assert target.publish({"a": spark.range(4)}) == 2 and target.read("a").count() == 4 and target.read("a", 1).count() == 3


# Manifests


def manifest_of(spark, rows, depth=None):
    df = spark.createDataFrame(rows, "key string, content string, epoch string")
    out = CorpusManifest(spark, new_folder(spark, "test-manifest"))
    out.write(corpus_manifest.leaves(df, F.col("key"), {"content": F.col("content"), "epoch": F.col("epoch")}), depth)
    return out


def test_differences_are_found_by_descending(spark):
    rows = [(f"k{i}", f"text {i}", "e1") for i in range(3000)]
    mine = manifest_of(spark, rows)
    assert mine.depth() == 2
    assert mine.root_digest() == manifest_of(spark, rows[::-1], 2).root_digest()
    other = [r for r in rows if r[0] != "k7"]
    other[100] = (other[100][0], "changed", "e1")
    other[200] = (other[200][0], other[200][1], None)
    other.append(("new", "text", "e1"))
    theirs = manifest_of(spark, other, mine.depth())
    found = {r["key"]: (r["problem"], r["facets"]) for r in corpus_manifest.differences(mine, theirs).collect()}
    assert found == {"k7": ("missing", []), "new": ("unexpected", []), other[100][0]: ("changed", ["content"]), other[200][0]: ("changed", ["epoch"])}
    # Of 256 bottom nodes only those of the four rows are opened.
    assert 0 < corpus_manifest.open_nodes(mine, theirs).count() <= 4
    assert corpus_manifest.differences(mine, mine).count() == 0


def test_manifest_edges(spark):
    empty, one = manifest_of(spark, []), manifest_of(spark, [("a", None, "")], 0)
    assert empty.root_digest() is None and empty.depth() == 0
    assert [(r["key"], r["problem"]) for r in corpus_manifest.differences(one, empty).collect()] == [("a", "missing")]
    assert corpus_manifest.differences(one, manifest_of(spark, [("a", None, None)], 0)).collect()[0]["facets"] == ["epoch"]
    for bad in ([("a", "x", "e"), ("a", "y", "e")], [(None, "x", "e")]):
        with pytest.raises(ValueError):
            manifest_of(spark, bad)


# Scans and extraction


def test_scanner_takes_the_first_pattern_of_each_family():
    s = content_scan.Scanner(content_scan.CONTENT_PATTERNS, content_scan.TECHNICAL_CONTEXT)
    assert s.line("The former employer gave a job application") == [("career", "prior-employer reference")]
    assert s.line("简历 derived from production traffic") == [("career", "résumé material"), ("scale", "tuning provenance")]
    assert s.line("rerank the former employer") == [] and s.line("former employer " + "x" * 2000) == []
    assert s.line("FORMER EMPLOYER") and not s.line("informer employers")
    every = content_scan.Scanner((content_scan.Pattern("n", "number", r"\d{3}"),), None)
    assert every.line("a 123") == [("n", "number")] and every.line("a 12") == []


def test_automaton_finds_what_the_patterns_alone_find():
    import random
    import re

    words = ["former employer", "job", "application", "post-employment", "面试", "官", "离职", "derived from", "a/b test", "open source", "derivative of", "rerank", "the company project experience", "recruiter facing", "x"]
    rng = random.Random(6)
    s = content_scan.Scanner(content_scan.CONTENT_PATTERNS, None)
    for _ in range(3000):
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
        want = {}
        for p in content_scan.CONTENT_PATTERNS:
            if p.family not in want and re.search(p.shape, line):
                want[p.family] = p.label
        assert dict(s.line(line)) == want


def test_articles_of_a_regulation(spark):
    text = "导语\n第一章 总则\n\n第一条 为了\n 细则 \n第二章 管理\n第二条 应当\n第三章 附则\n第十三条 施行\n末行\n解读\n第十四条 不算"
    df = spark.createDataFrame([(1, text), (2, "第一条 没有正文"), (3, None), (4, ""), (5, "第一章 只有章")], "id long, text string")
    found = extraction.articles(df, "id", F.col("text"), extraction.REGULATION).orderBy("article").collect()
    assert [(r["key"], r["article"], r["name"], r["chapter"], r["body"]) for r in found] == [
        (1, 1, "一", "第一章 总则", "第一条 为了\n细则"),
        (1, 2, "二", "第二章 管理", "第二条 应当"),
        (1, 3, "十三", "第三章 附则", "第十三条 施行\n末行"),
    ]


def test_first_object_of_an_answer(spark):
    cases = {
        'x {"a": "}"} y': '{"a": "}"}',
        'x {"a": {"b": "\\"}"}} {"c": 1}': '{"a": {"b": "\\"}"}}',
        '{no} {"a": 1}': '{"a": 1}',
        '5" {"a": 1} 6"': '{"a": 1}',
        "{": None,
        "": None,
        "}{": None,
        '{"open": {"a": 1}': '{"a": 1}',
    }
    df = spark.createDataFrame(list(enumerate([*cases, None])), "i long, t string")
    got = [r["o"] for r in df.select("i", extraction.first_object(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == [*cases.values(), None]


def test_an_answer_is_read_once(spark):
    """Of 50,000 characters with many braces, by a scan; the plan has one reading of the JSON text for all fields."""
    df = spark.createDataFrame([(1, "{ " * 40 + "x " * 25_000 + '{"intent": "late"}'), (2, None), (3, "{}")], "i long, t string")
    parsed = df.select("i", extraction.parsed_rewrite(F.col("t"), F.lit("q")).alias("p")).select("i", "p.*")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1 and "regexp_extract_all" not in plan
    got = {r["i"]: (r["rewritten_query"], r["intent"], r["confidence"]) for r in parsed.collect()}
    assert got == {1: ("q", "late", 0.5), 2: (None, None, None), 3: ("q", "general", 0.5)}


def test_a_manifest_has_no_more_levels_than_asked():
    from stratasift.operators.corpus_manifest import NODE_LEAVES, depth_for

    assert depth_for(NODE_LEAVES * 16**3 + 1) == 4
    assert [depth_for(n, 3) for n in (0, 64, 65, 1024, 16384, 16385, NODE_LEAVES * 16**3 + 1, 10**9)] == [0, 0, 1, 1, 2, 3, 3, 3]


def test_json_differences(spark):
    cases = [
        ('{"a": 1}', '{"a": 1}', []),
        ('{"a": 1, "b": [1, 2]}', '{"b": [1, 2], "a": 1}', []),
        ('{"a": 1}', '{"a": "1"}', [("a", "kind")]),
        ('{"a": {"b": 1}}', '{"a": [1]}', [("a", "kind")]),
        ('{"a": [1, 2]}', '{"a": [3]}', [("a", "length")]),
        ('[1, {"x": [true]}]', '[1, {"x": [false]}]', [("[1].x[0]", "value")]),
        ('{"a": {"b": {"c": 1}}}', "{}", [("a", "left only")]),
        ("[]", "{}", [("", "kind")]),
        ('{"n": null}', "{}", [("n", "left only")]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i long, a string, b string")
    got = {}
    for r in extraction.json_differences(df, "i", F.col("a"), F.col("b")).collect():
        got.setdefault(r["key"], []).append((r["path"], r["problem"]))
    assert got == {i: want for i, (_, _, want) in enumerate(cases) if want}


# Sessions and feedback


def test_sessions_end_and_belong_to_their_owner(spark):
    t0 = dt.datetime(2024, 1, 1)

    def at(minutes):
        return t0 + dt.timedelta(minutes=minutes)

    rows = [("a", "s", at(0), 1, "r1", None), ("a", "s", at(60), 2, "r2", "d1"), ("b", "s", at(61), 3, "x", "d9"), ("a", "s", at(179), 4, "r3", "d2"), ("a", "s", at(299), 5, "r4", None), (None, "s", at(300), 6, "n", None), ("", "s", at(301), 7, "e", None)]
    df = spark.createDataFrame(rows, "owner string, session string, ts timestamp, id long, round string, evidence string")
    got = {r["id"]: (r["frame"], r["evidence"], r["n_rounds"]) for r in dialogues.batch_sessions(df).collect()}
    assert got == {1: ("r1", None, 1), 2: ("r1|r2", "d1", 2), 3: ("x", "d9", 1), 4: ("r1|r2|r3", "d1", 3), 5: ("r4", None, 1), 6: ("n", None, 1), 7: ("n|e", None, 2)}


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"o{i % 3}", f"s{i % 2}", t0 + dt.timedelta(minutes=17 * i + (150 if i > 40 else 0)), i, f"r{i}", f"d{i}" if i % 5 == 3 else None) for i in range(80)]
    schema = "owner string, session string, ts timestamp, id long, round string, evidence string"
    folder = f"file://{tmp_path}/in"
    for k in range(4):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = dialogues.stream_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    from stratasift.streaming import events

    found = events.run_to_table(stream, "append")
    want = dialogues.batch_sessions(spark.createDataFrame(rows, schema)).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


LOG = "feedback_id string, ts timestamp, rating long, corrected boolean, answered boolean"


def test_feedback_runs_only_take_what_is_new(spark):
    t0 = dt.datetime(2024, 1, 1)
    store = FeedbackStore(spark, new_folder(spark, "test-feedback"), late_s=3600)

    def log(*rows):
        return spark.createDataFrame([(i, t0 + dt.timedelta(hours=h), rating, True, True) for i, h, rating in rows], LOG)

    assert store.collect(log(("a", 0, 0), ("b", 5, 1), ("a", 3, 1), (None, 4, 1))) == 2
    assert store.collect(log(("a", 0, 0), ("b", 5, 1))) == 0
    # Late rows within the hour count, older ones are behind the cursor.
    assert store.collect(log(("c", 4.5, 0), ("d", 1, 0), ("e", 9, 1))) == 2
    store.decide(spark.createDataFrame([("a", "accepted"), ("b", "accepted"), ("zz", "accepted"), ("c", "maybe")], "feedback_id string, status string"))
    store.decide(spark.createDataFrame([("b", "rejected")], "feedback_id string, status string"))
    assert {r["feedback_id"]: r["status"] for r in store.statuses().collect()} == {"a": "accepted", "b": "rejected", "c": "pending", "e": "pending"}
    assert sorted(r["dataset"] for r in store.datasets().collect()) == ["evaluation", "hard_negatives", "preference", "rewrite_corrections"]
    assert [r["feedback_id"] for r in store.regression_candidates().collect()] == ["a"]


def test_a_run_without_its_cursor_is_repeated(spark, monkeypatch):
    store = FeedbackStore(spark, new_folder(spark, "test-feedback"))
    row = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 0, True, True)], LOG)
    make = spark.createDataFrame

    def dies(data, schema=None, **_):
        if schema == "run int, cursor timestamp, n_new long" and data:
            raise RuntimeError("lost")
        return make(data, schema)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: dies(*a, **b))
    with pytest.raises(RuntimeError):
        store.collect(row)
    monkeypatch.undo()
    assert store.records().count() == 0 and store.collect(row) == 1 and store.collect(row) == 0
