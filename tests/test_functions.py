import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from stratasift.functions import access, ids, redaction, rules, text, vectors


def one(spark, *columns, data=((1,),), schema="x int"):
    return spark.createDataFrame(list(data), schema).select(*columns).first()


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize("n,count", [(0, 0), (1, 1), (500, 1), (501, 2), (950, 2), (951, 3)])
def test_character_windows(spark, n, count):
    (w,) = one(spark, text.char_windows(lit("a" * n)))
    assert len(w) == count
    assert sum(map(len, w)) == n + max(0, count - 1) * 50


def test_uuid5_and_buckets(spark):
    name, key = "doc:é:1", "7:exp1"
    u, b = one(spark, ids.uuid5(lit(name)), ids.md5_bucket(lit(key)))
    assert u == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert b == int(hashlib.md5(key.encode()).hexdigest(), 16) % 10_000


def test_relevance_key_prefers_the_pair(spark):
    row = one(
        spark,
        ids.relevance_key(lit("d"), lit("c")),
        ids.relevance_key(lit(""), lit("c")),
        ids.relevance_key(lit("d"), lit("")),
        ids.relevance_key(lit(""), lit(None).cast("string"), lit("s")),
    )
    assert list(row) == ["d::c", "c", "d", "s"]


@pytest.mark.parametrize(
    "role,dept,expected",
    [(0, 0, True), (2, 0, True), (4, 0, False), (2, 8, False), (None, 0, False), (-1, 0, False), (1 << 32, 0, False)],
)
def test_authorisation_fails_closed(spark, role, dept, expected):
    r, d = F.lit(role).cast("long"), F.lit(dept).cast("long")
    (ok,) = one(spark, access.is_authorized(r, F.lit(2).cast("long"), d, F.lit(4).cast("long")))
    assert ok is expected


def test_admin_sees_all_but_documents_without_masks(spark):
    admin, zero = F.lit(0xFFFFFFFF).cast("long"), F.lit(0).cast("long")
    row = one(
        spark,
        access.is_authorized(F.lit(8).cast("long"), admin, F.lit(8).cast("long"), zero),
        access.is_authorized(F.lit(None).cast("long"), admin, zero, zero),
    )
    assert list(row) == [True, False]


def test_default_epoch_owns_rows_without_one(spark):
    null = F.lit(None).cast("string")
    row = one(spark, access.in_epoch(null, "default"), access.in_epoch(null, "e1"), access.in_epoch(lit("e1"), "e1"))
    assert list(row) == [True, False, True]


def test_first_glob_wins_and_star_crosses_slashes(spark):
    c = access.first_glob(F.col("p"), [("a/*.txt", 1), ("a/*", 2)], 9)
    got = [r[0] for r in spark.createDataFrame([("a/b/c.txt",), ("a/x",), ("b",)], "p string").select(c).collect()]
    assert got == [1, 2, 9]
    with pytest.raises(ValueError):
        access.first_glob(F.col("p"), [], None)


def test_vectors(spark):
    a = F.array(*map(F.lit, (3.0, 4.0)))
    b = F.array(*map(F.lit, (0.0, 0.0)))
    row = one(spark, vectors.cosine(a, a), vectors.cosine(a, b), vectors.valid_vector(a, 2), vectors.valid_vector(a, 3))
    assert row[0] == pytest.approx(1.0) and list(row)[1:] == [None, True, False]


def test_similarity_of_empty_texts(spark):
    row = one(spark, text.ngram_jaccard(lit(""), lit("abc")), *text.overlap_entailment(lit(""), lit("abc")))
    assert list(row) == [0.0, 0.1, 0.3]


def test_gates(spark):
    yes, no = lit(True), lit(False)
    row = one(
        spark,
        rules.evidence_decision(lit(0.76), lit(0.5), no),
        rules.evidence_decision(lit(0.76), lit(0.1), no),
        rules.evidence_decision(lit(0.76), lit(0.5), yes),
        rules.answer_verdict(lit(0.1), lit(0.0), yes, yes)[0],
        rules.answer_verdict(lit(0.1), lit(0.0), no, yes)[0],
        rules.answer_verdict(lit(0.3), lit(0.55), yes, yes)[0],
        rules.answer_verdict(lit(0.3), lit(0.55), no, yes)[0],
        rules.answer_verdict(lit(0.0), lit(0.9), yes, no)[0],
    )
    assert list(row) == ["pass", "enhanced_generate", "enhanced_generate", False, True, False, True, True]


def test_trust_pairs(spark):
    row = one(
        spark,
        rules.trust_class(lit("MANAGED_INTERNAL"), lit("APPROVED")),
        rules.trust_class(lit("UNTRUSTED_EXTERNAL"), lit("APPROVED")),
        rules.trust_class(lit("UNTRUSTED_EXTERNAL"), lit("REJECTED")),
    )
    assert list(row) == [None, "APPROVED_EXTERNAL", "UNTRUSTED"]


def test_redaction(spark):
    m = F.create_map(lit("apiKey"), lit("x"), lit("detail"), lit("Bearer abc"), lit("auth_env"), lit("y"))
    row = one(
        spark,
        redaction.redact_map(m),
        redaction.strip_userinfo(lit("https://u:p@h/x")),
        redaction.client_ip(lit("1.2.3.4, 8.8.8.8, 10.0.0.2"), lit("10.0.0.1"), [("10.0.0.0", 8)]),
        redaction.client_ip(lit("1.2.3.4"), lit("9.9.9.9"), [("10.0.0.0", 8)]),
    )
    assert row[0] == {"apiKey": "[REDACTED]", "detail": "[REDACTED]", "auth_env": "y"}
    assert list(row)[1:] == ["https://h/x", "8.8.8.8", "9.9.9.9"]


def test_tokens_of_cjk_and_words(spark):
    (got,) = one(spark, text.cjk_and_word_tokens(lit("法规标准 ABC abc")))
    assert sorted(got) == ["abc", "标准", "法规", "规标"]


def test_longest_common_substring(spark):
    (n,) = one(spark, text.longest_common_substring(lit("xxabcdyy"), lit("zabcdz")))
    assert n == 4


@pytest.mark.parametrize(
    "key,secret",
    [(f"x_{m[:3]}-{m[3:]}Y", True) for m in redaction.SECRET_MARKERS]
    + [(f"my.{s.upper()}", True) for s in redaction.SECRET_SUFFIXES]
    + [("is_private", False), ("auth_env_presence", False), ("jwt_count", False), ("signature_ok", False), ("note", False), ("", False)],
)
def test_secret_keys(spark, key, secret):
    (found,) = one(spark, redaction.is_secret_key(lit(key)))
    assert found is secret
    assert redaction.redact_value({key: {"a": 1}}) == {key: "[REDACTED]" if secret else {"a": 1}}


def test_nested_redaction(spark):
    deep = {"note": "ok"}
    for _ in range(14):
        deep = {"in": deep}
    value = {"meta": {"api-Key": "k"}, "list": ["Bearer x", "eyJhbGciOi.eyJzdWIiOjE.sig", "plain", 1, None], "EYJHBGCIOI.EYJZDWIIOJE.sig": "kept"}
    want = {"meta": {"api-Key": "[REDACTED]"}, "list": ["[REDACTED]", "[REDACTED]", "plain", 1, None], "EYJHBGCIOI.EYJZDWIIOJE.sig": "kept"}
    assert redaction.redact_value(value) == want
    assert redaction.redact_value("EYJHBGCIOI.EYJZDWIIOJE.sig") == "EYJHBGCIOI.EYJZDWIIOJE.sig"
    assert "note" not in json.dumps(redaction.redact_value(deep))
    row = one(spark, redaction.redact_json(lit(json.dumps(value))), redaction.redact_json(lit("{broken")), redaction.redact_json(lit(None).cast("string")))
    assert json.loads(row[0]) == want and list(row)[1:] == ["[REDACTED]", None]


def test_attributes_and_request_ids(spark):
    m = F.create_map(*map(lit, ("a", "x" * 300, "token", "t", "other", "o")))
    row = one(
        spark,
        redaction.allowed_attributes(m, ["a", "token"]),
        redaction.request_id(lit("r-1.x"), lit("new")),
        redaction.request_id(lit("bad id\n"), lit("new")),
        redaction.request_id(lit("x" * 65), lit("new")),
    )
    assert row[0] == {"a": "x" * 256, "token": "[REDACTED]"}
    assert list(row)[1:] == ["r-1.x", "new", "new"]


def test_cache_keys_and_epoch_names(spark):
    null = F.lit(None).cast("string")
    row = one(
        spark,
        ids.cache_key(q=lit("x"), a=lit(1)),
        ids.cache_key(a=lit(1), q=lit("x")),
        ids.cache_key(a=lit(1), q=null),
        ids.epoch_name(F.lit("2024-03-05 06:07:08").cast("timestamp")),
    )
    assert row[0] == row[1] == hashlib.sha256(b'{"a":1,"q":"x"}').hexdigest()
    assert row[2] == hashlib.sha256(b'{"a":1,"q":null}').hexdigest() and row[3] == "20240305_060708"


def test_normal_forms_and_cuts(spark):
    row = one(spark, text.nfkc_passage(lit(" ﬁ  Ａ\n²")), text.token_cut(lit("a" * 900)), text.token_cut(lit("b" * 150)), text.token_cut(lit("c" * 50)))
    assert row[0] == "fi A 2" and [len(x) for x in list(row)[1:]] == [600, 128, 50]


def test_blocks_are_packed_greedily():
    blocks = ["a" * 200, "", "b" * 250, None, "c" * 49, "d" * 501, "e"]
    packed = text.pack_blocks(blocks, 500, 50)
    assert [c["blocks"] for c in packed] == [[0, 2], [4], [5], [5], [6]]
    assert [len(c["text"]) for c in packed] == [451, 49, 500, 51, 1]
    # 451 and one line end and 49 are 501 characters; one less, and they share a chunk.
    assert [c["blocks"] for c in text.pack_blocks(["a" * 200, "b" * 250, "c" * 48], 500, 50)] == [[0, 1, 2]]
    assert text.pack_blocks([], 500, 50) == []


def test_failures_and_retries(spark):
    row = one(
        spark,
        rules.path_failure(lit("ValueError"), lit("bad shape"))[0],
        rules.path_failure(lit("RuntimeError"), lit("CLIP died"))[1],
        rules.path_failure(lit("RuntimeError"), lit("else"))[0],
        rules.transport_failure(F.lit(503), F.lit(None).cast("string")),
        rules.transport_failure(F.lit(500), lit("ReadTimeout")),
        rules.transport_failure(F.lit(None).cast("int"), lit("RemoteProtocolError")),
        rules.backoff_delay(F.lit(3), F.lit(None).cast("double"), 0.5, 8.0),
        rules.backoff_delay(F.lit(9), F.lit(1.0), 0.5, 8.0),
        rules.backoff_delay(F.lit(1), F.lit(9.0), 0.5, 8.0),
        rules.retry_after(lit("nan")),
    )
    assert list(row) == ["dimension_mismatch", "loader_error", "unknown", "http_transient", "http_permanent", "connection", 2.0, 8.0, None, None]


@pytest.mark.parametrize("t,found", [("苯甲醇", True), ("甲醇", False), ("苯甲醇, 甲醇", False), ("none", False), ("甲醇甲醇", True)])
def test_terms_inside_longer_names(spark, t, found):
    (got,) = one(spark, text.only_embedded(lit(t), "甲醇"))
    assert got is found
