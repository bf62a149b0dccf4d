import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratasift.llm import ppm


def brute(docs):
    """Scores by a dictionary trie, one byte at a time."""
    words = {k: (t or "").encode().lower().split() for k, t in docs}
    train = [k for k, _ in docs if not ppm.is_held_out(k)]
    counts = defaultdict(Counter)
    unigram = Counter()
    texts = {k: (t or "").encode() for k, t in docs}
    end = bytes([ppm.END])
    pad = end * ppm.ORDER
    for k in train:
        unigram.update(words[k] + [b""])
        s = pad + texts[k] + end
        for i in range(ppm.ORDER, len(s)):
            for order in range(ppm.ORDER + 1):
                counts[s[i - order : i]][s[i]] += 1
    n, v = sum(unigram.values()), len(unigram)
    out = {}
    for k, _ in docs:
        s, score = pad + texts[k] + end, 0.0
        for i in range(ppm.ORDER, len(s)):
            shut = set()
            for order in range(ppm.ORDER, -1, -1):
                here = {b: c for b, c in counts.get(s[i - order : i], {}).items() if b not in shut}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                if s[i] in here:
                    score += math.log10(here[s[i]] / whole)
                    break
                score += math.log10(len(here) / whole)
                shut |= here.keys()
            else:
                score -= math.log10(256 - len(shut))
        c = [unigram[w] for w in words[k] + [b""]]
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in c)
        out[k] = (ppm.zlib.crc32(str(k).encode()) % 7 == 2, len(c), sum(x > 0 for x in c), n, base, score)
    return out


def check(spark, docs, rows=None):
    got = {r["doc_id"]: r for r in ppm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    for k, (held, n, known, total, base, score) in want.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] == pytest.approx(score, abs=1e-6)


def test_scores_equal_a_dictionary_trie(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ppm, "STEP_BYTES", 700)
    rng = random.Random(5)
    vocabulary = ["the", "of", "Éan", "thing", "ing", "a", "ou", "x" * 30, "ciónta,", "And"]
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "unseen øøø words " * 40), (1003, "the " * 3000)]
    docs += [(1004, docs[0][1].upper() + "\r\n"), (1005, "\n"), (1006, "\ufffd\x00\x7f")]
    check(spark, docs)


def test_case_and_layout_change_the_score(spark):
    docs = [(i, "One line. Another line.\nA third") for i in range(20)]
    other = next(i for i in range(100, 200) if not ppm.is_held_out(i))
    rows = {r["doc_id"]: r for r in ppm.score_documents(spark.createDataFrame([*docs, (other, "one line.\nanother line. a third")], "doc_id long, text string")).collect()}
    assert rows[0]["base_score"] == rows[other]["base_score"]
    assert rows[0]["score"] > rows[other]["score"] + 1


def test_a_very_long_text(spark):
    rng = random.Random(11)
    check(spark, [(0, " ".join(rng.choices(["abc", "de", "Fgh", "x"], k=100_000))), (1, "abc de"), (2, None)])


def test_empty_table_and_no_training_document(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score_documents(empty).count() == 0
    held = next(i for i in range(100) if ppm.is_held_out(i))
    (row,) = ppm.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert row["score"] == pytest.approx(-3 * math.log10(256))
    assert row["base_score"] == 0


def test_repeated_rows_null_ids_and_extra_columns(spark):
    df = spark.createDataFrame(
        [(1, "a b", "x"), (1, "a b", "x"), (None, "a c", "y")], "doc_id long, text string, score string"
    )
    rows = ppm.score_documents(df).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]


def test_scores_do_not_depend_on_the_shards():
    rng = np.random.default_rng(7)
    texts = [b" ".join(bytes(rng.choice(list(b"abcdef"), 5).tolist()) for _ in range(40)) for _ in range(5)] + [b"fz zq", b"qa dzb"]
    codes, starts = ppm.window_codes(texts)
    known, counts = ppm.sorted_counts(codes[: starts[6]])
    asked = np.setdiff1d(codes, known)
    code, count = np.r_[known, asked], np.r_[counts, np.zeros(len(asked), np.int64)]
    order = np.argsort(code)
    code, count = code[order], count[order]
    triple, where = np.unique(code & 0xFFFFFF, return_inverse=True)
    low = ppm.Triples(triple, np.bincount(where, count).astype(np.int64))
    whole = ppm.log_probabilities(code, count, low)
    shard = (code >> 8) & 0xFFFFFF
    assert len(np.unique(shard)) > 100
    for x in np.unique(shard):
        mine = shard == x
        assert ppm.log_probabilities(code[mine], count[mine], low) == pytest.approx(whole[mine], abs=1e-12)


@pytest.mark.parametrize("partitions", [1, 64])
def test_scores_agree_for_any_number_of_partitions(spark, partitions):
    rng = random.Random(8)
    docs = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(20))) for i in range(60)]
    docs += [(100 + i, " ".join(rng.sample("az bz qa dzb fzx hq".split(), 4))) for i in range(30)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(spark, docs)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
