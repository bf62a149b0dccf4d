"""Id columns with the names of results, or with characters that need quoting."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratasift.llm import packing, simhash

ROWS = [(1, "some words of a text"), (2, None), (None, "other words")]


@pytest.mark.parametrize("name", ["start", "offset", "length", "sequence_id", "n.m", "a`b"])
def test_packing_takes_any_id_name(spark, name):
    df = spark.createDataFrame(ROWS, "i long, t string").withColumn("ids_crc32", F.lit("clash")).withColumnRenamed("i", name)
    out = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), name, "t", with_ids=False)
    expected = "id" if name in ("start", "offset", "length", "sequence_id") else name
    assert sorted(out.columns) == sorted([expected, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    assert sorted(str(r[expected]) for r in out.collect()) == ["1", "2", "None"]


@pytest.mark.parametrize("name", ["fingerprint", "component_id", "fp", "n.m", "a`b"])
def test_simhash_takes_any_id_name(spark, name):
    df = spark.createDataFrame(ROWS, "i long, t string").withColumn("least", F.lit("clash")).withColumnRenamed("i", name)
    out = simhash.simhash_components(df, name, "t")
    assert out.columns == ["id" if name in ("fingerprint", "component_id") else name, "fingerprint", "component_id"]
    assert len(out.collect()) == 3
