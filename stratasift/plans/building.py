"""Queries that build chunk tables: block packing and epochs that carry unchanged documents on."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import ids, text
from stratasift.operators import corpus, lifecycle

from .catalog import register
from .corpus import _DIFF_SQL, _diff
from .fixtures import CHUNKS_SQL, chunks, table


@register(
    "block_chunks",
    """WITH RECURSIVE b AS (SELECT doc_id, x, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
      FROM (SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)) WHERE x <> ''),
    s AS (
      SELECT doc_id, i, CAST(CASE WHEN n > 500 THEN ceil((n - 50) / 450.0) ELSE 1 END AS BIGINT) AS next, CASE WHEN n > 500 THEN 0 ELSE n END AS held, CAST(0 AS BIGINT) AS chunk FROM b WHERE i = 1
      UNION ALL
      SELECT b.doc_id, b.i, CASE WHEN n > 500 THEN next + CAST(ceil((n - 50) / 450.0) AS BIGINT) WHEN held > 0 AND held + 1 + n <= 500 THEN next ELSE next + 1 END,
        CASE WHEN n > 500 THEN 0 WHEN held > 0 AND held + 1 + n <= 500 THEN held + 1 + n ELSE n END,
        CASE WHEN n <= 500 AND held > 0 AND held + 1 + n <= 500 THEN chunk ELSE next END
      FROM s JOIN b ON b.doc_id = s.doc_id AND b.i = s.i + 1)
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, sha256(string_agg(x, chr(10) ORDER BY i)) AS content_hash, count(*) AS n_blocks FROM s JOIN b USING (doc_id, i) WHERE n <= 500 GROUP BY doc_id, chunk
    UNION ALL SELECT doc_id, CAST(chunk + j AS INTEGER), sha256(substr(x, CAST(j * 450 + 1 AS BIGINT), 500)), 1 FROM s JOIN b USING (doc_id, i), unnest(range(0, CAST(ceil((n - 50) / 450.0) AS BIGINT))) u(j) WHERE n > 500""",
)
def block_chunks(spark, sf):
    """Lines stand for the blocks of a document; small ones share a chunk, large ones are cut into windows."""
    packed = text.packed_blocks(F.split("text", "\n"))
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(packed).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", F.sha2("c.text", 256).alias("content_hash"), F.size("c.blocks").cast("long").alias("n_blocks"))


def _old_epoch(spark, sf):
    """Chunks of the epoch before: of stored documents, which some have had another text."""
    stored = table(spark, sf, "documents").where("doc_id % 10 <> 0 and doc_id % 11 <> 0")
    had = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old = chunks(stored.select("doc_id", had.alias("text")))
    return old.select("doc_id", "chunk_index", F.sha2("chunk", 256).alias("content_hash"), F.lit("e8").alias("epoch"), F.lit("v1").alias("embedding_version"))


@register(
    "incremental_build",
    f"""{_DIFF_SQL}, {CHUNKS_SQL}
    SELECT c.doc_id, c.chunk_index, CASE WHEN change = 'UNCHANGED' THEN 'carried' ELSE 'built' END AS origin, 'e9' AS epoch, sha256(chunk) AS content_hash
    FROM chunks c JOIN diff USING (doc_id) WHERE change <> 'DELETED'""",
)
def incremental_build(spark, sf):
    """Unchanged documents' chunks come from the old epoch; only new and modified documents are cut."""
    diff = _diff(spark, sf)
    carried = corpus.carry_forward(_old_epoch(spark, sf), diff.where("change = 'UNCHANGED'"), "doc_id", "epoch", "e9")
    changed = table(spark, sf, "documents").join(diff.where("change in ('NEW', 'MODIFIED')"), "doc_id", "left_semi")
    built = chunks(changed.select("doc_id", "text")).select("doc_id", "chunk_index", F.sha2("chunk", 256).alias("content_hash"))
    columns = ["doc_id", "chunk_index", "origin", "epoch", "content_hash"]
    return (
        carried.withColumn("origin", F.lit("carried"))
        .select(*columns)
        .unionByName(built.withColumns({"origin": F.lit("built"), "epoch": F.lit("e9")}).select(*columns))
    )


@register(
    "carry_forward_versions",
    f"""{_DIFF_SQL}, {CHUNKS_SQL} SELECT doc_id, chunk_index, 'e9' AS epoch, sha256(doc_id || ':' || chunk_index || ':e9') AS point_id
    FROM chunks JOIN diff USING (doc_id) WHERE change = 'UNCHANGED'""",
)
def carry_forward_versions(spark, sf):
    """Points of unchanged documents under the new epoch; a vector of another version stops the build."""
    unchanged = _diff(spark, sf).where("change = 'UNCHANGED'")
    carried = corpus.carry_forward(_old_epoch(spark, sf), unchanged, "doc_id", "epoch", "e9", "embedding_version", ["v1"])
    chunk = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return carried.select("doc_id", "chunk_index", "epoch", ids.index_id(chunk, F.col("epoch")).alias("point_id"))


@register(
    "epoch_lifecycle",
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'validate' WHEN 'view' THEN 'seal' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'activate' ELSE 'fail' END AS action,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, i, event_id, action, CASE WHEN action = 'validate' THEN 'validated' ELSE 'staging' END AS state, action IN ('validate', 'write', 'fail') AS accepted FROM e WHERE i = 1),
    r AS (WITH RECURSIVE t AS (SELECT * FROM s UNION ALL
      SELECT e.user_id, e.i, e.event_id, e.action, CASE WHEN t.state = 'staging' AND e.action = 'validate' THEN 'validated' WHEN t.state = 'validated' AND e.action = 'seal' THEN 'sealed'
          WHEN t.state = 'sealed' AND e.action = 'activate' THEN 'active' WHEN t.state IN ('staging', 'validated') AND e.action IN ('write', 'fail') THEN 'staging' ELSE t.state END,
        (t.state = 'staging' AND e.action = 'validate') OR (t.state = 'validated' AND e.action = 'seal') OR (t.state = 'sealed' AND e.action = 'activate') OR (t.state IN ('staging', 'validated') AND e.action IN ('write', 'fail'))
      FROM t JOIN e ON e.user_id = t.user_id AND e.i = t.i + 1) SELECT * FROM t)
    SELECT user_id, event_id, action, state, accepted FROM r""",
)
def epoch_lifecycle(spark, sf):
    """A user's events stand for what is done to an epoch: staged, validated, sealed for good and activated by hand."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "validate").when(kind == "view", "seal").when(kind == "click", "write").when(kind == "purchase", "activate").otherwise("fail")
    log = table(spark, sf, "events").select("user_id", "event_id", "ts", action.alias("action"))
    return lifecycle.replay(log, ["user_id"], ["ts", "event_id"], "action", lifecycle.EPOCH).select("user_id", "event_id", "action", "state", "accepted")


@register(
    "review_states",
    """SELECT doc_id, action, CASE WHEN action = 'reject' THEN 'rejected' WHEN action = 'accept' AND expected THEN 'accepted' ELSE 'pending' END AS state, NOT (action = 'accept' AND NOT expected) AS accepted
    FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'propose' END AS action, doc_id % 3 <> 0 AS expected FROM labels)""",
)
def review_states(spark, sf):
    """A candidate is accepted only with what people expect of it written down."""
    action = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("propose")
    named = table(spark, sf, "labels").select("doc_id", action.alias("action"), (F.col("doc_id") % 3 != 0).alias("expected"))
    step = F.when((F.col("action") == "accept") & ~F.col("expected"), "accept_without_expectations").otherwise(F.col("action"))
    done = lifecycle.replay(named.withColumn("step", step), ["doc_id"], ["doc_id"], "step", lifecycle.REVIEW)
    return done.select("doc_id", "action", "state", "accepted")
