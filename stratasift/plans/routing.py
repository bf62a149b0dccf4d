"""Routing by the complete lists of domain words."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratasift.functions import rules

from .catalog import register
from .fixtures import table

_WORDS = [w for words in rules.DOMAIN_WORDS.values() for w in words]
_LIST_SQL = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"


def _any_sql(domain: str) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in rules.DOMAIN_WORDS[domain]) + ")"


_HITS_SQL = " + ".join(f"CAST(contains(q, '{w}') AS INT)" for w in rules.DOMAIN_WORDS["visual"])
_CASES_SQL = "CASE " + " ".join(f"WHEN {_any_sql(b)} THEN '{b}'" for b in rules.INTENT_OF) + " ELSE 'general' END"


@register(
    "domain_routing",
    f"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || ({_LIST_SQL})[(conv_id * 7 + turn) % {len(_WORDS)} + 1] || CASE WHEN turn % 2 = 0 THEN ({_LIST_SQL})[(conv_id + 3 * turn) % {len(_WORDS)} + 1] ELSE '' END AS q FROM conversations),
    b AS (SELECT conv_id, turn, {_CASES_SQL} AS business_type, {_HITS_SQL} AS hits FROM q),
    i AS (SELECT *, CASE business_type WHEN 'regulation' THEN 'compliance' WHEN 'development' THEN 'formulation' ELSE business_type END AS intent FROM b)
    SELECT conv_id, turn, business_type, intent, CAST(hits AS INT) AS hits, CASE WHEN greatest(least(hits * 0.3, 1.0), CASE WHEN intent IN ('formulation', 'ingredient') THEN 0.3 ELSE 0 END) >= 0.5 THEN 50
        WHEN greatest(least(hits * 0.3, 1.0), CASE WHEN intent IN ('formulation', 'ingredient') THEN 0.3 ELSE 0 END) >= 0.2 THEN 20 ELSE 0 END AS top_k,
      conv_id % 6 = 0 OR greatest(least(hits * 0.3, 1.0), CASE WHEN intent IN ('formulation', 'ingredient') AND hits > 0 THEN 0.7 WHEN business_type = 'development' AND hits > 0 THEN 0.6 ELSE 0 END) >= 0.3 AS captioned FROM i""",
)
def domain_routing(spark, sf):
    """Type, intent, image depth and captions of questions that name every word of every list in turn."""
    c, t = F.col("conv_id"), F.col("turn")
    words = F.array(*[F.lit(w) for w in _WORDS])
    first = F.get(words, ((c * 7 + t) % len(_WORDS)).cast("int"))
    second = F.when(t % 2 == 0, F.get(words, ((c + 3 * t) % len(_WORDS)).cast("int"))).otherwise("")
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), first, second).alias("q"))
    business, intent = rules.domain_intent(F.col("q"))
    rows = asked.select("conv_id", "turn", business.alias("business_type"), intent.alias("intent"), rules.visual_hits(F.col("q")).alias("hits"))
    return rows.select(
        "conv_id",
        "turn",
        "business_type",
        "intent",
        F.col("hits").cast("int").alias("hits"),
        rules.visual_route(F.col("hits"), F.col("intent"), F.lit(None).cast("double")).alias("top_k"),
        rules.caption_trigger(c % 6 == 0, F.col("hits"), F.col("business_type"), F.col("intent")).alias("captioned"),
    )
