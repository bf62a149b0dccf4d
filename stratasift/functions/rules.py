"""Routing, gate and classification rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import keyword_hits

# Words that routing rules look for.
REGULATION = ["法规", "合规", "标准", "备案", "许可", "禁用"]
DEVELOPMENT = ["配方", "研发", "工艺", "制备", "开发"]
INGREDIENT = ["成分", "INCI", "功效", "浓度"]
PRODUCT = ["产品", "品牌", "适用", "肤质", "包装"]
PARAPHRASE = ["请问", "请简要说明", "我想知道", "根据化妆品相关规定", "给我介绍一下", "能否告诉我"]

# The complete lists of words by domain; visual ones say that a question is about what a picture shows.
DOMAIN_WORDS = {
    "regulation": ["法规", "合规", "标准", "备案", "许可", "标准号", "GB", "禁用"],
    "development": ["配方", "研发", "工艺", "制备", "合成", "开发"],
    "ingredient": ["成分", "INCI", "功效", "浓度", "含量", "添加量"],
    "product": ["产品", "品牌", "适用", "肤质", "包装"],
    "visual": [
        "图片", "包装", "外观", "照片", "扫描", "标签", "成分表", "配方", "图像", "图像识别", "OCR", "说明书", "瓶身", "外盒", "瓶盖", "瓶贴",
        "生产日期", "保质期", "批号", "条形码", "产品图", "实物图", "对比图", "展示图", "扫描件", "背标", "正标", "净含量", "成分", "功效",
        "使用说明", "警告", "储存", "生产商", "委托方", "地址", "化妆品生产许可证", "执行标准", "备案号", "注册证", "防伪", "二维码", "售价",
    ],
}
INTENT_OF = {"regulation": "compliance", "development": "formulation", "ingredient": "ingredient", "product": "product"}


# Token estimate per type of business, cost of a token, thresholds of admission.
KV_PREFILL_KB, KV_DECODE_KB = 0.45, 0.54
PRESSURE = {"critical": 0.95, "soft_stop": 0.90, "truncate": 0.80, "tighten": 0.70}


def intent(query: Column, groups=None) -> tuple[Column, Column]:
    """(business type, intent) of the first group of words that has one in the query."""
    groups = groups or [
        (REGULATION, "regulation", "compliance"),
        (DEVELOPMENT, "development", "formulation"),
        (INGREDIENT, "ingredient", "ingredient"),
        (PRODUCT, "product", "product"),
    ]
    business = kind = F
    for words, b, k in groups:
        hit = keyword_hits(query, words) > 0
        business, kind = business.when(hit, b), kind.when(hit, k)
    return business.otherwise("general"), kind.otherwise("general")


def domain_intent(query: Column) -> tuple[Column, Column]:
    """:func:`intent` by the complete lists."""
    return intent(query, [(DOMAIN_WORDS[b], b, kind) for b, kind in INTENT_OF.items()])


def visual_hits(query: Column) -> Column:
    """How many of the visual words a question has."""
    return keyword_hits(query, DOMAIN_WORDS["visual"])


def is_complex(query: Column, keywords: list[str], least: int = 2) -> Column:
    return keyword_hits(query, keywords) >= least


def visual_route(hits: Column, intent_name: Column, centroid: Column, high: float = 0.5, low: float = 0.2) -> Column:
    """Images to look for: 50, 20 or none."""
    score = F.greatest(
        F.least(hits * 0.3, F.lit(1.0)),
        F.when(intent_name.isin("formulation", "ingredient"), 0.3).otherwise(0.0),
        F.greatest(F.coalesce(centroid, F.lit(0.0)), F.lit(0.0)),
    )
    return F.when(score >= high, 50).when(score >= low, 20).otherwise(0)


def caption_trigger(has_image: Column, hits: Column, business: Column, intent_name: Column, threshold: float = 0.3) -> Column:
    rule = (
        F.when(intent_name.isin("formulation", "ingredient") & (hits > 0), 0.7)
        .when((business == "development") & (hits > 0), 0.6)
        .otherwise(0.0)
    )
    return has_image | (F.greatest(F.least(hits * 0.3, F.lit(1.0)), rule) >= threshold)


def platt(x: Column, a: float = 1.0, b: float = 0.0) -> Column:
    """Calibrated score; the argument is clamped to 500 on either side."""
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -(F.lit(a) * x + F.lit(b))))
    return 1.0 / (1.0 + F.exp(z))


def evidence_score(x: Column) -> Column:
    """Six places of a weighted sum of such scores: digits that only come from binary fractions decide no half."""
    return F.round(F.round(x, 12), 6)


def evidence_decision(score: Column, agreement: Column, conservative: Column) -> Column:
    """Low agreement or caution raises both thresholds."""
    strict = conservative | (agreement < 0.3)
    high, low = F.when(strict, 0.80).otherwise(0.75), F.when(strict, 0.65).otherwise(0.55)
    return F.when(score >= high, "pass").when(score >= low, "enhanced_generate").otherwise("reject")


def answer_verdict(similarity: Column, contradiction: Column, is_regulation: Column, has_doc: Column) -> tuple[Column, Column]:
    """(passed, warning): similar answers pass, strangers warn, the rest is up to the contradiction score."""
    contra = F.when(similarity < 0.15, 0.6).otherwise(contradiction)
    limit = F.when(is_regulation, 0.5).otherwise(0.6)
    passed = (
        F.when(~has_doc, True)
        .when(similarity > 0.6, True)
        .when(similarity < 0.15, ~is_regulation)
        .otherwise(contra <= limit)
    )
    warning = F.when(~has_doc | (similarity > 0.6), False).when(similarity < 0.15, True).otherwise(contra > 0.5)
    return passed, warning


#: Names of the level whose content needs a review.
UNTRUSTED = ("UNTRUSTED", "UNTRUSTED_EXTERNAL")


def trust_class(trust: Column, approval: Column) -> Column:
    """Null for a pair that the contract does not allow."""
    return (
        F.when((trust == "MANAGED_INTERNAL") & (approval == "NOT_REQUIRED"), "MANAGED_INTERNAL")
        .when(trust.isin(*UNTRUSTED) & (approval == "APPROVED"), "APPROVED_EXTERNAL")
        .when(trust.isin(*UNTRUSTED) & approval.isin("PENDING_REVIEW", "REJECTED"), "UNTRUSTED")
    )


def request_outcome(answer_passed: Column, evidence: Column, degraded: Column, generated: Column, cache_level: Column) -> Column:
    """Terminal state of a request; gates come before errors, errors before answers."""
    return (
        F.when(F.coalesce(~answer_passed, F.lit(False)), "rejected_by_answer_gate")
        .when(F.coalesce(evidence == "reject", F.lit(False)), "rejected_by_evidence_gate")
        .when(degraded, "error")
        .when(generated, "answered")
        .when(cache_level.isNotNull(), "cache_hit")
        .when(evidence.isNull(), "rejected_by_admission")
        .otherwise("rejected_by_evidence_gate")
    )


def kv_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * KV_PREFILL_KB + tokens_out * KV_DECODE_KB


def admission(pressure: Column, priority: Column, fits: Column) -> Column:
    """Reason for a request at a pressure, as if each were alone with it."""
    p = PRESSURE
    return (
        F.when(
            pressure > p["critical"],
            F.when(priority == "P0", F.when(fits, "critical").otherwise("critical_p0_budget"))
            .when(priority == "P1", "critical_p1_queued")
            .otherwise("critical_p2_rejected"),
        )
        .when((pressure > p["soft_stop"]) & (priority == "P2"), "soft_stop")
        .when(~fits, "budget_exceeded")
        .when(pressure > p["soft_stop"], F.when(priority == "P1", "downgrade").otherwise("admitted"))
        .when(pressure > p["truncate"], "admitted_with_truncation")
        .when(pressure > p["tighten"], "admitted_with_tighten")
        .otherwise("admitted")
    )


def truncation_tokens(n: Column, divisor: int = 2) -> Column:
    return F.greatest(F.floor(n / divisor), F.lit(256)).cast("long")


def backoff_seconds(attempt: Column, base: float = 0.5, cap: float = 8.0, asked: Column | None = None) -> Column:
    """Exponential delay without jitter; null where the server asks for longer than the cap."""
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    if asked is None:
        return delay
    return F.when(asked > cap, None).otherwise(F.greatest(delay, F.coalesce(asked, F.lit(0.0))))


def is_paraphrase(question: Column) -> Column:
    """Whether a question begins as reworded ones do."""
    found = F.lit(False)
    for prefix in PARAPHRASE:
        found = found | F.startswith(question, F.lit(prefix))
    return found


def primary_category(business: Column, question: Column, n_contexts: Column) -> Column:
    """The category under which a question counts; null if none fits."""
    # Categories of types of business.
    named = {"image": "image_related", "product": "product_knowledge", "regulation": "regulation_precise", "ingredient": "ingredient_query"}
    category = F
    for kind, name in named.items():
        category = category.when(business == kind, name)
    return category.when(is_paraphrase(question), "semantic_paraphrase").when(n_contexts >= 3, "multi_document")


# Statuses that are worth another attempt.
TRANSIENT_STATUSES = (408, 429, 502, 503, 504)


def path_failure(kind: Column, message: Column) -> tuple[Column, Column]:
    """(outcome, detail) of a failed image path, from the kind of error and never from its words alone."""
    words = F.lower(F.coalesce(message, F.lit("")))
    # What becomes of each kind, the first that fits.
    cases = [
        (kind.isin("ImportError", "ModuleNotFoundError"), "model_unavailable", "not_installed"),
        (kind.isin("FileNotFoundError", "OSError"), "model_unavailable", "missing_weights"),
        (kind == "UnexpectedResponse", "qdrant_failed", "qdrant_error"),
        (kind == "LinAlgError", "encode_failed", "encoder_error"),
        ((kind == "RuntimeError") & F.contains(words, F.lit("clip")), "model_unavailable", "loader_error"),
        (kind == "ValueError", "dimension_mismatch", "query_vs_collection"),
    ]
    outcome = detail = F
    for fits, a, b in cases:
        outcome, detail = outcome.when(fits, a), detail.when(fits, b)
    return outcome.otherwise("unknown"), detail.otherwise("unclassified")


def transport_failure(status: Column, kind: Column) -> Column:
    """Class of a failed request: by its status if there is one, else by the kind of error."""
    return (
        F.when(status.isin(*TRANSIENT_STATUSES), "http_transient")
        .when(status.isNotNull(), "http_permanent")
        .when(kind.isin("ConnectTimeout", "ReadTimeout", "PoolTimeout"), "timeout")
        .when(kind.isin("ConnectError", "NetworkError", "RemoteProtocolError"), "connection")
        .when(kind.isin("ValueError", "KeyError", "IndexError", "TypeError"), "malformed_response")
        .otherwise("unknown")
    )


def retry_after(header: Column) -> Column:
    """Seconds that a server asks for; null unless they are a finite number that isn't negative."""
    n = F.trim(header).try_cast("double")
    return F.when((n >= 0) & (n < float("inf")) & ~F.isnan(n), n)


def backoff_delay(attempts: Column, asked: Column, base: float, longest: float) -> Column:
    """Wait before the next attempt; null if the server asks for longer than the policy waits."""
    own = F.least(base * F.pow(F.lit(2.0), attempts - 1), F.lit(longest))
    return F.when(asked > longest, None).otherwise(F.greatest(own, F.coalesce(asked, F.lit(0.0))))
