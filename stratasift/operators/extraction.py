"""Structure out of text: articles by a line grammar, JSON objects inside prose, and differences between JSON documents."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratasift.staging import stage

# Articles


@dataclass(frozen=True)
class LineGrammar:
    """Regular expressions for lines: where the body starts and ends, what opens a chapter, and what opens an article.

    The first group of ``article`` (and of ``chapter``) is its name.
    """

    article: str
    chapter: str | None = None
    body_start: str | None = None
    tail: str | None = None


# Numbered articles of Chinese regulations.
REGULATION = LineGrammar(article=r"^第([一二三四五六七八九十百零]+)条", chapter=r"^(第[一二三四五六七八九十]+章.*)", body_start=r"^第一章", tail=r"^解读$")


def articles(df: DataFrame, key: str, text: Column, grammar: LineGrammar) -> DataFrame:
    """(key, article, name, chapter, n_lines, body): the articles of each text, numbered from 1.

    Lines are trimmed and empty ones dropped.  The body begins at the first
    line that matches ``body_start`` (a text without it has no articles) and
    ends before the first later ``tail``.  A chapter's line belongs to no
    article and is the ``chapter`` of those that follow; lines before the first
    article belong to none.  A fold over the lines of each text carries all of
    that: a text never meets another one and nothing is shuffled.
    """
    trimmed = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    article = "struct<name:string,chapter:string,own:array<string>>"
    zero = F.struct(
        F.lit(grammar.body_start is None).alias("inside"),
        F.lit(False).alias("over"),
        F.lit(None).cast("string").alias("chapter"),
        F.array().cast(f"array<{article}>").alias("done"),
        F.lit(None).cast(article).alias("open"),
    )

    def closed(state):
        return F.when(state["open"].isNotNull(), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    def state_of(inside, over, chapter, done, opened):
        return F.struct(inside.alias("inside"), over.alias("over"), chapter.alias("chapter"), done.alias("done"), opened.alias("open"))

    def step(state, line):
        begins = state["inside"] | (line.rlike(grammar.body_start) if grammar.body_start else F.lit(True))
        skipped = state["over"] | ~begins
        ends = line.rlike(grammar.tail) if grammar.tail else F.lit(False)
        heading = line.rlike(grammar.chapter) if grammar.chapter else F.lit(False)
        named = F.regexp_extract(line, grammar.chapter, 1) if grammar.chapter else state["chapter"]
        name = F.regexp_extract(line, grammar.article, 1)
        opened = F.struct(name.alias("name"), state["chapter"].alias("chapter"), F.array(line).alias("own"))
        last = state["open"]
        longer = F.struct(last["name"].alias("name"), last["chapter"].alias("chapter"), F.concat(last["own"], F.array(line)).alias("own"))
        yes = F.lit(True)
        return (
            F.when(skipped, state)
            .when(ends, state_of(yes, yes, state["chapter"], state["done"], last))
            .when(heading, state_of(yes, F.lit(False), named, state["done"], last))
            .when(line.rlike(grammar.article), state_of(yes, F.lit(False), state["chapter"], closed(state), opened))
            .when(last.isNotNull(), state_of(yes, F.lit(False), state["chapter"], state["done"], longer))
            .otherwise(state_of(yes, F.lit(False), state["chapter"], state["done"], last))
        )

    folded = F.aggregate(trimmed, zero, step, closed)
    found = df.select(F.col(key).alias("key"), F.posexplode(folded).alias("place", "a"))
    return found.select(
        "key", (F.col("place") + 1).alias("article"), "a.name", "a.chapter", F.size("a.own").alias("n_lines"), F.array_join("a.own", "\n").alias("body")
    )


# JSON inside prose


#: Strings, braces, what is neither, and quotes that nothing closes.
_TOKEN = re.compile('"(?:[^"\\\\]|\\\\[^\n\r\u0085\u2028\u2029])*"|[{}]|[^"{}]+|"')


def _balanced(text: str) -> list[str]:
    out = []
    at = text.find("{")
    while at >= 0:
        depth = 0
        for token in _TOKEN.finditer(text, at):
            depth += {"{": 1, "}": -1}.get(token[0], 0)
            if depth == 0:
                out.append(text[at : token.end()])
                break
        at = text.find("{", at + 1)
    return out


def balanced_objects(text: Column) -> Column:
    """For each opening brace of a text the shortest balanced object that begins there, braces in strings not counted.

    A scan in Arrow batches; what precedes the first brace is prose, whatever
    quotes it has.
    """

    @F.pandas_udf("array<string>")
    def scanned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _balanced(t) for t in texts], dtype="object")

    return scanned(text)


def first_object(text: Column) -> Column:
    """The first balanced object of a text that is JSON; null without one."""
    return F.get(F.filter(balanced_objects(text), lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))


_REWRITE = "rewritten_query string, business_type string, intent string, requires_context boolean, standardized_entities array<string>, confidence double, fallback boolean"

# Intents that cannot go with a question about rules, and the one that takes their place.
WRONG_UNDER_REGULATION, REPAIRED_INTENT = ("ingredient", "formulation"), "compliance"


def parsed_rewrite(answer: Column, query: Column) -> Column:
    """A model's answer as a struct, repaired; null if there is no object in it.

    Missing and null fields get their defaults, and an intent that contradicts
    the business type is replaced.
    """

    def repaired(found: Column) -> Column:
        business = F.coalesce(found["business_type"], F.lit("general"))
        intent = F.coalesce(found["intent"], F.lit("general"))
        contradicts = (business == "regulation") & intent.isin(*WRONG_UNDER_REGULATION)
        return F.when(
            found.isNotNull(),
            F.struct(
                F.coalesce(found["rewritten_query"], query).alias("rewritten_query"),
                business.alias("business_type"),
                F.when(contradicts, REPAIRED_INTENT).otherwise(intent).alias("intent"),
                F.coalesce(found["requires_context"], F.lit(True)).alias("requires_context"),
                F.coalesce(found["standardized_entities"], F.array().cast("array<string>")).alias("standardized_entities"),
                F.coalesce(found["confidence"], F.lit(0.5)).alias("confidence"),
                F.coalesce(found["fallback"], F.lit(False)).alias("fallback"),
            ),
        )

    # The answer is read once, not for each field.
    return F.get(F.transform(F.array(F.from_json(first_object(answer), _REWRITE)), repaired), F.lit(0))


# Differences between JSON documents


def flattened(df: DataFrame, key: str, json: Column) -> DataFrame:
    """(key, path, parent, kind, value) of every node of JSON texts; kind is OBJECT, ARRAY or that of the value.

    Each round opens one more level of all documents at once, until no
    container is left; the root has an empty path.
    """
    kind = F.regexp_extract(F.schema_of_variant("node"), r"^([A-Z]+)", 1)
    level = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(json).alias("node"))
    level = level.where("node is not null")
    out = None
    spark = df.sparkSession
    while True:
        # Variants are not written; their texts are.
        rows = stage(level.select("key", "path", "parent", kind.alias("kind"), F.to_json("node").alias("value")), "json-level")
        out = rows if out is None else out.unionByName(rows)
        if not rows.where("kind in ('OBJECT', 'ARRAY')").limit(1).count():
            return out
        view = rows.where("kind in ('OBJECT', 'ARRAY')").withColumn("node", F.parse_json("value")).alias("r")
        opened = view.lateralJoin(spark.tvf.variant_explode(F.col("r.node").outer()).alias("e"))
        path = (
            F.when(F.col("r.kind") == "ARRAY", F.concat("r.path", F.lit("["), F.col("e.pos").cast("string"), F.lit("]")))
            .when(F.col("r.path") == "", F.col("e.key"))
            .otherwise(F.concat("r.path", F.lit("."), "e.key"))
        )
        level = opened.select(F.col("r.key").alias("key"), path.alias("path"), F.col("r.path").alias("parent"), F.col("e.value").alias("node"))


def json_differences(df: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """(key, path, problem): where two JSON texts of a row differ.

    ``left only`` and ``right only`` name the highest path that one side lacks,
    ``kind`` where the types differ, ``length`` where lists do (their items are
    not compared then) and ``value`` where plain values do.
    """
    sides = []
    for name, json in (("l", left), ("r", right)):
        rows = flattened(df, key, json)
        size = F.when(F.col("kind") == "ARRAY", F.variant_get(F.parse_json("value"), "$", "array<variant>"))
        sides.append(rows.select("key", "path", F.col("parent").alias(f"{name}_parent"), F.col("kind").alias(f"{name}_kind"), F.col("value").alias(f"{name}_value"), F.size(size).alias(f"{name}_size")))
    both = sides[0].join(sides[1], ["key", "path"], "full")
    container = F.col("l_kind").isin("OBJECT", "ARRAY")
    problem = (
        F.when(F.col("r_kind").isNull(), "left only")
        .when(F.col("l_kind").isNull(), "right only")
        .when(F.col("l_kind") != F.col("r_kind"), "kind")
        .when((F.col("l_kind") == "ARRAY") & (F.col("l_size") != F.col("r_size")), "length")
        .when(~container & (F.col("l_value") != F.col("r_value")), "value")
    )
    judged = stage(both.select("key", "path", F.coalesce("l_parent", "r_parent").alias("parent"), problem.alias("problem")).where("problem is not null"), "json-differences")
    # Below a difference that stands for its whole branch nothing more is said.
    tops = judged.where("problem <> 'value'").select("key", F.col("path").alias("top"))
    inside = F.startswith("j.path", F.concat("t.top", F.lit("."))) | F.startswith("j.path", F.concat("t.top", F.lit("[")))
    below = (F.col("j.key") == F.col("t.key")) & (inside | ((F.col("t.top") == "") & (F.col("j.path") != "")))
    return judged.alias("j").join(tops.alias("t"), below, "left_anti").select("key", "path", "problem")
