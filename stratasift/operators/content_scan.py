"""Labelled pattern families over texts and paths, found by an Aho-Corasick automaton.

Each pattern names literals of which one must stand in a matching line.  One
automaton over all literals reads a text once, however many patterns there are;
only lines with a literal are looked at by the patterns that it belongs to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer lines are data rather than prose and are not read.
LONGEST_LINE = 2000


@dataclass(frozen=True)
class Pattern:
    """``shape`` is a regular expression; one of ``literals`` (lower case) is in every match, none means any line."""

    family: str
    label: str
    shape: str
    literals: tuple[str, ...] = ()


# Families of content that a public corpus should not have.  A line counts once for each family.
CONTENT_PATTERNS = (
    Pattern("career", "résumé material", r"简历", ("简历",)),
    Pattern("career", "job-seeking material", r"求职", ("求职",)),
    Pattern("career", "interview material", r"面试(?:官|题|准备|话术|复现)", ("面试",)),
    Pattern("career", "interview material", r"面试指南", ("面试",)),
    Pattern("career", "recruiting-facing material", r"(?:面向|用于)(?:招聘|求职|应聘)", ("招聘", "求职", "应聘")),
    Pattern("career", "recruiting material", r"候选人(?:筛选|评估|画像)", ("候选人",)),
    Pattern("career", "employment timeline", r"离职(?:后|时间|前)?", ("离职",)),
    Pattern("career", "prior-employer reference", r"前雇主", ("前雇主",)),
    Pattern("career", "prior-employer reference", r"上一家公司", ("上一家公司",)),
    Pattern("career", "employment timeline", r"(?:任职|在职)期间", ("任职", "在职")),
    Pattern("career", "employment framing", r"(?i)\bpost[- ]employment\b", ("employment",)),
    Pattern("career", "employment timeline", r"(?i)\bafter leaving (?:the |my |their )?(?:company|employer)\b", ("after leaving",)),
    Pattern("career", "employment framing", r"(?i)\b(?:company|employer) project experience\b", ("project experience",)),
    Pattern("career", "prior-employer reference", r"(?i)\bformer employer\b", ("former employer",)),
    Pattern("career", "employer-project framing", r"(?i)\bopen[- ]source (?:evolution|derivative) of\b", ("source evolution", "source derivative")),
    Pattern("career", "employer-project framing", r"(?i)\bindependent reproduction of (?:an|the) (?:enterprise|company|former)", ("independent reproduction",)),
    Pattern("career", "employment framing", r"(?i)\benterprise project experience\b", ("project experience",)),
    Pattern("career", "job-seeking material", r"(?i)\bjob application\b", ("job application",)),
    Pattern("career", "recruiting-facing material", r"(?i)\brecruiter[- ]facing\b", ("recruiter",)),
    Pattern("scale", "traffic volume", r"日均\s*1500\+?\s*请求", ("日均",)),
    Pattern("scale", "internal recognition", r"(?:年度|技术)?创新奖", ("创新奖",)),
    Pattern("scale", "tuning provenance", r"(?i)derived from (?:live |production |customer )?(?:experiments?|traffic|a/?b test)", ("derived from",)),
)

# Fixed value: lines that are plainly about engineering are never reported.
TECHNICAL_CONTEXT = (
    r"(?i)query\s*rewrite|rewrite\s*path|candidate\s*rank|rerank|recall_candidate"
    r"|checkpoint\s*resume|resume\s+(?:the\s+)?(?:run|ingestion|job|pipeline|replay)"
    r"|candidate\s*(?:document|set|result|user|pass|row|label|mapping|id)"
    r"|regulatory|regulation|ingredient|formula|dosage|labeling"
)

# File names of such material.
PATH_PATTERNS = (
    Pattern("career", "résumé", r"(?i)RESUME(?:[_ .-]|$)", ("resume",)),
    Pattern("career", "curriculum vitae", r"(?i)\bCV\b", ("cv",)),
    Pattern("career", "interview", r"(?i)INTERVIEW", ("interview",)),
    Pattern("career", "cover letter", r"(?i)\bCOVER[_ -]?LETTER\b", ("letter",)),
    Pattern("career", "job description", r"(?i)\bJOB[_ -]?(APPLICATION|DESCRIPTION|DESC)\b", ("job",)),
    Pattern("career", "recruiting", r"(?i)\b(RECRUIT|CANDIDATE[_ -]?(POOL|LIST|TRACKER))\b", ("recruit", "candidate")),
    Pattern("career", "performance review", r"(?i)\bPERFORMANCE[_ -]?REVIEW\b", ("performance",)),
)


class Scanner:
    """The automaton and the patterns of its literals; made once for each task."""

    def __init__(self, patterns: tuple[Pattern, ...], context: str | None):
        self.patterns = [(p.family, p.label, re.compile(p.shape)) for p in patterns]
        self.context = re.compile(context) if context else None
        self.always = [i for i, p in enumerate(patterns) if not p.literals]
        of: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            for literal in p.literals:
                of.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in of.items():
            self.automaton.add_word(literal, numbers)
        self.automaton.make_automaton()

    def line(self, line: str) -> list[tuple[str, str]]:
        """(family, label) of the first pattern of each family that the line matches."""
        if len(line) > LONGEST_LINE:
            return []
        candidates = set(self.always)
        if len(self.automaton):
            for _, numbers in self.automaton.iter(line.lower()):
                candidates.update(numbers)
        found: dict[str, str] = {}
        for i in sorted(candidates):
            family, label, shape = self.patterns[i]
            if family not in found and shape.search(line):
                found[family] = label
        if found and self.context and self.context.search(line):
            return []
        return list(found.items())


def scan_lines(df: DataFrame, key: str, text: Column, patterns: tuple[Pattern, ...] = CONTENT_PATTERNS, context: str | None = TECHNICAL_CONTEXT) -> DataFrame:
    """(key, line, family, label): lines of texts, from 1, with a forbidden pattern.

    Each family names its first pattern that matches.  Lines of more than 2,000
    characters and lines with an allowed context are passed over.  Null texts
    have no lines; texts are read whole, one at a time, and nothing is shuffled.
    """
    rows = df.select(F.col(key).alias("key"), text.alias("text"))
    schema = rows.select("key").schema.add("line", "long").add("family", "string").add("label", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(patterns, context)
        for batch in batches:
            rows_of, lines, families, labels = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                for n, line in enumerate((value.as_py() or "").split("\n"), 1):
                    for family, label in scanner.line(line):
                        rows_of.append(i)
                        lines.append(n)
                        families.append(family)
                        labels.append(label)
            keys = batch.column(0).take(pa.array(rows_of, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(lines, pa.int64()), pa.array(families, pa.string()), pa.array(labels, pa.string())], names=["key", "line", "family", "label"])

    return rows.mapInArrow(run, schema)


def scan_paths(df: DataFrame, key: str, path: Column, patterns: tuple[Pattern, ...] = PATH_PATTERNS) -> DataFrame:
    """(key, name, label) of paths whose file name, with or without its ending, looks like forbidden material.

    A short list of patterns on short names stays with the column functions.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    label = F.lit(None).cast("string")
    for p in reversed(patterns):
        label = F.when(stem.rlike(p.shape) | name.rlike(p.shape), p.label).otherwise(label)
    return df.select(F.col(key).alias("key"), name.alias("name"), label.alias("label")).where("label is not null")
