"""Findings about documents, ordered by severity, and the verdict they lead to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clipped, compare_key, stray_letters
from quire.operators.coverage import repeated_lines
from quire.sources.tables import text_lines

#: Severities in order; the first decides the verdict.
SEVERITIES = ("solve", "check", "info")


def finding(df: DataFrame, owner: str, kind: str, severity: str, evidence: Column) -> DataFrame:
    return df.select(F.col(owner).alias("owner"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence"))


def document_findings(docs: DataFrame) -> DataFrame:
    """(owner, kind, severity, evidence): empty documents, symbols in running text, lines that other
    documents have too, stray letters and paragraphs that begin in lower case.

    Each kind is one pass; all are united. Null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    empty = docs.where(F.trim(text) == "")
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[*#$%&|<>]", ""))
    noisy = docs.withColumn("__n", symbols).where(F.col("__n") * 20 > F.char_length(text))
    letters = docs.withColumn("__l", F.array_distinct(stray_letters(text))).where(F.size("__l") > 0)
    begins = docs.where(F.regexp_extract(text, r"^\s*(\S)", 1).rlike(r"\p{Ll}"))
    lines = text_lines(docs)
    common = repeated_lines(lines, "source", "doc_id", F.col("text"), 3).select("source", "key")
    hits = lines.withColumn("key", compare_key(F.col("text"))).join(common, ["source", "key"]).groupBy("doc_id").agg(F.count("*").alias("__n"))
    return reduce(
        DataFrame.unionByName,
        [
            finding(empty, "doc_id", "empty", "solve", F.lit("")),
            finding(noisy, "doc_id", "symbols", "solve", F.col("__n")),
            finding(hits, "doc_id", "repeated_line", "check", F.col("__n")),
            finding(letters, "doc_id", "stray_letters", "info", F.array_join(F.array_sort("__l"), " ")),
            finding(begins, "doc_id", "lower_case_start", "check", clipped(text, 20)),
        ],
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def verdicts(owners: DataFrame, findings: DataFrame) -> DataFrame:
    """(owner, solve, check, info, verdict) for every owner, without findings too: to solve, to check or ready."""
    counts = findings.groupBy("owner").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    full = owners.join(counts, "owner", "left").fillna(0, list(SEVERITIES))
    return full.withColumn("verdict", F.when(F.col("solve") > 0, "to solve").when(F.col("check") > 0, "to check").otherwise("ready"))


def open_findings(findings: DataFrame, ticked: DataFrame) -> DataFrame:
    """Findings that nobody ticked off: `ticked` has (owner, kind)."""
    return findings.join(ticked, ["owner", "kind"], "left_anti")
