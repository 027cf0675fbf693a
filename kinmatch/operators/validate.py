"""Findings about result files: (file, rule, severity, n, examples), no row for a rule that holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = "file string, rule string, severity string, n long, examples string"


def parse(lines: DataFrame) -> DataFrame:
    """(s1_id, ids, tabs) of lines(value) without the header."""
    return lines.select(F.substring_index("value", "\t", 1).alias("s1_id"), F.when(F.contains("value", F.lit("\t")), F.regexp_extract("value", "\t(.*)$", 1)).otherwise("").alias("ids"), (F.length("value") - F.length(F.replace(F.col("value"), F.lit("\t"), F.lit("")))).alias("tabs"))


def finding(bad: DataFrame, what: Column, file: str, rule: str, severity: str = "error", most: int = 5) -> DataFrame:
    """A row with the number of bad rows and the first few in order."""
    b = bad.select(what.cast("string").alias("x"))
    top = b.distinct().orderBy("x").limit(most).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
    return b.agg(F.count("*").alias("n")).crossJoin(top).where("n > 0").select(F.lit(file).alias("file"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def ids_of(rows: DataFrame) -> DataFrame:
    return rows.select("s1_id", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("t_id"))


def check_lists(rows: DataFrame, required: DataFrame, file: str, known: DataFrame | None = None) -> DataFrame:
    """Findings on rows(s1_id, ids, tabs): tabs, repeated S1 rows, repeated or ill-formed ids, missing and extra S1."""
    each = ids_of(rows)
    need, have = required.select("s1_id").distinct(), rows.select("s1_id").distinct()
    split = F.filter(F.split("ids", ","), lambda x: x != "")
    parts = [
        finding(rows.where("tabs = 0"), F.col("s1_id"), file, "row_without_tab"),
        finding(rows.where("tabs > 1"), F.col("s1_id"), file, "more_than_one_tab"),
        finding(rows.groupBy("s1_id").count().where("count > 1"), F.col("s1_id"), file, "duplicate_s1"),
        finding(rows.where(F.size(split) != F.size(F.array_distinct(split))), F.col("s1_id"), file, "duplicate_in_list"),
        finding(each.where("t_id like 'S1-%'"), F.col("t_id"), file, "s1_in_list"),
        finding(each.where("t_id not like 'S1-%' and t_id not like 'S2-%' and t_id not like 'S3-%'"), F.col("t_id"), file, "unknown_prefix"),
        finding(need.join(have, "s1_id", "left_anti"), F.col("s1_id"), file, "missing_s1"),
        finding(have.join(need, "s1_id", "left_anti"), F.col("s1_id"), file, "extra_s1"),
    ]
    if known is not None:
        parts.append(finding(each.join(known.select("t_id"), "t_id", "left_anti"), F.col("t_id"), file, "unknown_id"))
    return reduce(DataFrame.unionByName, parts)


def check_subset(matches: DataFrame, candidates: DataFrame, strict: bool = False) -> DataFrame:
    """Matched pairs that are no candidates: a warning, or with ``strict`` an error."""
    out = ids_of(matches).join(ids_of(candidates), ["s1_id", "t_id"], "left_anti")
    return finding(out, F.concat_ws(":", "s1_id", "t_id"), "matching_results", "match_not_candidate", "error" if strict else "warning")


def check_files(spark: SparkSession, matches: str, candidates: str | None, required: DataFrame, strict_subset: bool = False, known: DataFrame | None = None) -> DataFrame:
    """All findings on files of id lists; a missing candidate file is a warning, a wrong header an error."""
    heads = {"matching_results": "matched_entity_ids", "candidate_pairs": "candidate_entity_ids"}
    found, rows = spark.createDataFrame([], FINDING), {}
    for file, path in (("matching_results", matches), ("candidate_pairs", candidates)):
        if path is None:
            found = found.unionByName(spark.createDataFrame([(file, "missing_file", "warning", 1, "")], FINDING))
            continue
        lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).text(path)
        head = f"source1_entity_id\t{heads[file]}"
        got = lines.first()
        if got is None or got[0].strip().lower() != head:
            found = found.unionByName(spark.createDataFrame([(file, "header", "error", 1, (got[0] if got else "")[:80])], FINDING))
        rows[file] = parse(lines.where(F.lower(F.trim("value")) != head))
        found = found.unionByName(check_lists(rows[file], required, file, known))
    return found.unionByName(check_subset(rows["matching_results"], rows["candidate_pairs"], strict_subset)) if len(rows) == 2 else found


def passed(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").isEmpty()
