"""Fixed rule tables as small DataFrames.

Each is a literal VALUES relation: known to the optimizer, no job to load it.
Row counts equal the rule lists' lengths (at most a few dozen), whatever the
input size, so broadcasting them needs no runtime size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytesieve import rules


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v) + ("D" if isinstance(v, float) else "")
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(literal(x) for x in v) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values(spark: SparkSession, rows, columns: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def file_types(spark: SparkSession) -> DataFrame:
    rows = [
        (t, rules.TYPE_RISK.get(t, rules.DEFAULT_TYPE_RISK), t in rules.EXECUTABLE_TYPES,
         t in rules.SCRIPT_TYPES, rules.TYPE_NAMES.get(t, rules.DEFAULT_TYPE_NAME))
        for t in rules.FILE_TYPES
    ]
    return values(spark, rows, "detected_type, type_risk, is_executable, is_script, type_name")


def extensions(spark: SparkSession) -> DataFrame:
    exts = sorted(set(rules.EXTENSION_TYPES) | set(rules.EXTENSION_RISK) | set(rules.EXECUTABLE_EXTENSIONS))
    rows = [(e, rules.EXTENSION_TYPES.get(e), rules.EXTENSION_RISK.get(e),
             e in rules.EXECUTABLE_EXTENSIONS) for e in exts]
    return values(spark, rows, "extension, expected_types, listed_risk, runs")


def threat_levels(spark: SparkSession) -> DataFrame:
    return values(spark, rules.THREAT_LEVELS, "threat_level, score, requires_blocking, action")


def stream_types(spark: SparkSession) -> DataFrame:
    return values(spark, rules.STREAM_TYPES, "stream_type, type_name, is_streaming")


def track_policy(spark: SparkSession) -> DataFrame:
    return values(spark, rules.TRACK_POLICY, "track_kind, decision")


def statuses(spark: SparkSession) -> DataFrame:
    return values(spark, rules.STATUSES, "status, is_terminal, is_active, description")


def resource_levels(spark: SparkSession) -> DataFrame:
    return values(spark, rules.RESOURCE_LEVELS, "level, level_name, speed_multiplier, max_concurrent, level_text")


def error_kinds(spark: SparkSession) -> DataFrame:
    return values(spark, rules.ERROR_KINDS, "error_kind, category, recoverable, is_security")
