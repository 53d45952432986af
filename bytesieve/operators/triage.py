"""File triage: from a table of headers to one verdict per file.

All checks are column expressions over one row, so a triage job is a scan
plus broadcast joins against fixed rule tables: no shuffle until a report
aggregates.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import bytesx as B
from bytesieve.functions import text as T
from bytesieve.functions.entropy import entropy
from bytesieve.operators import dims

ISSUE_TYPE = "array<struct<severity:string,description:string,indicator:string>>"


# ------------------------------------------------------------ detection

def detected_type(header: Column, *, by_container: bool = False) -> Column:
    """Type code of the first matching signature, then byte-order marks.

    ``by_container`` first tells RIFF and ftyp containers apart by brand.
    """
    code = B.first_signature(header, rules.SIGNATURES + rules.BYTE_ORDER_MARKS, rules.UNKNOWN_TYPE)
    if by_container:
        for parts, name in reversed(rules.CONTAINER_SIGNATURES):
            cond = F.lit(True)
            for pattern, offset in parts:
                cond = cond & B.has_at(header, pattern, offset)
            code = F.when(cond, F.lit(name)).otherwise(code)
        doc_type = B.has_at(header, b"\x1a\x45\xdf\xa3") & B.has(header, b"webm")
        code = F.when(doc_type, F.lit("Webm")).otherwise(code)
    return code


def with_detected_type(df: DataFrame, header: str = "header", *, by_container: bool = False) -> DataFrame:
    return df.withColumn("detected_type", detected_type(F.col(header), by_container=by_container))


def with_type_facts(df: DataFrame) -> DataFrame:
    """Add risk, executable/script flags and display name of ``detected_type``."""
    return df.join(F.broadcast(dims.file_types(df.sparkSession)), "detected_type", "left")


def type_census(df: DataFrame) -> DataFrame:
    """Files and risk per detected type."""
    return (
        with_type_facts(df)
        .groupBy("detected_type")
        .agg(
            F.count("*").alias("files"),
            F.round(F.avg("type_risk"), 6).alias("mean_risk"),
            F.max("type_risk").alias("max_risk"),
            F.bool_or("is_executable").alias("is_executable"),
            F.bool_or("is_script").alias("is_script"),
        )
    )


# ------------------------------------------------------------ extensions

def with_extension(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("extension", T.file_extension(F.col(path)))


def with_extension_facts(df: DataFrame) -> DataFrame:
    """Add risk and flags of ``extension``; unlisted ones get the default risk."""
    out = df.join(F.broadcast(dims.extensions(df.sparkSession)), "extension", "left")
    risk = F.coalesce(F.col("listed_risk"), F.lit(rules.DEFAULT_EXTENSION_RISK))
    return out.select(
        *df.columns,
        risk.alias("extension_risk"),
        (risk >= rules.HIGH_RISK).alias("is_high_risk"),
        F.coalesce(F.col("runs"), F.lit(False)).alias("is_executable_extension"),
        F.col("expected_types").isNotNull().alias("is_known_extension"),
        "expected_types",
    )


def high_risk_extensions(spark: SparkSession) -> DataFrame:
    return (
        dims.extensions(spark)
        .where(F.col("listed_risk") >= rules.HIGH_RISK)
        .select("extension", F.col("listed_risk").alias("extension_risk"))
    )


def spoofed(expected_types: Column, detected: Column) -> Column:
    """A mapped extension over a recognised but unexpected type."""
    return F.coalesce(
        (detected != rules.UNKNOWN_TYPE) & ~F.array_contains(expected_types, detected), F.lit(False))


def with_url_check(df: DataFrame, url: str = "url") -> DataFrame:
    """Judge a download URL by its extension: is_safe, risk and reason."""
    name = F.substring_index(F.substring_index(F.col(url), "?", 1), "/", -1)
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    known = dims.extensions(df.sparkSession).select("extension", "listed_risk")
    risk = F.when(F.col("extension") == "", F.lit(rules.NO_EXTENSION_URL_RISK)).otherwise(
        F.coalesce(F.col("listed_risk"), F.lit(rules.DEFAULT_EXTENSION_RISK)))
    pct = F.format_string("%.0f", F.bround(F.col("url_risk") * 100, 0))
    dotted = F.concat(F.lit("."), F.col("extension"))
    reason = (
        F.when(F.col("extension") == "", F.lit("No extension detected"))
        .when(F.col("is_safe"), F.concat(dotted, F.lit(" is considered safe (risk: "), pct, F.lit("%)")))
        .otherwise(F.concat(dotted, F.lit(" is HIGH RISK (risk: "), pct, F.lit("%)")))
    )
    return (
        df.withColumn("extension", ext)
        .join(F.broadcast(known), "extension", "left")
        .withColumn("url_risk", risk)
        .withColumn("is_safe", F.col("url_risk") < rules.HIGH_RISK)
        .withColumn("reason", reason)
        .drop("listed_risk")
    )


def double_extension(path: Column) -> Column:
    """Two listed extensions in a row, the last of them high-risk."""
    listed = sorted(set(rules.EXTENSION_TYPES) | set(rules.EXTENSION_RISK))
    risky = sorted(e for e, r in rules.EXTENSION_RISK.items() if r >= rules.HIGH_RISK)
    name = F.lower(T.file_name(path))
    decoy = F.regexp_extract(name, r"^.+\.([^.]+)\.([^.]+)$", 1)
    real = F.regexp_extract(name, r"^.+\.([^.]+)\.([^.]+)$", 2)
    return decoy.isin(listed) & real.isin(risky)


def clean_url(url: Column, keys: list[str] | None = None) -> Column:
    """Drop tracking parameters, keep every other parameter and the fragment."""
    names = "|".join(re.escape(k) for k in (rules.TRACKING_PARAMETERS if keys is None else keys))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.regexp_replace(query, rf"(^|&)(?:{names})=[^&]*(?=&|$)", "")
    kept = F.regexp_replace(kept, "^&", "")
    return F.concat(base, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)), fragment)


# ------------------------------------------------------------ header checks

class Check(NamedTuple):
    """One header issue: where it applies and how it is reported."""

    condition: Column
    severity: str
    description: str
    indicator: str


def pattern_checks(header: Column) -> list[Check]:
    return [Check(B.has(header, p.pattern), p.severity, p.description, p.description)
            for p in rules.PATTERNS]


def pe_checks(header: Column, kind: Column) -> list[Check]:
    pe = kind == "PeExecutable"
    size = F.octet_length(header)
    full = pe & (size >= 64)
    mz = B.has_at(header, b"MZ")
    offset = B.le_uint(header, 60, 4)
    signature = F.substring(header, (offset + 1).cast("int"), F.lit(4))
    checks = [
        Check(pe & (size < 64), "Medium", "PE header too small", "TruncatedPEHeader"),
        Check(full & ~mz, "Critical", "Invalid PE signature", "InvalidPESignature"),
        Check(full & mz & (offset > rules.MAX_PE_OFFSET), "High",
              "Suspicious PE offset - possible corruption or evasion", "SuspiciousPEOffset"),
        Check(full & mz & (offset + 4 < size) & (signature != B.blob(b"PE\x00\x00")), "Medium",
              "PE signature not found at expected offset", "MissingPESignature"),
    ]
    checks += [Check(full & mz & B.has(header, mark), "Medium", f"Packed executable: {name}", "PackedExecutable")
               for mark, name in rules.PACKERS]
    return checks


def elf_checks(header: Column, kind: Column) -> list[Check]:
    elf = kind == "ElfExecutable"
    size = F.octet_length(header)
    full = elf & (size >= 16)
    return [
        Check(elf & (size < 16), "Medium", "ELF header too small", "TruncatedELFHeader"),
        Check(full & ~B.has_at(header, b"\x7fELF"), "Critical", "Invalid ELF magic bytes", "InvalidELFMagic"),
        Check(full & ~B.byte_at(header, 4).isin(1, 2), "Medium", "Invalid ELF class byte", "InvalidELFClass"),
        Check(elf & (size >= 18) & (B.le_uint(header, 16, 2) == 4), "High", "ELF core dump file", "ELFCoreDump"),
    ]


def entropy_checks(header: Column, limit: float = rules.ENTROPY_LIMIT) -> list[Check]:
    """High entropy in the first 64 bytes.

    64 bytes hold at most 6 of 8 bits, so limits of 0.75 and more can never be
    passed and the entropy is not computed at all.
    """
    if limit >= 0.75:
        return []
    head = F.substring(header, 1, 64)
    return [Check((F.octet_length(header) >= 64) & (entropy(head) / 8 > limit), "Medium",
                  "Very high entropy - possibly encrypted/packed", "HighEntropy")]


def embedded_checks(header: Column, kind: Column) -> list[Check]:
    plain = ~kind.isin("PeExecutable", "ElfExecutable")
    # The searched stretch starts at byte 4 and stops before the last byte.
    inner = F.substring(header, F.lit(5), F.octet_length(header) - 5)
    return [
        Check(plain & B.has(inner, b"MZ"), "High",
              "PE executable embedded in non-executable file", "EmbeddedPE"),
        Check(plain & B.has(inner, b"\x7fELF"), "High", "ELF executable embedded in file", "EmbeddedELF"),
    ]


def polyglot_checks(header: Column, kind: Column) -> list[Check]:
    return [
        Check((kind == "Pdf") & B.has(header, b"<script"), "High", "PDF contains JavaScript", "PDFJavaScript"),
        Check((kind == "Pdf") & B.has(header, b"/AA"), "Medium", "PDF with auto-action", "PDFAutoAction"),
        Check((kind == "Zip") & B.has_at(header, b"MZ"), "Critical",
              "File is both ZIP and PE executable (polyglot)", "PolyglotZipPE"),
    ]


def header_checks(header: Column, kind: Column, *, entropy_limit: float = rules.ENTROPY_LIMIT) -> list[Check]:
    """Every check, in report order."""
    return (pattern_checks(header) + pe_checks(header, kind) + elf_checks(header, kind)
            + entropy_checks(header, entropy_limit) + embedded_checks(header, kind)
            + polyglot_checks(header, kind))


def issue_mask(checks: list[Check]) -> Column:
    """Raised checks as bits of one BIGINT, in report order.

    Each check runs once; severities, risk, threat name and counts are then
    integer tests on the mask, and the issue array is only built on output.
    """
    if len(checks) > 63:
        raise ValueError("a mask holds at most 63 checks")
    out = F.lit(0).cast("long")
    for i, c in enumerate(checks):
        out = out.bitwiseOR(F.when(c.condition, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _bits(checks: list[Check], severities: tuple[str, ...]) -> int:
    return sum(1 << i for i, c in enumerate(checks) if c.severity in severities)


def has_severity(mask: Column, checks: list[Check], *severities: str) -> Column:
    return mask.bitwiseAND(F.lit(_bits(checks, severities))) != 0


def severity_count(mask: Column, checks: list[Check], severity: str) -> Column:
    return F.bit_count(mask.bitwiseAND(F.lit(_bits(checks, (severity,)))))


def issues(mask: Column, checks: list[Check]) -> Column:
    """The raised checks as an array of structs."""
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.struct(
            F.lit(c.severity).alias("severity"), F.lit(c.description).alias("description"),
            F.lit(c.indicator).alias("indicator")))
        for i, c in enumerate(checks)]))


def issue_risk(mask: Column, checks: list[Check]) -> Column:
    """Largest weight among raised checks."""
    out = F.lit(0.0)
    for severity, weight in sorted(rules.SEVERITY_WEIGHT.items(), key=lambda kv: kv[1]):
        out = F.when(has_severity(mask, checks, severity), F.lit(weight)).otherwise(out)
    return out


def critical_threat(mask: Column, checks: list[Check]) -> Column:
    """Indicator of the first critical check, or NULL."""
    out = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(checks))):
        if c.severity == "Critical":
            out = F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c.indicator)).otherwise(out)
    return out


def checks_for(header: str = "header", *, entropy_limit: float = rules.ENTROPY_LIMIT) -> list[Check]:
    return header_checks(F.col(header), F.col("detected_type"), entropy_limit=entropy_limit)


def with_issue_mask(df: DataFrame, header: str = "header", checks: list[Check] | None = None) -> DataFrame:
    return df.withColumn("issue_mask", issue_mask(checks_for(header) if checks is None else checks))


def with_header_issues(df: DataFrame, header: str = "header") -> DataFrame:
    """Add ``issues``, ``risk_score`` and ``threat_name``; needs ``detected_type``."""
    checks, mask = checks_for(header), F.col("issue_mask")
    return with_issue_mask(df, header, checks).select(
        *df.columns, issues(mask, checks).alias("issues"), issue_risk(mask, checks).alias("risk_score"),
        critical_threat(mask, checks).alias("threat_name"))


def issue_counts(df: DataFrame, header: str = "header") -> DataFrame:
    """Raised issues per severity, and the files they occur in.

    One scan and one one-row aggregate; nothing is exploded.
    """
    checks = checks_for(header)
    sums = []
    for s in rules.SEVERITY_WEIGHT:
        n = severity_count(F.col("issue_mask"), checks, s)
        sums += [F.sum(n).alias(s + "_n"), F.count(F.when(n > 0, 1)).alias(s + "_f")]
    one = with_issue_mask(df, header, checks).agg(*sums)
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s + "_n").alias("issues"),
                              F.col(s + "_f").alias("files")) for s in rules.SEVERITY_WEIGHT])
    return one.select(F.inline(rows)).where("issues > 0")


# ------------------------------------------------------------ verdicts

def with_verdict(
    df: DataFrame, header: str = "header", score: str = "score", *,
    threshold: float = rules.MALWARE_THRESHOLD, warn_threshold: float | None = None,
) -> DataFrame:
    """The coded cascade: spoofing, critical header issue, then model score.

    Needs ``detected_type``, ``expected_types`` and a nullable score column.
    """
    checks = [c for c in checks_for(header) if c.severity == "Critical"]
    staged = df.withColumn("_spoofed", spoofed(F.col("expected_types"), F.col("detected_type")))
    # Header bytes are searched only where the cheaper test left the file open.
    staged = staged.withColumn("_mask", F.when(~F.col("_spoofed"), issue_mask(checks)))
    staged = staged.withColumn("_critical", critical_threat(F.col("_mask"), checks))
    p = F.coalesce(F.col(score), F.lit(0.0))
    suspicious = (p >= warn_threshold) if warn_threshold is not None else F.lit(False)
    verdict = (
        F.when(F.col("_spoofed") | F.col("_critical").isNotNull() | (p >= threshold), F.lit("Malicious"))
        .when(suspicious, F.lit("Suspicious")).otherwise(F.lit("Clean"))
    )
    confidence = (
        F.when(F.col("_spoofed"), F.lit(rules.SPOOF_CONFIDENCE))
        .when(F.col("_critical").isNotNull(), F.lit(rules.CRITICAL_CONFIDENCE))
        .when((p >= threshold) | suspicious, p).otherwise(1 - p)
    )
    return staged.select(
        *df.columns, verdict.alias("verdict"), confidence.alias("confidence"),
        F.when(F.col("_spoofed"), F.lit(rules.SPOOF_THREAT)).otherwise(F.col("_critical")).alias("threat_name"),
    )


def with_priority(df: DataFrame, path: str = "path", score: str = "score",
                  *, threshold: float = rules.MALWARE_THRESHOLD) -> DataFrame:
    """The documented six-step order: first step that applies decides."""
    ext = T.file_extension(F.col(path))
    steps = [
        (double_extension(F.col(path)), 1),
        (ext.isin(rules.DANGEROUS_EXTENSIONS), 2),
        (spoofed(F.col("expected_types"), F.col("detected_type")), 3),
        (F.col("detected_type").isin(rules.DANGEROUS_HEADER_TYPES), 4),
        (F.coalesce(F.col(score), F.lit(0.0)) >= threshold, 5),
    ]
    priority = F.lit(6)
    for cond, n in reversed(steps):
        priority = F.when(cond, F.lit(n)).otherwise(priority)
    return df.withColumn("priority", priority).withColumn(
        "action", F.when(F.col("priority") < 6, F.lit("BLOCK")).otherwise(F.lit("CLEAN")))


def with_verdict_summary(df: DataFrame) -> DataFrame:
    """Add block/warn/safe flags, percent text and the summary line."""
    pct = T.percent_text(F.col("confidence"))
    conf = F.concat(F.lit(" ("), F.col("confidence_pct"), F.lit(" confidence)"))
    return (
        df.withColumn("should_block", F.col("verdict") == "Malicious")
        .withColumn("should_warn", F.col("verdict").isin("Suspicious", "Malicious"))
        .withColumn("is_safe", F.col("verdict") == "Clean")
        .withColumn("confidence_pct", pct)
        .withColumn("summary", F.when(F.col("verdict") == "Clean", F.concat(F.lit("✓ Clean"), conf))
                    .when(F.col("verdict") == "Suspicious", F.concat(F.lit("⚠ Suspicious"), conf))
                    .otherwise(F.concat(F.lit("✗ "), F.coalesce(F.col("threat_name"), F.lit("Malware")),
                                        F.lit(" detected"), conf)))
    )


def verdict_rollup(df: DataFrame, size: str = "file_size", *, triage_bytes: int = rules.TRIAGE_BYTES) -> DataFrame:
    """Files per verdict and the bytes an early stop saved."""
    saved = F.when(F.col("verdict") != "Clean", F.greatest(F.col(size) - triage_bytes, F.lit(0))).otherwise(0)
    return df.groupBy("verdict").agg(
        F.count("*").alias("files"), F.sum(size).alias("bytes_seen"), F.sum(saved).alias("bytes_saved"))


# ------------------------------------------------------------ reports

def threat_reports(df: DataFrame) -> DataFrame:
    """Score, action, block flag, full name and summary per report row.

    Needs ``filename, threat_level, threat_family, threat_variant, ai_confidence``.
    """
    full = F.when(F.col("threat_family").isNull(), F.lit("Unknown Threat")).otherwise(
        F.concat_ws(".", "threat_family", "threat_variant"))
    return (
        df.join(F.broadcast(dims.threat_levels(df.sparkSession)), "threat_level", "left")
        .withColumn("full_threat_name", full)
        .withColumn("confidence_pct", T.percent_text(F.col("ai_confidence")))
        .withColumn("summary", F.concat(
            F.lit("["), "threat_level", F.lit("] "), "filename", F.lit(" - "), "full_threat_name",
            F.lit(" (confidence: "), "confidence_pct", F.lit(")")))
    )


def attach_indicators(reports: DataFrame, indicators: DataFrame, key: str) -> DataFrame:
    """Left-join each report with its indicator rows, gathered per report.

    ``indicators`` needs ``ord`` plus any value columns.  A report's indicators
    come from the fixed check list, so each gathered list is short.
    """
    values = [c for c in indicators.columns if c != key]
    per = indicators.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ord", *[v for v in values if v != "ord"]))).alias("indicators"))
    return reports.join(per, key, "left").withColumn(
        "indicators", F.coalesce("indicators", F.array().cast(per.schema["indicators"].dataType)))


def mark_quarantined(reports: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """Flag reports whose key is in the quarantine list."""
    marks = quarantined.select(key).distinct().withColumn("_q", F.lit(True))
    return reports.join(marks, key, "left").withColumn(
        "quarantined", F.coalesce(F.col("_q"), F.lit(False))).drop("_q")


def with_hashes(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("md5", F.md5(content)).withColumn("sha256", F.sha2(F.col(content), 256))


def known_hashes(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose SHA-256 is on the known list; needs ``sha256`` on both sides."""
    return files.join(known.select("sha256"), "sha256", "left_semi")
