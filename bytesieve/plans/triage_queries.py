"""Triage queries over the derived files table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import ordered as O
from bytesieve.functions import text as T
from bytesieve.functions.entropy import entropy
from bytesieve.operators import dims, triage
from bytesieve.plans import duck as D
from bytesieve.plans.registry import query
from bytesieve.plans.tables import cte, given, table


def headers(spark, sf) -> DataFrame:
    """File rows with their 512-byte header and full size."""
    return table(spark, sf, "files").select(
        "file_id", "path", "content",
        F.substring("content", 1, rules.HEADER_SIZE).alias("header"),
        F.octet_length("content").cast("long").alias("file_size"),
        (F.col("file_id") * 37 % 101 / F.lit(100.0)).alias("score"),
    )


def typed(spark, sf) -> DataFrame:
    return triage.with_detected_type(headers(spark, sf))


def judged_inputs(spark, sf) -> DataFrame:
    return triage.with_extension_facts(triage.with_extension(typed(spark, sf)))


@query("detect_type", D.HEAD + "select file_id, detected_type from t")
def detect_type(spark, sf):
    return typed(spark, sf).select("file_id", "detected_type")


@query("detect_type_by_container", D.HEAD + f"""
  select file_id, case
    when {D.has_at('hx', bytes.fromhex('1A45DFA3'))} and {D.has('hx', b'webm')} then 'Webm'
    when {D.has_at('hx', b'RIFF')} and {D.has_at('hx', b'WAVE', 8)} then 'Wav'
    when {D.has_at('hx', b'RIFF')} and {D.has_at('hx', b'AVI ', 8)} then 'Avi'
    when {D.has_at('hx', b'ftypqt', 4)} then 'Mov'
    when {D.has_at('hx', b'ftypM4A', 4)} then 'M4a'
    else detected_type end as detected_type from t""")
def detect_type_by_container(spark, sf):
    return triage.with_detected_type(headers(spark, sf), by_container=True).select("file_id", "detected_type")


@query("type_dim", D.HEAD + """
  select file_id, t.detected_type, type_risk, is_executable, is_script, type_name
  from t join type_dim using (detected_type)""")
def type_dim(spark, sf):
    return triage.with_type_facts(typed(spark, sf)).select(
        "file_id", "detected_type", "type_risk", "is_executable", "is_script", "type_name")


@query("type_census", D.HEAD + """
  select detected_type, count(*) as files, round(avg(type_risk), 6) as mean_risk, max(type_risk) as max_risk,
    bool_or(is_executable) as is_executable, bool_or(is_script) as is_script
  from t join type_dim using (detected_type) group by detected_type""")
def type_census(spark, sf):
    return triage.type_census(typed(spark, sf))


@query("file_extension", D.HEAD + "select file_id, name, extension from x")
def file_extension(spark, sf):
    return triage.with_extension(headers(spark, sf)).select(
        "file_id", T.file_name(F.col("path")).alias("name"), "extension")


@query("extension_risk", D.HEAD + "select file_id, extension, extension_risk from e")
def extension_risk(spark, sf):
    return judged_inputs(spark, sf).select("file_id", "extension", "extension_risk")


@query("extension_flags", D.HEAD + """
  select file_id, extension_risk >= 0.7 as is_high_risk, runs as is_executable_extension,
    expected_types is not null as is_known_extension from e""")
def extension_flags(spark, sf):
    return judged_inputs(spark, sf).select(
        "file_id", "is_high_risk", "is_executable_extension", "is_known_extension")


@query("high_risk_extensions", D.HEAD + """
  select d.extension, d.listed_risk as extension_risk, count(e.file_id) as files
  from ext_dim d left join e on d.extension = e.extension where d.listed_risk >= 0.7 group by 1, 2""")
def high_risk_extensions(spark, sf):
    """The high-risk list, with how many files carry each extension."""
    counts = triage.with_extension(headers(spark, sf)).groupBy("extension").agg(F.count("*").alias("files"))
    return (
        triage.high_risk_extensions(spark).join(counts, "extension", "left")
        .select("extension", "extension_risk", F.coalesce("files", F.lit(0)).alias("files"))
    )


@query("spoofed", D.HEAD + "select file_id, extension, detected_type, spoofed from e")
def spoofed(spark, sf):
    return judged_inputs(spark, sf).select(
        "file_id", "extension", "detected_type",
        triage.spoofed(F.col("expected_types"), F.col("detected_type")).alias("spoofed"))


_URL = cte("urls") + f""",
  {D.EXT_DIM},
  u as (select url, {D.ext_of("regexp_extract(regexp_extract(url, '^([^?]*)', 1), '([^/]*)$', 1)")} as extension from urls),
  r as (select u.url, u.extension, case when u.extension = '' then 0.1::double
          else coalesce(d.listed_risk, 0.3::double) end as url_risk
        from u left join ext_dim d on u.extension = d.extension)
"""


@query("validate_url", _URL + """
  select url, url_risk < 0.7 as is_safe, url_risk,
    case when extension = '' then 'No extension detected'
      when url_risk < 0.7 then concat('.', extension, ' is considered safe (risk: ', printf('%.0f', url_risk * 100), '%)')
      else concat('.', extension, ' is HIGH RISK (risk: ', printf('%.0f', url_risk * 100), '%)') end as reason
  from r""")
def validate_url(spark, sf):
    return triage.with_url_check(table(spark, sf, "urls")).select("url", "is_safe", "url_risk", "reason")


@query("double_extension", D.HEAD + f"""
  , p as (select file_id, name, string_split(lower(name), '.') as parts from h)
  select file_id, name, coalesce(len(parts) >= 3
    and list_contains({sorted(set(rules.EXTENSION_TYPES) | set(rules.EXTENSION_RISK))!r}, parts[-2])
    and list_contains({sorted(e for e, r in rules.EXTENSION_RISK.items() if r >= rules.HIGH_RISK)!r}, parts[-1]), false)
    as double_extension
  from p""")
def double_extension(spark, sf):
    return headers(spark, sf).select(
        "file_id", T.file_name(F.col("path")).alias("name"),
        triage.double_extension(F.col("path")).alias("double_extension"))


@query("dangerous_extension", D.HEAD + """
  select file_id, name, extension from e where extension in ('exe', 'bat', 'sh', 'jar')""")
def dangerous_extension(spark, sf):
    return (
        triage.with_extension(headers(spark, sf))
        .where(F.col("extension").isin(rules.DANGEROUS_EXTENSIONS))
        .select("file_id", T.file_name(F.col("path")).alias("name"), "extension")
    )


# ------------------------------------------------------------ header checks

def _tags(df: DataFrame, checks) -> DataFrame:
    """file_id and its issues as one text, in report order."""
    mask = df.withColumn("m", triage.issue_mask(checks))
    return mask.select("file_id", F.array_join(F.transform(
        triage.issues(F.col("m"), checks), lambda i: F.concat(i["severity"], F.lit(":"), i["indicator"])), "|")
        .alias("issues"))


def _duck_checks() -> dict[str, list[tuple[str, str, str]]]:
    off = D.le("hx", 60, 4)
    pe, elf = "detected_type = 'PeExecutable'", "detected_type = 'ElfExecutable'"
    plain = "detected_type not in ('PeExecutable', 'ElfExecutable')"
    inner = "substr(hx, 13, greatest(hlen - 5, 0) * 3)"
    full = f"{pe} and hlen >= 64"
    return {
        "patterns": [(D.has("hx", p.pattern), p.severity, p.description) for p in rules.PATTERNS],
        "pe": [
            (f"{pe} and hlen < 64", "Medium", "TruncatedPEHeader"),
            (f"{full} and {off} > 1048576", "High", "SuspiciousPEOffset"),
            (f"{full} and {off} + 4 < hlen and substr(hx, cast(least({off}, 4096) * 3 + 1 as bigint), 12) <> '50 45 00 00 '",
             "Medium", "MissingPESignature"),
        ] + [(f"{full} and {D.has('hx', m)}", "Medium", "PackedExecutable") for m, _ in rules.PACKERS],
        "elf": [
            (f"{elf} and hlen < 16", "Medium", "TruncatedELFHeader"),
            (f"{elf} and hlen >= 16 and {D.byte('hx', 4)} not in (1, 2)", "Medium", "InvalidELFClass"),
            (f"{elf} and hlen >= 18 and {D.le('hx', 16, 2)} = 4", "High", "ELFCoreDump"),
        ],
        "embedded": [
            (f"{plain} and {D.has(inner, b'MZ')}", "High", "EmbeddedPE"),
            (f"{plain} and {D.has(inner, bytes.fromhex('7F454C46'))}", "High", "EmbeddedELF"),
        ],
        "polyglot": [
            (f"detected_type = 'Pdf' and {D.has('hx', b'<script')}", "High", "PDFJavaScript"),
            (f"detected_type = 'Pdf' and {D.has('hx', b'/AA')}", "Medium", "PDFAutoAction"),
        ],
    }


_CHECKS = _duck_checks()
_ALL = [c for g in ("patterns", "pe", "elf", "embedded", "polyglot") for c in _CHECKS[g]]


def _duck_tags(group) -> str:
    items = ", ".join(f"case when {c} then {D.q(s + ':' + i)} end" for c, s, i in group)
    return f"array_to_string(list_filter([{items}], lambda v: v is not null), '|')"


def _duck_risk(group) -> str:
    arms = ", ".join(f"case when {c} then {rules.SEVERITY_WEIGHT[s]!r}::double else 0.0::double end" for c, s, _ in group)
    return f"greatest({arms})"


def _duck_threat(group) -> str:
    arms = ", ".join(f"case when {c} then {D.q(i)} end" for c, s, i in group if s == "Critical")
    return f"coalesce({arms})"


def _check_query(name, key, build):
    @query(name, D.HEAD + f"select file_id, {_duck_tags(_CHECKS[key])} as issues from t")
    def run(spark, sf):
        df = typed(spark, sf)
        return _tags(df, build(F.col("header"), F.col("detected_type")))
    return run


_check_query("pattern_hits", "patterns", lambda h, k: triage.pattern_checks(h))
_check_query("pe_structure", "pe", triage.pe_checks)
_check_query("elf_structure", "elf", triage.elf_checks)
_check_query("embedded_exec", "embedded", triage.embedded_checks)
_check_query("polyglot", "polyglot", triage.polyglot_checks)


@query("entropy64", D.HEAD + """
  , b as (select file_id, unnest(string_split(rtrim(substr(hx, 1, 192)), ' ')) as byte from x where hlen >= 64),
  c as (select file_id, byte, count(*) as n from b group by 1, 2)
  select file_id, round(-sum(n / 64.0::double * log2(n / 64.0::double)) / 8, 6) as entropy,
    -sum(n / 64.0::double * log2(n / 64.0::double)) / 8 > 0.95 as is_high
  from c group by file_id""")
def entropy64(spark, sf):
    e = headers(spark, sf).where(F.octet_length("header") >= 64).select(
        "file_id", (entropy(F.substring("header", 1, 64)) / 8).alias("e"))
    return e.select("file_id", F.round("e", 6).alias("entropy"), (F.col("e") > rules.ENTROPY_LIMIT).alias("is_high"))


@query("header_issues", D.HEAD + f"""
  select file_id, {_duck_tags(_ALL)} as issues, {_duck_risk(_ALL)} as risk_score,
    {_duck_threat(_ALL)} as threat_name from t""")
def header_issues(spark, sf):
    return triage.with_header_issues(typed(spark, sf)).select(
        "file_id",
        F.array_join(F.transform("issues", lambda i: F.concat(i["severity"], F.lit(":"), i["indicator"])), "|").alias("issues"),
        "risk_score", "threat_name")


@query("issue_counts", D.HEAD + f"""
  , i as (select file_id, unnest(list_filter([{', '.join(f"case when {c} then '{s}' end" for c, s, _ in _ALL)}],
            lambda v: v is not null)) as severity from t)
  select severity, count(*) as issues, count(distinct file_id) as files from i group by severity""")
def issue_counts(spark, sf):
    return triage.issue_counts(typed(spark, sf))


@query("issue_flags", D.HEAD + f"""
  , r as (select file_id, {_duck_risk(_ALL)} as risk from t)
  select file_id, risk >= 1.0 as is_critical, risk >= 0.8 as has_high from r""")
def issue_flags(spark, sf):
    checks, mask = triage.checks_for(), F.col("issue_mask")
    return triage.with_issue_mask(typed(spark, sf), "header", checks).select(
        "file_id", triage.has_severity(mask, checks, "Critical").alias("is_critical"),
        triage.has_severity(mask, checks, "Critical", "High").alias("has_high"))


# ------------------------------------------------------------ verdicts

_VERDICT = D.HEAD + f"""
  , v0 as (select *, case when spoofed then null else {_duck_threat(_ALL)} end as crit from e),
  v as (select file_id, file_size, detected_type,
    case when spoofed or crit is not null or score >= 0.85 then 'Malicious'
      when score >= 0.6 then 'Suspicious' else 'Clean' end as verdict,
    round(case when spoofed then 0.99 when crit is not null then 0.95 when score >= 0.6 then score
      else 1 - score end, 6) as confidence,
    case when spoofed then 'ExtensionSpoofing' else crit end as threat_name from v0)
"""


def verdicts(spark, sf) -> DataFrame:
    return triage.with_verdict(judged_inputs(spark, sf), warn_threshold=0.6).select(
        "file_id", "path", "file_size", "detected_type", "verdict",
        F.round("confidence", 6).alias("confidence"), "threat_name")


@query("triage_verdict", _VERDICT + """
  select file_id, file_size, type_name as detected_type, verdict, confidence, threat_name
  from v join type_dim using (detected_type)""")
def triage_verdict(spark, sf):
    return triage.with_type_facts(verdicts(spark, sf)).select(
        "file_id", "file_size", F.col("type_name").alias("detected_type"), "verdict", "confidence", "threat_name")


@query("triage_priority", D.HEAD + f"""
  , p as (select *, string_split(lower(name), '.') as parts from e),
  d as (select *, case
    when coalesce(len(parts) >= 3
      and list_contains({sorted(set(rules.EXTENSION_TYPES) | set(rules.EXTENSION_RISK))!r}, parts[-2])
      and list_contains({sorted(e for e, r in rules.EXTENSION_RISK.items() if r >= rules.HIGH_RISK)!r}, parts[-1]), false) then 1
    when extension in ('exe', 'bat', 'sh', 'jar') then 2
    when spoofed then 3
    when detected_type in ('PeExecutable', 'ElfExecutable', 'MachoExecutable') then 4
    when score >= 0.85 then 5 else 6 end as priority from p)
  select file_id, priority, case when priority < 6 then 'BLOCK' else 'CLEAN' end as action from d""")
def triage_priority(spark, sf):
    return triage.with_priority(judged_inputs(spark, sf)).select("file_id", "priority", "action")


@query("verdict_summary", _VERDICT + """
  select file_id, verdict, verdict = 'Malicious' as should_block, verdict <> 'Clean' as should_warn,
    verdict = 'Clean' as is_safe, concat(printf('%.1f', confidence * 100), '%') as confidence_pct,
    case verdict when 'Clean' then concat('✓ Clean (', printf('%.1f', confidence * 100), '% confidence)')
      when 'Suspicious' then concat('⚠ Suspicious (', printf('%.1f', confidence * 100), '% confidence)')
      else concat('✗ ', coalesce(threat_name, 'Malware'), ' detected (', printf('%.1f', confidence * 100), '% confidence)')
    end as summary
  from v""")
def verdict_summary(spark, sf):
    return triage.with_verdict_summary(verdicts(spark, sf)).select(
        "file_id", "verdict", "should_block", "should_warn", "is_safe", "confidence_pct", "summary")


@query("verdict_rollup", _VERDICT + """
  select verdict, count(*) as files, cast(sum(file_size) as bigint) as bytes_seen,
    cast(sum(case when verdict <> 'Clean' then greatest(file_size - 102400, 0) else 0 end) as bigint) as bytes_saved
  from v group by verdict""")
def verdict_rollup(spark, sf):
    return triage.verdict_rollup(verdicts(spark, sf))


# ------------------------------------------------------------ reports

_REPORT = D.HEAD + f"""
  , {D.values(rules.THREAT_LEVELS, 'threat_level, score, requires_blocking, action', 'levels')},
  i as (select *, {_duck_risk(_ALL)} as risk, {_duck_threat(_ALL)} as crit from e),
  r as (select file_id, name as filename, case when risk >= 1 then 'Critical' when risk >= 0.8 then 'High'
      when risk >= 0.5 then 'Medium' when spoofed then 'Low' else 'Info' end as threat_level,
    coalesce(crit, case when spoofed then 'ExtensionSpoofing' end) as threat_family,
    case when file_id % 2 = 0 then detected_type end as threat_variant,
    i.score as ai_confidence from i)
"""


def report_rows(spark, sf) -> DataFrame:
    df = judged_inputs(spark, sf)
    checks, mask = triage.checks_for(), F.col("issue_mask")
    sp = triage.spoofed(F.col("expected_types"), F.col("detected_type"))
    risk = F.col("risk")
    return (
        triage.with_issue_mask(df, "header", checks)
        .withColumn("risk", triage.issue_risk(mask, checks))
        .withColumn("_family", triage.critical_threat(mask, checks))
        .select(
            "file_id", T.file_name(F.col("path")).alias("filename"),
            F.when(risk >= 1, "Critical").when(risk >= 0.8, "High").when(risk >= 0.5, "Medium")
            .when(sp, "Low").otherwise("Info").alias("threat_level"),
            F.coalesce("_family", F.when(sp, F.lit(rules.SPOOF_THREAT))).alias("threat_family"),
            F.when(F.col("file_id") % 2 == 0, F.col("detected_type")).alias("threat_variant"),
            F.col("score").alias("ai_confidence"))
    )


@query("threat_report", _REPORT + """
  , n as (select r.*, case when threat_family is null then 'Unknown Threat'
      when threat_variant is null then threat_family else concat(threat_family, '.', threat_variant) end as full_threat_name
    from r)
  select file_id, n.threat_level, l.score, requires_blocking, action, full_threat_name,
    concat('[', n.threat_level, '] ', filename, ' - ', full_threat_name, ' (confidence: ',
      printf('%.1f', ai_confidence * 100), '%)') as summary
  from n join levels l on n.threat_level = l.threat_level""")
def threat_report(spark, sf):
    return triage.threat_reports(report_rows(spark, sf)).select(
        "file_id", "threat_level", "score", "requires_blocking", "action", "full_threat_name", "summary")


@query("threat_indicators", D.HEAD + f"""
  select file_id, {_duck_tags(_ALL)} as indicators from t""")
def threat_indicators(spark, sf):
    """Indicator rows, stored as a table of their own, gathered back onto their report."""
    df = triage.with_header_issues(typed(spark, sf))
    # The outer form keeps the optimizer from copying the whole check list
    # into a size(issues) > 0 filter below the generator.
    rows = df.select("file_id", F.posexplode_outer("issues").alias("ord", "i")).select(
        "file_id", "ord", F.concat("i.severity", F.lit(":"), "i.indicator").alias("value"))
    out = triage.attach_indicators(df.select("file_id"), O.written(rows, "indicators"), "file_id")
    return out.select("file_id", F.array_join("indicators.value", "|").alias("indicators"))


@query("quarantine_set", _VERDICT + """
  select file_id, verdict, file_id in (select doc_id from labels where toxic = 1) as quarantined from v""")
def quarantine_set(spark, sf):
    """Every report, clean ones too, with its quarantine flag."""
    listed = given(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return triage.mark_quarantined(verdicts(spark, sf).select("file_id", "verdict"), listed, "file_id")


@query("url_clean", cte("urls") + f""",
  p as (select url, regexp_extract(url, '^([^?#]*)', 1) as base, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as qs,
          regexp_extract(url, '(#.*)$', 1) as frag from urls),
  k as (select *, array_to_string(list_filter(string_split(qs, '&'),
          lambda v: not list_contains({rules.TRACKING_PARAMETERS!r}, string_split(v, '=')[1]) and v <> ''), '&') as kept from p)
  select url, concat(base, case when kept = '' then '' else concat('?', kept) end, frag) as cleaned from k""")
def url_clean(spark, sf):
    return table(spark, sf, "urls").select("url", triage.clean_url(F.col("url")).alias("cleaned"))


@query("hash_files", cte("files") + " select file_id, md5(content) as md5, sha256(content) as sha256 from files")
def hash_files(spark, sf):
    return triage.with_hashes(table(spark, sf, "files")).select("file_id", "md5", "sha256")


_KNOWN = cte("files") + """,
  k as (select distinct sha256(content) as sha256 from files join labels on file_id = doc_id where toxic = 1)"""


@query("known_hash_match", _KNOWN + """
  select file_id, sha256(content) as sha256 from files where sha256(content) in (select sha256 from k)""")
def known_hash_match(spark, sf):
    """Files whose content is on the known-bad list (here: labelled toxic)."""
    files = triage.with_hashes(table(spark, sf, "files")).select("file_id", "sha256")
    bad = given(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    known = files.join(bad, "file_id", "left_semi").select("sha256").distinct()
    return triage.known_hashes(files, known).select("file_id", "sha256")
