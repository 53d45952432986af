import pytest
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import text as T
from bytesieve.operators import triage

PNG = b"\x89PNG\r\n\x1a\n"
ELF = b"\x7fELF\x02\x01\x01\x00"

TYPES = [
    (PNG + bytes(504), "Png"), (b"MZ\x90\x00\x03\x00\x00\x00", "PeExecutable"), (ELF + bytes(504), "ElfExecutable"),
    (b"#!/bin/bash\necho", "ShellScript"), (b"%PDF-1.7" + bytes(503), "Pdf"),
    (b"\x00\x00\x00\x18ftypisom" + bytes(500), "Mp4"), (b"\xca\xfe\xba\xbe\x00\x00\x00\x02", "MachoExecutable"),
    (b"BCDEFGHI", "Unknown"), (b"", "Unknown"), (b"\x89", "Unknown"), (bytes(16), "Unknown"),
    (b"\xff\xfea", "Utf16Le"), (b"\xfe\xffa", "Utf16Be"), (b"\xef\xbb\xbfhi", "Utf16Le"),
    (b"RIFF\x00\x00\x00\x00WAVE", "Webp"), (b"\x00\x00\x00\x18fty", "Unknown"), (b"M", "Unknown"),
]


def frame(spark, rows, names):
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], names)


def test_detect_type(spark):
    df = frame(spark, [(i, h) for i, (h, _) in enumerate(TYPES)], "id int, header binary")
    got = [r.detected_type for r in triage.with_detected_type(df).orderBy("id").collect()]
    assert got == [t for _, t in TYPES]


def test_containers_by_brand(spark):
    rows = [(b"RIFF\x00\x00\x00\x00WAVE", "Wav"), (b"RIFF\x00\x00\x00\x00AVI ", "Avi"),
            (b"RIFF\x00\x00\x00\x00WEBP", "Webp"), (b"\x00\x00\x00\x18ftypqt  ", "Mov"),
            (b"\x00\x00\x00\x18ftypM4A ", "M4a"), (b"\x1a\x45\xdf\xa3..webm", "Webm"), (b"\x1a\x45\xdf\xa3..", "Mkv")]
    df = frame(spark, [(i, h) for i, (h, _) in enumerate(rows)], "id int, header binary")
    got = [r.detected_type for r in triage.with_detected_type(df, by_container=True).orderBy("id").collect()]
    assert got == [t for _, t in rows]


@pytest.mark.parametrize("name,ext", [
    ("video.MP4", "mp4"), ("archive.tar.gz", "gz"), ("Makefile", ""), (".bashrc", ""), ("a/b.c/d", ""),
    ("a/b.txt/", "txt"), ("x.", ""), ("..", ""),
])
def test_extension(spark, name, ext):
    assert spark.range(1).select(T.file_extension(F.lit(name))).first()[0] == ext


def check(spark, header, kind, name="x.bin"):
    df = frame(spark, [(header, kind, name)], "header binary, detected_type string, path string")
    return triage.with_header_issues(df).first()


def test_issues(spark):
    clean = check(spark, PNG + bytes(504), "Png")
    assert clean.issues == [] and clean.risk_score == 0.0 and clean.threat_name is None
    shell = check(spark, PNG + bytes(100) + b"powershell -enc AAAA", "Png")
    assert [i.severity for i in shell.issues] == ["Critical"] and shell.threat_name == "Encoded PowerShell execution"
    pe = check(spark, PNG + bytes(100) + b"MZ\x90\x00" + bytes(392), "Png")
    assert [i.indicator for i in pe.issues] == ["EmbeddedPE"] and pe.risk_score == 0.8
    script = check(spark, b'CreateObject("WScript.Shell")' + bytes(483), "Unknown")
    assert [i.severity for i in script.issues] == ["High", "Medium"]


def test_embedded_stops_before_last_byte(spark):
    assert check(spark, bytes(10) + b"MZ", "Png").issues == []
    assert [i.indicator for i in check(spark, bytes(10) + b"MZ\x00", "Png").issues] == ["EmbeddedPE"]
    assert check(spark, b"abcMZ", "Png").issues == []
    assert check(spark, b"ab", "Png").issues == []


def test_structures(spark):
    ind = lambda h, k: [i.indicator for i in check(spark, h, k).issues]
    assert ind(b"MZ" + bytes(10), "PeExecutable") == ["TruncatedPEHeader"]
    stub = b"MZ" + bytes(58)
    assert ind(stub + (0x200000).to_bytes(4, "little") + bytes(64), "PeExecutable") == ["SuspiciousPEOffset"]
    assert ind(stub + (64).to_bytes(4, "little") + b"PE\x00\x00" + bytes(8), "PeExecutable") == []
    assert ind(stub + (64).to_bytes(4, "little") + b"NE\x00\x00UPX0UPX1", "PeExecutable") == [
        "MissingPESignature", "PackedExecutable", "PackedExecutable"]
    assert ind(b"\x7fELF\x02", "ElfExecutable") == ["TruncatedELFHeader"]
    assert ind(b"\x7fELF\x07" + bytes(11) + b"\x04\x00", "ElfExecutable") == ["InvalidELFClass", "ELFCoreDump"]
    assert ind(b"PK\x03\x04<script", "Zip") == []
    assert ind(b"%PDF<script /AA", "Pdf") == ["PDFJavaScript", "PDFAutoAction"]
    assert ind(b"MZ" + bytes(8), "Zip") == ["PolyglotZipPE"]


def test_entropy_rule_cannot_fire_by_default_but_does_below(spark):
    assert triage.entropy_checks(F.col("header")) == []
    df = frame(spark, [(bytes(range(64)),), (bytes(64),)], "header binary")
    c = triage.entropy_checks(F.col("header"), limit=0.7)
    assert [r[0] for r in df.select(c[0].condition).collect()] == [True, False]


def test_verdict_cascade(spark):
    rows = [("a.png", b"MZ" + bytes(70), 0.0), ("a.png", PNG + b"powershell -enc ", 0.0), ("a.png", PNG, 0.9),
            ("a.png", PNG, 0.7), ("a.png", PNG, None), ("a.docx", b"PK\x03\x04", 0.1)]
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)], "id int, path string, header binary, score double")
    df = triage.with_extension_facts(triage.with_extension(triage.with_detected_type(df)))
    got = triage.with_verdict(df, warn_threshold=0.6).orderBy("id").collect()
    assert [r.verdict for r in got] == ["Malicious", "Malicious", "Malicious", "Suspicious", "Clean", "Clean"]
    assert [r.threat_name for r in got][:3] == ["ExtensionSpoofing", "Encoded PowerShell execution", None]
    assert got[0].confidence == 0.99 and got[1].confidence == 0.95


def test_priority_and_double_extension(spark):
    rows = [("movie.mp4.exe", PNG, 1), ("run.sh", PNG, 2), ("a.jpg", PNG, 3), ("tool", b"\x7fELF" + bytes(20), 4),
            ("a.png", PNG, 6), ("a.tar.gz", b"\x1f\x8b", 6)]
    df = frame(spark, [(i, p, h, 0.0) for i, (p, h, _) in enumerate(rows)], "id int, path string, header binary, score double")
    df = triage.with_extension_facts(triage.with_extension(triage.with_detected_type(df)))
    assert [r.priority for r in triage.with_priority(df).orderBy("id").collect()] == [w for *_, w in rows]


@pytest.mark.parametrize("url,safe,risk", [
    ("https://x/video.mp4", True, 0.0), ("https://x/malware.exe?a=1", False, 1.0), ("https://x/script.ps1", False, 1.0),
    ("https://evil.com", False, 1.0), ("https://x/none", True, 0.1), ("https://x/a.zzz", True, 0.3)])
def test_url(spark, url, safe, risk):
    r = triage.with_url_check(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.is_safe, r.url_risk) == (safe, risk)


def test_clean_url(spark):
    one = lambda u: spark.range(1).select(triage.clean_url(F.lit(u))).first()[0]
    assert one("http://a/b?utm_source=x&id=3&gclid=9#f") == "http://a/b?id=3#f"
    assert one("http://a/b?gclid=9&fbclid=2") == "http://a/b"
    assert one("http://a/b?xref=1") == "http://a/b?xref=1"


def test_rule_tables():
    assert len(rules.SIGNATURES) == 39 and len(rules.PATTERNS) == 18 and len(rules.FILE_TYPES) == 48
    assert len(rules.FEATURE_SIGNATURES) == 20 and len(rules.FILTER_RULES) == 10


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_local(spark, sf_dir):
    from bytesieve.plans import catalog
    text = plan(catalog.queries()["triage_verdict"](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "SortMergeJoin" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text
    text = plan(catalog.queries()["task_progress"](spark, sf_dir))
    assert "Exchange" not in text
