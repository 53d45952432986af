"""Fixed rule tables.

Everything in this module is data: values that decide results and therefore
have to be exactly these.  No behaviour lives here; operators turn the tables
into column expressions or into small joins whose size never depends on the
input.
"""

from __future__ import annotations

from typing import NamedTuple

# --------------------------------------------------------------------------
# Header signatures, in match order (bytes, type, offset).
# --------------------------------------------------------------------------


class Signature(NamedTuple):
    pattern: bytes
    file_type: str
    offset: int = 0


SIGNATURES = [
    # executables
    Signature(b"MZ", "PeExecutable"),
    Signature(b"\x7fELF", "ElfExecutable"),
    Signature(b"\xca\xfe\xba\xbe", "MachoExecutable"),
    Signature(b"\xfe\xed\xfa\xce", "MachoExecutable"),
    Signature(b"\xce\xfa\xed\xfe", "MachoExecutable"),
    # scripts
    Signature(b"#!/bin/sh", "ShellScript"),
    Signature(b"#!/bin/bash", "ShellScript"),
    Signature(b"#!/usr/bin/env bash", "ShellScript"),
    Signature(b"#!/usr/bin/python", "PythonScript"),
    Signature(b"<?php", "PhpScript"),
    # images
    Signature(b"\x89PNG\r\n\x1a\n", "Png"),
    Signature(b"\xff\xd8\xff", "Jpeg"),
    Signature(b"GIF87a", "Gif"),
    Signature(b"GIF89a", "Gif"),
    Signature(b"BM", "Bmp"),
    Signature(b"RIFF", "Webp"),
    # video
    Signature(b"\x1a\x45\xdf\xa3", "Mkv"),
    Signature(b"ftyp", "Mp4", 4),
    Signature(b"FLV\x01", "Flv"),
    # audio
    Signature(b"ID3", "Mp3"),
    Signature(b"\xff\xfb", "Mp3"),
    Signature(b"\xff\xf3", "Mp3"),
    Signature(b"fLaC", "Flac"),
    Signature(b"OggS", "Ogg"),
    Signature(b"RIFF", "Wav"),
    # archives
    Signature(b"PK\x03\x04", "Zip"),
    Signature(b"PK\x05\x06", "Zip"),
    Signature(b"Rar!\x1a\x07\x00", "Rar"),
    Signature(b"Rar!\x1a\x07\x01", "Rar"),
    Signature(b"7z\xbc\xaf\x27\x1c", "SevenZip"),
    Signature(b"\x1f\x8b", "Gzip"),
    Signature(b"BZh", "Bzip2"),
    # documents
    Signature(b"%PDF", "Pdf"),
    Signature(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "MsOfficeOld"),
    Signature(b"\xef\xbb\xbf", "Utf16Le"),
    # markup
    Signature(b"<?xml", "Xml"),
    Signature(b"<!DOCTYPE", "Html"),
    Signature(b"<html", "Html"),
    # java
    Signature(b"\xca\xfe\xba\xbe", "JavaClass"),
]

# Byte-order marks tried after every signature failed.
BYTE_ORDER_MARKS = [
    Signature(b"\xff\xfe", "Utf16Le"),
    Signature(b"\xfe\xff", "Utf16Be"),
]

UNKNOWN_TYPE = "Unknown"

# Optional corrected table: containers are told apart by their inner brand.
# Each row needs *all* of its (bytes, offset) parts; rows precede SIGNATURES.
CONTAINER_SIGNATURES = [
    ([(b"RIFF", 0), (b"WAVE", 8)], "Wav"),
    ([(b"RIFF", 0), (b"AVI ", 8)], "Avi"),
    ([(b"ftypqt", 4)], "Mov"),
    ([(b"ftypM4A", 4)], "M4a"),
]

# Every file type code.
FILE_TYPES = [
    "Png", "Jpeg", "Gif", "Bmp", "Webp", "Tiff", "Ico",
    "Mp4", "Mkv", "Webm", "Avi", "Mov", "Flv", "Wmv",
    "Mp3", "Flac", "Ogg", "Wav", "Aac", "M4a",
    "Zip", "Rar", "SevenZip", "Gzip", "Bzip2", "Tar", "Xz",
    "PeExecutable", "ElfExecutable", "MachoExecutable", "JavaClass",
    "ShellScript", "PowerShell", "BatchFile", "PythonScript",
    "JavaScriptFile", "PhpScript", "VbsScript",
    "Pdf", "MsOfficeOld", "MsOfficeNew", "Rtf",
    "Xml", "Html", "Json", "Utf16Le", "Utf16Be", "Unknown",
]

# Risk per file type; every other type has DEFAULT_TYPE_RISK.
TYPE_RISK = {
    "PeExecutable": 1.0, "ElfExecutable": 1.0, "MachoExecutable": 1.0,
    "VbsScript": 0.9, "BatchFile": 0.9, "PowerShell": 0.85, "ShellScript": 0.8,
    "PhpScript": 0.7, "JavaClass": 0.7, "JavaScriptFile": 0.6,
    "Pdf": 0.35, "MsOfficeOld": 0.4, "MsOfficeNew": 0.3, "Rtf": 0.35,
    "PythonScript": 0.4, "Zip": 0.2, "Rar": 0.2, "SevenZip": 0.2,
    "Mp4": 0.05, "Mkv": 0.05, "Webm": 0.05, "Avi": 0.05, "Mov": 0.05, "Flv": 0.05,
    "Mp3": 0.02, "Flac": 0.02, "Ogg": 0.02, "Wav": 0.02, "Aac": 0.02,
    "Png": 0.01, "Jpeg": 0.01, "Gif": 0.01, "Bmp": 0.01, "Webp": 0.01,
    "Unknown": 0.5,
}
DEFAULT_TYPE_RISK = 0.1

EXECUTABLE_TYPES = ["PeExecutable", "ElfExecutable", "MachoExecutable", "JavaClass"]
SCRIPT_TYPES = [
    "ShellScript", "PowerShell", "BatchFile", "PythonScript",
    "JavaScriptFile", "PhpScript", "VbsScript",
]
# File types that are blocked whatever the name says.
DANGEROUS_HEADER_TYPES = ["PeExecutable", "ElfExecutable", "MachoExecutable"]

# Display names; every other type shows DEFAULT_TYPE_NAME.
TYPE_NAMES = {
    "PeExecutable": "Windows Executable (PE)",
    "ElfExecutable": "Linux Executable (ELF)",
    "MachoExecutable": "macOS Executable (Mach-O)",
    "ShellScript": "Shell Script",
    "PowerShell": "PowerShell Script",
    "BatchFile": "Batch File",
    "VbsScript": "VBScript",
    "PhpScript": "PHP Script",
    "JavaScriptFile": "JavaScript",
    "Pdf": "PDF Document",
    "Zip": "ZIP Archive",
    "Mp4": "MP4 Video",
    "Png": "PNG Image",
    "Jpeg": "JPEG Image",
    "Mp3": "MP3 Audio",
    "Unknown": "Unknown",
}
DEFAULT_TYPE_NAME = "Unknown Type"

# File types an extension may hold.
EXTENSION_TYPES = {
    "png": ["Png"], "jpg": ["Jpeg"], "jpeg": ["Jpeg"], "gif": ["Gif"],
    "bmp": ["Bmp"], "webp": ["Webp"], "tiff": ["Tiff"], "tif": ["Tiff"],
    "ico": ["Ico"], "svg": ["Xml", "Html"],
    "mp4": ["Mp4"], "m4v": ["Mp4"], "mkv": ["Mkv"], "webm": ["Webm"],
    "avi": ["Avi"], "mov": ["Mov"], "flv": ["Flv"], "wmv": ["Wmv"],
    "mp3": ["Mp3"], "flac": ["Flac"], "ogg": ["Ogg"], "wav": ["Wav"],
    "aac": ["Aac"], "m4a": ["M4a"],
    "zip": ["Zip"], "rar": ["Rar"], "7z": ["SevenZip"], "gz": ["Gzip"],
    "bz2": ["Bzip2"], "tar": ["Tar"], "xz": ["Xz"],
    "exe": ["PeExecutable"], "dll": ["PeExecutable"], "scr": ["PeExecutable"],
    "com": ["PeExecutable"], "pif": ["PeExecutable"],
    "so": ["ElfExecutable"], "dylib": ["MachoExecutable"],
    "sh": ["ShellScript"], "bash": ["ShellScript"], "zsh": ["ShellScript"],
    "ps1": ["PowerShell"], "bat": ["BatchFile"], "cmd": ["BatchFile"],
    "py": ["PythonScript"], "js": ["JavaScriptFile"], "php": ["PhpScript"],
    "vbs": ["VbsScript"],
    "pdf": ["Pdf"], "doc": ["MsOfficeOld"], "xls": ["MsOfficeOld"],
    "ppt": ["MsOfficeOld"], "docx": ["MsOfficeNew", "Zip"],
    "xlsx": ["MsOfficeNew", "Zip"], "pptx": ["MsOfficeNew", "Zip"],
    "rtf": ["Rtf"],
}

# Risk per extension; every other one has DEFAULT_EXTENSION_RISK.
EXTENSION_RISK_GROUPS = {
    1.0: ["exe", "dll", "scr", "com", "pif", "vbs", "bat", "cmd", "ps1"],
    0.8: ["sh", "bash", "php", "jar", "msi", "apk", "dmg", "app", "deb", "rpm"],
    0.4: ["py", "js", "rb", "pl", "r", "class", "swf", "pdf", "doc", "xls", "ppt"],
    0.2: ["zip", "rar", "7z", "gz", "bz2", "tar", "xz"],
    0.0: [
        "mp4", "mkv", "avi", "mov", "flv", "wmv", "webm",
        "mp3", "flac", "ogg", "wav", "aac", "m4a",
        "png", "jpg", "jpeg", "gif", "bmp", "webp", "svg",
    ],
}
EXTENSION_RISK = {ext: risk for risk, exts in EXTENSION_RISK_GROUPS.items() for ext in exts}
DEFAULT_EXTENSION_RISK = 0.3
HIGH_RISK = 0.7
NO_EXTENSION_URL_RISK = 0.1

# Extensions that run directly.
EXECUTABLE_EXTENSIONS = [
    "exe", "dll", "scr", "com", "pif", "msi", "bat", "cmd", "ps1", "vbs",
    "so", "dylib", "app", "dex", "apk",
]
# Extensions blocked on sight.
DANGEROUS_EXTENSIONS = ["exe", "bat", "sh", "jar"]

# --------------------------------------------------------------------------
# Suspicious header patterns in report order.
# --------------------------------------------------------------------------


class Pattern(NamedTuple):
    pattern: bytes
    description: str
    severity: str


PATTERNS = [
    Pattern(b"\x60\x89\xe5\x31\xd2", "Linux shellcode pattern", "Critical"),
    Pattern(b"\xfc\xe8\x82\x00\x00\x00", "Windows shellcode (Metasploit)", "Critical"),
    Pattern(b"cmd.exe /c", "Command injection attempt", "High"),
    Pattern(b"powershell -enc", "Encoded PowerShell execution", "Critical"),
    Pattern(b"powershell -e ", "Encoded PowerShell execution", "Critical"),
    Pattern(b"WScript.Shell", "WScript Shell object creation", "High"),
    Pattern(b"CreateObject(", "ActiveX object creation", "Medium"),
    Pattern(b"regsvr32", "RegSvr32 bypass technique", "High"),
    Pattern(b"mshta.exe", "MSHTA execution", "High"),
    Pattern(b"certutil.exe", "CertUtil abuse", "High"),
    Pattern(b"eval(base64_decode", "PHP base64 eval", "Critical"),
    Pattern(b"eval(", "JavaScript eval execution", "Medium"),
    Pattern(b"document.write(unescape", "Obfuscated JavaScript", "High"),
    Pattern(b"<script>eval", "Inline script eval", "High"),
    Pattern(b"fromCharCode", "JavaScript char obfuscation", "Medium"),
    Pattern(b"VirtualAlloc", "Memory allocation (shellcode)", "High"),
    Pattern(b"WriteProcessMemory", "Process injection attempt", "Critical"),
    Pattern(b"CreateRemoteThread", "Remote thread creation", "Critical"),
]

# Issue weights.
SEVERITY_WEIGHT = {"Critical": 1.0, "High": 0.8, "Medium": 0.5, "Low": 0.2, "Info": 0.0}

# Packer markers.
PACKERS = [
    (b"UPX0", "UPX packer (evasion)"),
    (b"UPX1", "UPX packer (evasion)"),
    (b"MPRESS", "MPRESS packer"),
    (b"Themida", "Themida protector"),
    (b"ASPack", "ASPack packer"),
]
MAX_PE_OFFSET = 0x100000
ENTROPY_LIMIT = 0.95

# The triage cascade.
SPOOF_THREAT = "ExtensionSpoofing"
SPOOF_CONFIDENCE = 0.99
CRITICAL_CONFIDENCE = 0.95
MALWARE_THRESHOLD = 0.85
HEADER_SIZE = 512
TRIAGE_BYTES = 102400

# Threat levels, low to high (name, score, blocking, action).
THREAT_LEVELS = [
    ("Info", 0, False, "INFO: No action required."),
    ("Low", 25, False, "INFO: Potentially unwanted content detected."),
    ("Medium", 50, False, "WARN: Proceed with caution. Scan with antivirus."),
    ("High", 75, True, "BLOCK: Download blocked. File may be harmful."),
    ("Critical", 100, True,
     "BLOCK: Do not download. Delete any partial files. Report to security team."),
]

# --------------------------------------------------------------------------
# Stream filter rules in evaluation order.
# --------------------------------------------------------------------------


class FilterRule(NamedTuple):
    name: str
    pattern: bytes
    severity: str
    action: str  # BlockSegment | RemoveBytes | LogOnly


FILTER_RULES = [
    FilterRule("PE_Header_Injection", b"MZ\x90\x00", "Critical", "BlockSegment"),
    FilterRule("ELF_Header_Injection", b"\x7fELF", "Critical", "BlockSegment"),
    FilterRule("PowerShell_Injection", b"powershell -enc", "Critical", "BlockSegment"),
    FilterRule("CMD_Injection", b"cmd.exe /c", "Critical", "BlockSegment"),
    FilterRule("Shell_Injection", b"#!/bin/", "High", "BlockSegment"),
    FilterRule("Metasploit_Shellcode", b"\xfc\xe8\x82\x00\x00\x00", "Critical", "BlockSegment"),
    FilterRule("Cobalt_Strike_Beacon", b"\x4d\x5a\x90\x00\x03\x00\x00\x00\x04\x00",
               "Critical", "BlockSegment"),
    FilterRule("HLS_Ad_Marker", b"#EXT-X-DISCONTINUITY", "Low", "RemoveBytes"),
    FilterRule("SCTE35_Ad_Cue", b"\xfc\x30", "Low", "RemoveBytes"),
    FilterRule("Invalid_TS_Sync", b"\x47\xff\xff", "Medium", "RemoveBytes"),
]

# Transport packets.
TS_PACKET_SIZE = 188
TS_SYNC_BYTE = 0x47
TS_NULL_PID = 0x1FFF
TS_RESERVED_PIDS = (0x0002, 0x000F)
TS_NULL_PACKET = bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(184)
MAX_SEGMENT_SIZE = 50 * 1024 * 1024
MAX_BUFFERED_SEGMENTS = 10

# Stream kinds and their display names.
STREAM_TYPES = [
    ("Hls", "HLS (HTTP Live Streaming)", True),
    ("Dash", "DASH (Dynamic Adaptive Streaming)", True),
    ("Progressive", "Progressive Download", False),
    ("Rtmp", "RTMP", True),
    ("Rtsp", "RTSP", True),
    ("WebRtc", "WebRTC", False),
    ("Unknown", "Unknown", False),
]
PROGRESSIVE_SUFFIXES = [".mp4", ".mkv", ".avi", ".webm"]

# Container track policy; tracks not listed are dropped.
TRACK_POLICY = [
    ("video", "KEEP"), ("audio", "KEEP"), ("subtitle", "KEEP"),
    ("script", "DROP"), ("attachment", "DROP"), ("metadata", "DROP"), ("data", "DROP"),
]

# --------------------------------------------------------------------------
# The feature extractor's own signature table, in match order.
# --------------------------------------------------------------------------
FEATURE_SIGNATURES = [
    Signature(b"\x4d\x5a", "PE_EXE"),
    Signature(b"\x7fELF", "ELF"),
    Signature(b"\xce\xfa\xed\xfe", "MACHO32"),
    Signature(b"\xcf\xfa\xed\xfe", "MACHO64"),
    Signature(b"\x50\x4b\x03\x04", "ZIP"),
    Signature(b"\x52\x61\x72\x21", "RAR"),
    Signature(b"\x1f\x8b", "GZIP"),
    Signature(b"\x42\x5a\x68", "BZIP2"),
    Signature(b"\xfd\x37\x7a\x58", "XZ"),
    Signature(b"\x25\x50\x44\x46", "PDF"),
    Signature(b"\xd0\xcf\x11\xe0", "OLE"),
    Signature(b"\x89\x50\x4e\x47", "PNG"),
    Signature(b"\xff\xd8\xff", "JPEG"),
    Signature(b"\x47\x49\x46\x38", "GIF"),
    Signature(b"\x42\x4d", "BMP"),
    Signature(b"\x00\x00\x00\x20\x66\x74\x79\x70", "MP4"),
    Signature(b"\x49\x44\x33", "MP3"),
    Signature(b"\x52\x49\x46\x46", "WAV"),
    Signature(b"\x23\x21", "SHEBANG"),
    Signature(b"\xef\xbb\xbf", "UTF8_BOM"),
]
FEATURE_UNKNOWN = "UNKNOWN"
# Dotted extensions each feature type accepts.
FEATURE_EXTENSIONS = {
    "PE_EXE": [".exe", ".dll", ".sys", ".com"],
    "ELF": [".elf", ".so", ".out", ""],
    "PDF": [".pdf"],
    "ZIP": [".zip", ".apk", ".jar", ".docx", ".xlsx"],
    "PNG": [".png"],
    "JPEG": [".jpg", ".jpeg"],
    "MP4": [".mp4", ".m4v"],
    "MP3": [".mp3"],
}
ENTROPY_WINDOWS = 4
# One-hot group of each feature type in the compact layout.
COMPACT_TYPE_SLOTS = {
    "PE_EXE": 0, "ELF": 1,
    "ZIP": 8, "RAR": 8, "GZIP": 8, "BZIP2": 8, "XZ": 8,
    "PNG": 9, "JPEG": 9, "GIF": 9, "BMP": 9,
    "UNKNOWN": 15,
}

# --------------------------------------------------------------------------
# Dataset checks.
# --------------------------------------------------------------------------
VALID_LABELS = [0, 1]
MIN_SAMPLES = 100
MIN_SAMPLES_PER_CLASS = 10
MAX_IMBALANCE = 100.0
MAX_NAN_FRACTION = 0.01
FEATURE_RANGE = (-0.01, 1.01)
SPLIT_RATIOS = (0.70, 0.15, 0.15)
AUGMENT_FACTOR = 3
NOISE_LEVEL = 0.05
DROPOUT_RATE = 0.05
MAX_SHIFT = 8
SCALE_RANGE = (0.95, 1.05)
STRATEGIES = ["noise", "dropout", "shift", "scale", "combined"]

# Quality and latency gates.
MIN_ACCURACY = 0.95
MAX_FNR = 0.02
MAX_MEAN_MS = 100.0
MAX_P95_MS = 200.0
MAX_SCORE_DIFF = 1e-4
PROB_SUM_TOLERANCE = 1e-5

# --------------------------------------------------------------------------
# Transfer states (status, terminal, active, description).
# --------------------------------------------------------------------------
STATUSES = [
    ("Queued", False, False, "Waiting in queue"),
    ("Downloading", False, True, "Downloading"),
    ("Scanning", False, True, "Scanning for threats"),
    ("Complete", True, False, "Download complete"),
    ("Blocked", True, False, "Blocked - threat detected"),
    ("Cancelled", True, False, "Cancelled"),
    ("Failed", True, False, "Failed"),
    ("Paused", False, False, "Paused"),
    ("Resuming", False, True, "Resuming"),
]
TERMINAL_STATUSES = ["Complete", "Blocked", "Cancelled", "Failed"]

# Resource levels, low to high (level, name, speed, slots, text).
RESOURCE_LEVELS = [
    (0, "Low", 1.0, 4, "System free - full speed"),
    (1, "Medium", 0.7, 2, "Moderate usage - reduced speed"),
    (2, "High", 0.3, 1, "High usage - minimal speed"),
    (3, "Critical", 0.0, 0, "Critical - downloads paused"),
]
RAM_CUTS = (65.0, 80.0, 95.0)
CPU_CUTS = (60.0, 80.0, 95.0)
RAM_CRITICAL_PCT = 95.0

# Error kinds (kind, category, recoverable, security).
ERROR_KINDS = [
    ("Network", "network", True, False),
    ("Io", "io", False, False),
    ("AI", "ai", False, False),
    ("Stream", "stream", False, False),
    ("Config", "config", False, False),
    ("ThreatDetected", "security", False, True),
    ("Internal", "internal", False, False),
    ("FFmpeg", "ffmpeg", False, False),
    ("Parse", "parse", False, False),
    ("Timeout", "timeout", True, False),
    ("NotFound", "not_found", False, False),
    ("PermissionDenied", "permission", False, False),
    ("Cancelled", "cancelled", False, False),
]

# Transfer error message formats ({} are the error's fields).
TRANSFER_ERRORS = {
    "HttpError": "HTTP error: %s - %s",
    "Timeout": "Connection timeout after %ss",
    "ConnectionRefused": "Connection refused: %s",
    "TlsError": "SSL/TLS error: %s",
    "TooManyRedirects": "Too many redirects: %s",
    "WriteError": "File write error: %s",
    "InvalidResumeOffset": "Resume failed: offset %s exceeds file size %s",
    "Cancelled": "Download cancelled",
    "Network": "Network error: %s",
}

MAX_RETRIES = 3
RETRY_DELAY_MS = 1000
RESUME_TTL_SECS = 7 * 24 * 3600
IDLE_SECS = 90

# Query keys that only track visitors; the list is a parameter of url_clean.
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "ref",
]
