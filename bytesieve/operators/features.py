"""Header bytes to numeric vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import bytesx as B
from bytesieve.functions import entropy as E
from bytesieve.functions import text as T

METADATA_NAMES = [
    "log_size", "type_pe", "type_elf", "type_zip", "type_pdf", "type_unknown",
    "is_pe", "is_elf", "extension_mismatch", "printable_density", "null_density",
]
COMPACT_SIZE = 512


def raw_vector(header: Column, width: int = rules.HEADER_SIZE, *, normalize: bool = True) -> Column:
    """Zero-padded or truncated bytes as ARRAY<FLOAT>."""
    padded = F.rpad(B.latin1(F.substring(header, 1, width)), width, "\0")
    scale = 255.0 if normalize else 1.0
    return F.transform(F.split(padded, ""), lambda c: (F.ascii(c) / F.lit(scale)).cast("float"))


def entropy_vector(header: Column, width: int = rules.HEADER_SIZE) -> Column:
    """Four window entropies and the overall one, each in [0, 1]."""
    return F.transform(E.window_entropies(header, width, rules.ENTROPY_WINDOWS), lambda e: e / 8)


def histogram_vector(header: Column, width: int = rules.HEADER_SIZE) -> Column:
    return F.transform(E.histogram(header, width), lambda c: (c / F.lit(float(width))).cast("float"))


def feature_type(header: Column) -> Column:
    return B.first_signature(header, rules.FEATURE_SIGNATURES, rules.FEATURE_UNKNOWN)


def extension_mismatch(kind: Column, dotted: Column) -> Column:
    """A type with a known extension list, under an extension not on it."""
    out = F.lit(False)
    for name, exts in rules.FEATURE_EXTENSIONS.items():
        out = F.when(kind == name, ~F.lower(dotted).isin(exts)).otherwise(out)
    return out


def dotted_extension(path: Column) -> Column:
    ext = T.file_extension(path)
    return F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))


def log_size(size: Column) -> Column:
    return F.when(size > 0, F.least(F.log10(size.cast("double")) / 10, F.lit(1.0))).otherwise(F.lit(0.0))


def printable_density(header: Column) -> Column:
    """Share of bytes 32..126 of the unpadded value."""
    t = B.latin1(header)
    return F.char_length(F.regexp_replace(t, r"[^ -~]+", "")) / F.greatest(F.octet_length(header), F.lit(1))


def null_density(header: Column) -> Column:
    t = B.latin1(header)
    kept = F.char_length(F.replace(t, F.lit("\0"), F.lit("")))
    return (F.octet_length(header) - kept) / F.greatest(F.octet_length(header), F.lit(1))


def metadata_values(header: Column, size: Column, dotted: Column, kind: Column) -> list[Column]:
    """The eleven metadata values, in slot order, as DOUBLE."""
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        log_size(size),
        *[flag(kind == k) for k in ("PE_EXE", "ELF", "ZIP", "PDF", rules.FEATURE_UNKNOWN)],
        flag(B.has_at(header, b"MZ")), flag(B.has_at(header, b"\x7fELF")),
        flag(extension_mismatch(kind, dotted)),
        printable_density(header), null_density(header),
    ]


def with_features(
    df: DataFrame, header: str = "header", size: str = "file_size", path: str = "path", *,
    width: int = rules.HEADER_SIZE, entropy: bool = True, histogram: bool = True, metadata: bool = True,
    out: str = "features",
) -> DataFrame:
    """Add the full vector: raw bytes, then each switched-on part."""
    staged = df.withColumn("_kind", feature_type(F.col(header))).withColumn("_ext", dotted_extension(F.col(path)))
    h = F.col(header)
    # everything made of the bytes alone comes from one pass over them
    parts = [E.byte_features(h, width, rules.ENTROPY_WINDOWS, entropy=entropy, histogram=histogram)]
    if metadata:
        parts.append(F.array(*metadata_values(h, F.col(size), F.col("_ext"), F.col("_kind"))).cast("array<float>"))
    return staged.withColumn(out, F.when(h.isNotNull(), F.concat(*parts))).drop("_kind", "_ext")


def feature_size(width: int = rules.HEADER_SIZE, *, entropy=True, histogram=True, metadata=True) -> int:
    return width + (5 if entropy else 0) + (256 if histogram else 0) + (11 if metadata else 0)


def feature_names(width: int = rules.HEADER_SIZE, *, entropy=True, histogram=True, metadata=True) -> list[str]:
    """A distinct name per vector slot."""
    names = [f"byte_{i}" for i in range(width)]
    if entropy:
        names += [f"entropy_window_{i}" for i in range(rules.ENTROPY_WINDOWS)] + ["entropy_overall"]
    if histogram:
        names += [f"hist_{i}" for i in range(256)]
    if metadata:
        names += METADATA_NAMES
    return names


def names_table(spark: SparkSession, **parts) -> DataFrame:
    return spark.createDataFrame(list(enumerate(feature_names(**parts))), "slot int, name string")


def batch_features(df: DataFrame, header: str = "header", **kw) -> DataFrame:
    """Vectors for every readable row; unreadable (NULL) headers are dropped."""
    return with_features(df.where(F.col(header).isNotNull()), header, **kw)


def with_compact_features(
    df: DataFrame, header: str = "header", size: str = "file_size", path: str = "path", out: str = "features",
) -> DataFrame:
    """The 512-wide layout; slots without a pinned meaning stay 0 (experimental)."""
    h = F.col(header)
    staged = (
        df.withColumn("_kind", feature_type(h)).withColumn("_ext", dotted_extension(F.col(path)))
        .withColumn("_e", E.entropy(h) / 8)
    )
    some = F.octet_length(h) > 0
    flag = lambda c: F.when(some & c, F.lit(1.0)).otherwise(F.lit(0.0))
    mean = F.aggregate(B.byte_values(B.latin1(h)), F.lit(0).cast("long"), lambda a, b: a + b) / (
        F.greatest(F.octet_length(h), F.lit(1)) * 255.0)
    zeros = lambda n: [F.lit(0.0)] * n
    onehot = [
        flag(F.col("_kind").isin([k for k, s in rules.COMPACT_TYPE_SLOTS.items() if s == slot]))
        if slot in rules.COMPACT_TYPE_SLOTS.values() else F.lit(0.0)
        for slot in range(16)
    ]
    tail = [
        F.when(some, F.col("_e")).otherwise(F.lit(0.0)), *zeros(1),           # 256-257
        null_density(h), *zeros(2), printable_density(h), *zeros(2),          # 258-263
        *onehot,                                                              # 264-279
        log_size(F.col(size)), *zeros(2),                                     # 280-282
        flag(extension_mismatch(F.col("_kind"), F.col("_ext"))), *zeros(3),   # 283-286
        flag(B.has(h, b"This program cannot be run")), *zeros(208),           # 287-495
        F.when(some, mean).otherwise(F.lit(0.0)), *zeros(15),                 # 496-511
    ]
    return staged.withColumn(out, F.concat(raw_vector(h, 256), F.array(*tail).cast("array<float>"))).drop(
        "_kind", "_ext", "_e")


def class_profiles(df: DataFrame, features: str = "features", label: str = "label", width: int = 256) -> DataFrame:
    """Mean of the first ``width`` slots per class.

    A vector summary keeps one running vector per class and task, so nothing
    is exploded before the shuffle and two classes are no hot spot.
    """
    vec = array_to_vector(F.slice(F.col(features), 1, width))
    return (
        df.groupBy(label).agg(Summarizer.mean(vec).alias("m"))
        .select(label, F.posexplode(vector_to_array("m")).alias("slot", "mean"))
    )
