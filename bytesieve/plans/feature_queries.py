"""Feature-extraction queries over the derived files table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.operators import features
from bytesieve.plans import duck as D
from bytesieve.plans.registry import query
from bytesieve.plans.tables import given, table
from bytesieve.plans.triage_queries import headers

_HEX = "0123456789ABCDEF"
_BYTES = D.HEAD + f""",
  n as (select file_id, hlen, extension, file_size, hx, spoofed,
     list_transform(generate_series(0, 511), lambda i: case when i < hlen then
       (instr('{_HEX}', substr(hx, i * 3 + 1, 1)) - 1) * 16 + instr('{_HEX}', substr(hx, i * 3 + 2, 1)) - 1 else 0 end) as b
   from e),
  w as (select file_id, unnest(generate_series(0, 511)) as i, unnest(b) as v from n),
  wc as (select file_id, i // 128 as w, v, count(*) as c from w group by 1, 2, 3),
  we as (select file_id, w, abs(-sum(c / 128.0::double * log2(c / 128.0::double))) / 8 as e from wc group by 1, 2),
  oc as (select file_id, v, sum(c)::double as c from wc group by 1, 2),
  oe as (select file_id, abs(-sum(c / 512 * log2(c / 512))) / 8 as e from oc group by 1),
  ent as (select file_id, max(we.e) filter (w = 0) as e0, max(we.e) filter (w = 1) as e1,
            max(we.e) filter (w = 2) as e2, max(we.e) filter (w = 3) as e3, max(oe.e) as e4
          from we join oe using (file_id) group by file_id),
  hist as (select file_id, list_transform(generate_series(0, 255),
            lambda k: len(list_filter(b, lambda y: y = k))) as hist from n),
  k as (select *, {D.first_signature('hx', rules.FEATURE_SIGNATURES, rules.FEATURE_UNKNOWN)} as kind,
          case when extension = '' then '' else concat('.', extension) end as dotted from n),
  mm as (select *, case kind {' '.join(
      f"when {D.q(t)} then dotted not in ({', '.join(D.q(x) for x in xs)})" for t, xs in rules.FEATURE_EXTENSIONS.items())}
      else false end as mismatch from k),
  m as (select file_id, kind, mismatch, case when file_size > 0 then least(log10(file_size) / 10, 1.0::double) else 0 end as log_size,
     len(list_filter(b[1:hlen], lambda v: v between 32 and 126)) / greatest(hlen, 1)::double as printable_density,
     len(list_filter(b[1:hlen], lambda v: v = 0)) / greatest(hlen, 1)::double as null_density,
     {D.has_at('hx', b'MZ')} as is_pe, {D.has_at('hx', bytes.fromhex('7F454C46'))} as is_elf,
     contains(hx, {D.q(D.spaced(b'This program cannot be run'))}) as pe_text,
     list_sum(b[1:hlen]) / (greatest(hlen, 1) * 255.0::double) as byte_mean, b, hlen from mm)
"""


def _digest(values) -> F.Column:
    """md5 over integer-coded slots."""
    return F.md5(F.array_join(values, ",").cast("binary"))


@query("feat_raw", _BYTES + """
  select file_id, len(b) as width, md5(array_to_string(b, ',')) as digest,
    list_sum(b)::bigint as byte_sum from n""")
def feat_raw(spark, sf):
    df = headers(spark, sf).select("file_id", features.raw_vector(F.col("header")).alias("f"))
    return df.select(
        "file_id", F.size("f").cast("long").alias("width"),
        _digest(F.transform("f", lambda x: F.round(x * 255).cast("int"))).alias("digest"),
        F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 255).cast("long")).alias("byte_sum"))


@query("feat_entropy", _BYTES + """
  select file_id, round(e0, 6) as e0, round(e1, 6) as e1, round(e2, 6) as e2, round(e3, 6) as e3, round(e4, 6) as e4
  from ent""")
def feat_entropy(spark, sf):
    df = headers(spark, sf).select("file_id", features.entropy_vector(F.col("header")).alias("e"))
    return df.select("file_id", *[F.round(F.element_at("e", i + 1), 6).alias(f"e{i}") for i in range(5)])


@query("feat_histogram", _BYTES + """
  select file_id, md5(array_to_string(hist, ',')) as digest, hist[1] as zeros, hist[33] as spaces from hist""")
def feat_histogram(spark, sf):
    df = headers(spark, sf).select("file_id", features.histogram_vector(F.col("header")).alias("h"))
    ints = df.select("file_id", F.transform("h", lambda x: F.round(x * 512).cast("int")).alias("h"))
    return ints.select("file_id", _digest(F.col("h")).alias("digest"),
                       F.element_at("h", 1).cast("long").alias("zeros"),
                       F.element_at("h", 33).cast("long").alias("spaces"))


@query("feat_magic", _BYTES + "select file_id, kind from k")
def feat_magic(spark, sf):
    return headers(spark, sf).select("file_id", features.feature_type(F.col("header")).alias("kind"))


@query("feat_ext_mismatch", _BYTES + "select file_id, kind, dotted, mismatch from mm")
def feat_ext_mismatch(spark, sf):
    df = headers(spark, sf).select("file_id", features.feature_type(F.col("header")).alias("kind"),
                                   features.dotted_extension(F.col("path")).alias("dotted"))
    return df.withColumn("mismatch", features.extension_mismatch(F.col("kind"), F.col("dotted")))


@query("feat_metadata", _BYTES + """
  select file_id, round(log_size, 6) as log_size, (kind = 'PE_EXE')::int as type_pe, (kind = 'ELF')::int as type_elf,
    (kind = 'ZIP')::int as type_zip, (kind = 'PDF')::int as type_pdf, (kind = 'UNKNOWN')::int as type_unknown,
    is_pe::int as is_pe, is_elf::int as is_elf, mismatch::int as extension_mismatch,
    round(printable_density, 6) as printable_density, round(null_density, 6) as null_density from m""")
def feat_metadata(spark, sf):
    df = headers(spark, sf).select(
        "file_id", "header", "file_size", features.feature_type(F.col("header")).alias("kind"),
        features.dotted_extension(F.col("path")).alias("ext"))
    vals = features.metadata_values(F.col("header"), F.col("file_size"), F.col("ext"), F.col("kind"))
    real = {"log_size", "printable_density", "null_density"}
    return df.select("file_id", *[
        (F.round(v, 6) if n in real else v.cast("int")).alias(n) for n, v in zip(features.METADATA_NAMES, vals)])


_FULL_LIST = """list_concat(list_concat(list_transform(b, lambda v: cast(v / 255.0::double as float)),
      [cast(e0 as float), cast(e1 as float), cast(e2 as float), cast(e3 as float), cast(e4 as float)]), list_concat(
      list_transform(hist, lambda v: cast(v / 512.0::double as float)), [cast(log_size as float),
      (kind = 'PE_EXE')::int::float, (kind = 'ELF')::int::float, (kind = 'ZIP')::int::float, (kind = 'PDF')::int::float,
      (kind = 'UNKNOWN')::int::float, is_pe::int::float, is_elf::int::float, mismatch::int::float,
      cast(printable_density as float), cast(null_density as float)]))"""
_FULL = _BYTES + f""", full_v as (select file_id, {_FULL_LIST} as f from m join ent using (file_id) join hist using (file_id))
"""


def full(spark, sf):
    return features.batch_features(headers(spark, sf)).select("file_id", "features")


@query("feat_full", _FULL + """
  select file_id, len(f) as width,
    md5(array_to_string(list_transform(f, lambda x: cast(floor(x * 1000 + 0.25) as int)), ',')) as digest from full_v""")
def feat_full(spark, sf):
    return full(spark, sf).select(
        "file_id", F.size("features").cast("long").alias("width"),
        _digest(F.transform("features", lambda x: F.floor(x * 1000 + 0.25).cast("int"))).alias("digest"))


@query("feat_names", _FULL + f""",
  s as (select unnest({features.feature_names()!r}) as name, unnest(generate_series(0, 783)) as slot),
  g as (select unnest(f) as v, unnest(generate_series(0, 783)) as slot from full_v)
  select name, slot::int as slot, round(avg(v::double) + 1e-7, 4) as mean from g join s using (slot) group by 1, 2""")
def feat_names(spark, sf):
    """Mean of every named slot over all files."""
    means = features.class_profiles(
        full(spark, sf).withColumn("label", F.lit(0)), width=features.feature_size())
    return means.join(F.broadcast(features.names_table(spark)), "slot").select(
        "name", "slot", F.round(F.col("mean") + 1e-7, 4).alias("mean"))


@query("feat_batch", _FULL + "select count(*) as files, sum(len(f))::bigint as slots from full_v")
def feat_batch(spark, sf):
    return full(spark, sf).agg(F.count("*").alias("files"), F.sum(F.size("features")).alias("slots"))


@query("feat_tested_layout", _BYTES + f"""
  , c as (select m.*, e.e as e from m join
      (select file_id, abs(-sum(p * log2(p))) / 8 as e from
        (select file_id, count(*) / max(hlen)::double as p from
          (select file_id, unnest(b[1:hlen]) as v, hlen from n) group by file_id, v) group by file_id) e using (file_id))
  select file_id, round(e, 4) as entropy, round(null_density, 4) as nulls, round(printable_density, 4) as printable,
    case when kind = 'PE_EXE' then 0 when kind = 'ELF' then 1 when kind in ('ZIP', 'RAR', 'GZIP', 'BZIP2', 'XZ') then 8
      when kind in ('PNG', 'JPEG', 'GIF', 'BMP') then 9 when kind = 'UNKNOWN' then 15 else -1 end as type_slot,
    round(log_size, 4) as log_size, mismatch::int as mismatch, pe_text::int as pe_text, round(byte_mean, 4) as byte_mean,
    md5(array_to_string(b[1:256], ',')) as head_digest from c""")
def feat_tested_layout(spark, sf):
    v = features.with_compact_features(headers(spark, sf)).select("file_id", F.col("features").alias("f"))
    at = lambda i: F.element_at("f", i + 1).cast("double")
    slot = F.array_position(F.slice("f", 265, 16), F.lit(1.0).cast("float")).cast("int") - 1
    return v.select(
        "file_id", F.round(at(256), 4).alias("entropy"), F.round(at(258), 4).alias("nulls"),
        F.round(at(261), 4).alias("printable"), slot.alias("type_slot"), F.round(at(280), 4).alias("log_size"),
        at(283).cast("int").alias("mismatch"), at(287).cast("int").alias("pe_text"),
        F.round(at(496), 4).alias("byte_mean"),
        _digest(F.transform(F.slice("f", 1, 256), lambda x: F.round(x * 255).cast("int"))).alias("head_digest"))


@query("byte_profile_by_class", _BYTES + """
  , g as (select quality as label, unnest(b[1:256]) as v, unnest(generate_series(0, 255)) as slot
      from n join labels on file_id = doc_id)
  select label, slot::int as slot, round(avg(v / 255.0::double) + 1e-7, 4) as mean from g group by 1, 2""")
def byte_profile_by_class(spark, sf):
    labels = given(spark, sf, "labels").select(F.col("doc_id").alias("file_id"), F.col("quality").alias("label"))
    v = headers(spark, sf).join(labels, "file_id").select(
        "label", features.raw_vector(F.col("header"), 256).cast("array<double>").alias("features"))
    return features.class_profiles(v).withColumn("mean", F.round(F.col("mean") + 1e-7, 4))
