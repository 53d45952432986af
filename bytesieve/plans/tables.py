"""Operator inputs derived from the given tables.

The given tables hold text, events and orders; the operators want files,
media segments, playlists and transfer logs.  Each derived table is one
projection over one given table (whole rows, whole texts, no shuffle), written
once in Spark SQL and once in DuckDB SQL with the same arithmetic.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from bytesieve import rules

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def sql_list(items, dialect: str) -> str:
    body = ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)
    return f"array({body})" if dialect == "spark" else f"[{body}]"


def pick(items, index: str, dialect: str) -> str:
    """SQL: the ``index``-th (zero-based) item of a literal list."""
    fn = "element_at" if dialect == "spark" else "list_extract"
    return f"{fn}({sql_list(items, dialect)}, cast({index} as int) + 1)"


def intdiv(a: str, b: int, dialect: str) -> str:
    return f"(({a}) div {b})" if dialect == "spark" else f"(({a}) // {b})"


def hx(value: bytes) -> str:
    return value.hex().upper()


def _micros(col: str, dialect: str) -> str:
    if dialect == "spark":
        return f"timestampdiff(MICROSECOND, {EPOCH}, cast({col} as timestamp_ntz))"
    return f"epoch_us({col})"


# ---------------------------------------------------------------- files

EXTENSIONS = sorted(set(rules.EXTENSION_TYPES) | set(rules.EXTENSION_RISK)) + ["dex", "txt", "dat"]
_PREFIXES = ["00" * s.offset + hx(s.pattern) for s in rules.SIGNATURES] + [
    "FFFE", "FEFF", "", "", "", ""]
_PDF = next(i for i, s in enumerate(rules.SIGNATURES) if s.file_type == "Pdf")
_STUB = "9000" + "00" * 56 + "80000000"
_PE_GOOD = _STUB + "00" * 64 + hx(b"PE\x00\x00")
_PE_PACKED = _STUB + "00" * 68 + hx(b"UPX0")
_ELF_RUN = "020101" + "00" * 9 + "0200"
_ELF_CORE = "020101" + "00" * 9 + "0400"


def files_sql(dialect: str) -> str:
    kind = "doc_id % 45"
    variant = intdiv("doc_id", 45, dialect) + " % 3"
    pattern = pick([hx(p.pattern) for p in rules.PATTERNS],
                   intdiv("doc_id", 11, dialect) + f" % {len(rules.PATTERNS)}", dialect)
    ext = pick(EXTENSIONS, f"(doc_id * 7) % {len(EXTENSIONS)}", dialect)
    text = "encode(text, 'UTF-8')" if dialect == "spark" else "encode(text)"
    return f"""
      select doc_id as file_id, lang, source,
        concat('data/', source, '/', case
          when doc_id % 34 = 0 then concat('f', doc_id, '.mp4.exe')
          when doc_id % 17 = 0 then concat('f', doc_id, '.tar.gz')
          when doc_id % 19 = 0 then '.bashrc'
          when doc_id % 23 = 0 then 'Makefile'
          when doc_id % 5 = 0 then concat('f', doc_id, '.', upper({ext}))
          else concat('f', doc_id, '.', {ext}) end) as path,
        unhex(concat(
          {pick(_PREFIXES, kind, dialect)},
          case when {kind} = 0 and {variant} = 1 then '{_PE_GOOD}'
               when {kind} = 0 and {variant} = 2 then '{_PE_PACKED}'
               when {kind} = 1 and {variant} = 1 then '{_ELF_RUN}'
               when {kind} = 1 and {variant} = 2 then '{_ELF_CORE}'
               when {kind} = {_PDF} and {variant} = 1 then '{hx(b"<script")}'
               when {kind} = {_PDF} and {variant} = 2 then '{hx(b"/AA")}'
               else '' end,
          case when doc_id % 11 = 0 then {pattern} else '' end,
          case when doc_id % 13 = 5 then '4D5A9000' when doc_id % 13 = 7 then '7F454C46' else '' end
        )) || {text} as content
      from documents"""


# ---------------------------------------------------------------- segments

_MARKERS = [hx(r.pattern) for r in rules.FILTER_RULES] + [
    hx(b"\xfc\xfc\x30\x30"), hx(b"\xfc\x30") * 3, hx(b"\x47\xff\xff#EXT-X-DISCONTINUITY")]


def segments_sql(dialect: str) -> str:
    marker = pick(_MARKERS, f"(conv_id + turn) % {len(_MARKERS)}", dialect)
    enc = (lambda c: f"encode({c}, 'UTF-8')") if dialect == "spark" else (lambda c: f"encode({c})")
    return f"""
      select conv_id as stream_id, turn as idx,
        concat('https://cdn', conv_id % 7, '.example.com/', case conv_id % 6
          when 0 then 'hls/' when 1 then 'dash/' else 'v/' end, conv_id, case conv_id % 5
          when 0 then '.m3u8' when 1 then '.MPD' when 2 then '.mp4' when 3 then '.webm'
          else '' end) as url,
        cast(turn + 1 as double) / cast(4 as double) as duration,
        {enc('text')} || case when (conv_id * 13 + turn) % 9 = 0
          then unhex({marker}) else unhex('') end || {enc('role')} as data
      from conversations"""


# One to three transport packets per line item.
def ts_segments_sql(dialect: str) -> str:
    if dialect == "spark":
        h = lambda v, n: f"lpad(hex({v}), {n}, '0')"
        seq = "sequence(0, cast(l_linenumber % 3 as int))"
        tf = "transform({}, i -> {})"
        join = "array_join"
    else:
        h = lambda v, n: f"printf('%0{n}X', cast({v} as bigint))"
        seq = "generate_series(0, l_linenumber % 3)"
        tf = "list_transform({}, lambda i: {})"
        join = "array_to_string"
    pid = "((l_partkey + i * 31) % 8192)"
    packet = (
        f"concat(case when (l_suppkey + i) % 17 = 0 and i > 0 then '48' else '47' end, "
        f"{h(pid, 4)}, '10', repeat({h('l_quantity', 2)}, 100), "
        f"case when (l_orderkey + i) % 29 = 0 then '{hx(rules.FILTER_RULES[0].pattern)}' "
        f"when (l_orderkey + i) % 31 = 0 then '{hx(rules.FILTER_RULES[8].pattern)}0000' "
        f"else '00000000' end, repeat({h('l_orderkey % 256', 2)}, 80))"
    )
    packet = packet.replace("hex(l_quantity)", "hex(cast(l_quantity as bigint))")
    return f"""
      select l_orderkey as stream_id, l_linenumber as idx, l_partkey, l_suppkey,
        unhex({join}({tf.format(seq, packet)}, '')) as data
      from lineitem"""


# ---------------------------------------------------------------- playlists

def playlists_sql(dialect: str) -> str:
    if dialect == "spark":
        seq, tf, join = "sequence(1, cast(1 + o_orderkey % 6 as int))", "transform({}, i -> {})", "array_join"
    else:
        seq, tf, join = "generate_series(1, 1 + o_orderkey % 6)", "list_transform({}, lambda i: {})", "array_to_string"
    nl = "chr(10)"
    entry = (
        f"concat(case when (o_orderkey + i) % 11 = 0 then '#EXTINF:bad,' "
        f"when (o_orderkey + i) % 13 = 0 then '#EXT-X-DISCONTINUITY' "
        f"else concat('#EXTINF:', (o_custkey + i) % 40, '.', ((o_custkey + i) % 4) * 25, ',') end, {nl}, "
        f"case when i % 3 = 0 then concat({nl}, '# note', {nl}) else '' end, "
        f"case when (o_orderkey + i) % 4 = 0 then concat('http://b.example.org/', o_orderkey, '/', i, '.ts') "
        f"else concat('  seg', i, '.ts ') end)"
    )
    return f"""
      select o_orderkey as playlist_id,
        concat('https://cdn.example.com/v/', o_orderkey, '/index.m3u8') as base_url,
        concat('#EXTM3U', {nl}, '#EXT-X-TARGETDURATION:40', {nl},
          {join}({tf.format(seq, entry)}, {nl}), {nl}, '#EXT-X-ENDLIST') as content
      from orders"""


def masters_sql(dialect: str) -> str:
    if dialect == "spark":
        seq, tf, join = "sequence(1, cast(o_orderkey % 5 as int), 1)", "transform({}, i -> {})", "array_join"
        seq = "if(o_orderkey % 5 = 0, cast(array() as array<int>), " + seq + ")"
    else:
        seq, tf, join = "generate_series(1, o_orderkey % 5)", "list_transform({}, lambda i: {})", "array_to_string"
    nl = "chr(10)"
    entry = (
        f"concat('#EXT-X-STREAM-INF:', case when i % 2 = 0 then '' else 'PROGRAM-ID=1,' end, 'BANDWIDTH=', "
        f"case when (o_orderkey + i) % 9 = 0 then 'fast' else cast(((o_custkey * 7 + i * 3) % 6) * 400000 as varchar(20)) end, "
        f"',RESOLUTION=640x360', {nl}, "
        f"case when (o_orderkey + i) % 4 = 0 then 'http://b.example.org/' else '' end, 'v', i, '.m3u8')"
    )
    if dialect == "spark":
        entry = entry.replace("as varchar(20)", "as string")
    return f"""
      select o_orderkey as playlist_id,
        concat('https://cdn.example.com/m/', o_orderkey, '/master.m3u8') as base_url,
        concat('#EXTM3U', {nl}, {join}({tf.format(seq, entry)}, {nl})) as content
      from orders"""


# ---------------------------------------------------------------- urls

def urls_sql(dialect: str) -> str:
    ext = pick(EXTENSIONS + ["m3u8", "mpd"], f"o_orderkey % {len(EXTENSIONS) + 2}", dialect)
    return f"""
      select url from pages
      union all
      select concat(case o_orderkey % 9 when 0 then 'RTMP' when 1 then 'rtsp' else 'https' end,
        '://h', o_orderkey % 20, '.example.com/',
        case o_orderkey % 10 when 3 then 'hls/' when 4 then 'DASH/' else 'p/' end, o_orderkey,
        case when o_orderkey % 8 = 0 then '' else concat('.', {ext}) end,
        case when o_orderkey % 3 = 0 then concat('?utm_source=n', o_orderkey % 5, '&id=', o_orderkey, '&gclid=x')
             when o_orderkey % 3 = 1 and o_orderkey % 2 = 0 then '?fbclid=9#frag' else '' end) as url
      from orders"""


# ---------------------------------------------------------------- transfers

def transfers_sql(dialect: str) -> str:
    return f"""
      select event_id, user_id as task_id, {_micros('ts', dialect)} as ts_us,
        cast(round(value * 1024) as bigint) as chunk_bytes, event_type, value, props
      from events"""


def sys_metrics_sql(dialect: str) -> str:
    return f"""
      select event_id, user_id % 10 as host, {_micros('ts', dialect)} as ts_us,
        value % 100 as ram_pct, (value * 3) % 100 as cpu_pct,
        cast(floor(value * 4194304) as bigint) as used_bytes,
        cast(2000 as bigint) * 1048576 as total_bytes
      from events"""


def requests_sql(dialect: str) -> str:
    return f"""
      select event_id, {_micros('ts', dialect)} as ts_us,
        concat('https://h', user_id % 20, '.example.com/p/', event_id) as url,
        event_type in ('view', 'click', 'signup') as hit,
        event_type in ('purchase', 'view') as in_use
      from events"""


def tasks_sql(dialect: str) -> str:
    status = pick([s[0] for s in rules.STATUSES], "o_orderkey % 9", dialect)
    start = _micros("o_orderdate", dialect)
    return f"""
      select o_orderkey as task_id, {status} as status,
        concat('https://h', o_orderkey % 20, '.example.com/p/', o_orderkey) as url,
        concat('out/', o_orderkey % 1000, '/', o_orderkey, '.bin') as output_path,
        case when o_orderkey % 50 = 0 then cast(0 as bigint)
          else cast(floor(o_totalprice * 10000) as bigint) end as total_bytes,
        cast(floor(o_totalprice * 100) as bigint) * (o_custkey % 106) as done_bytes,
        (o_custkey * 3) % 500 as speed_kbps,
        {start} as started_us,
        case when o_orderkey % 7 = 3 then cast(null as bigint)
          else {start} + (o_orderkey % 500) * 1000000 + (o_custkey % 10) * 100000 end as completed_us
      from orders"""


def resume_sql(dialect: str) -> str:
    """Saved positions: one row per save, several saves per path."""
    return f"""
      select concat('out/', o_custkey, '.bin') as output_path,
        concat('https://h', o_custkey % 20, '.example.com/p/', o_custkey) as url,
        cast(floor(o_totalprice) as bigint) as bytes_downloaded,
        case when o_custkey % 21 = 0 then cast(0 as bigint) else cast(600000 as bigint) end as total_size,
        case when o_custkey % 4 = 0 then cast(null as varchar(9))
          else concat('v', o_custkey % 5) end as etag,
        cast(o_orderkey as bigint) * 60 + o_custkey % 60 as saved_at
      from orders""".replace("varchar(9)", "string" if dialect == "spark" else "varchar")


def server_sql(dialect: str) -> str:
    """What the server and the disk say about each path."""
    return """
      select concat('out/', c_custkey, '.bin') as output_path,
        concat('https://h', c_custkey % 20, '.example.com/p/',
          case when c_custkey % 9 = 0 then 0 else c_custkey end) as url,
        case when c_custkey % 6 = 0 then cast(null as string)
          else concat('v', c_custkey % 10) end as etag,
        case when c_custkey % 3 = 0 then cast(null as bigint)
          else cast(floor(c_acctbal) as bigint) end as content_length,
        case c_custkey % 4 when 0 then 'none' when 1 then cast(null as string) else 'bytes' end as accept_ranges,
        case c_custkey % 5
          when 0 then concat('attachment; filename="f', c_custkey, '.mp4"')
          when 1 then concat('inline;  filename=a', c_custkey, '=b.mp4 ; size=3')
          when 2 then 'attachment'
          when 3 then concat('attachment; filename*=UTF-8''x', c_custkey)
          else cast(null as string) end as disposition,
        cast(case c_custkey % 7 when 0 then 404 when 1 then 206 when 2 then 500 else 200 end as int) as http_status
      from customer""".replace("as string", "as string" if dialect == "spark" else "as varchar")


# ---------------------------------------------------------------- labelled data

def labelled_sql(dialect: str) -> str:
    if dialect == "spark":
        feats = ("transform(embedding, x -> case when vec_id % 37 = 0 and x > 0.2 "
                 "then double('NaN') else (cast(x as double) + 1) / 2 * (case when vec_id % 41 = 0 then 2.5 else 1.0 end) end)")
        lab = "int"
    else:
        feats = ("list_transform(embedding, lambda x: case when vec_id % 37 = 0 and x > 0.2 "
                 "then 'NaN'::double else (cast(x as double) + 1) / 2 * (case when vec_id % 41 = 0 then 2.5 else 1.0 end) end)")
        lab = "int"
    return f"""
      select vec_id as id, {feats} as features,
        cast(case when label >= 5 then 1 else 0 end as {lab}) as label
      from embeddings"""


def predictions_sql(dialect: str) -> str:
    return """
      select doc_id as id, quality as y_true, 1 - toxic as y_pred,
        ((doc_id * 37) % 101) / 100.0 as y_prob
      from labels""".replace("/ 100.0", "/ cast(100 as double)")


def logits_sql(dialect: str) -> str:
    """Two logits from the whole vector: the sums of its halves."""
    if dialect == "spark":
        half = "cast(size(embedding) div 2 as int)"
        total = lambda part: f"aggregate({part}, 0D, (a, x) -> a + x)"
        first, second = total(f"slice(embedding, 1, {half})"), total(f"slice(embedding, {half} + 1, size(embedding))")
    else:
        half = "len(embedding) // 2"
        first, second = (f"list_sum(embedding[{p}]::double[])" for p in (f"1:{half}", f"{half} + 1:"))
    return f"""
      select vec_id as id, {first} * 2 as l0, {second} * 2 as l1, label
      from embeddings"""


SOURCES = {
    "files": files_sql, "segments": segments_sql, "ts_segments": ts_segments_sql,
    "playlists": playlists_sql, "masters": masters_sql, "urls": urls_sql,
    "transfers": transfers_sql, "sys_metrics": sys_metrics_sql, "requests": requests_sql,
    "tasks": tasks_sql, "resume_saves": resume_sql, "server": server_sql,
    "labelled": labelled_sql, "predictions": predictions_sql, "logits": logits_sql,
}

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# Derived tables whose rows cost much more to build and search than to move.
CPU_BOUND = {"files", "ts_segments", "playlists", "masters"}


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out over the number of tasks that the session setting bytesieve.input.partitions names, if any.
    For tables of a single row group, which no split size can divide; unset, the files' own splits stay."""
    parts = int(df.sparkSession.conf.get("bytesieve.input.partitions", "0"))
    return df.repartition(parts) if parts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    text = SOURCES[name]("spark")
    frames = {}
    for g in GIVEN:
        if f"from {g}" in text:
            frames[g] = given(spark, sf_dir, g)
            if name in CPU_BOUND:
                frames[g] = dealt(frames[g])
            text = text.replace(f"from {g}", "from {" + g + "}")
    return spark.sql(text, **frames)


def cte(*names: str) -> str:
    """DuckDB WITH clause holding the named derived tables."""
    return "with " + ",\n".join(f"{n} as ({SOURCES[n]('duck')})" for n in names)
