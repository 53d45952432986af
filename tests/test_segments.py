import random

import pytest
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.operators import hls
from bytesieve.operators import playlists as pl
from bytesieve.operators import segments as sg

R = rules.FilterRule


def frame(spark, datas, **extra):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(datas)], "idx int, data binary")


def brute_filter(data, rule_set):
    """Reference meaning, in plain Python."""
    for r in rule_set:
        if r.pattern and r.pattern in data:
            if r.action == "BlockSegment":
                return data, r.name
            if r.action == "RemoveBytes":
                data = data.replace(r.pattern, b"")
    return data, None


def brute_ts(data, rule_set):
    out = b""
    for at in range(0, len(data) - len(data) % 188, 188):
        p = data[at:at + 188]
        pid = (p[1] & 31) << 8 | p[2]
        bad = p[0] != 0x47 or 2 <= pid <= 15 or any(r.pattern in p[4:] for r in rule_set)
        out += rules.TS_NULL_PACKET if bad else p
    return out + data[len(data) - len(data) % 188:]


CASES = [b"\xaa" * 1880, b"xx" + b"MZ\x90\x00" + b"yy", b"a\x7fELFb", b"powershell -enc z", b"cmd.exe /c del",
         b"before#EXT-X-DISCONTINUITYafter", b"\xfc\xfc\x30\x30", b"\x47\xff\xff\xfc\x30", b"", b"\xfc\x30" * 5,
         b"\xfc#EXT-X-DISCONTINUITY\x30tail"]


def test_filter_matches_brute_force(spark):
    rng = random.Random(3)
    marks = [r.pattern for r in rules.FILTER_RULES] + [b"\xfc", b"\x30", b"\x47", b"\xff", b"MZ", b"q"]
    cases = CASES + [b"".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(120)]
    custom = [R("drop_q", b"q", "Low", "RemoveBytes"), R("log", b"MZ", "Low", "LogOnly"),
              R("late_block", b"\xfc\x30\x30", "High", "BlockSegment"), R("empty", b"", "Low", "BlockSegment")]
    for rule_set in (rules.FILTER_RULES, custom, custom + rules.FILTER_RULES, []):
        got = sg.with_filtered(frame(spark, cases), rule_set).orderBy("idx").collect()
        want = [brute_filter(c, rule_set) for c in cases]
        assert [(bytes(r.filtered), r.blocked_by) for r in got] == want
        chunks = sg.filter_chunks(frame(spark, cases), rule_set).orderBy("idx").collect()
        assert [bytes(r.filtered) for r in chunks] == [b"" if b else d for d, b in want]


def test_two_threats(spark):
    r = sg.with_rule_hits(frame(spark, [b"MZ\x90\x00 powershell -enc"])).first()
    assert r.rule_hits == ["PE_Header_Injection", "PowerShell_Injection"]


def test_rules_table(spark):
    df = spark.createDataFrame([(1, "b", bytearray(b"X"), "Low", "LogOnly"), (0, "a", bytearray(b"Y"), "High", "BlockSegment")],
                               "ord int, name string, pattern binary, severity string, action string")
    assert [r.name for r in sg.rules_from(df)] == ["a", "b"]
    with pytest.raises(ValueError):
        sg.rules_from(df, most=1)
    with pytest.raises(ValueError):
        sg.rules_from(df, most_bytes=1)


def test_scan_matches_brute_force(spark):
    """Overlapping, repeated, nested and empty patterns; removals that make new matches."""
    rng = random.Random(11)
    cases = [b"", b"\x00\xff", *[bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(40))) for _ in range(150)]]
    for seed in range(4):
        r = random.Random(seed)
        made = [R(f"r{i}", bytes(r.choice(b"ab\xff") for _ in range(r.randrange(0, 5))), "Low",
                  r.choice(["LogOnly", "RemoveBytes", "RemoveBytes", "BlockSegment"])) for i in range(14)]
        got = sg.scan_rules(frame(spark, cases), made).orderBy("idx").collect()
        for c, row in zip(cases, got, strict=True):
            assert (bytes(row.filtered), row.blocked_by) == brute_filter(c, made)
            assert [(h.rule, h.at) for h in row.rule_hits] == [(x.name, c.find(x.pattern)) for x in made if x.pattern and x.pattern in c]
    none = spark.createDataFrame([(1, None)], "idx int, data binary")
    r = sg.scan_rules(none, made).first()
    assert r.rule_hits == [] and r.blocked_by is None and r.filtered is None


def test_thousand_rules_in_one_pass(spark):
    made = [R(f"w{i}", b"<%04d>" % i, "Low", "BlockSegment" if i == 777 else "LogOnly") for i in range(1000)]
    df = frame(spark, [b"..<0007>..<0993>", b"<0777>", b"none"])
    out = sg.scan_rules(df, made)
    assert [([h.rule for h in r.rule_hits], r.blocked_by) for r in out.orderBy("idx").collect()] == [
        (["w7", "w993"], None), (["w777"], "w777"), ([], None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def ts_packet(rng, pid=None, sync=0x47, payload=b""):
    pid = rng.randrange(16, 8191) if pid is None else pid
    body = payload + bytes(rng.randrange(60, 90) for _ in range(184 - len(payload)))
    return bytes([sync, pid >> 8 | rng.choice([0, 0x40]), pid & 255, 0x10]) + body


def test_ts_repair(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(40):
        pkts = [ts_packet(rng, rng.choice([None, None, 2, 15, 1, 16, 8191]), rng.choice([0x47, 0x47, 0x48]),
                          rng.choice([b"", b"", b"cmd.exe /c", b"\xfc\x30"])) for _ in range(rng.randrange(1, 5))]
        cases.append(b"".join(pkts) + rng.choice([b"", b"tail"]))
    got = [bytes(r[0]) for r in frame(spark, cases).withColumn("o", sg.ts_repaired(F.col("data"))).orderBy("idx").select("o").collect()]
    assert got == [brute_ts(c, rules.FILTER_RULES) for c in cases]


def test_oversize_and_disabled(spark):
    r = sg.filter_segments(frame(spark, [b"x" * 50 + b"MZ\x90\x00"]), max_size=10).first()
    assert not r.is_clean and r.issues == ["Segment too large: 54 bytes"]
    r = sg.filter_segments(frame(spark, [b"MZ\x90\x00"]), []).first()
    assert r.is_clean and bytes(r.clean_data) == b"MZ\x90\x00"


def play(rows, most):
    """Pieces written as they come: {stream: (next, written, bytes, waiting, dropped)}."""
    out = {}
    for s, i, at, data in sorted(rows, key=lambda r: (r[2], r[1])):
        w = out.setdefault(s, {"next": 0, "bytes": 0, "held": {}, "lost": 0})
        if i > w["next"]:
            if len(w["held"]) < most:
                w["held"][i] = len(data)
            else:
                w["lost"] += 1
        elif i == w["next"]:
            w["held"][i] = len(data)
            while w["next"] in w["held"]:
                w["bytes"] += w["held"].pop(w["next"])
                w["next"] += 1
    return {s: (w["next"], w["next"], w["bytes"], len(w["held"]), w["lost"]) for s, w in out.items()}


def timed_streams(spark, rows):
    return spark.createDataFrame([(s, i, at, bytearray(d)) for s, i, at, d in rows], "stream_id long, idx long, arrival long, data binary")


def late_pieces(seed, streams=40):
    """Late, lost and repeated pieces; arrivals of a stream are all different."""
    r = random.Random(seed)
    rows = []
    for s in range(streams):
        n = r.randrange(1, 30)
        order = [i for i in range(n) if r.random() > 0.06] + [r.randrange(n) for _ in range(r.randrange(4))]
        spread = r.choice([1, 4, 30])
        order = sorted(order, key=lambda i: i + r.random() * spread)
        rows += [(s, i, at, b"x" * r.randrange(9)) for at, i in enumerate(order)]
    return rows


@pytest.mark.parametrize("most", [0, 1, 3, 10])
def test_reassembly_as_pieces_arrive(spark, most):
    rows = late_pieces(most)
    got = {r.stream_id: r for r in sg.reassembly_summary(timed_streams(spark, rows), max_waiting=most).collect()}
    want = play(rows, most)
    assert {s: (r.next_idx, r.written, r.bytes_written, r.waiting, r.dropped) for s, r in got.items()} == want
    assert {s for s, r in got.items() if r.overflow} == {s for s, w in want.items() if w[4]}


def test_overflow_that_closes_its_gap(spark):
    """Three pieces wait for index 0, which two slots do not allow; a third slot does, and the end looks the same."""
    rows = [(1, i, at, b"ab") for at, i in enumerate([1, 2, 3, 0, 3])]
    two = sg.reassembly_summary(timed_streams(spark, rows), max_waiting=2).first()
    assert (two.next_idx, two.waiting, two.dropped, two.overflow) == (4, 0, 1, True)
    three = sg.reassembly_summary(timed_streams(spark, rows), max_waiting=3).first()
    assert (three.next_idx, three.waiting, three.dropped, three.overflow) == (4, 0, 0, False)


def streams(spark, rows):
    return spark.createDataFrame([(s, i, bytearray(d)) for s, i, d in rows], "stream_id long, idx long, data binary")


def test_reassembly_with_a_hot_stream(spark):
    rows = [(1, i, b"x") for i in range(5000) if i != 4321] + [(2, 2, b"c"), (2, 0, b"a"), (2, 1, b"b"), (3, 1, b"z")]
    at = spark.createDataFrame([(s, i, i, bytearray(d)) for s, i, d in rows], "stream_id long, idx long, arrival long, data binary")
    got = {r.stream_id: r for r in sg.reassembly_summary(at).collect()}
    assert (got[1].next_idx, got[1].written, got[1].waiting, got[1].dropped, got[1].overflow) == (4321, 4321, 10, 668, True)
    assert (got[2].next_idx, got[2].waiting) == (3, 0)
    assert (got[3].next_idx, got[3].written, got[3].overflow) == (0, 0, False)
    whole = {r.stream_id: (r.bytes, r.parts) for r in sg.stream_digests(streams(spark, rows)).collect()}
    assert whole == {1: (4999, 4999), 2: (3, 3), 3: (1, 1)}  # every stream, however much larger than the rest


def test_digest_tells_order(spark):
    one = sg.stream_digests(streams(spark, [(1, 0, b"ab"), (1, 1, b"cd")])).first().digest
    assert one == sg.stream_digests(streams(spark, [(1, 1, b"cd"), (1, 0, b"ab")])).first().digest
    assert one != sg.stream_digests(streams(spark, [(1, 0, b"cd"), (1, 1, b"ab")])).first().digest


def test_repeated_segments_are_ignored(spark):
    rows = [(1, 0, b"a"), (1, 0, b"a"), (1, 1, b"b"), (1, 5, b"f"), (1, 5, b"g")]
    r = sg.reassembly_summary(timed_streams(spark, [(s, i, n, d) for n, (s, i, d) in enumerate(rows)])).first()
    assert (r.next_idx, r.written, r.bytes_written, r.waiting) == (2, 2, 2, 1)
    at = sg.placed(sg.arrivals(streams(spark, rows))).orderBy("idx").collect()
    assert [(r.idx, r.offset, bytes(r.data)) for r in at] == [(0, 0, b"a"), (1, 1, b"b"), (5, 2, b"f")]


def test_hundred_rules(spark):
    table = spark.createDataFrame([(i, f"r{i}", bytearray(b"<%03d>" % i), "Low", "LogOnly") for i in range(100)],
                                  "ord int, name string, pattern binary, severity string, action string")
    made = sg.rules_from(table)
    df = frame(spark, [b"..<007>..<093>", b"<061><062><063>", b"none"])
    hits = [r.rule_hits for r in sg.with_rule_hits(df, made).orderBy("idx").collect()]
    assert hits == [["r7", "r93"], ["r61", "r62", "r63"], []]
    assert {r.rule: r.segments for r in sg.rule_hit_counts(df, made).collect()} == {f"r{i}": 1 for i in (7, 61, 62, 63, 93)}


def test_offsets_across_buckets(spark):
    rows = [(1, i, b"x" * (i % 5)) for i in range(700)]
    sized = streams(spark, rows).select("stream_id", "idx", F.octet_length("data").cast("long").alias("length"))
    got = sg.with_offsets(sized, width=64).orderBy("idx").collect()
    at = 0
    for r in got:
        assert r.offset == at
        at += r.length


def test_chain(spark):
    class Off:
        is_enabled = False

        def __call__(self, df):
            raise AssertionError

    out = sg.chain(frame(spark, [b"a"]), lambda d: d.withColumn("n", F.lit(1)), Off())
    assert "n" in out.columns


def test_stats_numbers(spark):
    one = spark.range(1)
    assert one.select(sg.saved_pct(F.lit(100), F.lit(1000))).first()[0] == 10.0
    assert one.select(sg.saved_pct(F.lit(1), F.lit(0))).first()[0] == 0.0
    assert one.select(sg.throughput_mbps(F.lit(1048576), F.lit(1000))).first()[0] == 1.0
    assert one.select(sg.throughput_mbps(F.lit(5), F.lit(0))).first()[0] == 0.0


@pytest.mark.parametrize("url,kind", [
    ("http://a/x.M3U8", "Hls"), ("http://a/hls/x", "Hls"), ("http://a/x.mpd", "Dash"), ("rtmp://a", "Rtmp"),
    ("rtsp://a/x.mp4", "Rtsp"), ("http://a/x.webm", "Progressive"), ("http://a/x.mp4?y", "Unknown")])
def test_stream_type(spark, url, kind):
    assert spark.range(1).select(sg.stream_type(F.lit(url))).first()[0] == kind


def test_playlist(spark):
    text = "#EXTM3U\r\n#EXTINF:5.0,\nseg0.ts\n#EXTINF:5.0,t\n# note\n\nseg1.ts\n#EXTINF:4.5\nhttp://b/seg2.ts\nbare.ts\n#EXTINF:x,\nbad.ts"
    df = spark.createDataFrame([(1, "http://a/v/i.m3u8", text)], "id int, base_url string, content string")
    got = [(r.idx, r.url, r.duration) for r in pl.entries(df).orderBy("idx").collect()]
    assert got == [(0, "http://a/v/seg0.ts", 5.0), (1, "http://a/v/seg1.ts", 5.0), (2, "http://b/seg2.ts", 4.5),
                   (3, "http://a/v/bare.ts", 0.0), (4, "http://a/v/bad.ts", 0.0)]
    r = pl.durations(df, "id").first()
    assert (r.segments, r.total_duration) == (5, 14.5)


@pytest.mark.parametrize("text,want", [
    ("#EXT-X-STREAM-INF:BANDWIDTH=100\na\n#EXT-X-STREAM-INF:BANDWIDTH=300\nb\n#EXT-X-STREAM-INF:BANDWIDTH=300\nc", "h/b"),
    ("#EXT-X-STREAM-INF:BANDWIDTH=0\na", None), ("#EXT-X-STREAM-INF:BANDWIDTH=x\na", None), ("", None),
    ("#EXT-X-STREAM-INF:BANDWIDTH=9\n#EXT-X-STREAM-INF:BANDWIDTH=5\na\nb", "h/a")])
def test_best_variant(spark, text, want):
    assert spark.range(1).select(pl.best_variant(F.lit(text), F.lit("h/m"))).first()[0] == want


def test_whole_hls_path(spark):
    """Two levels of masters, a circle, a lost playlist, a playlist without a valid variant, lost segments."""
    m = lambda *v: "#EXTM3U\n" + "\n".join(f"#EXT-X-STREAM-INF:BANDWIDTH={b}\n{u}" for b, u in v)
    docs = spark.createDataFrame([
        ("http://a/top", m((5, "low"), (9, "v/mid"))), ("http://a/v/mid", m((1, "media"))),
        ("http://a/v/media", "#EXTINF:2.0,\ns0.ts\n#EXTINF:3.0,\ns1.ts\n#EXTINF:4.0,\nhttp://z/s2.ts\ns3.ts"),
        ("http://a/ring", m((1, "http://a/ring"))), ("http://a/none", m((0, "x"))), ("http://a/gone", m((3, "nowhere"))),
        ("http://a/flat", "#EXTINF:1.0,\nflat.ts")], "url string, content string")
    streams_ = spark.createDataFrame([(1, "http://a/top"), (2, "http://a/ring"), (3, "http://a/none"), (4, "http://a/gone"),
                                      (5, "http://a/flat"), (6, "http://a/unknown")], "stream_id long, url string")
    bodies = spark.createDataFrame([("http://a/v/s0.ts", bytearray(b"abc")), ("http://a/v/s1.ts", bytearray(b"xMZ\x90\x00")),
                                    ("http://a/v/s3.ts", bytearray(b"de")), ("http://a/flat.ts", bytearray(b"f"))], "url string, data binary")
    found = {r.stream_id: (r.base_url, r.content is None, r.hops) for r in hls.media_playlists(streams_, docs).collect()}
    assert found[1] == ("http://a/v/media", False, 2) and found[5] == ("http://a/flat", False, 0)
    assert all(found[s][1] for s in (2, 3, 4, 6)) and found[2][2] == hls.MAX_HOPS
    entries = hls.cleaned(streams_, docs, bodies)
    assert [(r.stream_id, r.idx, r.state) for r in entries.orderBy("stream_id", "idx").collect()] == [
        (1, 0, "clean"), (1, 1, "blocked"), (1, 2, "failed"), (1, 3, "clean"), (5, 0, "clean")]
    assert [(r.stream_id, r.idx, r.length, r.offset) for r in hls.output_parts(entries).orderBy("stream_id", "idx").collect()] == [
        (1, 0, 3, 0), (1, 3, 2, 3), (5, 0, 1, 0)]
    s = {r.stream_id: r for r in hls.stats(streams_, entries).collect()}
    assert (s[1].total_segments, s[1].clean_segments, s[1].blocked_segments, s[1].failed_fetches, s[1].bytes_written) == (4, 2, 2, 1, 5)
    assert len(s) == 6 and s[4].total_segments == 0 and s[6].bytes_received == 0
