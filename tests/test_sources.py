import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

from bytesieve import session
from bytesieve.operators import triage
from bytesieve.sources import files, sinks, text
from bytesieve.sources.header_source import HeaderReader, Store


@pytest.fixture()
def folder(tmp_path):
    for kind, head in (("benign", b"\x89PNG\r\n\x1a\n"), ("malicious", b"MZ\x90\x00")):
        d = tmp_path / kind / "samples"
        d.mkdir(parents=True)
        for i in range(3):
            (d / f"{i}.bin").write_bytes(head + bytes(i * 1000))
    (tmp_path / "benign" / "samples" / "empty.bin").write_bytes(b"")
    return tmp_path


def test_headers_and_labels(spark, folder):
    df = files.sample_folders(spark, str(folder), {"benign": 0, "malicious": 1}, size=16)
    rows = {(r.label, r.path.rsplit("/", 1)[1]): r for r in triage.with_detected_type(df).collect()}
    assert len(rows) == 7
    assert rows[(0, "2.bin")].detected_type == "Png" and rows[(0, "2.bin")].file_size == 2008
    assert len(rows[(1, "2.bin")].header) == 16 and rows[(1, "0.bin")].detected_type == "PeExecutable"
    assert bytes(rows[(0, "empty.bin")].header) == b"" and rows[(0, "empty.bin")].detected_type == "Unknown"


def test_missing_file_gives_null(spark):
    df = spark.createDataFrame([("/nowhere/x",), (None,)], "path string")
    assert [r[0] for r in df.select(files.prefix(F.col("path"))).collect()] == [None, None]


def test_listing_depth_and_glob(spark, folder):
    deep = folder / "benign" / "samples" / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "deep.bin").write_bytes(b"x")
    (folder / "top.txt").write_bytes(b"yy")
    names = lambda **kw: sorted(r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(folder), **kw).collect())
    assert names() == sorted(["0.bin", "1.bin", "2.bin"] * 2 + ["empty.bin", "deep.bin", "top.txt"])
    assert names(recursive=False) == ["top.txt"] and names(glob="*.txt") == ["top.txt"]


def test_flat_folder_is_listed_in_shares(spark, tmp_path):
    """50,000 empty files in one folder: no partition keeps more than a share, all of them keep everything once."""
    for i in range(50_000):
        (tmp_path / f"{i:05d}.bin").touch()
    (tmp_path / "other.txt").touch()
    reader = HeaderReader({"path": str(tmp_path), "filesPerTask": "6000", "size": "0"})
    parts = reader.partitions()
    assert len(parts) == 9 and all(p.shares == 9 for p in parts)
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(sizes) == 50_001 and max(sizes) < 6500
    assert all(b.num_rows <= 1000 for b in reader.read(parts[0]))
    df = files.file_headers(spark, str(tmp_path), glob="*.bin", per_task=6000)
    assert df.rdd.getNumPartitions() == 9
    assert df.select("path").distinct().count() == 50_000
    found = df.where(F.col("path").endswith("7.bin") & (F.col("file_size") == 0))
    assert found.count() == 5000


def test_filters_reach_the_listing(tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.bin").write_bytes(b"x" * i)
    reader = HeaderReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([StringEndsWith(("path",), "1.bin"), GreaterThan(("file_size",), 5), EqualTo(("header",), b"x")]))
    assert [type(f) for f in rest] == [EqualTo]
    opened = []
    reader_prefix = Store.prefix
    try:
        Store.prefix = lambda self, path, size: opened.append(path) or reader_prefix(self, path, size)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        Store.prefix = reader_prefix
    assert [(r["file_size"], len(r["header"])) for r in rows] == [(11, 11)] and len(opened) == 1


def test_folders_beyond_the_plan_are_walked_by_tasks(spark, tmp_path):
    for i in range(30):
        d = tmp_path / f"a{i}" / "b"
        d.mkdir(parents=True)
        (d / "x.bin").write_bytes(b"abc")
        (tmp_path / f"a{i}" / "y.bin").write_bytes(b"d")
    reader = HeaderReader({"path": str(tmp_path), "plannedFolders": "5"})
    parts = reader.partitions()
    assert sum(p.deep for p in parts) > 20
    assert sorted(len(r["header"]) for p in parts for b in reader.read(p) for r in b.to_pylist()) == [1] * 30 + [3] * 30
    assert files.list_files(spark, str(tmp_path)).count() == 60
    with pytest.raises(FileNotFoundError):
        HeaderReader({"path": str(tmp_path / "none")}).partitions()


def test_response_prefix(spark):
    df = spark.createDataFrame([(200, bytearray(b"abcdef")), (206, bytearray(b"xy")), (404, bytearray(b"no"))], "http_status int, body binary")
    assert [bytes(r.header) for r in files.response_prefix(df, 4).collect()] == [b"abcd", b"xy"]


@pytest.mark.parametrize("probe,want", [
    ('{"streams":[{"codec_name":"h264","width":1920,"height": 1080}],"format":{"duration":"12.5","bit_rate":"1200999"}}',
     (12.5, 1200, 1920, 1080, "h264")),
    ('{"width":7', (0.0, 0, 0, 0, "")), ('{}', (0.0, 0, 0, 0, "")), ('{"bit_rate":"N/A","duration":3.5}', (3.5, 0, 0, 0, ""))])
def test_media_probe(spark, probe, want):
    r = text.media_probe(spark.createDataFrame([(probe,)], "probe string")).first()
    assert (r.duration_secs, r.bitrate_kbps, r.width, r.height, r.video_codec or "") == want


def test_resume_text(spark, tmp_path):
    (tmp_path / "a.resume").write_text("bytes=42\npath=out/a\ntimestamp=7")
    (tmp_path / "b.resume").write_text("bytes=x\npath=out/b=c")
    rows = {r.output_path: (r.bytes_downloaded, r.saved_at) for r in text.resume_files(spark, str(tmp_path)).collect()}
    assert rows == {"out/a": (42, 7), "out/b=c": (0, 0)}


def test_playlist_files(spark, tmp_path):
    (tmp_path / "i.m3u8").write_text("#EXTM3U\nseg.ts\n")
    r = text.playlist_files(spark, str(tmp_path)).first()
    assert r.base_url.endswith("/i.m3u8") and r.content == "#EXTM3U\nseg.ts\n"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", 0.5), (2, "val", 0.25)], "id int, split string, x double")
    sinks.write_splits(df, str(tmp_path / "s"), fmt="csv")
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=val"}
    path = str(tmp_path / "e")
    for e in (1, 2):
        sinks.append_epochs(spark.createDataFrame([(e, 0.1)], "epoch int, val_loss double"), path)
    back = spark.read.csv(path, header=True)
    assert back.columns == sinks.EPOCH_COLUMNS and back.count() == 2
    segs = spark.createDataFrame([(1, i, bytearray(b"x" * 10)) for i in range(5)], "stream_id long, idx long, data binary")
    sinks.write_ordered(segs, str(tmp_path / "o"))
    placed = spark.read.parquet(str(tmp_path / "o"))
    marks = spark.createDataFrame([(1, 20)], "stream_id long, resume_offset long")
    assert sorted(r.idx for r in sinks.after_offset(placed, marks).collect()) == [2, 3, 4]


def test_work_dir_prefers_the_named_folder(spark, tmp_path):
    class Named:
        class conf:
            @staticmethod
            def get(key, default=None):
                return str(tmp_path) if key == "spark.checkpoint.dir" else default

    assert session.new_path(Named, "x").startswith(str(tmp_path))
    first = session.work_dir(spark)
    assert session.work_dir(spark) == first


def test_flat_and_nested_folders_below_a_labelled_name(spark, tmp_path):
    """Many files in one folder, empty ones, deeper folders, and a root below a folder named like a label."""
    root = tmp_path / "benign" / "set"
    for name in ("benign", "malware/deep/er", "other"):
        (root / name).mkdir(parents=True)
    for i in range(3000):
        (root / "malware" / f"{i}.bin").touch()
    (root / "malware/deep/er/x.bin").write_bytes(b"MZ")
    (root / "benign/y.bin").write_bytes(b"ab")
    (root / "other/z.bin").write_bytes(b"c")
    rows = files.sample_folders(spark, str(root), {"benign": 0, "malware": 1})
    got = {(r.label, r.file_size): r["count"] for r in rows.groupBy("label", "file_size").count().collect()}
    assert got == {(1, 0): 3000, (1, 2): 1, (0, 2): 1, (None, 1): 1}


def test_packed_playlists(spark, tmp_path):
    """Playlists of one file stay apart, whatever their lines; a text that would break one is refused."""
    rows = [("http://a/1", "#EXTM3U\n\nseg.ts\n"), ("http://a/2", ""), ("http://a/3", "x"), ("http://a/4", "#EXTM3U\r\ny\n#EXTM3U")]
    df = spark.createDataFrame(rows, "base_url string, content string").coalesce(1)
    text.packed(df, F.concat("base_url", F.lit("\n"), "content"), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("part-*"))) == 1
    back = text.packed_playlists(spark, str(tmp_path / "p"))
    assert sorted((r.base_url, r.content) for r in back.collect()) == rows
    with pytest.raises(Exception, match="record separator"):
        text.packed(df, F.lit("a\x1eb"), str(tmp_path / "q"))


def test_every_playlist_is_reported(spark, sf_dir):
    from bytesieve.plans import catalog
    got = catalog.queries()["src_playlist"](spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert sorted(r.playlist_id for r in got.collect()) == sorted(r.o_orderkey for r in orders.collect())


def test_many_resume_states_to_a_file(spark, sf_dir, tmp_path, monkeypatch):
    """As many files as tasks, not as outputs, and each state keeps its own lines."""
    from bytesieve.plans import catalog
    monkeypatch.setattr(session, "new_path", lambda spark, label: str(tmp_path / label))
    rows = catalog.queries()["src_resume_files"](spark, sf_dir).collect()
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert len({r.output_path for r in rows}) == len(rows) == suppliers
    assert len(list((tmp_path / "resume").rglob("part-*"))) < suppliers / 2
