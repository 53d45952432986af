import math

import numpy as np
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.operators import features


def frame(spark, rows):
    return spark.createDataFrame([(i, p, bytearray(h) if h is not None else None, n) for i, (p, h, n) in enumerate(rows)],
                                 "id int, path string, header binary, file_size long")


def ent(b):
    if len(b) == 0:
        return 0.0
    p = np.bincount(np.frombuffer(b, np.uint8), minlength=256) / len(b)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def brute(h, size, mismatch, kind):
    pad = h[:512] + bytes(max(0, 512 - len(h)))
    v = [b / 255 for b in pad]
    v += [ent(pad[i * 128:(i + 1) * 128]) / 8 for i in range(4)] + [ent(pad) / 8]
    v += list(np.bincount(np.frombuffer(pad, np.uint8), minlength=256) / 512)
    n = max(len(h), 1)
    v += [min(math.log10(size) / 10, 1) if size else 0.0] + [float(kind == k) for k in ("PE_EXE", "ELF", "ZIP", "PDF", "UNKNOWN")]
    v += [float(h[:2] == b"MZ"), float(h[:4] == b"\x7fELF"), float(mismatch),
          sum(32 <= b <= 126 for b in h) / n, h.count(0) / n]
    return v


CASES = [("a.exe", b"MZ\x90\x00This program cannot be run in DOS mode" + bytes(100), 5000, False, "PE_EXE"),
         ("a.png", b"MZ" + bytes(300), 7, True, "PE_EXE"), ("b", b"\x7fELF" + bytes(range(256)) * 2, 10 ** 11, False, "ELF"),
         ("c.zip", b"", 0, False, "UNKNOWN"), ("d.bin", bytes([255] * 512), 512, False, "UNKNOWN"),
         ("e.txt", np.random.default_rng(4).integers(0, 256, 700, dtype=np.uint8).tobytes(), 700, False, "UNKNOWN")]


def test_full_vector(spark):
    df = frame(spark, [c[:3] for c in CASES])
    got = features.with_features(df).orderBy("id").collect()
    for r, (_, h, n, mis, kind) in zip(got, CASES):
        want = brute(h, n, mis, kind)
        assert len(r.features) == 784 == features.feature_size()
        assert np.allclose(r.features, want, atol=1e-6)


def test_parts_and_names(spark):
    df = frame(spark, [CASES[0][:3], ("x", None, 0)])
    rows = features.batch_features(df, histogram=False).collect()
    assert len(rows) == 1 and len(rows[0].features) == 528
    names = features.feature_names()
    assert len(names) == len(set(names)) == 784


def test_raw_unscaled_and_sparse_slices(spark):
    df = frame(spark, [("x", bytes(range(256)), 1)])
    r = df.select(features.raw_vector(F.col("header"), 256, normalize=False).alias("f")).first()
    assert list(r.f) == list(range(256))


def test_compact_layout(spark):
    rng = np.random.default_rng(1)
    rows = [("a.png", b"\x89PNG\r\n\x1a\n" + bytes(200), 208), ("malware.exe", CASES[0][1], 140), ("binary", b"\x7fELF" + bytes(200), 204),
            ("a.zip", b"PK\x03\x04" + bytes(200), 204), ("u.xyz", b"BCDE" + bytes(200), 204), ("f.png", CASES[0][1], 140),
            ("x", b"", 0), ("r", rng.integers(0, 256, 512, dtype=np.uint8).tobytes(), 512), ("s", b"A" * 512, 512),
            ("n", bytes(128) + b"\xff" * 128, 256), ("p", b"Hello World! " * 39, 507), ("m", bytes([128] * 512), 512)]
    v = [r.features for r in features.with_compact_features(frame(spark, rows)).orderBy("id").collect()]
    assert all(len(x) == 512 and min(x) >= 0 and max(x) <= 1 for x in v)
    assert [v[i][264 + s] for i, s in ((0, 9), (1, 0), (2, 1), (3, 8), (4, 15))] == [1.0] * 5
    assert v[5][283] == 1.0 and v[0][283] == 0.0 and v[1][287] == 1.0 and v[0][280] > 0
    assert not any(v[6])
    assert v[7][256] > 0.8 and v[8][256] < 0.1 and 0.4 < v[9][258] < 0.6 and v[10][261] > 0.8
    assert abs(v[11][496] - 128 / 255) < 0.01


def test_mismatch_table(spark):
    one = lambda k, e: spark.range(1).select(features.extension_mismatch(F.lit(k), F.lit(e))).first()[0]
    assert one("PE_EXE", ".png") and not one("PE_EXE", ".EXE") and not one("ELF", "") and not one("GIF", ".exe")
    assert set(rules.FEATURE_EXTENSIONS) == {"PE_EXE", "ELF", "PDF", "ZIP", "PNG", "JPEG", "MP4", "MP3"}


def test_class_profiles(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, [7.0, 9.0])], "label int, features array<double>")
    got = {(r.label, r.slot): r["mean"] for r in features.class_profiles(df, width=2).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 4.0, (1, 0): 7.0, (1, 1): 9.0}


def test_vectors_of_a_batch_exist_once(monkeypatch):
    """Work arrays beside a full batch's vectors stay small, and its slices meet without a seam."""
    import tracemalloc

    import pyarrow as pa

    from bytesieve.functions import entropy as E
    held = []
    monkeypatch.setattr(E.F, "arrow_udf", lambda kind: lambda f: lambda *a: held.append(f))
    E.byte_features(None, 512, 4)
    rng = np.random.default_rng(7)
    raw = [rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in rng.integers(0, 600, 5000)]
    values = pa.array(raw, pa.binary())
    tracemalloc.start()
    try:
        got = held[0](values)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * 5000 * 773 * 4
    for i in (0, 127, 128, 1023, 1024, 4999):
        assert np.allclose(got[i].as_py(), brute(raw[i], 1, False, "UNKNOWN")[:773], atol=1e-6)
    assert len(held[0](values.slice(0, 0))) == 0 and held[0](values.slice(3, 2)).to_pylist() == got.slice(3, 2).to_pylist()
