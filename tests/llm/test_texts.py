import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from helpers import documents, edge_rows, sentence

from bytesieve.llm import byte_bpe, decontaminate, html_text, op7_queries, pii, warc


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path),
                                   special_tokens={})


def test_byte_bpe(spark, encoding):
    path, plain = encoding
    r = random.Random(4)
    chars = "aabbtheinerßéİ́日本😀²½_\x1c\x85\xa0\x0b \n\t!?'0123456789"
    rows = edge_rows() + [(50 + i, "".join(r.choice(chars) for _ in range(200))) for i in range(60)]
    rows += [(200, "ab" * 20_000 + "x" * 30_000), (201, "<|endoftext|> it's")]
    out = byte_bpe.encoded(documents(spark, rows), path, public_tokenizers.PATTERN).collect()
    want = sorted((str(i), plain.encode_ordinary(t or ""), t or "") for i, t in rows)
    got = sorted((str(x.doc_id), list(x.ids), x) for x in out)
    for (i, ids, text), (j, own, x) in zip(want, got, strict=True):
        assert (i, ids) == (j, own) and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encoded(documents(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_pieces_survive_the_bound(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 50)
    own = byte_bpe.Encoder(byte_bpe.read_ranks(encoding[0]))
    text = sentence(3, 2000)
    ids = [int(i) for run in own.pieces_of(text, byte_bpe.Splitter(public_tokenizers.PATTERN)) for p in run
           for i in p[0].split(",")]
    assert ids == encoding[1].encode_ordinary(text)


def pages(spark):
    big = "<p>" + sentence(1, 60) + "</p>"
    rows = [(5, big), (3, big), (9, big), (1, "short"), (2, "short"), (4, None), (6, ""), (7, sentence(2, 200_000)),
            (3, big), (8, "é" * 60), (None, "<i>" + "y" * 200)]
    return rows, spark.createDataFrame([(i, "http://x/\r\n a", h, "z") for i, h in rows],
                                       "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    rows, table = pages(spark)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                 for r in warc.round_trip(table).collect())
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        first = min(x for x, y in rows if (y or "") == (h or "") and x is not None) if i is not None else None
        again = len(raw) >= 100 and first is not None and first != i
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
                     first if again else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2]))
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_chunks(spark, tmp_path):
    rows, table = pages(spark)
    manifest = warc.write_archives(warc.record_types(table), f"file://{tmp_path}/warc", archive_bytes=1 << 16)
    out = warc.read_archives(spark, manifest, chunk=100_000).where("page_id = 7").orderBy("chunk_no").collect()
    text = dict(rows)[7].encode()
    assert len(out) > 5 and b"".join(bytes(r.data) for r in out) == text
    assert [r.last for r in out] == [False] * (len(out) - 1) + [True]
    assert all(len(r.data) <= 100_000 for r in out)
    for r in out:
        upto = text[:r.payload_bytes]
        assert r.sha256 == hashlib.sha256(upto).hexdigest()
    assert out[-1].stated == out[-1].sha256
    assert manifest.agg({"records": "sum"}).collect()[0][0] == len(rows)


def test_warc_digests_are_compared(spark, tmp_path):
    """A payload changed in the archive, and a revisit whose header states another digest, end the job."""
    _, table = pages(spark)
    typed = warc.record_types(table)
    for n, wrong in enumerate((F.col("refers_to").isNull() & (F.col("page_id") == 7), F.col("refers_to").isNotNull())):
        other = typed.withColumn("digest", F.when(wrong, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
        manifest = warc.write_archives(other, f"file://{tmp_path}/{n}")
        with pytest.raises(Exception, match="its record says"):
            warc.restored(warc.read_archives(spark, manifest)).collect()


def test_warc_records_are_not_held():
    """A payload of 64 MB is packed piece by piece, and reads back."""
    import tracemalloc
    import zlib

    payload = bytes(range(256)) * (1 << 18)
    tracemalloc.start()
    size, unzip = 0, zlib.decompressobj(31)
    for part in warc._packed(1, "http://x", memoryview(payload), "d", None):
        size += len(unzip.decompress(part))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    assert size > len(payload) and unzip.eof


def test_warc_sql(spark):
    rows, table = pages(spark)
    con = duckdb.connect()
    con.register("pages", table.where("page_id is not null").dropDuplicates(["page_id"]).toPandas())
    want = con.execute(op7_queries.ORACLES["op7_warc"]).fetchall()
    cols = [d[0] for d in con.description]
    got = warc.round_trip(table.where("page_id is not null").dropDuplicates(["page_id"])).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(want)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans():
    r = random.Random(8)
    parts = ["a@b.c", "x.y+z@mail.example.org", "@", "a@b", "a@b.c.d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.4",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+1 23", "+", "..", "é", "日本", " ", "-", "12",
             "4111111111111111", "000000000000000000000"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii(spark):
    rows = edge_rows() + [(60 + i, f"{sentence(i, 30)} mail bob{i}@mail.example.com or +1 (555) 010-99{i:02d} {sentence(i + 99, 400)} "
                                   f"AKIA{'ABCDEFGH'[i % 8]}7J4KQ2M9XW5T8ZR") for i in range(40)]
    docs = documents(spark, rows)
    model = pii.train(docs, pii.Settings(steps=150))
    found = {}
    for r in pii.spans(docs, model).collect():
        spans = [(pii.KINDS.index(k), a, b) for k, a, b in zip(r.kinds, r.starts, r.ends, strict=True)]
        text = next(t for i, t in rows if i == r.doc_id) or ""
        if r.doc_id is not None:
            assert [s for s, own in zip(spans, r.base, strict=True) if own] == plain_spans(text)
            found[r.doc_id] = [text[a:b] for k, a, b in spans if k == 4]
    assert sum(any(x.startswith("AKIA") for x in found[60 + i]) for i in range(40)) >= 30
    assert not any(found[i] for i in found if i < 60 and i != 7 and i != 8)
    clean = pii.redacted(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[4] is None and text[1] == dict(rows)[1]
    assert all("[email]" in text[60 + i] and "@" not in text[60 + i] and "[phone]" in text[60 + i] for i in range(40))


def test_pii_untrained(spark):
    docs = documents(spark, [])
    model = pii.train(docs)
    assert not model.tuned and pii.spans(docs, model).count() == 0
    row = pii.spans(documents(spark, [(1, "a@b.cd")]), model).collect()[0]
    assert row.kinds == ["email"] and row.base == [True]


def test_window_borders_do_not_matter():
    """Tags of a text do not depend on where windows fall: a span across a border is one span."""
    s = pii.Settings(window=64, overlap=32)
    model = pii.Tagger(s)
    model.tuned = True
    model.decode = lambda ids: (ids == ord("#")).astype(np.uint8)
    text = np.frombuffer(b"a" * 50 + b"#" * 40 + b"b" * 100, np.uint8)
    tags = pii.tagged(model, text, np.array([0, 0, len(text), len(text)]))
    assert list(pii.runs(tags, np.array([0, 0, len(text), len(text)]))) == [(1, 1, 50, 90)]


def test_gradients():
    """The analytic gradient against differences."""
    model = pii.Tagger(pii.Settings(hidden=3))
    rng = np.random.default_rng(0)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids, gold = rng.integers(97, 110, (7, 4)), np.zeros((7, 4), int)
    gold[2:5, 1] = 2
    pii_f32, pii.F32 = pii.F32, np.float64
    try:
        _, grads = model.gradients(ids, gold)
        for name in ("re_f", "out_b", "in_f", "bias"):
            w = model.weights[name]
            at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
            keep, step = w[at], 1e-5
            w[at] = keep + step
            up = model.gradients(ids, gold)[0]
            w[at] = keep - step
            down = model.gradients(ids, gold)[0]
            w[at] = keep
            assert abs((up - down) / (2 * step) * 7 - grads[name][at]) < 1e-2 * max(1, abs(grads[name][at]))
    finally:
        pii.F32 = pii_f32


def test_decontaminate(spark):
    items = [(i, sentence(1000 + i, 30)) for i in range(6)] + [(90, None), (91, ""), (None, sentence(5)), (92, "too short"),
                                                              (0, sentence(1000, 30))]
    r = random.Random(1)

    def changed(text, n):
        w = text.split()
        for k in r.sample(range(len(w)), n):
            w[k] = f"zz{k}"
        return " ".join(w)

    rows = edge_rows() + [(100, sentence(7, 50) + " " + items[0][1] + " " + sentence(8, 50)),
                          (101, changed(items[1][1], 4)), (102, items[2][1].upper() + "! " + items[3][1]),
                          (103, " ".join(items[4][1].split()[:8])), (104, changed(items[5][1], 20)), (100, items[0][1])]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    out = decontaminate.leaks(documents(spark, rows), table).collect()
    assert {(x.doc, x.item) for x in out} == {(100, 0), (101, 1), (102, 2), (102, 3)}
    exact = next(x for x in out if x.doc == 100)
    assert (exact.n_equal, exact.item_words) == (30, 30)
    assert next(x for x in out if x.doc == 101).n_equal >= 24
    assert decontaminate.leaks(documents(spark, []), table).count() == 0
    assert decontaminate.leaks(documents(spark, rows), table.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("<table><tr><th>Name<th>N<tr><td>Apple<td>5<tr><td>Fig<td>12</table>", "Name   N\nApple  5\nFig    12"),
    ("<table><tr><td rowspan=2>a<td>1<tr><td>2</table>", "a  1\n   2"),
    ("<script>x='</p>'</script><style>p{}</style><p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
    ("<pre>\n a\n  b</pre>", " a\n  b".strip("\n")), ("1 &lt; 2 &amp;amp; 3", "1 < 2 &amp; 3"),
    ("<!-- no --><p>yes<!-- -->!", "yes!"), ("<a href='x>y'>link</a> < 3", "link < 3"),
    ("<p>a <b> b</b>\n c</p>", "a b c"), ("</div></p>x", "x"), ("<select><option>a<option>b</select>", "a\nb")])
def test_visible_text(page, text):
    assert html_text.visible_text(page) == text


def test_html_edges(spark):
    deep = "<div>" * 30_000 + "x"
    rows = [(1, "<p>a"), (2, None), (3, ""), (None, "<b>z"), (1, "<p>a"), (4, deep), (5, "<table><tr><td>" * 500 + "y"),
            (6, "<ul><li>" * 3000 + "w"), (7, "<p>" + sentence(1, 50_000))]
    table = spark.createDataFrame([(i, "u", h, "t") for i, h in rows], "page_id long, url string, html string, text string")
    out = {(r.page_id, r.text if r.n_chars < 9 else r.n_chars): r for r in html_text.extracted(table).collect()}
    assert {k for k in out if k[0] in (1, 2, 3, 4, 5, None)} == {(1, "a"), (2, ""), (3, ""), (4, "x"), (5, "y"), (None, "z")}
    assert out[7, len(sentence(1, 50_000))].n_lines == 1
    assert html_text.extracted(table.limit(0)).count() == 0


def test_leaks_of_long_quotes_and_shifted_copies(spark):
    long = [f"l{i}" for i in range(2000)]
    item = [f"m{i}" for i in range(60)]
    shifted = [*item[:29], "put", "in", *item[29:]]
    for i in (3, 11, 20, 40, 48, 55):
        shifted[i] = "other"
    docs = [(1, " ".join(["so", *long[500:1400], "on"])), (2, " ".join(shifted)), (3, " ".join(long[:40])),
            (4, " ".join(item[:25]))]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(item))], "item_id long, text string")
    got = {(r.doc, r.item): (r.start_word, r.end_word, r.n_equal)
           for r in decontaminate.leaks(documents(spark, docs), items).collect()}
    assert got == {(1, 1): (1, 901, 900), (2, 2): (0, 62, 54)}
