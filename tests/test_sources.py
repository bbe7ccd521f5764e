"""Rasters, corpora and manifests written by the test itself."""

import json
import struct
import zlib

import pytest

from proofmill.sources import read_manifest, read_raster, scan_corpus
from proofmill.sources import sinks


def png(path, pixels):
    """Write rows of (r, g, b) as a PNG file."""
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_raster_pixels(spark, tmp_path):
    pixels = [[(10 * y + x, 200 - x, 128 + y) for x in range(5)] for y in range(4)]
    png(tmp_path / "a.png", pixels)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in read_raster(spark, str(tmp_path)).collect()}
    assert got == {(y, x): pixels[y][x] for y in range(4) for x in range(5)}


def test_corpus_scan_marks_first_copy(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.png", b"one"), ("sub/b.PNG", b"one"), ("c.jpg", b"two"), ("d.txt", b"one")):
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.copies, r.is_first) for r in scan_corpus(spark, str(tmp_path), [".png", "jpg"]).collect()}
    assert got == {"a.png": ("PNG", 2, True), "b.PNG": ("PNG", 2, False), "c.jpg": ("JPEG", 1, True)}


def test_manifest_document(spark, tmp_path):
    doc = {"manifest_version": "1.0", "dataset_id": "d1", "images": [{"image_id": "i1", "width": 8}, {"image_id": "i2", "extra": 1}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    got = sorted((r.manifest_dataset, r.image_id, r.width) for r in read_manifest(spark, str(tmp_path / "m.json")).collect())
    assert got == [("d1", "i1", 8), ("d1", "i2", None)]


def test_replacing_partitions_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v long, k string")
    sinks.replace_partitions(df, path, ["k"])
    sinks.replace_partitions(spark.createDataFrame([(9, "a")], "v long, k string"), path, ["k"])
    sinks.replace_partitions(spark.createDataFrame([(9, "a")], "v long, k string"), path, ["k"])
    assert sorted((r.v, r.k) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_replace_partitions_clears_processed_keys_without_rows(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "v long, k string"), path, ["k"])
    ran = spark.createDataFrame([("a",), ("b",)], "k string")
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "v long, k string"), path, ["k"], ran)
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [("b", 9), ("c", 3)]


def test_corpus_kinds(spark):
    from proofmill.sources.scans import CASIA_KINDS, CASIA_RULES, label_from_path
    names = ["x/Tp_D_CND_M_N_ani00018.tif", "Tampered/abc_d_1.jpg", "x/Tp_S_NRN_S_N.tif", "x/Au_ani_s_1.jpg", "x/Tp_x.jpg", "y/q.jpg"]
    df = label_from_path(spark.createDataFrame([(n,) for n in names], "p string"), "p", CASIA_RULES, "", CASIA_KINDS)
    assert [r.manipulation_type for r in df.collect()] == ["COPY_MOVE", "COPY_MOVE", "SPLICING", "NONE", "UNKNOWN", "UNKNOWN"]


def test_work_folder(spark, monkeypatch):
    import os

    from proofmill import session
    step = session.cut(spark.range(3))
    folder = session.STEPS[-1].removeprefix("file:")
    assert step.count() == 3 and os.path.isdir(folder)
    session.drop_steps(spark)
    assert not os.path.exists(folder) and not session.STEPS

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())


def test_large_raster_is_linear(spark, tmp_path):
    import time

    png(tmp_path / "a.png", [[(x, x, x) for x in range(16)] for _ in range(16)])
    read_raster(spark, str(tmp_path / "a.png")).count()
    png(tmp_path / "b.png", [[((x + y) % 256,) * 3 for x in range(256)] for y in range(256)])
    start = time.time()
    got = read_raster(spark, str(tmp_path / "b.png"))
    assert tuple(got.selectExpr("count(*) as n", "sum(if(b = (x + y) % 256, 0, 1)) as bad").first()) == (65536, 0)
    assert time.time() - start < 10


def test_corpus_scan_hashes_bytes_as_they_are(spark, tmp_path):
    import gzip
    import hashlib
    import random

    mark, some = b"\xef\xbb\xbf", random.Random(5)
    bodies = {"a b/x%y+z.bin": mark + b"ab\r\ncd\n\xff\xfe\x00", "n.bin": b"x\n\n", "mark.bin": mark, "line.bin": mark + b"x\n", "feed.BIN": mark + b"\n", "one.bin": b"\n",
              "two.bin": b"x", "large.bin": some.randbytes(3_000_000), "zeros.bin": bytes(200_000), "packed.gz": gzip.compress(b"x"), "other.txt": b"x"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {r.path.split(str(tmp_path) + "/")[1]: (r.length, r.sha256) for r in scan_corpus(spark, str(tmp_path), ["bin", ".gz"]).collect()}
    assert got == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items() if not name.endswith("txt")}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_corpus_scan_reads_no_file_whole(spark, tmp_path, monkeypatch):
    """Contents are no value of a row; files that are split all the same are brought together in order."""
    import hashlib
    import random
    from contextlib import contextmanager

    from proofmill import session
    from proofmill.sources import scans

    bodies = {f"{k}.bin": random.Random(k).randbytes(40_000 * k) for k in range(1, 5)} | {"text.bin": b"\xef\xbb\xbf" + b"line\n" * 30_000, "same.bin": random.Random(2).randbytes(80_000)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)

    @contextmanager
    def split(spark, wanted):
        with session.holding(spark, wanted | {"spark.sql.files.maxPartitionBytes": "10k", "spark.sql.files.openCostInBytes": "1"}):
            yield
    wanted = {name: (hashlib.sha256(body).hexdigest(), 2 if name in ("2.bin", "same.bin") else 1) for name, body in bodies.items()}
    for kept in (session.holding, split):
        monkeypatch.setattr(scans, "holding", kept)
        found = scan_corpus(spark, str(tmp_path), ["bin"])
        assert "sha2(content" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {r.path.rsplit("/", 1)[1]: (r.sha256, r.copies) for r in found.collect()} == wanted
