"""Readers: declared-schema tables, file corpora, rasters, manifests, name rules."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, MANIFEST_IMAGE, TABLES
from ..session import cut, holding

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table with its declared schema (no inference job)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: load(spark, sf_dir, name) for name in TABLES}


# Extensions that Hadoop's readers unpack; the bytes of such files are only given whole.
PACKED = ("bz2", "deflate", "gz", "lz4", "snappy", "xz", "zst", "zstd")
MARK = b"\xef\xbb\xbf"  # readers of lines leave it out where a file starts with it
PIECES = "file string, size long, start long, place long, sha256 string, data binary"


class _Digest:
    """SHA-256 of a file of `size` bytes from its lines, each with a line end. Whether the last one has it, and a mark stood first, is known from the size at the end."""

    def __init__(self, size: int) -> None:
        self.size, self.read, self.ended = size, 0, False
        self.plain, self.marked = sha256(), sha256(MARK)

    def _add(self, data) -> None:
        self.plain.update(data)
        self.marked.update(data)

    def add(self, data: memoryview) -> None:
        if not len(data):
            return
        if self.ended:
            self._add(b"\n")
        self._add(data[:-1])
        self.read, self.ended = self.read + len(data), True

    def text(self) -> str:
        more = self.size - self.read
        if more in (0, len(MARK)):
            self._add(b"\n")
        elif more not in (-1, len(MARK) - 1):
            raise ValueError(f"{self.read} of {self.size} bytes of a file were read")
        return (self.marked if more > 0 else self.plain).hexdigest()


def _column_bytes(values: pa.Array) -> memoryview:
    """The bytes of a column of binary values without nulls, one after the other, not copied."""
    if not len(values):
        return memoryview(b"")
    ends = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)
    data = values.buffers()[2]
    return memoryview(data if data is not None else b"")[ends[values.offset]:ends[values.offset + len(values)]]


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch in runs of equal values of `names`."""
    codes = [batch.column(n).dictionary_encode().indices.to_numpy(zero_copy_only=False) for n in names]
    new = np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0) if batch.num_rows else np.zeros(0, bool)
    for a, b in pairwise([*np.flatnonzero(new).tolist(), batch.num_rows]):
        yield tuple(batch.column(n)[a].as_py() for n in names), batch.slice(a, b - a)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the files that a task reads whole; the lines of others as pieces, numbered from the start of their part."""
    schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("sha256", pa.string()), ("data", pa.binary())])
    at, digest, place = None, None, 0

    def row(of: tuple, place: int, text: str | None, data: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": of[0], "size": of[2], "start": of[1], "place": place, "sha256": text, "data": data}], schema)

    for batch in batches:
        for of, rows in _runs(batch, ("file", "start", "size", "part")):
            if of != at:
                if digest:
                    yield row(at, 0, digest.text(), None)
                at, place, digest = of, 0, _Digest(of[2]) if of[2] == of[3] else None
            data = _column_bytes(rows.column("line"))
            if digest:
                digest.add(data)
            else:
                yield row(at, place, None, data.tobytes())
                place += 1
    if digest:
        yield row(at, 0, digest.text(), None)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files whose pieces come in order."""
    at, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "sha256": digest.text()}], pa.schema([("file", pa.string()), ("sha256", pa.string())]))

    for batch in batches:
        for of, rows in _runs(batch, ("file", "size")):
            if of != at:
                if digest:
                    yield row()
                at, digest = of, _Digest(of[1])
            digest.add(_column_bytes(rows.column("data")))
    if digest:
        yield row()


def _digests(spark: SparkSession, path: str, listed: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """(file, sha256) of files with these extensions, read line by line, so that a task never holds a file.

    A file is one task's work, as its digest is; where the session splits
    files all the same, their pieces are brought together in order.
    """
    total, most = listed.agg(F.sum("length"), F.max("length")).first()
    # decoded like a path; files of other extensions are not opened
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.format("text").option("recursiveFileLookup", True).option("lineSep", "\n").load(path) \
        .where(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*extensions)) \
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
                F.col("_metadata.file_block_length").alias("part"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    whole = {"spark.sql.files.maxPartitionBytes": str(max(1, most or 0, (total or 0) // spark.sparkContext.defaultParallelism)),
             "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    with holding(spark, whole):
        found = cut(lines.mapInArrow(_digested, PIECES))
    parts = found.where("sha256 is null").select("file", "size", "start", "place", "data").repartition("file").sortWithinPartitions("file", "start", "place")
    return found.where("sha256 is not null").select("file", "sha256").unionByName(parts.mapInArrow(_joined, "file string, sha256 string"))


def scan_corpus(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """Recursive file crawl: path, length, format, sha256, and the first path per content.

    Bytes are hashed where they are read, a line at a time; only 64-character
    digests are shuffled. Memory holds the longest run of bytes without a line
    end, and a file whole only where its name makes readers unpack it (`PACKED`).
    """
    wanted = [e.lower().lstrip(".") for e in extensions]
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
        .where(F.col("extension").isin(*wanted))
    )
    plain, packed = [e for e in wanted if e not in PACKED], [e for e in wanted if e in PACKED]
    listed = files.where(F.col("extension").isin(*plain)).select("path", "length", "extension", F.col("_metadata.file_path").alias("file"))
    unread = F.when(F.col("length") == len(MARK), F.sha2(F.lit(MARK), 256)).otherwise(F.raise_error(F.concat(F.lit("no bytes were read of "), F.col("path"))))
    hashed = listed.join(_digests(spark, path, listed, plain), "file", "left").select("path", "length", "extension", F.coalesce("sha256", unread).alias("sha256"))
    if packed:
        hashed = hashed.unionByName(files.where(F.col("extension").isin(*packed)).select("path", "length", "extension", F.sha2("content", 256).alias("sha256")))
    first = hashed.groupBy("sha256").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies"))
    return (
        hashed.join(first, "sha256")
        .withColumn("format", F.when(F.col("extension").isin("jpg", "jpeg"), "JPEG")
                    .when(F.col("extension").isin("tif", "tiff"), "TIFF").otherwise(F.upper("extension")))
        .withColumn("is_first", F.col("path") == F.col("first_path"))
    )


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images as pixel rows (item, y, x, b, g, r); gray images repeat the channel.

    The bytes of an image become an array once, in linear time.
    """
    def pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                y, x = np.divmod(np.arange(row.height * row.width, dtype=np.int32), row.width)
                channel = [a[:, :, min(k, row.nChannels - 1)].ravel().astype(np.int32) for k in range(3)]
                yield pd.DataFrame({"item": row.origin, "y": y, "x": x, "b": channel[0], "g": channel[1], "r": channel[2]})

    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return image.select("origin", "height", "width", "nChannels", "data").mapInPandas(pixels, "item string, y int, x int, b int, g int, r int")


def read_manifest(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """Image records of a manifest.

    `document` is one JSON object with an images array; `records` is one image
    record per line, the layout that splits across tasks for large corpora.
    """
    if layout == "records":
        return spark.read.schema(MANIFEST_IMAGE).json(path)
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return doc.select("manifest_version", F.col("dataset_id").alias("manifest_dataset"), "dataset_version",
                      "dataset_type", "provenance", F.explode("images").alias("image")) \
        .select("manifest_version", "manifest_dataset", "dataset_version", "dataset_type", "provenance", "image.*")


class NameRule(NamedTuple):
    """If `test` (prefix / contains / regex) fits the file name or folder, give label and type."""

    where: str
    test: str
    pattern: str
    label: str
    kind: str


# Naming conventions of three public labelled corpora.
CASIA_RULES = (
    NameRule("name", "prefix", "au_", "AUTHENTIC", "NONE"),
    NameRule("folder", "contains", "authentic", "AUTHENTIC", "NONE"),
    NameRule("name", "prefix", "tp_", "MANIPULATED", "UNKNOWN"),
    NameRule("folder", "contains", "tampered", "MANIPULATED", "UNKNOWN"),
    NameRule("folder", "contains", "casia", "MANIPULATED", "UNKNOWN"),
)
# Marks anywhere in the name of a tampered file that tell how it was made.
CASIA_KINDS = (("_d_", "COPY_MOVE"), ("_s_", "SPLICING"))
COLUMBIA_RULES = (
    NameRule("folder", "contains", "authentic", "AUTHENTIC", "NONE"),
    NameRule("name", "contains", "auth", "AUTHENTIC", "NONE"),
    NameRule("folder", "contains", "spliced", "MANIPULATED", "SPLICING"),
    NameRule("name", "contains", "splice", "MANIPULATED", "SPLICING"),
)
OPENMFC_RULES: tuple[NameRule, ...] = ()


def label_from_path(df: DataFrame, path: str, rules: Sequence[NameRule], prefix: str = "", kinds: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Add `label` and `manipulation_type` by the first rule that fits; `kinds` refine the type of manipulated files by marks in the name."""
    lowered = F.lower(F.translate(F.col(path), "\\", "/"))
    part = {"name": F.element_at(F.split(lowered, "/"), -1), "folder": F.regexp_replace(lowered, "/?[^/]*$", "")}
    label, kind = F.lit("UNKNOWN"), F.lit("UNKNOWN")
    for rule in reversed(rules):
        text = part[rule.where]
        hit = {"prefix": F.startswith(text, F.lit(rule.pattern)), "contains": F.contains(text, F.lit(rule.pattern)),
               "regex": text.rlike(rule.pattern)}[rule.test]
        label = F.when(hit, rule.label).otherwise(label)
        kind = F.when(hit, rule.kind).otherwise(kind)
    for mark, name in reversed(kinds):
        kind = F.when((label == "MANIPULATED") & F.contains(part["name"], F.lit(mark)), name).otherwise(kind)
    return df.withColumn(f"{prefix}label", label).withColumn(f"{prefix}manipulation_type", kind)
