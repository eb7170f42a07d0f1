"""Snapshots of contract files: Parquet at scale, and a deterministic gzip JSON archive for small catalogs."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.paths import valid

#: An archive is gzip JSON {version, contract_files: [{path: {value}, bytes: [0 to 255, ...]}]}.
VERSION = 1
#: Most bytes of an archive, of what it expands to, and of a file; most files. A catalog beyond LARGEST bytes isn't written as one archive.
COMPRESSED, EXPANDED, FILE, FILES, LARGEST = 64 << 20, 256 << 20, 16 << 20, 100_000, 64 << 20


def write(files: DataFrame, path: str) -> None:
    """(path, content) as a Parquet snapshot; an existing one is never replaced."""
    files.select("path", "content", F.sha2("content", 256).alias("digest")).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, content binary, digest string").parquet(path)


def encode(files: DataFrame) -> bytes:
    """A small catalog as gzip JSON with its files in path order and no time in it; a larger one is refused after a size check."""
    total = files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    if total > LARGEST:
        raise ValueError(f"{total} bytes are too many for one archive; write a Parquet snapshot")
    rows = files.select("path", "content").orderBy("path").collect()
    payload = {"version": VERSION, "contract_files": [{"path": {"value": r.path}, "bytes": list(r.content)} for r in rows]}
    return gzip.compress(json.dumps(payload, separators=(",", ":")).encode(), mtime=0)


def expanded(data: bytes) -> bytes:
    """The bytes of one gzip member, of bounded size; ValueError with a fault's code for anything else."""
    if len(data) > COMPRESSED:
        raise ValueError("too_large")
    unzip = zlib.decompressobj(31)
    out = unzip.decompress(data, EXPANDED + 1)
    if len(out) > EXPANDED:
        raise ValueError("too_large")
    if not unzip.eof:
        raise ValueError("damaged")
    if unzip.unused_data:
        raise ValueError("trailing_data")
    return out


def files_of(data: bytes) -> list[tuple[str, bytes]]:
    payload = json.loads(expanded(data))
    if payload["version"] != VERSION:
        raise ValueError("version")
    found = payload["contract_files"]
    if len(found) > FILES:
        raise ValueError("too_many_files")
    if any(len(f["bytes"]) > FILE for f in found):
        raise ValueError("too_large")
    if len({str(f["path"]["value"]) for f in found}) != len(found):
        raise ValueError("duplicate_path")
    return [(str(f["path"]["value"]), bytes(f["bytes"])) for f in found]


#: Codes of a broken archive.
FAULTS = ("damaged", "trailing_data", "version", "too_large", "too_many_files", "duplicate_path")


def decode(archives: DataFrame) -> DataFrame:
    """archive, path, content, fault of each file of gzip JSON archives (path, content); a broken archive is one row with a fault."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b.path, b.content, strict=True):
                try:
                    rows += [(name, p, c, None) for p, c in files_of(data)]
                except (zlib.error, ValueError, KeyError, TypeError, RecursionError) as e:
                    rows.append((name, None, None, str(e) if str(e) in FAULTS else "damaged"))
            yield pd.DataFrame(rows, columns=["archive", "path", "content", "fault"])

    out = archives.select("path", "content").mapInPandas(run, "archive string, path string, content binary, fault string")
    return out.withColumn("fault", F.coalesce("fault", F.when(F.col("path").isNotNull() & ~valid(F.col("path")), "path")))


def duplicate_paths(decoded: DataFrame) -> DataFrame:
    return decoded.where("path IS NOT NULL").groupBy("archive", "path").agg(F.count("*").alias("times")).where("times > 1")
