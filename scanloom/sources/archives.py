"""ZIP uploads as a ``files`` table.

A ZIP file ends with a directory of its members, with the place and packed size of each. The directories are listed
first; then every member is a row, rows are spread in the order of their paths, and each task reads just the bytes of its
members and inflates them, so a large archive is read by many tasks and no task reads a whole one. What can't be read
(a broken directory, a wrong checksum, damaged or encrypted data, an unknown packing) becomes a row with the reason.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.functions import text
from scanloom.operators.ordered import spread_join
from scanloom.session import cut_lineage
from scanloom.sources.trees import TreeScan, _filesystem, _LARGE, not_ignored, read_in_order, refusal, small_enough

_MEMBER = ("repository_name string, absolute_path string, member string, size bigint, modified_time timestamp, "
           "header_at bigint, packed bigint, method int, checksum bigint, reason string")
_COLUMNS = [f.split()[0] for f in _MEMBER.split(", ")]
#: Bytes of the record that ends every ZIP file, and of a member's own header before its name.
_SHORTEST, _HEADER = 22, 30
_STORED, _DEFLATED, _BZIP2 = 0, 8, 12


def _open(location: str):
    system, path = _filesystem(location)
    stream = system.open_input_file(path)
    if stream.size() < _SHORTEST:
        stream.close()
        raise zipfile.BadZipFile("File is too short")
    return zipfile.ZipFile(stream)


def _modified(member: zipfile.ZipInfo) -> pd.Timestamp:
    try:
        return pd.Timestamp(*member.date_time)
    except ValueError:  # some writers leave the date empty
        return pd.Timestamp(1980, 1, 1)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            bad = lambda member, reason: (row.repository_name, row.path, member, *[None] * 6, reason)
            try:
                with _open(row.path) as archive:
                    found = [bad(m.filename, "encrypted member") if m.flag_bits & 1 else (
                        row.repository_name, row.path, m.filename, m.file_size, _modified(m), m.header_offset, m.compress_size, m.compress_type, m.CRC, None)
                        for m in archive.infolist()]
            except (PermissionError, FileNotFoundError) as error:
                found = [bad(None, refusal(error))]
            except (zipfile.BadZipFile, NotImplementedError, ValueError, struct.error) as error:
                found = [bad(None, f"not a ZIP archive: {error}")]
            if found:
                yield pd.DataFrame(found, columns=_COLUMNS).astype({c: "Int64" for c in ("size", "header_at", "packed", "method", "checksum")})


def _inflated(packed: bytes, method: int, size: int) -> bytes:
    """At most one byte more than ``size``: an archive can't fill the memory by what it says of itself."""
    if method == _STORED:
        return packed
    if method == _DEFLATED:
        return zlib.decompressobj(-zlib.MAX_WBITS).decompress(packed, size + 1)
    if method == _BZIP2:
        return bz2.BZ2Decompressor().decompress(packed, size + 1)
    raise NotImplementedError(f"unknown packing {method}")


def _member_bytes(rows: pd.DataFrame) -> Iterator[tuple[bytes | None, str | None]]:
    """Bytes of each member from its place in the archive, or why there are none."""
    with ExitStack() as closing:
        opened: dict[str, object] = {}  # of a few rows
        for row in rows.itertuples():
            try:
                if row.absolute_path not in opened:
                    system, path = _filesystem(row.absolute_path)
                    opened[row.absolute_path] = closing.enter_context(system.open_input_file(path))
                stream = opened[row.absolute_path]
                header = stream.read_at(_HEADER, row.header_at)
                if len(header) < _HEADER or header[:4] != b"PK\x03\x04":
                    yield None, "damaged data"
                    continue
                begin = row.header_at + _HEADER + sum(struct.unpack("<HH", header[26:30]))  # name and extra field
                data = _inflated(stream.read_at(row.packed, begin), row.method, row.size)
            except (PermissionError, FileNotFoundError) as error:
                yield None, refusal(error)
                continue
            except NotImplementedError as error:
                yield None, str(error)
                continue
            except (zlib.error, lzma.LZMAError, ValueError, EOFError):
                yield None, "damaged data"
                continue
            except OSError as error:
                if error.errno is not None:  # of the file system, not of the packed data
                    raise
                yield None, "damaged data"
                continue
            yield (data, None) if len(data) == row.size and zlib.crc32(data) == row.checksum else (None, "wrong checksum")


def _listing(archives: DataFrame) -> DataFrame:
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("repository_name", "path").repartition(n).mapInPandas(_members, _MEMBER)


def unreadable_archives(archives: DataFrame) -> DataFrame:
    """repository_name, absolute_path, member, reason: archives and members that the directories alone show to be unreadable."""
    return _listing(archives).where(F.col("reason").isNotNull()).select("repository_name", "absolute_path", "member", "reason")


def list_archives(archives: DataFrame) -> DataFrame:
    """Members of ``archives(repository_name, path)``: only the directories of the ZIP files are read."""
    return _listing(archives).where(F.col("reason").isNull()).drop("reason")


def refused_archives(members: DataFrame) -> DataFrame:
    """Archives with a member that would be written outside its folder."""
    return members.where(~text.stays_inside(F.col("member"))).select("repository_name").distinct()


def unwrapped(members: DataFrame) -> DataFrame:
    """File members with ``relative_path``; a single root folder is dropped."""
    bare = F.regexp_replace("member", r"^(?:\./)+", "")
    top = F.substring_index(bare, "/", 1)
    roots = members.groupBy("repository_name").agg(
        F.min(top).alias("lowest"), F.max(top).alias("highest"), F.bool_and(F.contains(bare, F.lit("/"))).alias("foldered"))
    single = roots.where(F.col("foldered") & (F.col("lowest") == F.col("highest"))).select(
        "repository_name", F.col("lowest").alias("root"))
    joined = spread_join(members.where(~F.col("member").endswith("/")), single, ["repository_name"], ["member"], "left")
    path = F.when(F.col("root").isNull(), bare).otherwise(F.substring(bare, F.length("root") + 2, F.length(bare)))
    return joined.withColumn("relative_path", path).drop("root")


def read_archives(archives: DataFrame) -> TreeScan:
    """Files of uploaded archives, and what is left out. An archive with an escaping member is refused as a whole."""
    listing = cut_lineage(_listing(archives))
    members = listing.where(F.col("reason").isNull()).drop("reason")
    bad = refused_archives(members).withColumn("_bad", F.lit(True))
    checked = cut_lineage(spread_join(members, bad, ["repository_name"], ["member"], "left"))
    named = unwrapped(checked.where(F.col("_bad").isNull()).drop("_bad")).where(not_ignored(F.col("relative_path")))
    name = text.file_name(F.col("relative_path"))
    wanted = named.where(small_enough(F.col("size"))).withColumns({"name": name, "extension": text.suffix(name)})
    files, unread, counts = read_in_order(wanted, _member_bytes)
    narrow = ["repository_name", "absolute_path", F.col("member").alias("relative_path"), "reason"]
    reason = lambda df, why: df.withColumn("reason", F.lit(why)).select(narrow)
    skipped = listing.where(F.col("reason").isNotNull()).select(narrow).unionByName(unread.select(narrow)).unionByName(
        reason(named.where(~small_enough(F.col("size"))), _LARGE)).unionByName(reason(checked.where("_bad"), "archive refused: a member would be outside its folder"))
    columns = ["repository_name", "name", "extension", "relative_path", "absolute_path", "size", "modified_time", "content", "valid_utf8", "file_seq"]
    return TreeScan(files.select(columns), skipped, counts)


def load_archives(archives: DataFrame) -> DataFrame:
    """``files`` of uploaded archives; see ``read_archives`` for what is left out."""
    return read_archives(archives).files


def archives_of(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(paths.items()), "repository_name string, path string")
