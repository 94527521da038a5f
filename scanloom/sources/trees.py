"""Repository trees as a ``files`` table.

The folder listing is itself a Spark job: one row per folder, listed level by level on
the executors, so neither the driver nor one task ever holds a whole tree. Ignored folders
are not entered. Only the paths that pass the name and size filters are read. (``binaryFile``
is no option: it skips ``.env``, ``.github`` and ``__init__.py``.)

Contents are read once and neither exchanged nor sorted: the narrow listing is put in order, each task reads its
stretch of it and numbers what it keeps, and one row a task carries the numbers on. What is not kept is given back with
the reason. A path that is missing or may not be read is such a row; any other failure of a read ends the job.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.session import cut_lineage

_ENTRY = "repository_name string, root string, absolute_path string, is_dir boolean, size bigint, modified_time timestamp, reason string"
SKIPPED = "repository_name string, absolute_path string, relative_path string, reason string"
_DENIED, _MISSING, _LARGE, _BINARY = "no permission", "not found", "larger than the limit", "binary"


def _filesystem(location: str):
    """File system and path behind a location: an address pyarrow knows, or a local/mounted path."""
    from pyarrow import fs

    if location.startswith("file:"):
        return fs.LocalFileSystem(), "/" + location[5:].lstrip("/")
    if "://" in location:
        return fs.FileSystem.from_uri(location.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), location


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        for row in batch.itertuples():
            system, path = _filesystem(row.absolute_path)
            columns = ["repository_name", "root", "absolute_path", "is_dir", "size", "modified_time", "reason"]
            try:
                infos = system.get_file_info(fs.FileSelector(path, recursive=False))
            except (PermissionError, FileNotFoundError) as error:  # any other failure must not look like an empty folder
                yield pd.DataFrame([(row.repository_name, row.root, row.absolute_path, False, None, None, refusal(error))], columns=columns)
                continue
            local = system.type_name == "local"
            prefix = row.absolute_path.removesuffix(path)
            found = [
                (row.repository_name, row.root, prefix + i.path, i.type == fs.FileType.Directory, i.size,
                 (i.mtime or datetime.fromtimestamp(0, timezone.utc)), None)
                for i in infos if i.type in (fs.FileType.Directory, fs.FileType.File) and not (local and os.path.islink(i.path))
            ]
            if found:
                yield pd.DataFrame(found, columns=columns)


def refusal(error: OSError) -> str:
    return _DENIED if isinstance(error, PermissionError) else _MISSING


def list_entries(repositories: DataFrame, parts: int | None = None, ignored: bool = True) -> DataFrame:
    """Files below ``repositories(repository_name, path)``, and folders that can't be listed, with the reason.

    Each level is listed by its own job and spread evenly, so one repository with most
    of the folders keeps every executor busy. Links are skipped, so every tree ends.
    ``ignored`` False leaves ignored folders unlisted.
    """
    spark = repositories.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = F.regexp_replace("path", r"(?<=.)/+\z", "")
    level = repositories.select("repository_name", root.alias("root"), root.alias("absolute_path"))
    relative = F.substring("absolute_path", F.length("root") + 2, F.length("absolute_path"))
    files = None
    while True:
        entries = cut_lineage(level.repartition(n).mapInPandas(_list_folders, _ENTRY))
        found = entries.where(~F.col("is_dir"))
        files = found if files is None else files.unionByName(found)
        level = entries.where("is_dir").where(F.lit(ignored) | not_ignored(relative)).select("repository_name", "root", "absolute_path")
        if level.isEmpty():
            break
    name = text.file_name(relative)
    return files.select(
        "repository_name", name.alias("name"), text.suffix(name).alias("extension"), relative.alias("relative_path"),
        "absolute_path", "size", "modified_time", "reason")


def list_trees(repositories: DataFrame, parts: int | None = None) -> DataFrame:
    """All files below ``repositories(repository_name, path)``, unfiltered."""
    return list_entries(repositories, parts).where(F.col("reason").isNull()).drop("reason")


# ------------------------------------------------------------------ loader filters
def not_ignored(path: Column) -> Column:
    """No part of the relative path, file name included, is an ignored name."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in fv.IGNORED_DIRECTORIES]))


def small_enough(size: Column) -> Column:
    return size <= fv.MAX_FILE_BYTES


def is_text(data: Column) -> Column:
    """No NUL byte among the first bytes."""
    return F.position(F.lit(b"\x00"), F.substring(data, 1, fv.BINARY_PROBE_BYTES)) == 0


def decode(data: Column) -> Column:
    """UTF-8 text without the invalid bytes, line ends as in a text-mode read.

    Invalid bytes are first turned into U+FFFD; a U+FFFD that the file itself holds is
    spelled with a mark meanwhile, and so is the mark.
    """
    raw, swap = data.cast("string"), lambda col, old, new: F.replace(col, F.lit(old), F.lit(new))
    mark, lost = "\ue000", "\ufffd"
    spelled = swap(swap(raw, mark, mark + "0"), lost, mark + "1")
    valid = swap(F.make_valid_utf8(spelled), lost, "")
    kept = F.when(F.is_valid_utf8(raw), raw).otherwise(swap(swap(valid, mark + "1", lost), mark + "0", mark))
    return F.regexp_replace(kept, r"\r\n?", "\n")


def _file_bytes(rows: pd.DataFrame) -> Iterator[tuple[bytes | None, str | None]]:
    """Bytes of each row's file, or why there are none."""
    for location in rows["absolute_path"]:
        system, path = _filesystem(location)
        try:
            with system.open_input_stream(path) as stream:
                data = stream.read()
        except (PermissionError, FileNotFoundError) as error:  # other failures are raised
            yield None, refusal(error)
            continue
        yield data, None


_STRETCH = "data binary, reason string, _part int, _rank bigint, _ends struct<first:string,last:string,to_first:bigint,to_last:bigint>"
_AT_ONCE = 16


def _stretch(read: Callable[[pd.DataFrame], Iterator[tuple[bytes | None, str | None]]]):
    """Reads a task's stretch of the ordered listing; kept files are numbered by repository, the last row has the totals."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        first = repository = None
        to_first = rank = 0
        for batch in batches:
            for start in range(0, len(batch), _AT_ONCE):
                rows = batch.iloc[start:start + _AT_ONCE].copy()
                got, ranks = [], []
                for name, (data, reason) in zip(rows["repository_name"], read(rows)):
                    if held is None and not got:
                        first = repository = name
                    elif name != repository:
                        repository, rank = name, 0
                    if data is not None and b"\x00" in data[:fv.BINARY_PROBE_BYTES]:
                        data, reason = None, _BINARY
                    rank += reason is None
                    to_first = rank if repository == first else to_first
                    got.append((data, reason))
                    ranks.append(rank)
                rows["data"], rows["reason"] = [d for d, _ in got], [r for _, r in got]
                rows["_part"], rows["_rank"], rows["_ends"] = part, ranks, None
                if held is not None:
                    yield held
                held = rows
        if held is not None:
            held["_ends"] = [None] * (len(held) - 1) + [{"first": first, "last": repository, "to_first": to_first, "to_last": rank}]
            yield held
    return run


def _carried(ends: list) -> list[tuple[int, str, int]]:
    """(part, its first repository, how many files of that were kept before); ``ends`` has one row a task."""
    out, repository, kept = [], None, 0
    for r in sorted(ends, key=lambda r: r["_part"]):
        end = r["_ends"]
        before = kept if out and end["first"] == repository else 0
        out.append((r["_part"], end["first"], before))
        kept = end["to_last"] + (before if end["first"] == end["last"] else 0)
        repository = end["last"]
    return out


@dataclass(frozen=True)
class TreeScan:
    """``files`` with contents; ``skipped`` has every other path with its reason; ``counts`` are known without a job."""
    files: DataFrame
    skipped: DataFrame
    counts: dict[str, int]


def read_in_order(wanted: DataFrame, read: Callable[[pd.DataFrame], Iterator[tuple[bytes | None, str | None]]]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows of ``wanted`` with ``content`` and ``file_seq`` (rank of the path inside its repository), those without content, and the counts of both."""
    spark = wanted.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = wanted.repartitionByRange(n, "repository_name", "relative_path").sortWithinPartitions("repository_name", "relative_path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema) + f", {_STRETCH}"
    seen = Observation()
    stored = cut_lineage(ordered.mapInPandas(_stretch(read), schema).observe(
        seen, F.count_if(F.col("reason").isNull()).alias("read"), F.count_if(F.col("reason").isNotNull()).alias("skipped")))
    ends = stored.where(F.col("_ends").isNotNull()).select("_part", "_ends").collect()
    starts = F.broadcast(spark.createDataFrame(_carried(ends), "_part int, _first string, _before bigint"))  # one row a task
    kept = stored.where(F.col("reason").isNull()).join(starts, "_part")
    seq = F.col("_rank") + F.when(F.col("repository_name") == F.col("_first"), F.col("_before")).otherwise(0)
    return with_content(kept).select(*wanted.columns, "content", "valid_utf8", seq.alias("file_seq")), stored.where(F.col("reason").isNotNull()), seen.get


def with_content(raw: DataFrame) -> DataFrame:
    """Decode ``data`` (text, see ``is_text``)."""
    return raw.withColumn("content", decode(F.col("data"))).withColumn(
        "valid_utf8", F.is_valid_utf8(F.col("data").cast("string"))).drop("data")


def read_trees(repositories: DataFrame, listing: DataFrame | None = None) -> TreeScan:
    """Files of every repository, and the paths that are left out: too large, binary, unreadable, gone since the listing."""
    entries = cut_lineage(list_entries(repositories, ignored=False)) if listing is None else listing
    entries = entries if "reason" in entries.columns else entries.withColumn("reason", F.lit(None).cast("string"))
    listed = entries.where(F.col("reason").isNull()).where(not_ignored(F.col("relative_path")))
    columns = ["repository_name", "name", "extension", "relative_path", "absolute_path", "size", "modified_time"]
    files, unread, counts = read_in_order(listed.where(small_enough(F.col("size"))).select(columns), _file_bytes)
    narrow = ["repository_name", "absolute_path", "relative_path", "reason"]
    large = listed.where(~small_enough(F.col("size"))).withColumn("reason", F.lit(_LARGE))
    skipped = unread.select(narrow).unionByName(large.select(narrow)).unionByName(entries.where(F.col("reason").isNotNull()).select(narrow))
    return TreeScan(files, skipped, counts)


def load_trees(repositories: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``files`` of every repository; see ``read_trees`` for what is left out."""
    return read_trees(repositories, listing).files


def repositories_of(spark, local: dict[str, str]) -> DataFrame:
    """The ``repositories`` table from a mapping of names to paths."""
    return spark.createDataFrame(list(local.items()), "repository_name string, path string")


def choose_paths(requests: DataFrame, workspace_root: str) -> DataFrame:
    """Resolve scan requests ``(repository_url, repository_name, custom_path)`` to repositories.

    A custom path wins; otherwise a safe repository name below the workspace root.
    Requests with an address need a clone first and are not resolved here.
    """
    safe = text.safe_name(F.col("repository_name"))
    return requests.select(
        F.coalesce("repository_name", F.when(F.col("custom_path").isNotNull(), text.file_name(F.col("custom_path")))).alias("repository_name"),
        F.coalesce("custom_path", F.concat(F.lit(workspace_root.rstrip("/") + "/"), safe)).alias("path"),
    ).where(F.col("path").isNotNull())


def source_label(url: Column, name: Column, uploaded: Column) -> Column:
    """Address shown in a report."""
    return F.when(F.coalesce(url, F.lit("")) != "", url).when(uploaded, F.concat(F.lit("Uploaded ZIP: "), name)).otherwise(
        F.concat(F.lit("Local: "), name))


def content_of(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content of ``wanted(repository_name, relative_path)``; back slashes in the request are turned."""
    asked = wanted.withColumn("relative_path", F.replace("relative_path", F.lit("\\"), F.lit("/"))).distinct()
    return files.select("repository_name", "relative_path", "content").join(asked, ["repository_name", "relative_path"])
