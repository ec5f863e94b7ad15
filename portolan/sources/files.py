"""A1, A2, I16: reading source files and keeping an index of them up to date."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.chunking import line_chunks
from portolan.functions.text import detect_language, is_excluded, line_count
from portolan.session import written

# fixed values: what is read unless told otherwise
INCLUDE = [f"**/*.{x}" for x in "java py js ts jsx tsx go rs cpp c h hpp cs php rb scala kt swift".split()]
EXCLUDE = [f"**/{d}/**" for d in (
    "target build dist node_modules .git bin obj .vscode .idea __pycache__ .pytest_cache coverage htmlcov logs tmp temp".split()
)] + [f"**/*.{x}" for x in "class jar war ear exe dll so".split()] + ["**/.coverage", "**/.DS_Store", "**/Thumbs.db"]


def include_regex(glob: str) -> str:
    """A path pattern for an include glob: ``**/`` is any folders, ``*`` stays in one."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def is_included(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(include_regex(p) for p in patterns)) if patterns else F.lit(True)


#: Changed files whose paths go into a scan's file filter; beyond it a look reads every wanted file.
MAX_PATHS = 10_000


def _listed(
    spark: SparkSession, root: str, include: list[str], exclude: list[str], extensions: list[str] | None, stream: bool, max_bytes: int | None = None, only: list[str] | None = None
) -> DataFrame:
    """All wanted files as ``(repository, path, length, modified, bytes, uri)``.

    What is wanted is told from a file's metadata, so the scan drops other files while it lists, and none of them is
    opened. Without ``bytes`` no file is opened at all. ``only`` names files by their ``uri``.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    kinds = [re.fullmatch(r"\*\*/(\*\.\w+)", p) for p in include]
    if include and all(kinds):
        # tested on the names while listing
        reader = reader.option("pathGlobFilter", "{" + ",".join(k[1] for k in kinds) + "}")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.load(root)
    uri = F.col("_metadata.file_path")
    base = re.escape("/" + root.split("://")[-1].strip("/").split("/", 1)[-1]) if "://" in root else re.escape("/" + root.strip("/"))
    inner = F.regexp_extract(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), rf"^(?:[a-z0-9]+:)?.*?{base}/(.*)$", 1)
    repository, path = F.split(inner, "/", 2)[0], F.get(F.split(inner, "/", 2), 1)
    wanted = [path.isNotNull(), is_included(path, include), ~is_excluded(path, exclude)]
    if extensions:
        wanted.append(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin([e.lower() for e in extensions]))
    if max_bytes is not None:
        wanted.append(F.col("_metadata.file_size") <= max_bytes)
    if only is not None:
        wanted.append(uri.isin(only))
    for test in wanted:
        files = files.where(test)
    return files.select(repository.alias("repository"), path.alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("content").alias("bytes"), uri.alias("uri"))


def read_repo_files(
    spark: SparkSession, root: str, include: list[str] = INCLUDE, exclude: list[str] = EXCLUDE, max_bytes: int | None = None,
    extensions: list[str] | None = None, stream: bool = False,
) -> DataFrame:
    """A1: files below ``root`` as ``(repository, path, length, modified, bytes)``.

    The first folder below ``root`` names the repository and paths are relative to it. Names, folders and a
    size bound are tested on the listing; only files that pass are opened. ``max_bytes`` bounds the size only if given, and
    `skipped_files` lists what it leaves out. With ``stream`` new files are read as they appear.
    """
    return _listed(spark, root, include, exclude, extensions, stream, max_bytes).drop("uri")


def list_repo_files(spark: SparkSession, root: str, include: list[str] = INCLUDE, exclude: list[str] = EXCLUDE, max_bytes: int | None = None, extensions: list[str] | None = None) -> DataFrame:
    """A1: the same files as ``(repository, path, length, modified, uri)``; none is opened."""
    return _listed(spark, root, include, exclude, extensions, False, max_bytes).drop("bytes")


def skipped_files(
    spark: SparkSession, root: str, max_bytes: int, include: list[str] = INCLUDE, exclude: list[str] = EXCLUDE, extensions: list[str] | None = None
) -> DataFrame:
    """A1: the files a bound of ``max_bytes`` leaves out, with length and reason; none is opened."""
    files = _listed(spark, root, include, exclude, extensions, False).where(F.col("length") > max_bytes)
    return files.select("repository", "path", "length", F.lit(f"longer than {max_bytes} bytes").alias("reason"))


def decode_text(files: DataFrame, col: str = "bytes", ignore_errors: bool = False) -> DataFrame:
    """A2: bytes to ``content``: UTF-8 where valid, else Latin-1 (or UTF-8 with bad bytes dropped)."""
    raw = F.col(col)
    if ignore_errors:
        text = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    else:
        text = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return files.withColumn("content", text).drop(col)


def source_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """Decoded files with language, lines and content hash."""
    return _described(read_repo_files(spark, root, **options))


def _described(files: DataFrame) -> DataFrame:
    return decode_text(files).withColumns(
        {"language": detect_language(F.col("path"), F.col("content")), "lines": line_count(F.col("content")), "digest": F.sha2("content", 256)}
    )


def file_changes(files: DataFrame, index: DataFrame) -> DataFrame:
    """I16: ``(repository, path, change)``: new, changed, removed or unchanged against an index of digests."""
    key = ["repository", "path"]
    now, then = files.select(*key, F.col("digest").alias("_now")), index.select(*key, F.col("digest").alias("_then"))
    change = (
        F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_then"), "changed").otherwise("unchanged")
    )
    return now.join(then, key, "full").select(*key, change.alias("change"))


def incremental_index(files: DataFrame, index: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I16: the index and the chunks after a new look at all files.

    Only new and changed files are cut again. ``chunks`` has what ``line_chunks`` gives.
    """
    key = ["repository", "path"]
    change = file_changes(files, index)
    redo = files.join(change.where("change in ('new', 'changed')").select(*key), key, "left_semi")
    gone = change.where("change <> 'unchanged'").select(*key)
    fresh = line_chunks(redo, keep=key)
    kept = chunks.join(gone, key, "left_anti").select(*fresh.columns)
    return files.select(*key, "digest"), kept.unionByName(fresh)


def refreshed_index(spark: SparkSession, root: str, index: DataFrame, chunks: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """I16: the index ``(repository, path, length, modified, digest)`` and the chunks after a new look below ``root``.

    Lists first: a file whose length and time are those of the index is unchanged and not opened. Only the others are
    read; those with a new digest are cut again.
    """
    key = ["repository", "path"]
    now = written(list_repo_files(spark, root, **options), "listed")
    stamp = ["length", "modified"]
    differ = now.join(index.select(*key, *stamp, F.lit(True).alias("_same")), [*key, *stamp], "left").where(F.col("_same").isNull()).drop("_same")
    uris = [r.uri for r in differ.select("uri").limit(MAX_PATHS + 1).collect()]
    defaults = {"include": INCLUDE, "exclude": EXCLUDE, "extensions": None, "max_bytes": None} | options
    few = uris if len(uris) <= MAX_PATHS else None
    opened = _described(_listed(spark, root, stream=False, only=few, **defaults).drop("uri")).join(differ.select(*key), key, "left_semi")
    opened = written(opened, "opened")
    then = index.select(*key, F.col("digest").alias("_then"))
    redo = opened.join(then, key, "left").where(~F.col("digest").eqNullSafe(F.col("_then"))).drop("_then")
    fresh = line_chunks(redo, keep=key)
    gone = redo.select(*key).unionByName(index.select(*key).join(now.select(*key), key, "left_anti"))
    kept = chunks.join(gone, key, "left_anti").select(*fresh.columns)
    rest = index.join(opened.select(*key), key, "left_anti").join(now.select(*key), key, "left_semi")
    columns = [*key, *stamp, "digest"]
    return rest.select(*columns).unionByName(opened.select(*columns)), kept.unionByName(fresh)
