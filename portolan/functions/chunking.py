"""Cutting files into chunks.

Cutting is sequential inside one file, so it runs as a small Python step per row over
Arrow batches; files are spread over all tasks. Whole files are cut, never a prefix.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from portolan.functions.rules import BLOCK_WORDS

# output batches are handed on once they hold this much text
FLUSH_CHARACTERS = 4_000_000


def line_cuts(text: str, size: int = 1000, overlap: int = 4) -> Iterator[tuple[int, int, str]]:
    """Greedy pieces ``(first line, last line, text)`` of at most ``size`` characters.

    Line breaks do not count towards the size. A piece that had more lines than
    ``overlap`` hands its last ones on to the next. Blank pieces are left out; a text
    with nothing but blank pieces gives none.
    """
    lines = text.split("\n")
    start, used = 0, 0
    for no, line in enumerate(lines):
        if no > start and used + len(line) > size:
            yield start, no - 1, "\n".join(lines[start:no])
            start = no - overlap if no - start > overlap else no
            used = sum(map(len, lines[start:no]))
        used += len(line)
    yield start, len(lines) - 1, "\n".join(lines[start:])


def semantic_cuts(text: str, size: int = 1000, least: int = 100) -> Iterator[tuple[int, int, str]]:
    """Pieces that end at or before a blank line or at ``size``, none shorter than ``least``."""
    lines = text.split("\n")
    blank = [not x.strip() for x in lines] + [False]
    start, length = 0, -1
    for no, line in enumerate(lines):
        length += len(line) + 1
        ends = blank[no] or blank[no + 1] or length >= size
        if (ends or no == len(lines) - 1) and length >= least:
            yield start, no, "\n".join(lines[start : no + 1])
            start, length = no + 1, -1


def block_cuts(text: str, language: str = "python") -> Iterator[tuple[int, int, str]]:
    """Pieces that start at a line opening with a block word."""
    words = re.compile(r"\s*(?:" + "|".join(BLOCK_WORDS.get(language, BLOCK_WORDS["python"])) + r")\b")
    lines = text.split("\n")
    start = 0
    for no, line in enumerate(lines):
        if no > start and words.match(line):
            yield start, no - 1, "\n".join(lines[start:no])
            start = no
    yield start, len(lines) - 1, "\n".join(lines[start:])


def _cut(files: DataFrame, content: str, keep: list[str], cuts: Callable[..., Iterator[tuple[int, int, str]]]) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema.fields]
    cols = ["start_line int", "end_line int", "start_byte long", "end_byte long", "chunk string"]
    schema = T.StructType.fromDDL(", ".join(fields + ["chunk_index int"] + cols))
    arrow = to_arrow_schema(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.to_pydict()
            out: dict[str, list] = {name: [] for name in names}
            waiting = 0
            for pos, text in enumerate(values[content]):
                if text is None:
                    continue
                row = {k: values[k][pos] for k in values}
                # place of each line's first character
                at = [0, *accumulate(len(x) + 1 for x in text.split("\n"))]
                pieces = [(a, b, at[a], at[b + 1], t) for a, b, t in cuts(row) if t.strip()]
                for index, piece in enumerate(pieces):
                    for name, v in zip(names, [*(row[k] for k in keep), index, *piece]):
                        out[name].append(v)
                waiting += len(text)
                if waiting > FLUSH_CHARACTERS:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                    out, waiting = {name: [] for name in names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return files.select(*dict.fromkeys([*keep, content])).mapInArrow(run, schema)


def line_chunks(files: DataFrame, content: str = "content", keep: list[str] = ("repository", "path"), size: int = 1000, overlap: int = 4) -> DataFrame:
    """Greedy line chunks with the id ``repository:path:index``."""
    out = _cut(files, content, list(keep), lambda v: line_cuts(v[content], size, overlap))
    ident = F.concat_ws(":", *[F.col(k).cast("string") for k in keep], F.col("chunk_index").cast("string"))
    return out.withColumn("id", ident)


def semantic_chunks(files: DataFrame, content: str = "content", keep: list[str] = ("repository", "path"), size: int = 1000, least: int = 100) -> DataFrame:
    """Chunks cut at blank lines or at the size limit."""
    return _cut(files, content, list(keep), lambda v: semantic_cuts(v[content], size, least))


def logical_blocks(files: DataFrame, content: str = "content", keep: list[str] = ("path", "language")) -> DataFrame:
    """Blocks cut before block words; offsets count characters."""
    return _cut(files, content, list(keep), lambda v: block_cuts(v[content], v.get("language") or "python"))


@udtf(returnType="chunk_index int, start_line int, end_line int, chunk string", useArrow=True)
class LineChunks:
    """C1 as a table function: ``SELECT * FROM files, LATERAL line_chunks(content, 1000)``."""

    def eval(self, text: str, size: int = 1000):
        pieces = (p for p in line_cuts(text or "", size) if p[2].strip())
        for i, (a, b, t) in enumerate(pieces):
            yield i, a, b, t


@udtf(returnType="chunk_index int, start_line int, end_line int, chunk string", useArrow=True)
class SemanticChunks:
    """C2 as a table function."""

    def eval(self, text: str, size: int = 1000):
        for i, (a, b, t) in enumerate(p for p in semantic_cuts(text or "", size) if p[2].strip()):
            yield i, a, b, t


def register(spark: SparkSession) -> None:
    """Make the chunkers callable from SQL."""
    spark.udtf.register("line_chunks", LineChunks)
    spark.udtf.register("semantic_chunks", SemanticChunks)
