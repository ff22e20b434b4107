"""Readers of regulation files: DOCX, HWPX and HWPML by the standard library, JSON lines with validation, manifests.

Files come as binaryFile rows and are parsed one by one in their tasks; a file that cannot be read gives one row with `error`.
PDF and binary HWP need libraries that are not assumed here: their files give an error row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ENTRIES = 4096
MOST_RATIO = 200
MOST_BYTES = 512 << 20


def guarded(data: bytes) -> zipfile.ZipFile:
    """An archive within the limits of entries, sizes and ratio, without links or absolute paths."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    infos = archive.infolist()
    if len(infos) > MOST_ENTRIES:
        raise ValueError("too many archive entries")
    if sum(i.file_size for i in infos) > MOST_BYTES:
        raise ValueError("archive too large")
    for i in infos:
        if i.file_size > MOST_RATIO * max(1, i.compress_size):
            raise ValueError("archive ratio too high")
        if i.filename.startswith("/") or ".." in i.filename.split("/") or (i.external_attr >> 28) == 0xA:
            raise ValueError("unsafe archive entry")
    return archive


def parsed_xml(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data[:65536], re.I):
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(data)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def blocks_of(root: ElementTree.Element, paragraph: str, table: str, row: str, cell: str, run: str) -> Iterator[tuple[str, str]]:
    """(block_type, text) in body order; a table is one block, a row a line, cells parted by ' | '."""

    def text_of(node: ElementTree.Element) -> str:
        return "".join(x.text or "" for x in node.iter() if local(x.tag) == run)

    def walk(node: ElementTree.Element) -> Iterator[tuple[str, str]]:
        for child in node:
            name = local(child.tag)
            if name == table:
                rows = [[text_of(c).strip() for c in r if local(c.tag) == cell] for r in child.iter() if local(r.tag) == row]
                yield "table", "\n".join(" | ".join(r) for r in rows)
            elif name == paragraph and not any(local(x.tag) == table for x in child.iter()):
                yield "text", text_of(child).strip()
            else:
                yield from walk(child)

    return walk(root)


def file_blocks(path: str, data: bytes) -> list[tuple[str, str]]:
    kind = path.rpartition(".")[2].lower()
    if kind == "docx":
        root = parsed_xml(guarded(data).read("word/document.xml"))
        return list(blocks_of(root, "p", "tbl", "tr", "tc", "t"))
    if kind == "hwpx":
        archive = guarded(data)
        names = sorted(n for n in archive.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n))
        return [b for n in names for b in blocks_of(parsed_xml(archive.read(n)), "p", "tbl", "tr", "tc", "t")]
    if kind in ("hwpml", "hml"):
        return list(blocks_of(parsed_xml(data), "P", "TABLE", "ROW", "CELL", "CHAR"))
    if kind in ("txt", "md"):
        return [("text", p.strip()) for p in re.split(r"\n\s*\n", data.decode("utf-8", "replace"))]
    raise ValueError(f"no reader for .{kind} files")


FILE_BLOCKS = T.ArrayType(T.StructType([T.StructField("block_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))


@F.udf(FILE_BLOCKS, useArrow=False)
def parse_file(path: str, data: bytes) -> list[tuple]:
    """One file at a time: Arrow batches would hold thousands of files at once."""
    try:
        return [(kind, text, None) for kind, text in file_blocks(path, bytes(data)) if text]
    except Exception as error:  # noqa: BLE001  one bad file is a row, not a failed job
        return [(None, None, f"{type(error).__name__}: {error}")]


def table_parts(data: bytes) -> Iterator[tuple]:
    """(kind, table_id, row, col, row_span, col_span, text) of an HWPX file: cells with the places and spans they are given, captions of tables, foot and end notes (with the table
    they stand in, if any). A table within a cell is a table of its own and no part of the cell's text."""
    archive = guarded(data)
    count = 0

    def own_text(node: ElementTree.Element) -> str:
        lines = []
        for child in node:
            name = local(child.tag)
            if name == "t":
                lines.append("".join(child.itertext()))
            elif name not in ("tbl", "footNote", "endNote", "caption"):
                inner = own_text(child)
                lines.append(inner + ("\n" if name == "p" else ""))
        return "".join(lines)

    def number(node: ElementTree.Element | None, name: str) -> int | None:
        value = None if node is None else node.get(name)
        return int(value) if value and value.lstrip("-").isdigit() else None

    def walk(node: ElementTree.Element, inside: int | None) -> Iterator[tuple]:
        nonlocal count
        for child in node:
            name, owner = local(child.tag), inside
            if name == "tbl":
                owner, count = count, count + 1
                for row, line in enumerate(x for x in child if local(x.tag) == "tr"):
                    for cell in (x for x in line if local(x.tag) == "tc"):
                        at, span = (next((x for x in cell if local(x.tag) == n), None) for n in ("cellAddr", "cellSpan"))
                        placed = number(at, "rowAddr")
                        yield "cell", owner, row if placed is None else placed, number(at, "colAddr"), number(span, "rowSpan") or 1, number(span, "colSpan") or 1, own_text(cell).strip()
            elif name in ("caption", "footNote", "endNote"):
                yield "caption" if name == "caption" else "note", inside, None, None, None, None, own_text(child).strip()
            yield from walk(child, owner)

    for name in sorted(n for n in archive.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)):
        yield from walk(parsed_xml(archive.read(name)), None)


PART = [("kind", T.StringType()), ("table_id", T.LongType()), *[(n, T.IntegerType()) for n in ("row", "col", "row_span", "col_span")], ("text", T.StringType()), ("error", T.StringType())]


@F.udf(T.ArrayType(T.StructType([T.StructField(n, k) for n, k in PART])), useArrow=False)
def parse_tables(data: bytes) -> list[tuple]:
    try:
        return [(*part, None) for part in table_parts(bytes(data))]
    except Exception as error:  # noqa: BLE001  one bad file is a row, not a failed job
        return [(None,) * 7 + (f"{type(error).__name__}: {error}",)]


def read_tables(spark: SparkSession, folder: str, pattern: str = "*.hwpx", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(document_id, place, kind, table_id, row, col, row_span, col_span, text, error) of the HWPX files below a folder, in the shape that `operators.grids` takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    small = files.filter(F.col("length") <= most_bytes).select(F.col("path").alias("document_id"), F.posexplode(parse_tables("content")).alias("place", "p")).select("document_id", "place", "p.*")
    none = [F.lit(None).cast(k).alias(n) for n, k in PART[:-1]]
    return small.unionByName(files.filter(F.col("length") > most_bytes).select(F.col("path").alias("document_id"), F.lit(0).alias("place"), *none, F.lit("file too large").alias("error")))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, block_index, block_type, text, error) of every file below a folder. Files over `most_bytes` are not loaded: they give an error row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    small = files.filter(F.col("length") <= most_bytes).select("path", F.posexplode(parse_file("path", "content")).alias("block_index", "b")).select("path", "block_index", "b.*")
    large = files.filter(F.col("length") > most_bytes).select("path", F.lit(0).alias("block_index"), F.lit(None).cast("string").alias("block_type"), F.lit(None).cast("string").alias("text"), F.lit("file too large").alias("error"))
    return small.unionByName(large)


def read_records(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """JSON lines with `line_error`: malformed, the first missing required field, or null."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    error = F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed"))
    for name in required:
        error = error.when(F.col(name).isNull(), F.lit(f"missing {name}"))
    return rows.withColumn("line_error", error).drop("_corrupt_record")


def best_of_identity(rows: DataFrame, identity: list[str], quality: str, position: str) -> DataFrame:
    """One manifest row for each identity: the best quality, then the first position."""
    order = Window.partitionBy(*identity).orderBy(F.col(quality).desc_nulls_last(), F.col(position))
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
