"""One JSON document per session: {report, chartData, tableData, vendors, session_id}, streamed from its entries.

Entries are dealt out by ranges of (session, section, place in the section) and sorted inside a range, so every
task writes a stretch of the documents' text, line by line, and no session is ever held in one row or task. A
document whose entries fall into one range is one file; a larger one is several, which put together in order
are the document. Besides its entries a section has one row that opens it. That row takes the place of the
section's first entry, so both are in one range, and whether an entry needs a comma follows from the row before.

The writer is a data source: each task attempt writes to a folder of its own, and the list of the folders that
count, with the sessions that each begins and ends with, is written when all have ended. Readers go by the list
alone, so what a failed or repeated attempt left is never read; the next commit removes it. The path must be
one that the driver and all executors see, on any file system that Arrow opens.
"""

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import quote, unquote
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from bidmatrix.session import release, stored, work_folder

# tasks get the code of this module with the job, whether the package is installed there or not
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sections with many entries, in the order of the document.
SECTIONS = ("chartData", "tableData", "vendors")
LIST = "_documents.json"
#: Bytes that are read at once.
BLOCK = 1 << 20


def json_text(value: Column) -> Column:
    """A string as JSON, null for null."""
    inside = F.to_json(F.array(value))
    return inside.substr(F.lit(2), F.length(inside) - 2)


def framed(bundle: DataFrame) -> DataFrame:
    """The lines of all documents, in no order yet: session_id, section_no, sort_number, sort_text, kind, text.

    ``bundle`` has the entries of ``comparison.bundle``. kind is 0 for lines that open or close sections.
    """
    given = bundle.where(F.col("session_id").isNotNull())
    number = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    key = ["session_id", "section_no", "sort_number", "sort_text"]
    text = F.when(F.col("section") == "vendors", json_text(F.col("entry"))).otherwise(F.col("entry"))
    entries = given.where(F.col("section").isin(*SECTIONS)).withColumn("section_no", number).select(*key, F.lit(1).alias("kind"), text.alias("text"))

    report = F.max(F.when(F.col("section") == "report", F.col("entry"))).alias("report")
    first = [
        F.min(F.when(F.col("section") == s, F.struct("sort_number", "sort_text"))).alias(f"first{n}") for n, s in enumerate(SECTIONS, 1)
    ]
    opens = [F.concat(F.lit('{"report":'), json_text(F.col("report")), F.lit(f',"{SECTIONS[0]}":['))]
    opens += [F.lit(f'],"{s}":[') for s in SECTIONS[1:]]
    line = lambda n, key, text: F.struct(F.lit(n).alias("section_no"), key["sort_number"].alias("sort_number"), key["sort_text"].alias("sort_text"), text.alias("text"))
    lines = [line(n, F.col(f"first{n}"), text) for n, text in enumerate(opens, 1)]
    nothing = F.struct(F.lit(None).cast("bigint").alias("sort_number"), F.lit(None).cast("string").alias("sort_text"))
    lines.append(line(len(SECTIONS) + 1, nothing, F.concat(F.lit('],"session_id":'), json_text(F.col("session_id")), F.lit("}"))))
    frame = given.groupBy("session_id").agg(report, *first).select("session_id", F.explode(F.array(*lines)).alias("l"))
    return entries.unionByName(frame.select("session_id", "l.*", F.lit(0).alias("kind")))


def write_documents(bundle: DataFrame, path: str) -> None:
    """Write the documents of all sessions of a bundle; they replace those that the path held.

    The bundle is read for the entries, for what opens their sections and for the bounds of the ranges, so it is stored.
    """
    key = ["session_id", "section_no", "sort_number", "sort_text"]
    spark, folder = bundle.sparkSession, work_folder(bundle.sparkSession)
    spark.dataSource.register(SessionDocuments)
    placed = framed(stored(bundle, folder)).repartitionByRange(*key).sortWithinPartitions(*key, "kind", "text")
    placed.select("session_id", "kind", "text").write.format("session_documents").mode("overwrite").save(path)
    release(spark, folder)


# the writer

def file_name(session_id: str) -> str:
    """The session's id, escaped; its hash where that is too long for a file's name."""
    name = quote(session_id, safe="")
    return f"{name if len(name) <= 200 else sha256(session_id.encode()).hexdigest()}.json"


def located(path: str) -> tuple[fs.FileSystem, str]:
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


@dataclass
class Piece(WriterCommitMessage):
    """A task's folder and the first and last session in it; no folder if it had no rows."""

    task: int
    folder: str | None = None
    first: str | None = None
    last: str | None = None


class SessionDocuments(DataSource):
    """``session_documents``: a sink for sorted lines (session_id, kind, text), a source of all documents' lines (session_id, line)."""

    @classmethod
    def name(cls) -> str:
        return "session_documents"

    def schema(self) -> str:
        return "session_id string, line string"

    def reader(self, schema) -> "LineReader":
        return LineReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> "DocumentWriter":
        if not overwrite:
            raise ValueError("documents are replaced as a whole: use mode overwrite")
        return DocumentWriter(self.options["path"])


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Piece:
        piece = Piece(TaskContext.get().partitionId())
        system, root = located(self.path)
        out, before = None, 1
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if piece.folder is None:
                    piece.folder, piece.first = f"{piece.task:06d}-{uuid4().hex}", batch.column(0)[0].as_py()
                    system.create_dir(f"{root}/{piece.folder}")
                session, kind, text = batch.columns
                earlier = pa.concat_arrays([pa.array([before], kind.type), kind[:-1]])
                comma = pc.if_else(pc.and_(pc.equal(kind, 1), pc.equal(earlier, 1)), ",", "")
                lines = pc.binary_join_element_wise(comma, text, "\n", "").cast(pa.large_string())
                new = pc.indices_nonzero(pc.not_equal(session[1:], session[:-1])).to_pylist()
                edges = [0, *[k + 1 for k in new], batch.num_rows]
                for start, stop in zip(edges[:-1], edges[1:]):
                    owner = session[start].as_py()
                    if out is None or owner != piece.last:
                        if out is not None:
                            out.close()
                        out, piece.last = system.open_output_stream(f"{root}/{piece.folder}/{file_name(owner)}"), owner
                    part = lines.slice(start, stop - start)
                    _, offsets, data = part.buffers()
                    bounds = pa.Array.from_buffers(pa.int64(), len(part) + 1, [None, offsets], offset=part.offset)
                    begin, end = bounds[0].as_py(), bounds[len(part)].as_py()
                    out.write(data.slice(begin, end - begin))
                before = kind[-1].as_py()
        finally:
            if out is not None:
                out.close()
        return piece

    def commit(self, messages: list[Piece | None]) -> None:
        system, root = located(self.path)
        pieces = sorted((m.task, m.folder, m.first, m.last) for m in messages if m is not None and m.folder)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{LIST}.draft") as out:
            out.write(json.dumps([{"folder": f, "first": a, "last": b} for _, f, a, b in pieces]).encode())
        system.move(f"{root}/{LIST}.draft", f"{root}/{LIST}")
        listed = {f for _, f, _, _ in pieces}
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.Directory and info.base_name not in listed:
                system.delete_dir(info.path)

    def abort(self, messages: list[Piece | None]) -> None:
        system, root = located(self.path)
        for m in messages:
            if m is not None and m.folder:
                system.delete_dir(f"{root}/{m.folder}")


# reading

def pieces_of(path: str) -> list[dict]:
    """The list: as many entries as tasks wrote something."""
    system, root = located(path)
    with system.open_input_stream(f"{root}/{LIST}") as given:
        return json.loads(given.read())


def read_document(path: str, session_id: str) -> Iterator[bytes]:
    """One session's document, in pieces of bounded size; nothing for a session that has none."""
    system, root = located(path)
    for piece in pieces_of(path):
        name = f"{root}/{piece['folder']}/{file_name(session_id)}"
        if piece["first"] <= session_id <= piece["last"] and system.get_file_info(name).type == fs.FileType.File:
            with system.open_input_stream(name) as given:
                while block := given.read(BLOCK):
                    yield block


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all documents: session_id (by the file's name) and line.

    A task reads the files of one piece, which are as many as a task wrote, one after another and block by block.
    """
    if not pieces_of(path):
        return spark.createDataFrame([], "session_id string, line string")
    spark.dataSource.register(SessionDocuments)
    return spark.read.format("session_documents").load(path)


@dataclass
class PieceFolder(InputPartition):
    folder: str


class LineReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[PieceFolder]:
        return [PieceFolder(p["folder"]) for p in pieces_of(self.path)]

    def read(self, partition: PieceFolder) -> Iterator[pa.RecordBatch]:
        system, root = located(self.path)
        ids, lines, size = [], [], 0
        for info in system.get_file_info(fs.FileSelector(f"{root}/{partition.folder}")):
            if not info.base_name.endswith(".json"):
                continue
            session_id, rest = unquote(info.base_name.removesuffix(".json")), b""
            with system.open_input_stream(info.path) as given:
                while block := given.read(BLOCK):
                    *whole, rest = (rest + block).split(b"\n")
                    ids += [session_id] * len(whole)
                    lines += whole
                    size += len(block)
                    if size >= BLOCK:
                        yield line_batch(ids, lines)
                        ids, lines, size = [], [], 0
            if rest:
                ids.append(session_id)
                lines.append(rest)
        if lines:
            yield line_batch(ids, lines)


def line_batch(ids: list[str], lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.binary()).cast(pa.string())], ["session_id", "line"])


def entries(lines: DataFrame) -> DataFrame:
    """What documents hold, from their lines: session_id, section, entry; a report with null text has no entry."""
    body = F.regexp_replace("line", "^,", "")
    opening = F.col("line").startswith('{"report":')
    report = F.from_json(F.concat("line", F.lit("]}")), "report string")["report"]
    plain = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")[0]
    section = (
        F.when(opening, "report").when(body.startswith('{"category":'), "tableData").when(body.startswith('{"'), "chartData")
        .when(body.startswith('"'), "vendors")
    )
    entry = F.when(opening, report).when(body.startswith('"'), plain).otherwise(body)
    return lines.select("session_id", section.alias("section"), entry.alias("entry")).where("section is not null and entry is not null")
