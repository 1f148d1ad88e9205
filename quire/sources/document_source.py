"""A Spark data source for stored documents whose filters prune documents and pages before they are read.

A document is one file: a first line that says where each page stands, then a line of JSON for each page. A reader that needs a
few pages reads that first line and the bytes of those pages; a document that a filter excludes isn't opened, as its name is its
file's. Filters on ``doc`` (equal, in, starts with) and ``page`` (equal, in, greater, less) are taken over from Spark; all others stay with it.

    spark.dataSource.register(DocumentSource)
    blocks.write.format("quire_documents").mode("append").save(folder)
    spark.read.format("quire_documents").option("pages", "1,3-5").load(folder).where("doc = 'a'")

Folders are local or of any kind that Arrow knows by its address. Rows of one document have to reach the writer in one task, in order:
``write_documents`` does that. A file appears only when its task's rows are all there and the job is committed; files of a failed job go.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCKS = "doc string, page int, page_w double, page_h double, ord int, block_id string, text string, x0 double, y0 double, x1 double, y1 double, font double, bold boolean"
FIELDS = ("ord", "block_id", "text", "x0", "y0", "x1", "y1", "font", "bold")
SUFFIX, HEAD = ".pages", 4096  # bytes that are read at first


def file_name(doc: str) -> str:
    """Any name as a file's: letters, digits, dots, dashes and underscores stay as they are, other names are encoded."""
    plain = bool(doc) and doc[0] not in "._=" and all(c.isascii() and (c.isalnum() or c in "._-") for c in doc)
    return (doc if plain else "=" + base64.urlsafe_b64encode(doc.encode()).decode()) + SUFFIX


def document_name(path: str) -> str:
    name = path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
    return base64.urlsafe_b64decode(name[1:]).decode() if name.startswith("=") else name


def page_ranges(text: str) -> list[tuple[int, int]]:
    """"1,3-5" as ranges, which may be open at the end: "7-"."""
    out = []
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        if not low.strip().isdigit() or (high.strip() and not high.strip().isdigit()):
            raise ValueError(f"page range {part!r} isn't valid")
        first = int(low)
        last = int(high) if high.strip() else (1 << 31) - 1 if dash else first
        if not 1 <= first <= last:
            raise ValueError(f"page range {part!r} is out of order")
        out.append((first, last))
    return out


@dataclass
class Wanted:
    """What filters leave: names and beginnings of documents, and bounds and numbers of pages. None: all."""

    docs: set[str] | None = None
    prefixes: tuple[str, ...] = ()
    low: int = 0
    high: int = (1 << 31) - 1
    pages: set[int] | None = None
    ranges: tuple[tuple[int, int], ...] | None = None

    def take(self, f: Filter) -> bool:
        """Narrows by a filter; whether it was one of those that are known, whole."""
        column = getattr(f, "attribute", ())
        value = getattr(f, "value", None)
        if column == ("doc",):
            if isinstance(f, EqualTo) and isinstance(value, str):
                self.docs = {value} if self.docs is None else self.docs & {value}
            elif isinstance(f, In) and all(isinstance(v, str) for v in value):
                self.docs = set(value) if self.docs is None else self.docs & set(value)
            elif isinstance(f, StringStartsWith):
                self.prefixes = (*self.prefixes, value)
            else:
                return False
            return True
        if column == ("page",):
            if isinstance(f, EqualTo) and isinstance(value, int):
                self.low, self.high = max(self.low, value), min(self.high, value)
            elif isinstance(f, In) and all(isinstance(v, int) for v in value):
                self.pages = set(value) if self.pages is None else self.pages & set(value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, value - 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value)
            else:
                return False
            return True
        return False

    def document(self, name: str) -> bool:
        return (self.docs is None or name in self.docs) and all(name.startswith(p) for p in self.prefixes) and self.low <= self.high

    def page(self, number: int) -> bool:
        return self.low <= number <= self.high and (self.pages is None or number in self.pages) and (self.ranges is None or any(a <= number <= b for a, b in self.ranges))


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass
class Document(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class DocumentReader(DataSourceReader):
    def __init__(self, folder: str, wanted: Wanted):
        self.folder, self.wanted = folder, wanted

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.folder)
        names = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.path.endswith(SUFFIX) and "/_" not in f.path[len(root) :]]
        return [Document(p) for p in sorted(names) if self.wanted.document(document_name(p))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Document):  # nothing is left to read
            return
        system, _ = _filesystem(self.folder)
        doc = document_name(partition.path)
        with system.open_input_file(partition.path) as f:
            head = f.read(HEAD)
            while b"\n" not in head and (more := f.read(len(head))):
                head += more
            line, _, _ = head.partition(b"\n")
            at = len(line) + 1
            for page, width, height, offset, length in json.loads(line):
                if not self.wanted.page(page):
                    continue
                f.seek(at + offset)
                for b in json.loads(f.read(length)):
                    yield (doc, page, width, height, *(b.get(k) for k in FIELDS))


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """Rows of a document one after the other, pages rising."""
        system, root = _filesystem(self.folder)
        staging = f"{root}/_{self.job}"
        moves: list[tuple[str, str]] = []
        doc, pages = None, []

        def close() -> None:
            if doc is None:
                return
            made = [json.dumps(blocks, ensure_ascii=False, separators=(",", ":")).encode() + b"\n" for *_, blocks in pages]
            offsets, at = [], 0
            for (page, width, height, _), line in zip(pages, made, strict=True):
                offsets.append([page, width, height, at, len(line)])
                at += len(line)
            system.create_dir(staging, recursive=True)
            path = f"{staging}/{uuid.uuid4().hex}"
            with system.open_output_stream(path) as f:
                f.write(json.dumps(offsets).encode() + b"\n")
                for line in made:
                    f.write(line)
            moves.append((path, f"{root}/{file_name(doc)}"))

        for r in rows:
            if r["doc"] is None or r["page"] is None:
                raise ValueError("a stored block has a document and a page")
            if r["doc"] != doc:
                close()
                doc, pages = r["doc"], []
            if not pages or pages[-1][0] != r["page"]:
                if pages and pages[-1][0] > r["page"]:
                    raise ValueError(f"the pages of {doc} aren't in order")
                pages.append((r["page"], r["page_w"], r["page_h"], []))
            pages[-1][3].append({k: r[k] for k in FIELDS if r[k] is not None})
        close()
        return Written(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, root = _filesystem(self.folder)
        moves = [m for message in messages if message is not None for m in message.moves]  # type: ignore[attr-defined]
        if len({name for _, name in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a document's rows came from several tasks")
        there = {f.path for f in system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)) if f.path.endswith(SUFFIX)}
        taken = there & {name for _, name in moves}
        if taken and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"stored already: {', '.join(sorted(document_name(p) for p in taken)[:5])}")
        if self.overwrite:
            for path in there:
                system.delete_file(path)
        for path, name in moves:
            system.move(path, name)
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_filesystem(self.folder))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_{self.job}")


class DocumentSource(DataSource):
    """Options: path; pages, ranges to read such as "1,3-5,9-"."""

    @classmethod
    def name(cls) -> str:
        return "quire_documents"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        pages = self.options.get("pages")
        return DocumentReader(self.options["path"].rstrip("/"), Wanted(ranges=tuple(page_ranges(pages)) if pages else None))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"].rstrip("/"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)


def write_documents(blocks: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each document. Without ``overwrite`` documents are added, never over one that is there."""
    register(blocks.sparkSession)
    rows = blocks.select(*[f.split(" ")[0] for f in BLOCKS.split(", ")])
    rows.repartition("doc").sortWithinPartitions("doc", "page", "ord").write.format("quire_documents").mode("overwrite" if overwrite else "append").save(folder)


def read_documents(spark: SparkSession, folder: str, pages: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("quire_documents")
    return (reader.option("pages", pages) if pages else reader).load(folder)
