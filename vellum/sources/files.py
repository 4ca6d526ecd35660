"""Reading PDF files and writing what they hold."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..operators.relations import READERS, SCHEMAS, batches, column_definitions, relation, rows_of


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf", max_bytes: int | None = None) -> DataFrame:
    """(doc_id, path, length, content) of all files under a path. doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


class Corpus:
    """The relations of a set of files, as attributes: corpus.pages, corpus.glyphs, ..."""

    def __init__(self, pdfs: DataFrame, **options: Any) -> None:
        self.pdfs, self.options = pdfs, options

    def __getattr__(self, name: str) -> DataFrame:
        if name not in READERS:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str, **options: Any) -> DataFrame:
        return relation(self.pdfs, name, **(self.options | options))

    def map_pages(self, function: Any, schema: str) -> DataFrame:
        """function(document, page) -> dict for every page, where the file is read."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        from ..core.document import Document

        full = StructType.fromDDL("doc_id bigint, page_idx int, " + schema)
        arrow = to_arrow_schema(full)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc_id, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    doc = Document(content)
                    rows = [{"doc_id": doc_id, "page_idx": p.index, **function(doc, p)} for p in doc.pages()]
                    yield pa.RecordBatch.from_pylist(rows, arrow)

        return self.pdfs.select("doc_id", "content").mapInArrow(run, full)


def open_pdf(spark: SparkSession, path: str, **options: Any) -> Corpus:
    """A Corpus of the files under a path; password, space and mode are options."""
    return Corpus(read_files(spark, path), **options)


def parse_pdf(spark: SparkSession, content: bytes, **options: Any) -> Corpus:
    """A Corpus of one file held in memory."""
    return Corpus(spark.createDataFrame([(0, bytearray(content))], "doc_id bigint, content binary"), **options)


def opened(uri: str) -> tuple[Any, str, str]:
    """(file system, path in it, what a path is prefixed with to name it as Spark does) of a local path or a URI (file, hdfs, s3, ...)."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:")), "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, "file:" if uri.startswith("file:") else uri[: uri.index(path.rstrip("/"))]


def path_id(path: str) -> int:
    """The doc_id of a path, as Spark's xxhash64 has it."""
    import xxhash

    n = xxhash.xxh64_intdigest(path, seed=42)
    return n - (1 << 64) if n >> 63 else n


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


#: Bytes of the files of one partition.
PARTITION_BYTES = 64 << 20


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: Any, columns: list[str]) -> None:
        self.options, self.relation, self.schema, self.columns = options, options.get("relation", "documents"), schema, columns
        self.kinds: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """object_type = '...' on content_objects decides what the interpreter builds."""
        for f in filters:
            if self.relation == "content_objects" and isinstance(f, EqualTo) and f.attribute == ("object_type",):
                self.kinds = [f.value]
            yield f  # rows are filtered by Spark as well

    def partitions(self) -> list[FilePartition]:
        """The files under a folder, or those that a pattern names, by their sizes: one listing, without opening any."""
        from fnmatch import fnmatch

        from pyarrow import fs

        system, path, _ = opened(self.options["path"])
        pattern = next((k for k, c in enumerate(path) if c in "*?["), None)
        if pattern is None and system.get_file_info(path).is_file:
            found = [system.get_file_info(path)]
        else:
            base = path if pattern is None else path[:pattern].rpartition("/")[0]
            wanted = f"{path.rstrip('/')}/*.pdf" if pattern is None else path
            infos = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            found = sorted((i for i in infos if i.is_file and fnmatch(i.path, wanted)), key=lambda i: i.path)
        parts: list[list[str]] = []
        size = PARTITION_BYTES + 1
        for i in found:
            if size + i.size > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(i.path)
            size += i.size
        return [FilePartition(p) for p in parts]

    def read(self, partition: FilePartition) -> Iterator[Any]:
        """Arrow batches."""
        from pyspark.sql.pandas.types import to_arrow_schema

        options: dict[str, Any] = {k: self.options[k] for k in ("password", "space", "mode", "cmap_folder") if k in self.options}
        if self.columns:
            options["columns"] = self.columns
        if self.kinds:
            options["kinds"] = self.kinds
        system, _, prefix = opened(self.options["path"])

        def every() -> Iterator[dict[str, Any]]:
            for path in partition.paths:
                with system.open_input_file(path) as f:
                    content = f.read()
                yield from rows_of(self.relation, path_id(prefix + path), content, options)

        yield from batches(to_arrow_schema(self.schema), every())


class PdfDataSource(DataSource):
    """spark.read.format("pdf").option("relation", "pages").load(folder), for folders and URIs that all workers can open.

    Option columns: a list with commas; only these are built. doc_id is that of read_files.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        whole = SCHEMAS[self.options.get("relation", "documents")]
        own = column_definitions(whole)
        return ", ".join(own[c] for c in self._columns()) or whole

    def _columns(self) -> list[str]:
        own = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return ["doc_id", *(c for c in own if c != "doc_id")] if own else []

    def reader(self, schema: Any) -> PdfReader:
        return PdfReader(dict(self.options), schema, self._columns())


def register(spark: SparkSession) -> None:
    from ..operators.relations import register_functions

    spark.dataSource.register(PdfDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register_functions(spark)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes each image as a file of its own, from the workers, to a folder or URI that they share; the rows with the paths written."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root, _ = opened(folder)
        system.create_dir(root)
        for part in parts:
            paths = []
            for r in part.itertuples():
                paths.append(f"{root}/doc{r.doc_id}-page{r.page_idx + 1}-{r.item_seq}-{r.part}{r.suffix}")
                with system.open_output_stream(paths[-1]) as f:
                    f.write(r.bytes)
            yield pd.DataFrame({"doc_id": part["doc_id"], "page_idx": part["page_idx"], "path": paths})

    return images.select("doc_id", "page_idx", "item_seq", "part", "suffix", "bytes").mapInPandas(run, "doc_id bigint, page_idx int, path string")


def write_fonts(fonts: DataFrame, folder: str) -> DataFrame:
    """Writes the program of the first font of each name; fonts is read with programs=True."""
    import pandas as pd

    first = fonts.where("program is not null").groupBy("doc_id", "fontname").agg(F.min_by(F.struct("embedded_kind", "program"), F.struct("page_idx", "ordinal")).alias("f"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root, _ = opened(folder)
        system.create_dir(root)
        for part in parts:
            paths = []
            for r in part.itertuples():
                suffix = {"FontFile": ".pfa", "FontFile2": ".ttf", "FontFile3": ".cff"}[r.embedded_kind]
                paths.append(f"{root}/doc{r.doc_id}-{r.fontname.replace('/', '_')}{suffix}")
                with system.open_output_stream(paths[-1]) as f:
                    f.write(r.program)
            yield pd.DataFrame({"doc_id": part["doc_id"], "fontname": part["fontname"], "path": paths})

    return first.select("doc_id", "fontname", "f.*").mapInPandas(run, "doc_id bigint, fontname string, path string")


def metadata_json(pdfs: DataFrame) -> DataFrame:
    """(doc_id, json): each document with its pages, as one JSON text."""
    pages = relation(pdfs, "pages").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_idx", "label", "page_objid", "mediabox", "cropbox", "rotate", "resources"))).alias("pages"))
    docs = relation(pdfs, "documents")
    fields = [c for c in docs.columns if c != "doc_id"]
    return docs.join(pages, "doc_id", "left").select("doc_id", F.to_json(F.struct(*fields, "pages")).alias("json"))
