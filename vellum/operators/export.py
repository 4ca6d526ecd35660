"""Relations as nested JSON, and as the pieces that the command line writes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..core.document import Document
from ..core.values import PdfError, Ref, plain
from . import lookups as L
from .relations import SCHEMAS, relation


def per_file(pdfs: DataFrame, make: Any) -> DataFrame:
    """(doc_id, json): make(document) for every file that can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, said = [], []
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    said.append(json.dumps(make(Document(content or b"")), ensure_ascii=False))
                    ids.append(doc_id)
                except PdfError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string())], ["doc_id", "json"])

    return pdfs.select("doc_id", "content").mapInArrow(run, "doc_id bigint, json string")


def catalog_json(pdfs: DataFrame) -> DataFrame:
    """The catalog with every reference resolved once, breadth first; keys that lead upwards are left out."""

    def make(doc: Document) -> Any:
        seen: set[int] = set()
        top: dict[str, Any] = {}
        waiting: list[tuple[Any, Any, Any]] = [(doc.trailer.get("Root"), top, "Root")]
        while waiting:
            value, holder, key = waiting.pop(0)
            if isinstance(value, Ref):
                if value.objid in seen:
                    holder[key] = plain(value)
                    continue
                seen.add(value.objid)
                value = doc.get(value.objid)
            if hasattr(value, "attrs"):
                value = value.attrs
            if isinstance(value, dict):
                holder[key] = own = {k: None for k in value if k not in ("Parent", "P")}
                waiting += [(value[k], own, k) for k in own]
            elif isinstance(value, list):
                holder[key] = items = [None] * len(value)
                waiting += [(v, items, k) for k, v in enumerate(value)]
            else:
                holder[key] = plain(value)
        return top.get("Root")

    return per_file(pdfs, make)


def nested(rows: DataFrame, fields: list[str], name: str = "children") -> DataFrame:
    """(doc_id, json) of trees of rows with node_id and parent_id; empty fields are left out."""

    def run(group: pa.Table) -> pa.Table:
        made: dict[int, dict[str, Any]] = {}
        tops: list[dict[str, Any]] = []
        for r in sorted(group.to_pylist(), key=lambda r: r["node_id"]):
            node = made[r["node_id"]] = {f: r[f] for f in fields if r[f] is not None}
            parent = made.get(r["parent_id"])
            (tops if parent is None else parent.setdefault(name, [])).append(node)
        return pa.table({"doc_id": group.column("doc_id")[:1], "json": pa.array([json.dumps(tops, ensure_ascii=False)], pa.string())})

    return rows.select("doc_id", "node_id", "parent_id", *fields).groupBy("doc_id").applyInArrow(run, "doc_id bigint, json string")


def structure_json(pdfs: DataFrame) -> DataFrame:
    """The logical structure with the texts of its items."""
    nodes = relation(pdfs, "struct_nodes")
    s = L.marked_content(relation(pdfs, "content_objects", kinds=["text", "image"], columns=L.SECTION_COLUMNS))
    s = s.select(F.col("doc_id").alias("s_doc"), F.col("page_idx").alias("s_page"), F.col("mcid_stream").alias("s_stream"), F.col("mcid").alias("s_mcid"), "text")
    same = (F.col("doc_id") == F.col("s_doc")) & (F.col("page_idx") == F.col("s_page")) & (F.col("mcid") == F.col("s_mcid")) & F.col("stream_id").eqNullSafe(F.col("s_stream"))
    said = nodes.join(s, same, "left").drop("s_doc", "s_page", "s_stream", "s_mcid")
    return nested(said, ["kind", "type", "role", "page_idx", "mcid", "title", "lang", "alt", "expansion", "actual_text", "class_name", "attributes", "text"])


def json_schemas() -> dict[str, dict[str, Any]]:
    """The JSON schema of a row of each relation."""
    from ..functions.values import json_schema

    return {name: json_schema(StructType.fromDDL(ddl), name) for name, ddl in SCHEMAS.items()}


def outline_json(pdfs: DataFrame) -> DataFrame:
    return nested(relation(pdfs, "outline_items"), ["title", "action_type", "uri", "dest_page_idx", "display", "top", "left"])


def page_arrays(items: DataFrame, drop: tuple[str, ...] = ("doc_id", "page_idx", "op_seq")) -> DataFrame:
    """(doc_id, page_idx, json): the rows of each page as one JSON array, in order."""
    order = [c for c in ("item_seq", "glyph_idx") if c in items.columns]
    fields = [c for c in items.columns if c not in (*drop, *order)]
    return items.groupBy("doc_id", "page_idx").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("o")))), lambda s: s.getField("o"))).alias("json"))


def texts_json(pdfs: DataFrame, glyphs: bool = False, space: str = "default") -> DataFrame:
    if glyphs:
        return page_arrays(relation(pdfs, "glyphs", space=space))
    return page_arrays(relation(pdfs, "content_objects", space=space, kinds=["text"]).select("doc_id", "page_idx", "item_seq", "chars", "bbox", "matrix", "gstate", "mcstack"))


def objects_json(pdfs: DataFrame, space: str = "default") -> DataFrame:
    return page_arrays(relation(pdfs, "content_objects", space=space))


def stream_bytes(pdfs: DataFrame, objid: int) -> DataFrame:
    """(doc_id, decoded) of a stream, from its newest revision."""
    rows = relation(pdfs, "objects").where((F.col("objid") == objid) & (F.col("kind") == "stream"))
    return rows.groupBy("doc_id").agg(F.max_by("decoded", "seq").alias("decoded"))


def outline_texts(pdfs: DataFrame, length: int = 100) -> DataFrame:
    """Outline items with the beginning of the text at or below what they lead to, on that page."""
    items = relation(pdfs, "outline_items").where("dest_page_idx is not null")
    texts = relation(pdfs, "content_objects", space="default", kinds=["text"]).select(F.col("doc_id").alias("t_doc"), F.col("page_idx").alias("t_page"), "item_seq", "chars", "bbox")
    under: Column = F.col("bbox.y0") <= F.col("top")
    pairs = items.join(texts, (F.col("doc_id") == F.col("t_doc")) & (F.col("dest_page_idx") == F.col("t_page")) & under, "left")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("chars").isNotNull(), F.struct("item_seq", "chars")))), lambda s: s.getField("chars")), " ")
    return pairs.groupBy("doc_id", "node_id", "title", "dest_page_idx").agg(F.substring(said, 1, length).alias("text"))
