"""python -m vellum.cli [what] FOLDER-OR-FILE: relations and JSON on standard output, or written to a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import export as X
from .operators import lookups as L
from .operators.relations import READERS, relation
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    p.add_argument("path")
    p.add_argument("-s", "--stream", type=int, metavar="OBJID", help="decoded bytes of a stream")
    for flag, said in (
        ("content-streams", "the pages' decoded content"), ("catalog", "the catalog as JSON"), ("content-objects", "all content objects as JSON"), ("text-objects", "text objects as JSON"), ("text", "the text of each page"),
        ("explode-text", "glyphs in place of text objects"), ("structure", "the logical structure as JSON"), ("outline", "the outline as JSON"),
    ):
        p.add_argument(f"--{flag}", action="store_true", help=said)
    p.add_argument("--images", metavar="FOLDER")
    p.add_argument("--fonts", metavar="FOLDER")
    p.add_argument("--relation", choices=sorted(READERS), help="any relation, as JSON lines")
    p.add_argument("--pages", default="all", help='such as "1,3-5"')
    p.add_argument("--space", default="default", choices=("screen", "page", "default"))
    p.add_argument("--output", metavar="FOLDER", help="write Parquet there, in place of printing")
    return p


def chosen(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The flag of the highest rank decides; without any, the metadata."""
    pdfs = files.read_files(spark, a.path)
    paged = None
    if a.relation:
        out = relation(pdfs, a.relation)
    elif a.stream is not None:
        out = X.stream_bytes(pdfs, a.stream)
    elif a.content_streams:
        out = paged = relation(pdfs, "page_content").withColumn("content", F.decode("content", "ISO-8859-1"))
    elif a.catalog:
        out = X.catalog_json(pdfs)
    elif a.content_objects:
        out = paged = X.objects_json(pdfs, a.space)
    elif a.text_objects or a.explode_text:
        out = paged = X.texts_json(pdfs, a.explode_text, a.space)
    elif a.text:
        out = paged = relation(pdfs, "page_text", space=a.space)
    elif a.structure:
        out = X.structure_json(pdfs)
    elif a.outline:
        out = X.outline_json(pdfs)
    elif a.images:
        out = files.write_images(L.select_pages(relation(pdfs, "images", space=a.space), a.pages), a.images)
    elif a.fonts:
        out = files.write_fonts(relation(pdfs, "fonts", programs=True), a.fonts)
    else:
        out = files.metadata_json(pdfs)
    return L.select_pages(out, a.pages) if paged is not None else out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The number of files that couldn't be read."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vellum").getOrCreate()
    out = chosen(spark, a)
    if a.output:
        out.write.mode("overwrite").parquet(a.output)
    else:
        order = [c for c in ("doc_id", "page_idx") if c in out.columns]
        for row in (out.orderBy(*order) if order else out).toLocalIterator():
            d = row.asDict(True)
            print(d["json"] if "json" in d else d["text"] if a.text else d["content"] if a.content_streams else d)
    return relation(files.read_files(spark, a.path), "documents").where("error is not null").count()


if __name__ == "__main__":
    sys.exit(main())
