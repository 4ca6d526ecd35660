"""The engine's queries by name, each with the SQL that says what must come back.

Every query renders whole tables as PDF files and hands only the bytes to the engine.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.values import Name, Ref
from ..core.writer import Writer, literal, show_lines, text_string
from ..functions import geometry as G
from ..functions import text as T
from ..operators import lookups as L
from ..operators.relations import relation, relations
from .synth import grouped, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Rows = list[dict[str, Any]]


def query(sql: str | None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latin(s: str) -> bytes:
    return literal(s.encode("latin-1", "replace"))


# texts


def one_name_a_page(_: int, rows: Rows) -> bytes:
    w = Writer()
    fonts = {"Font": {"F1": w.core_font()}}
    for r in rows:
        w.page(show_lines([r["n_name"]]), fonts, n_key=r["n_nationkey"])
    return w.save()


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS page_idx, n_name AS text FROM nation")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    return relation(pdfs, "page_text").select("doc_id", "page_idx", "text")


def turns(_: int, rows: Rows) -> bytes:
    w = Writer()
    fonts = {"Font": {"F1": w.core_font("Courier")}}
    for r in rows:
        t = r["text"]
        w.page(show_lines([t[k : k + 80] for k in range(0, len(t), 80)], size=6, leading=7), fonts, compress=True)
    return w.save()


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~\u00a1-\u00ff]', '', 'g') AS s FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, s) - 1 AS INTEGER) AS page_idx, md5(s) AS digest, CAST(length(s) AS BIGINT) AS n_chars,
CAST(ceil(length(s) / 80.0) AS INTEGER) AS n_lines FROM t"""
)
def text_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", "[^ -~\u00a1-\u00ff]", ""))
    pdfs = render(grouped(rows, "conv_id", "turn", "text"), turns)
    whole = F.replace("text", F.lit("\n"), F.lit(""))
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n")))
    return relation(pdfs, "page_text").select("doc_id", "page_idx", F.md5(whole).alias("digest"), F.length(whole).cast("bigint").alias("n_chars"), lines.cast("int").alias("n_lines"))


def courier_names(_: int, rows: Rows) -> bytes:
    w = Writer()
    fonts = {"Font": {"F1": w.core_font("Courier")}}
    for r in rows:
        w.page(b"BT /F1 12 Tf 72 700 Td " + latin(r["p_name"]) + b" Tj ET", fonts)
    return w.save()


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS part, CAST(i AS INTEGER) AS glyph_idx, substr(p_name, CAST(i + 1 AS INTEGER), 1) AS text, round(72 + CAST(7.2 AS DOUBLE) * i, 4) AS x0, round(72 + CAST(7.2 AS DOUBLE) * (i + 1), 4) AS x1
FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS i FROM part)"""
)
def glyph_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    pdfs = render(grouped(rows, F.floor(F.col("p_partkey") / 100), "p_partkey", "p_name"), courier_names)
    g = relation(pdfs, "glyphs", space="default")
    return g.select((F.col("doc_id") * 100 + F.col("page_idx")).alias("part"), "glyph_idx", "text", F.round("bbox.x0", 4).alias("x0"), F.round("bbox.x1", 4).alias("x1"))


def spaced(_: int, rows: Rows) -> bytes:
    w = Writer()
    fonts = {"Font": {"F1": w.core_font("Courier")}}
    for r in rows:
        k = r["s_nationkey"]
        w.page(f"BT {k / 10:g} Tc {k % 7} Tw {80 + k} Tz /F1 10 Tf 50 600 Td ".encode() + latin(r["s_name"] + " x y") + b" Tj ET", fonts)
    return w.save()


@query(
    """SELECT CAST(s_suppkey AS BIGINT) AS supplier, round((n * (6 + s_nationkey / 10.0) + (len(string_split(s, ' ')) - 1) * (s_nationkey % 7)) * (80 + s_nationkey) / 100.0, 4) AS width, CAST(n AS INTEGER) AS n_glyphs
FROM (SELECT s_suppkey, s_nationkey, s_name || ' x y' AS s, length(s_name || ' x y') AS n FROM supplier)"""
)
def glyph_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "supplier"), F.floor(F.col("s_suppkey") / 50), "s_suppkey", "s_nationkey", "s_name"), spaced)
    t = relation(pdfs, "content_objects", space="default", kinds=["text"])
    return t.select((F.col("doc_id") * 50 + F.col("page_idx")).alias("supplier"), F.round("displacement.x", 4).alias("width"), "n_glyphs")


# paths, states, forms, images


def rectangles(_: int, rows: Rows) -> bytes:
    w = Writer()
    body = [b"q 2 0 0 2 10 20 cm"]
    body += [f"{r['l_linenumber'] * 10} {r['l_discount'] * 100:g} {r['l_quantity']:g} {r['l_tax'] * 100:g} re {'S' if r['l_returnflag'] == 'R' else 'f'}".encode() for r in rows]
    w.page(b"\n".join([*body, b"Q"]), compress=True)
    return w.save()


@query(
    """SELECT CAST(l_suppkey AS BIGINT) AS doc_id, l_returnflag = 'R' AS stroke, CAST(count(*) AS BIGINT) AS n, round(sum(2 * l_quantity * 2 * round(l_tax * 100, 4)), 2) AS area,
CAST(min(10 + 20 * l_linenumber) AS DOUBLE) AS x0, round(min(20 + 2 * round(l_discount * 100, 4)), 4) AS y0,
round(max(10 + 2 * (10 * l_linenumber + l_quantity)), 4) AS x1, round(max(20 + 2 * (round(l_discount * 100, 4) + round(l_tax * 100, 4))), 4) AS y1 FROM lineitem GROUP BY ALL"""
)
def path_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_discount", "l_quantity", "l_tax", "l_returnflag"), rectangles)
    p = relation(pdfs, "content_objects", space="default", kinds=["path"], columns=["bbox", "stroke"])
    box = G.union_boxes(F.col("bbox"))
    out = p.groupBy("doc_id", "stroke").agg(F.count("*").alias("n"), F.round(F.sum(G.width(F.col("bbox")) * G.height(F.col("bbox"))), 2).alias("area"), box.alias("b"))
    return out.select("doc_id", "stroke", "n", "area", *(F.round(f"b.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


def turned_pages(_: int, rows: Rows) -> bytes:
    w = Writer()
    for r in rows:
        k = r["n_nationkey"]
        for rotate in (0, 90, 180, 270):
            w.page(b"", MediaBox=[k, 2 * k, 400 + k, 600 + 2 * k], Rotate=rotate)
    return w.save()


@query(
    """WITH p AS (SELECT n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nth, n_regionkey, r FROM nation, (VALUES (0), (90), (180), (270)) v(r)),
m AS (SELECT *, CASE r WHEN 90 THEN [0,-1,1,0,0,400] WHEN 180 THEN [-1,0,0,-1,400,600] WHEN 270 THEN [0,1,-1,0,600,0] ELSE [1,0,0,1,0,0] END AS m FROM p),
b AS (SELECT *, least(m[1]*k+m[3]*2*k, m[1]*(400+k)+m[3]*(600+2*k)) + m[5] AS bx0, least(m[2]*k+m[4]*2*k, m[2]*(400+k)+m[4]*(600+2*k)) + m[6] AS by0,
greatest(m[2]*k+m[4]*2*k, m[2]*(400+k)+m[4]*(600+2*k)) + m[6] AS by1 FROM m)
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY k, r) - 1) AS INTEGER) AS page_idx, CAST(r AS INTEGER) AS rotate,
CAST(m[1] AS DOUBLE) AS a, CAST(-m[2] AS DOUBLE) AS b, CAST(m[5] - bx0 AS DOUBLE) AS e, CAST(by1 - m[6] AS DOUBLE) AS f, CAST(m[6] - by0 AS DOUBLE) AS page_f FROM b"""
)
def page_rotation_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), turned_pages)
    p = relation(pdfs, "pages")
    screen, page = G.initial_matrix(F.col("mediabox"), F.col("rotate"), "screen"), G.initial_matrix(F.col("mediabox"), F.col("rotate"), "page")
    return p.select("doc_id", "page_idx", "rotate", *((screen.getField(c) + 0.0).alias(c) for c in "abef"), (page.getField("f") + 0.0).alias("page_f"))


def states(_: int, rows: Rows) -> bytes:
    w = Writer()
    body = []
    for r in rows:
        k = r["p_size"]
        body.append(f"q {k} w {k % 3} J [{k} 2] 1 d {k / 100:g} 0 1 rg q 9 w 0 g Q 0 0 {r['p_partkey'] + 1} 1 re B Q 0 0 1 1 re f".encode())
    w.page(b"\n".join(body), compress=True)
    return w.save()


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS part, CAST(p_size AS DOUBLE) AS linewidth, CAST(p_size % 3 AS INTEGER) AS linecap, CAST(p_size AS DOUBLE) AS dash, round(p_size / 100.0, 4) AS red, 'DeviceRGB' AS space FROM part"""
)
def graphics_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 200), "p_partkey", "p_size"), states)
    p = relation(pdfs, "content_objects", space="default", kinds=["path"]).where("stroke")
    g = F.col("gstate")
    return p.select((F.round("bbox.x1").cast("bigint") - 1).alias("part"), g.linewidth.alias("linewidth"), g.linecap.alias("linecap"), g.dash[0].alias("dash"), F.round(g.ncolor.values[0], 4).alias("red"), g.ncolor.space.alias("space"))


def nested_forms(_: int, rows: Rows) -> bytes:
    w = Writer()
    font = w.core_font()
    forms = {}
    for k, r in enumerate(rows):
        inner = w.stream(b"BT /F1 8 Tf 0 0 Td " + latin(str(r["s_suppkey"])) + b" Tj ET", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 50, 10], Resources={"Font": {"F1": font}})
        outer = w.stream(b"BT /F1 8 Tf 0 0 Td " + latin(r["s_name"]) + b" Tj ET q 1 0 0 1 5 5 cm /I Do Q", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 50, 10], Resources={"Font": {"F1": font}, "XObject": {"I": inner}})
        forms[f"X{k}"] = outer
    w.page(b" ".join(f"/X{k} Do".encode() for k in range(len(rows))), {"XObject": forms, "Font": {"F1": font}}, compress=True)
    return w.save()


@query(
    """SELECT CAST(s_nationkey AS BIGINT) AS doc_id, CAST(d AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS n, string_agg(CASE d WHEN 1 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END, ',' ORDER BY s_suppkey) AS texts
FROM supplier, (VALUES (1), (2)) v(d) GROUP BY s_nationkey, d"""
)
def form_xobject_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name"), nested_forms)
    t = relation(pdfs, "content_objects", kinds=["text"])
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "chars"))), lambda s: s.getField("chars")), ",")
    return t.groupBy("doc_id", F.size("xobj_path").alias("depth")).agg(F.count("*").alias("n"), said.alias("texts"))


def cyclic(_: int, rows: Rows) -> bytes:
    """A form that invokes itself, a page tree with a loop, and a page for each row."""
    w = Writer()
    form = w.stream(b"BT /F1 8 Tf (x) Tj ET /Me Do", Subtype=Name("Form"), BBox=[0, 0, 9, 9])
    w.objects[form.objid].attrs["Resources"] = {"XObject": {"Me": form}, "Font": {"F1": w.core_font()}}
    for _r in rows:
        w.page(b"/Me Do", {"XObject": {"Me": form}})
    w.tree |= {"Kids": [*w.pages, w.tree_ref, w.pages[0]], "Count": len(w.pages) + 2}
    return w.save()


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(count(*) AS BIGINT) AS n_pages, CAST(count(*) AS BIGINT) AS n_texts FROM nation GROUP BY 1")
def dedupe_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), cyclic)
    t = relation(pdfs, "content_objects", kinds=["text"])
    return t.groupBy("doc_id").agg(F.countDistinct("page_idx").alias("n_pages"), F.count("*").alias("n_texts"))


def picture_book(_: int, rows: Rows) -> bytes:
    w = Writer()
    for r in rows:
        n = r["p_size"]
        im = w.stream(bytes((n + k) % 256 for k in range(n * 3)), True, Subtype=Name("Image"), Width=n, Height=1, BitsPerComponent=8, ColorSpace=Name("DeviceRGB"))
        inline = f" BI /W {n} /H 1 /BPC 1 /CS /G ID ".encode() + bytes(-(-n // 8)) + b" EI"
        w.page(f"q {n} 0 0 5 10 10 cm /Im Do Q".encode() + inline, {"XObject": {"Im": im}})
    return w.save()


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS part, name, CAST(p_size AS INTEGER) AS width, CAST(CASE name WHEN 'Im' THEN 8 ELSE 1 END AS INTEGER) AS bits, CASE name WHEN 'Im' THEN '.ppm' ELSE '.pbm' END AS suffix,
CAST(CASE name WHEN 'Im' THEN 9 + length(CAST(p_size AS VARCHAR)) + 1 + 3 * p_size ELSE 6 + length(CAST(p_size AS VARCHAR)) + ceil(p_size / 8.0) END AS BIGINT) AS n_bytes, CAST(CASE name WHEN 'Im' THEN 10 + p_size ELSE 1 END AS DOUBLE) AS x1
FROM part, (VALUES ('Im'), ('inline')) v(name)"""
)
def image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 100), "p_partkey", "p_size"), picture_book)
    i = relation(pdfs, "images", space="default")
    return i.select((F.col("doc_id") * 100 + F.col("page_idx")).alias("part"), F.coalesce("name", F.lit("inline")).alias("name"), "width", "bits", "suffix", F.length("bytes").cast("bigint").alias("n_bytes"), F.round("bbox.x1", 4).alias("x1"))


# marked content and structure


def marked_orders(_: int, rows: Rows) -> bytes:
    w = Writer()
    body = [b"BT /F1 8 Tf 10 TL 20 700 Td"]
    for k, r in enumerate(rows):
        said = f"{r['o_orderkey']} "
        body.append(b"/P <</MCID %d>> BDC " % k + latin(said) + b" Tj " + latin(r["o_orderpriority"]) + b" Tj EMC T*")
    body.append(b"/Artifact BMC (footer) Tj EMC ET")
    w.page(b"\n".join(body), {"Font": {"F1": w.core_font()}}, compress=True, StructParents=0)
    w.catalog["MarkInfo"] = {"Marked": True}
    return w.save()


_ORDER_TEXT = "CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority"


@query(f"SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderpriority) - 1 AS INTEGER) AS mcid, {_ORDER_TEXT} AS text, CAST(2 AS BIGINT) AS n_items FROM orders")
def marked_content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority"), marked_orders)
    return L.marked_content(relation(pdfs, "content_objects", kinds=["text"], columns=[c for c in L.SECTION_COLUMNS if c != "bbox"])).select("doc_id", "mcid", "text", "n_items")


@query(f"SELECT CAST(o_custkey AS BIGINT) AS doc_id, string_agg({_ORDER_TEXT}, chr(10) ORDER BY o_orderkey, o_orderpriority) AS text FROM orders GROUP BY 1")
def text_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority"), marked_orders)
    return relation(pdfs, "page_text").select("doc_id", "text")


def structured(_: int, rows: Rows) -> bytes:
    """Document / Nation (a Sect by the role map) / P for each supplier, one page for each nation."""
    w = Writer()
    font = w.core_font()
    root: dict[str, Any] = {"Type": Name("StructTreeRoot"), "RoleMap": {"Nation": Name("Sect")}}
    top: dict[str, Any] = {"Type": Name("StructElem"), "S": Name("Document")}
    root_ref, top_ref = w.add(root), w.add(top)
    root["K"], top["P"], top["K"] = top_ref, root_ref, []
    w.catalog |= {"StructTreeRoot": root_ref, "MarkInfo": {"Marked": True}}
    nums: list[Any] = []
    by: dict[str, Rows] = {}
    for r in rows:
        by.setdefault(r["n_name"], []).append(r)
    for key, (nation, own) in enumerate(by.items()):
        body = b"BT /F1 9 Tf 11 TL 30 700 Td " + b" ".join(b"/P <</MCID %d>> BDC " % k + latin(r["s_name"]) + b" Tj EMC T*" for k, r in enumerate(own)) + b" ET"
        page = w.page(body, {"Font": {"F1": font}}, True, StructParents=key)
        sect: dict[str, Any] = {"Type": Name("StructElem"), "S": Name("Nation"), "P": top_ref, "Pg": page, "T": text_string(nation)}
        sect_ref = w.add(sect)
        sect["K"] = [w.add({"Type": Name("StructElem"), "S": Name("P"), "P": sect_ref, "Pg": page, "K": k, "Alt": text_string(str(r["s_suppkey"]))}) for k, r in enumerate(own)]
        top["K"].append(sect_ref)
        nums += [key, list(sect["K"])]
    root["ParentTree"] = {"Nums": nums}
    return w.save()


def supplier_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return render(grouped(rows, "n_regionkey", "n_nationkey", "n_name", "s_suppkey", "s_name"), structured)


_BY_NATION = "supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'Sect' AS role, n_name AS title, string_agg(s_name, '' ORDER BY s_suppkey) AS text, CAST(1 AS INTEGER) AS depth FROM {_BY_NATION} GROUP BY n_regionkey, n_name")
def struct_find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = supplier_trees(spark, sf_dir)
    read = relations(pdfs, {"struct_nodes": {}, "content_objects": {"kinds": ["text"], "columns": L.SECTION_COLUMNS}})
    nodes, sections = read["struct_nodes"], L.marked_content(read["content_objects"])
    found = L.find_elements(nodes, pattern="Sec")
    return found.join(L.element_text(nodes, sections).select("doc_id", "node_id", "text"), ["doc_id", "node_id"]).select("doc_id", "role", "title", "text", "depth")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(s_suppkey AS VARCHAR) AS supplier, n_name AS nation FROM {_BY_NATION}")
def struct_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = relation(supplier_trees(spark, sf_dir), "struct_nodes")
    start = nodes.where("role = 'P'").select("doc_id", F.col("node_id").alias("start_id"))
    up = L.climb(nodes, start, "Sect")
    leaf = nodes.select("doc_id", F.col("node_id").alias("start_id"), F.col("alt").alias("supplier"))
    sect = nodes.select("doc_id", "node_id", F.col("title").alias("nation"))
    return up.join(leaf, ["doc_id", "start_id"]).join(sect, ["doc_id", "node_id"]).select("doc_id", "supplier", "nation")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, s_name AS chars, CAST(s_suppkey AS VARCHAR) AS supplier FROM {_BY_NATION}")
def content_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = supplier_trees(spark, sf_dir)
    items = L.content_elements(relation(pdfs, "content_objects", kinds=["text"], columns=["mcid", "parent_key", "own_key", "chars"]), relation(pdfs, "parent_tree"))
    elements = relation(pdfs, "struct_nodes").where("kind = 'element'").select("doc_id", F.col("objid").alias("element_objid"), F.col("alt").alias("supplier"))
    return items.select("doc_id", "element_objid", "chars").join(elements, ["doc_id", "element_objid"]).select("doc_id", "chars", "supplier")


def with_forms(_: int, rows: Rows) -> bytes:
    """A page whose forms number their sections from 0 again, and an image with an entry of its own in the parent tree."""
    w = Writer()
    fonts = {"Font": {"F1": w.core_font()}}
    root: dict[str, Any] = {"Type": Name("StructTreeRoot")}
    top: dict[str, Any] = {"Type": Name("StructElem"), "S": Name("Document")}
    root_ref, top_ref = w.add(root), w.add(top)
    root["K"], top["P"], top["K"] = top_ref, root_ref, []
    w.catalog |= {"StructTreeRoot": root_ref, "MarkInfo": {"Marked": True}}
    nums: list[Any] = []

    def element(kind: str, page: Ref, kid: Any, **more: Any) -> Ref:
        ref = w.add({"Type": Name("StructElem"), "S": Name(kind), "P": top_ref, "Pg": page, "K": kid, **more})
        top["K"].append(ref)
        return ref

    for r in rows:
        key = len(nums) // 2
        said = [r["c_mktsegment"], f"{r['c_acctbal']:.2f}"]
        forms = [
            w.stream(b"BT /F1 9 Tf 1 0 0 1 %d 500 Tm /P <</MCID 0>> BDC " % (40 + 200 * k) + latin(t) + b" Tj EMC ET", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 600, 800], Resources=fonts, StructParents=key + 1 + k)
            for k, t in enumerate(said)
        ]
        image = w.stream(b"\x80", Type=Name("XObject"), Subtype=Name("Image"), Width=1, Height=1, BitsPerComponent=8, ColorSpace=Name("DeviceGray"), StructParent=key + 3)
        body = b"BT /F1 9 Tf 1 0 0 1 40 700 Tm /P <</MCID 0>> BDC " + latin(r["c_name"]) + b" Tj EMC ET /A Do /B Do q 9 0 0 9 40 600 cm /I Do Q"
        page = w.page(body, fonts | {"XObject": {"A": forms[0], "B": forms[1], "I": image}}, True, StructParents=key)
        nums += [key, [element("P", page, 0, T=text_string("page"))]]
        nums += [x for k, f in enumerate(forms) for x in (key + 1 + k, [element("P", page, {"Type": Name("MCR"), "Stm": f, "Pg": page, "MCID": 0}, T=text_string(f"form {k}"))])]
        nums += [key + 3, element("Figure", page, {"Type": Name("OBJR"), "Obj": image, "Pg": page}, Alt=text_string(str(r["c_custkey"])), T=text_string("image"))]
    root["ParentTree"] = {"Nums": nums}
    return w.save()


@query(
    """SELECT CAST(c_nationkey AS BIGINT) AS doc_id, title, said, CAST(row_number() OVER (PARTITION BY c_nationkey, title ORDER BY c_custkey) - 1 AS INTEGER) AS page_idx,
title AS parent FROM customer, LATERAL (VALUES ('page', c_name), ('form 0', c_mktsegment), ('form 1', printf('%.2f', c_acctbal)), ('image', CAST(c_custkey AS VARCHAR))) v(title, said)"""
)
def struct_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every element by its stream, and of every text and image the element it belongs to."""
    pdfs = render(grouped(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name", "c_mktsegment", "c_acctbal"), with_forms)
    read = relations(pdfs, {"struct_nodes": {}, "content_objects": {"kinds": ["text", "image"], "columns": [*L.SECTION_COLUMNS, "parent_key", "own_key"]}, "parent_tree": {}})
    nodes, items = read["struct_nodes"].where("kind = 'element' and role <> 'Document' or kind = 'item'"), read["content_objects"]
    own = L.element_text(nodes, L.marked_content(items.where("object_type = 'text'"))).select("doc_id", "node_id", "text")
    elements = nodes.where("kind = 'element'").select("doc_id", "node_id", "page_idx", "title", "alt", F.col("objid").alias("element_objid"))
    up = L.content_elements(items, read["parent_tree"]).select("doc_id", "chars", "element_objid")
    at = up.join(elements, ["doc_id", "element_objid"]).select("doc_id", "node_id", F.coalesce("chars", "alt").alias("seen"), F.col("title").alias("parent"))
    out = elements.join(own, ["doc_id", "node_id"]).select("doc_id", "node_id", "title", "page_idx", F.when(F.col("title") == "image", F.col("alt")).otherwise(F.col("text")).alias("said"))
    return out.join(at, ["doc_id", "node_id"]).where("seen = said").select("doc_id", "title", "said", "page_idx", "parent")


# outlines, destinations, annotations, labels


def with_outline(_: int, rows: Rows) -> bytes:
    w = Writer()
    top: dict[str, Any] = {"Type": Name("Outlines")}
    w.catalog["Outlines"] = w.add(top)
    by: dict[str, Rows] = {}
    for r in rows:
        by.setdefault(r["n_name"], []).append(r)

    def chain(parent: dict[str, Any], parent_ref: Ref, items: list[dict[str, Any]]) -> list[Ref]:
        refs = [w.add(x | {"Parent": parent_ref}) for x in items]
        for a, b in zip(refs, refs[1:], strict=False):
            w.objects[a.objid]["Next"] = b
            w.objects[b.objid]["Prev"] = a
        if refs:
            parent |= {"First": refs[0], "Last": refs[-1]}
        return refs

    pages = [w.page(b"") for _ in by]
    nations = chain(top, w.catalog["Outlines"], [{"Title": text_string(n), "Dest": [p, Name("XYZ"), 10, 500 + k, None]} for k, (n, p) in enumerate(zip(by, pages, strict=True))])
    for ref, page, own in zip(nations, pages, by.values(), strict=True):
        chain(w.objects[ref.objid], ref, [{"Title": text_string(r["s_name"]), "A": {"S": Name("GoTo"), "D": [page, Name("Fit")]}} for r in own])
    return w.save(xref="stream")


@query(
    f"""WITH n AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS p FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 0 AS depth, n_name AS title, CAST(p AS INTEGER) AS dest_page_idx, 'XYZ' AS display, CAST(500 + p AS DOUBLE) AS top FROM n
UNION ALL SELECT CAST(n.n_regionkey AS BIGINT), 1, s_name, CAST(p AS INTEGER), 'Fit', CAST(792 AS DOUBLE) FROM supplier JOIN n ON s_nationkey = n.n_nationkey"""
)
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pdfs = render(grouped(rows, "n_regionkey", "n_nationkey", "n_name", "s_suppkey", "s_name"), with_outline)
    return relation(pdfs, "outline_items").select("doc_id", "depth", "title", "dest_page_idx", "display", "top")


def with_names(_: int, rows: Rows) -> bytes:
    """Two name tree leaves under a root; links to each name on the first page; URIs too."""
    w = Writer()
    font = {"Font": {"F1": w.core_font("Courier")}}
    pages = [w.page(b"BT /F1 10 Tf 100 %d Td " % (50 + k) + latin(r["n_name"]) + b" Tj ET", font) for k, r in enumerate(rows)]
    leaves = []
    pairs = sorted((text_string(r["n_name"]), p) for r, p in zip(rows, pages, strict=True))
    for half in (pairs[: len(pairs) // 2], pairs[len(pairs) // 2 :]):
        if half:
            flat = [x for name, p in half for x in (name, [p, Name("FitH"), 333])]
            leaves.append(w.add({"Names": flat, "Limits": [half[0][0], half[-1][0]]}))
    w.catalog["Names"] = {"Dests": w.add({"Kids": leaves})}
    first = w.objects[pages[0].objid]
    first["Annots"] = [w.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, k, 10, k + 1], "Dest": text_string(r["n_name"])}) for k, r in enumerate(rows)]
    for k, (r, p) in enumerate(zip(rows, pages, strict=True)):
        page = w.objects[p.objid]
        page.setdefault("Annots", []).append(w.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [100, 50 + k, 112, 55 + k], "A": {"S": Name("URI"), "URI": b"http://x/%d" % r["n_nationkey"]}, "Contents": text_string("go")}))
    return w.save()


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), with_names)


_NTH = "CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER)"


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_name AS name, {_NTH} AS page_idx, 'FitH' AS display, CAST(333 AS DOUBLE) AS top FROM nation")
def named_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = nation_links(spark, sf_dir)
    links = relation(pdfs, "annotations").where("dest_name is not null").select("doc_id", "dest_name")
    return L.named_targets(links, relation(pdfs, "destinations")).select("doc_id", F.col("dest_name").alias("name"), "target.page_idx", "target.display", "target.top")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, '1' AS source, CAST({_NTH} + 1 AS VARCHAR) AS target, CAST(1 AS BIGINT) AS links FROM nation")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = nation_links(spark, sf_dir)
    return L.link_graph(relation(pdfs, "annotations"), relation(pdfs, "pages"))


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'http://x/' || n_nationkey AS uri, n_name AS text, {_NTH} AS page_idx FROM nation")
def link_anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = nation_links(spark, sf_dir)
    found = L.link_texts(relation(pdfs, "annotations"), relation(pdfs, "content_objects", space="default", kinds=["text"]))
    return found.select("doc_id", "uri", "text", "page_idx")


def url_pages(_: int, rows: Rows) -> bytes:
    w = Writer()
    for r in rows:
        w.page(b"", Annots=[{"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [9, 9, 1, 1], "A": {"S": Name("URI"), "URI": text_string(r["url"])}}, {"Subtype": Name("Bad")}])
    return w.save(xref="objects")


@query("SELECT CAST(page_id AS BIGINT) AS page_id, url AS uri, CAST(1 AS DOUBLE) AS x0, CAST(9 AS DOUBLE) AS x1 FROM pages")
def annotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "pages"), F.floor(F.col("page_id") / 100), "page_id", "url"), url_pages)
    a = relation(pdfs, "annotations")
    return a.select((F.col("doc_id") * 100 + F.col("page_idx")).alias("page_id"), "uri", F.col("rect.x0").alias("x0"), F.col("rect.x1").alias("x1"))


_ROMAN_SQL = (
    "list_extract(['','m','mm','mmm'], CAST(n // 1000 % 10 + 1 AS INTEGER)) || list_extract(['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'], CAST(n // 100 % 10 + 1 AS INTEGER)) || "
    "list_extract(['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'], CAST(n // 10 % 10 + 1 AS INTEGER)) || list_extract(['','i','ii','iii','iv','v','vi','vii','viii','ix'], CAST(n % 10 + 1 AS INTEGER))"
)
_ALPHA_SQL = "CASE WHEN n > 18278 THEN chr(CAST(97 + (n - 18279) // 17576 AS INTEGER)) ELSE '' END || CASE WHEN n > 702 THEN chr(CAST(97 + (n - 703) // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(97 + (n - 27) // 26 % 26 AS INTEGER)) ELSE '' END || chr(CAST(97 + (n - 1) % 26 AS INTEGER))"


def labelled(doc_id: int, rows: Rows) -> bytes:
    """Pages i.. in Roman, then decimals from 5 with a prefix, then letters."""
    w = Writer()
    for _r in rows:
        w.page(b"")
    n = len(rows)
    w.catalog["PageLabels"] = {"Nums": [0, {"S": Name("r")}, n // 3, {"S": Name("D"), "P": b"p-", "St": 5}, 2 * n // 3, {"S": Name("A")}]}
    return w.save()


@query(
    f"""WITH c AS (SELECT c_nationkey AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS k FROM customer),
s AS (SELECT *, CASE WHEN i >= 2 * k // 3 THEN 2 WHEN i >= k // 3 THEN 1 ELSE 0 END AS part, CASE WHEN i >= 2 * k // 3 THEN i - 2 * k // 3 + 1 WHEN i >= k // 3 THEN i - k // 3 + 5 ELSE i + 1 END AS n FROM c)
SELECT CAST(d AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS page_idx, CASE part WHEN 0 THEN {_ROMAN_SQL} WHEN 1 THEN 'p-' || n ELSE upper({_ALPHA_SQL}) END AS label FROM s"""
)
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey"), labelled)
    return L.page_labels(relation(pdfs, "pages"), relation(pdfs, "label_ranges"))


@query(f"SELECT CAST(n AS BIGINT) AS n, CASE WHEN n < 4000 THEN {_ROMAN_SQL} END AS roman, {_ALPHA_SQL} AS alpha FROM (SELECT c_custkey + 1 AS n FROM customer)")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("bigint").alias("n"))
    return n.select("n", T.roman(F.col("n")).alias("roman"), T.letters(F.col("n")).alias("alpha"))


def same_labels(_: int, rows: Rows) -> bytes:
    w = Writer()
    for _r in rows:
        w.page(b"")
    w.catalog["PageLabels"] = {"Nums": [x for k, r in enumerate(rows) for x in (k, {"P": text_string(r["c_mktsegment"])})]}
    return w.save()


@query(
    """WITH c AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_mktsegment AS label, CAST(min(i) AS INTEGER) AS page_idx FROM c GROUP BY ALL"""
)
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_mktsegment"), same_labels)
    return L.page_by_label(relation(pdfs, "pages")).select("doc_id", "label", "page_idx")


@query("WITH c AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer) SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS page_idx FROM c WHERE i = 0 OR i BETWEEN 3 AND 9")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_mktsegment"), same_labels)
    return L.select_pages(relation(pdfs, "pages"), "1,10-4").select("doc_id", "page_idx")


# files: cross references, revisions, object streams, filters, encryption


def inherited(_: int, rows: Rows) -> bytes:
    w = Writer()
    kids = []
    for r in rows:
        k = r["n_nationkey"]
        node: dict[str, Any] = {"Type": Name("Pages"), "Parent": w.tree_ref, "MediaBox": [0, 0, 100 + k, 200]} | ({"Rotate": 90} if k % 2 else {})
        ref = w.add(node)
        own = [w.page(b"", parent=ref), w.page(b"", parent=ref, MediaBox=[0, 0, 50, 50])]
        node |= {"Kids": own, "Count": 2}
        kids.append(ref)
    w.tree |= {"Kids": kids, "Count": 2 * len(kids), "CropBox": [1, 1, 40, 40]}
    return w.save()


@query(
    """WITH o AS (SELECT n_regionkey, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nth FROM nation),
p AS (SELECT n_regionkey, k, 2 * nth + j AS i, j FROM o, (VALUES (0), (1)) v(j))
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS page_idx, CAST(CASE j WHEN 0 THEN 100 + k ELSE 50 END AS DOUBLE) AS width, CAST(CASE k % 2 WHEN 1 THEN 90 ELSE 0 END AS INTEGER) AS rotate, CAST(40 AS DOUBLE) AS crop FROM p"""
)
def page_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), inherited)
    return relation(pdfs, "pages").select("doc_id", "page_idx", G.width(F.col("mediabox")).alias("width"), "rotate", F.col("cropbox.x1").alias("crop"))


def revised(doc_id: int, rows: Rows) -> bytes:
    """One object that each order replaces; damaged files for every third document."""
    w = Writer()
    w.page(b"")
    ref = w.add({"Order": -1})
    return w.save(revisions=[{ref.objid: {"Order": r["o_orderkey"], "Total": f"{r['o_totalprice']:.2f}".encode()}} for r in rows], damaged=doc_id % 3 == 0)


@query("SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(arg_max(o_orderkey, (o_orderkey, o_totalprice)) AS BIGINT) AS last_order, CAST(count(*) + 1 AS BIGINT) AS revisions FROM orders GROUP BY 1")
def xref_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice"), revised)
    read = relations(pdfs, {"xref_entries": {}, "objects": {"key": "Order", "columns": ["objid", "pos", "obj"]}})
    entries = L.latest_objects(read["xref_entries"]).select("doc_id", "objid", "pos")
    objects = read["objects"].select("doc_id", "objid", "pos", F.get_json_object("obj", "$.Order").cast("bigint").alias("last_order"))
    counts = objects.groupBy("doc_id").agg(F.count("*").alias("revisions"))
    return objects.join(entries, ["doc_id", "objid", "pos"]).join(counts, "doc_id").select("doc_id", "last_order", "revisions")


def packed(_: int, rows: Rows) -> bytes:
    w = Writer()
    w.page(b"")
    for r in rows:
        w.add({"Part": r["p_partkey"], "Name": text_string(r["p_name"]), "Price": r["p_retailprice"]})
    return w.save(xref="objects")


@query("SELECT CAST(p_partkey AS BIGINT) AS part, p_name AS name, round(p_retailprice, 2) AS price FROM part")
def object_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 500), "p_partkey", "p_name", "p_retailprice"), packed)
    o = relation(pdfs, "objects").where("container_id is not null and obj like '%\"Part\"%'")
    return o.select(F.get_json_object("obj", "$.Part").cast("bigint").alias("part"), F.get_json_object("obj", "$.Name").alias("name"), F.round(F.get_json_object("obj", "$.Price").cast("double"), 2).alias("price"))


def encoded_texts(_: int, rows: Rows) -> bytes:
    import base64
    import zlib

    w = Writer()
    for r in rows:
        raw = r["text"].encode()
        hexed = raw.hex().encode() + b">"
        w.stream(hexed, Filter=Name("ASCIIHexDecode"), Item=r["item_id"])
        w.stream(base64.a85encode(zlib.compress(raw)) + b"~>", Filter=[Name("A85"), Name("Fl")], Item=r["item_id"])
        runs = b"".join(bytes([len(raw[k : k + 128]) - 1]) + raw[k : k + 128] for k in range(0, len(raw), 128)) + b"\x80"
        w.stream(runs, Filter=Name("RunLengthDecode"), Item=r["item_id"])
        size = 16
        padded = raw + b" " * (-len(raw) % size)
        lines = [padded[k : k + size] for k in range(0, len(padded), size)]
        up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(line, above, strict=True)) for line, above in zip(lines, [bytes(size), *lines], strict=False))
        w.stream(zlib.compress(up), Filter=Name("FlateDecode"), DecodeParms={"Predictor": 12, "Columns": size}, Item=r["item_id"])
        left = b"".join(bytes([line[0]]) + bytes((x - y) & 255 for x, y in zip(line[1:], line, strict=False)) for line in lines)
        w.stream(zlib.compress(left), Filter=Name("FlateDecode"), DecodeParms={"Predictor": 2, "Columns": size}, Item=r["item_id"])
        w.stream(lzw_literals(raw), Filter=Name("LZWDecode"), Item=r["item_id"])
    return w.save()


def lzw_literals(raw: bytes) -> bytes:
    """LZW without matches: a clear code often enough that every code has nine bits."""
    codes = [256]
    for k, c in enumerate(raw):
        if k and k % 200 == 0:
            codes.append(256)
        codes.append(c)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@query("SELECT CAST(item_id AS BIGINT) AS item, md5(trim(text)) AS digest, CAST(6 AS BIGINT) AS chains FROM benchmark")
def codec_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "benchmark"), F.floor(F.col("item_id") / 20), "item_id", "text"), encoded_texts)
    o = relation(pdfs, "objects").where("kind = 'stream' and obj like '%\"Item\"%'")
    said = F.trim(F.decode("decoded", "UTF-8"))
    return o.select(F.get_json_object("obj", "$.Item").cast("bigint").alias("item"), F.md5(said.cast("binary")).alias("digest")).groupBy("item", "digest").agg(F.count("*").alias("chains"))


def lzw_codes(raw: bytes) -> bytes:
    """LZW with matches and codes of 9 to 12 bits, and a clear code when the table is full."""
    import numpy as np

    codes = [256]
    table: dict[int, int] = {}  # (code of the start, next byte) -> code
    size, at = 258, -1
    for c in raw:
        if at < 0:
            at = c
            continue
        key = at << 8 | c
        if (known := table.get(key)) is not None:
            at = known
            continue
        codes.append(at)
        table[key] = size
        size += 1
        if size == 4095:
            codes.append(256)
            table, size = {}, 258
        at = c
    if at >= 0:
        codes.append(at)
    codes.append(257)
    # every code but the first adds an entry, and 3,838 of them with the clear code fill a table
    entries = 258 + np.arange(len(codes) - 1) % 3838
    widths = np.concatenate([[9], 9 + (entries >= 512) + (entries >= 1024) + (entries >= 2048)])
    places = np.arange(11, -1, -1)
    bits = np.array(codes)[:, None] >> places & 1
    return np.packbits(bits[places < widths[:, None]].astype(np.uint8)).tobytes()


def run_lengths(raw: bytes) -> bytes:
    """Runs of three and more as repeats, the rest as copies."""
    import re

    out = bytearray()
    at = 0
    for m in [*re.finditer(rb"(?s)(.)\1{2,127}", raw), None]:
        stop = m.start() if m else len(raw)
        for k in range(at, stop, 128):
            piece = raw[k : min(k + 128, stop)]
            out += bytes([len(piece) - 1]) + piece
        if m:
            out += bytes([257 - len(m[0])]) + m[1]
            at = m.end()
    return bytes(out) + b"\x80"


def png_rows(raw: bytes, size: int) -> bytes:
    """Every kind of PNG prediction by turns: none, left, up, average, Paeth."""
    import numpy as np

    if not raw:
        return b""
    line = np.frombuffer(raw, np.uint8).reshape(-1, size).astype(np.int16)
    above = np.vstack([np.zeros((1, size), np.int16), line[:-1]])
    left, corner = (np.hstack([np.zeros((len(x), 1), np.int16), x[:, :-1]]) for x in (line, above))
    dl, du, dc = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
    paeth = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, above, corner))
    how = np.arange(len(line)) % 5
    guess = np.choose(how[:, None], [np.zeros_like(line), left, above, (left + above) // 2, paeth])
    return np.hstack([how[:, None], line - guess & 255]).astype(np.uint8).tobytes()


def filtered_documents(_: int, rows: Rows) -> bytes:
    """Each text four times, whole: LZW, run lengths within ASCII85, all PNG predictions, LZW within hexadecimal digits."""
    import base64
    import zlib

    w = Writer()
    for r in rows:
        raw = r["text"].encode()
        padded = raw + b" " * (-len(raw) % 64)
        packed = lzw_codes(raw)
        w.stream(packed, Filter=Name("LZWDecode"), Item=r["doc_id"])
        w.stream(base64.a85encode(run_lengths(raw)) + b"~>", Filter=[Name("ASCII85Decode"), Name("RunLengthDecode")], Item=r["doc_id"])
        w.stream(zlib.compress(png_rows(padded, 64)), Filter=Name("FlateDecode"), DecodeParms={"Predictor": 15, "Columns": 64}, Item=r["doc_id"])
        w.stream(packed.hex().encode() + b">", Filter=[Name("AHx"), Name("LZW")], Item=r["doc_id"])
    return w.save(xref="stream")


@query("SELECT CAST(doc_id AS BIGINT) AS item, md5(rtrim(text, ' ')) AS digest, CAST(4 * count(*) AS BIGINT) AS chains FROM documents GROUP BY doc_id, text")
def document_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "documents"), F.floor(F.col("doc_id") / 20), "doc_id", "text"), filtered_documents)
    o = relation(pdfs, "objects", key="Item", columns=["obj", "decoded"])
    said = F.rtrim(F.decode("decoded", "UTF-8"))
    return o.select(F.get_json_object("obj", "$.Item").cast("bigint").alias("item"), F.md5(said.cast("binary")).alias("digest")).groupBy("item", "digest").agg(F.count("*").alias("chains"))


def secured(w: Writer, seed: str) -> None:
    """AES-256 by revision 5, for the user's empty password."""
    from hashlib import md5, sha256

    from ..core.crypto import Aes

    key = sha256(b"key" + seed.encode()).digest()
    salts = [md5(f"{k}{seed}".encode()).digest()[:8] for k in range(4)]

    def entry(password: bytes, check: bytes, own: bytes, user: bytes = b"") -> tuple[bytes, bytes]:
        return sha256(password + check + user).digest() + check + own, Aes(sha256(password + own + user).digest()).cbc_encrypt(key, bytes(16))

    u, ue = entry(b"", salts[0], salts[1])
    o, oe = entry(b"owner", salts[2], salts[3], u)
    perms = Aes(key).encrypt((-44 & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + b"fill")
    crypt = {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}
    encrypt: dict[str, Any] = {"Filter": Name("Standard"), "V": 5, "R": 5, "O": o, "U": u, "OE": oe, "UE": ue, "Perms": perms, "P": -44, "Length": 256, "CF": {"StdCF": crypt}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    w.extra = {"Encrypt": w.add(encrypt), "ID": [salts[0], salts[0]], "_encrypt": encrypt}

    def cipher(objid: int, data: bytes) -> bytes:
        iv, pad = md5(f"{seed}/{objid}".encode()).digest(), 16 - len(data) % 16
        return iv + Aes(key).cbc_encrypt(data + bytes([pad]) * pad, iv)

    w.encrypt = cipher


def document_pages(doc_id: int, rows: Rows) -> bytes:
    """Whole texts on pages of a hundred lines: plain files, object streams, AES-256, and LZW content by turns."""
    w = Writer()
    fonts = {"Font": {"F1": w.core_font("Courier")}}
    for r in rows:
        lines = [line[k : k + 80] for line in r["text"].split("\n") for k in range(0, len(line), 80)]
        for k in range(0, len(lines), 100):
            body = show_lines(lines[k : k + 100], size=6, leading=7)
            if doc_id % 4 == 3:
                w.page(w.stream(lzw_codes(body), Filter=Name("LZWDecode")), fonts)
            else:
                w.page(body, fonts, compress=doc_id % 4 != 2)
    if doc_id % 4 == 2:
        secured(w, str(doc_id))
    return w.save(xref="objects" if doc_id % 4 == 1 else "table")


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(replace(text, chr(10), '')) AS digest, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS n_chars FROM documents")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document in all its languages, from the pages it was set on."""
    pdfs = render(grouped(table(spark, sf_dir, "documents"), "doc_id", "text"), document_pages)
    pages = relation(pdfs, "page_text").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "text"))).alias("p"))
    whole = F.replace(F.array_join(F.transform("p", lambda x: x.getField("text")), ""), F.lit("\n"), F.lit(""))
    return pages.select("doc_id", F.md5(whole.cast("binary")).alias("digest"), F.length(whole).cast("bigint").alias("n_chars"))


def number_tree(_: int, rows: Rows) -> bytes:
    w = Writer()
    w.page(b"")
    leaves = []
    for k in range(0, len(rows), 10):
        own = rows[k : k + 10]
        flat = [x for j, r in enumerate(own) for x in (k + j, {"P": text_string(str(r["o_orderkey"]))})]
        leaves.append(w.add({"Nums": flat, "Limits": [k, k + len(own) - 1]}))
    w.catalog["PageLabels"] = {"Kids": leaves}
    return w.save()


@query("SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def number_tree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), number_tree)
    return relation(pdfs, "label_ranges").select("doc_id", F.col("first_page").alias("key"), F.col("prefix").alias("value"))


def locked(doc_id: int, rows: Rows) -> bytes:
    """RC4 of 40 or 128 bits, or AES-128, by turns; the user's password is empty."""
    from hashlib import md5

    from ..core.crypto import PAD, Aes, rc4

    method = doc_id % 3
    w = Writer()
    font = w.core_font()
    for r in rows:
        w.page(show_lines([r["n_name"]]), {"Font": {"F1": font}}, n_title=text_string(r["n_name"]))
    file_id, p = md5(str(doc_id).encode()).digest(), -44
    size = 5 if method == 0 else 16
    owner = md5(b"own" + PAD[:29]).digest()
    for _ in range(0 if method == 0 else 50):
        owner = md5(owner).digest()
    o = PAD
    for i in range(1 if method == 0 else 20):
        o = rc4(bytes(x ^ i for x in owner[:size]), o)
    key = md5(PAD + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(0 if method == 0 else 50):
        key = md5(key[:size]).digest()
    key = key[:size]
    if method == 0:
        u = rc4(key, PAD)
    else:
        u = rc4(key, md5(PAD + file_id).digest())
        for i in range(1, 20):
            u = rc4(bytes(x ^ i for x in key), u)
        u += bytes(16)
    encrypt: dict[str, Any] = {"Filter": Name("Standard"), "V": (1, 2, 4)[method], "R": (2, 3, 4)[method], "O": o, "U": u, "P": p, "Length": size * 8}
    if method == 2:
        encrypt |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "AuthEvent": Name("DocOpen"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    ref = w.add(encrypt)
    w.extra = {"Encrypt": ref, "ID": [file_id, file_id], "_encrypt": encrypt}

    def cipher(objid: int, data: bytes) -> bytes:
        own = md5(key + objid.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if method == 2 else b"")).digest()[: min(size + 5, 16)]
        if method < 2:
            return rc4(own, data)
        pad = 16 - len(data) % 16
        iv = md5(own).digest()
        return iv + Aes(own).cbc_encrypt(data + bytes([pad]) * pad, iv)

    w.encrypt = cipher
    return w.save()


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, {_NTH} AS page_idx, n_name AS text, true AS is_encrypted, true AS is_printable, false AS is_modifiable FROM nation")
def encrypted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), locked)
    docs = relation(pdfs, "documents").select("doc_id", "is_encrypted", "is_printable", "is_modifiable")
    return relation(pdfs, "page_text").select("doc_id", "page_idx", "text").join(docs, "doc_id")


@query(
    """SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(count(*) AS INTEGER) AS n_pages, '1.7' AS pdf_version, false AS is_tagged, 'table' AS xref_kind, CAST(count(*) * 2 + 3 AS INTEGER) AS n_objects, CAST(0 AS BIGINT) AS header_offset FROM nation GROUP BY 1"""
)
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    return relation(pdfs, "documents").select("doc_id", "n_pages", "pdf_version", "is_tagged", "xref_kind", "n_objects", "header_offset")


@query(
    """WITH n AS (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1), o AS (SELECT * FROM n, (VALUES ('BT', 1), ('Tf', 1), ('TL', 1), ('Td', 1), ('Tj', 1), ('ET', 1)) v(op, times))
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, op, CAST(k * times AS BIGINT) AS n FROM o"""
)
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    return relation(pdfs, "tokens", of="pages").where("kind = 'keyword'").groupBy("doc_id", F.col("text").alias("op")).agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1)
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, op, CAST(k AS BIGINT) AS n, a AS args FROM n, (VALUES ('BT', '[]'), ('Tf', '["F1",12]'), ('TL', '[14]'), ('Td', '[72,720]'), ('ET', '[]')) v(op, a)"""
)
def page_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    return relation(pdfs, "page_ops").where("op <> 'Tj'").groupBy("doc_id", "op", "args").agg(F.count("*").alias("n")).select("doc_id", "op", "n", "args")


# places


def on_a_grid(_: int, rows: Rows) -> bytes:
    w = Writer()
    body = [b"BT /F1 10 Tf"]
    for k, r in enumerate(rows):
        body.append(b"1 0 0 1 %d %d Tm " % (20 + 150 * (k % 4), 700 - 20 * (k // 4)) + latin(r["s_name"]) + b" Tj")
    w.page(b"\n".join([*body, b"ET"]), {"Font": {"F1": w.core_font("Courier")}}, compress=True)
    return w.save()


_GRID = "(SELECT s_nationkey AS d, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier)"


@query(f"SELECT CAST(d AS BIGINT) AS doc_id, s_name AS chars FROM {_GRID} WHERE 20 + 150 * (k % 4) < 300 AND 20 + 150 * (k % 4) + 6 * length(s_name) > 160 AND 700 - 20 * (k // 4) + 6.29 > 600 AND 700 - 20 * (k // 4) - 1.57 < 690")
def region_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name"), on_a_grid)
    return L.in_region(relation(pdfs, "content_objects", space="default", kinds=["text"]), 160, 600, 300, 690).select("doc_id", "chars")


@query(f"SELECT CAST(d AS BIGINT) AS doc_id, string_agg(line, chr(10) ORDER BY y) AS text FROM (SELECT d, k // 4 AS y, string_agg(s_name, ' ' ORDER BY k) AS line FROM {_GRID} GROUP BY d, y) GROUP BY d")
def text_untagged_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name"), on_a_grid)
    return relation(pdfs, "page_text").select("doc_id", "text")


def placed_boxes(_: int, rows: Rows) -> bytes:
    w = Writer()
    w.page(b"\n".join(f"{r['p_size'] * 9} {(r['p_partkey'] * 37) % 700} {10 + r['p_partkey'] % 40} {5 + r['p_size'] % 30} re f".encode() for r in rows), compress=True)
    return w.save()


_BOXES = "(SELECT p_partkey // 100 AS d, p_partkey AS k, p_size * 9 AS x, p_partkey * 37 % 700 AS y, 10 + p_partkey % 40 AS w, 5 + p_size % 30 AS h FROM part)"


@query(f"SELECT CAST(a.d AS BIGINT) AS doc_id, CAST(a.k % 100 AS INTEGER) AS item_seq, CAST(b.k % 100 AS INTEGER) AS r_item_seq FROM {_BOXES} a JOIN {_BOXES} b ON a.d = b.d AND a.k < b.k AND b.x + b.w > a.x AND a.x + a.w > b.x AND b.y + b.h > a.y AND a.y + a.h > b.y")
def spatial_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 100), "p_partkey", "p_size"), placed_boxes)
    p = relation(pdfs, "content_objects", space="default", kinds=["path"], columns=["item_seq", "bbox"])
    return L.spatial_join(p, p, ["doc_id"]).where("item_seq < r_item_seq").select("doc_id", "item_seq", "r_item_seq")


def paragraphs(_: int, rows: Rows) -> bytes:
    """Each nation's suppliers as a block of lines, far from the next."""
    w = Writer()
    font = {"Font": {"F1": w.core_font("Courier")}}
    by: dict[str, Rows] = {}
    for r in rows:
        by.setdefault(r["n_name"], []).append(r)
    height = 200 + sum(60 + 12 * len(own) for own in by.values())
    y, body = height - 100, []
    for nation, own in by.items():
        body.append(show_lines([nation, *(r["s_name"] for r in own)], size=10, leading=10, y=y))
        y -= 60 + 12 * len(own)
    w.page(b"\n".join(body), font, True, MediaBox=[0, 0, 612, height])
    return w.save()


@query(
    f"""WITH b AS (SELECT n_regionkey, n_nationkey, n_name || chr(10) || string_agg(s_name, chr(10) ORDER BY s_suppkey) || chr(10) AS text FROM {_BY_NATION} GROUP BY n_regionkey, n_nationkey, n_name)
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS reading_index, text FROM b
UNION ALL SELECT CAST(n_regionkey AS BIGINT), -1, n_name || chr(10) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT CAST(n_regionkey AS BIGINT), -1, s_name || chr(10) FROM {_BY_NATION}"""
)
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pdfs = render(grouped(rows, "n_regionkey", "n_nationkey", "n_name", "s_suppkey", "s_name"), paragraphs)
    return relation(pdfs, "layout_items").where("kind in ('textbox', 'textline')").select("doc_id", F.coalesce("reading_index", F.lit(-1)).alias("reading_index"), "text")


def many_fonts(_: int, rows: Rows) -> bytes:
    w = Writer()
    names = ["Courier", "Helvetica", "Times-Roman"]
    refs = {}
    for r in rows:
        name = f"AB{r['p_size']:04d}+{names[r['p_partkey'] % 3]}"
        refs.setdefault(name, w.core_font(name))
        w.page(b"BT /F 11.5 Tf (x) Tj ET", {"Font": {"F": refs[name]}})
    return w.save()


@query(
    """WITH f AS (SELECT p_partkey // 100 AS d, p_partkey % 100 AS i, 'AB' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '+' || list_extract(['Courier', 'Helvetica', 'Times-Roman'], CAST(p_partkey % 3 + 1 AS INTEGER)) AS fontname FROM part)
SELECT CAST(d AS BIGINT) AS doc_id, fontname, split_part(fontname, '+', 2) AS fontbase, CAST(max(i) AS INTEGER) AS last_page FROM f GROUP BY d, fontname"""
)
def font_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 100), "p_partkey", "p_size"), many_fonts)
    return L.document_fonts(relation(pdfs, "fonts")).select("doc_id", "fontname", "fontbase", F.col("page_idx").alias("last_page"))


@query("SELECT CAST(p_partkey AS BIGINT) AS part, list_extract(['Courier', 'Helvetica', 'Times-Roman'], CAST(p_partkey % 3 + 1 AS INTEGER)) || ' 12' AS textfont FROM part")
def text_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 100), "p_partkey", "p_size"), many_fonts)
    t = relation(pdfs, "content_objects", kinds=["text"], columns=["page_idx", "gstate", "size"])
    return t.select((F.col("doc_id") * 100 + F.col("page_idx")).alias("part"), T.text_font(F.col("gstate.fontname"), F.col("size")).alias("textfont"))


def cid_texts(_: int, rows: Rows) -> bytes:
    """A composite font with Identity-H, widths of 500 and a ToUnicode map of code to code + 1."""
    w = Writer()
    cmap = w.stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0020> <00FE> <0021> endbfrange")
    child = w.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("X"), "DW": 500, "W": [0x20, [250]], "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}})
    font = w.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name("Identity-H"), "DescendantFonts": [child], "ToUnicode": cmap})
    for r in rows:
        codes = "".join(f"{ord(c) - 1:04X}" for c in r["n_name"])
        w.page(f"BT /F1 10 Tf 0 0 Td <{codes}> Tj ET".encode(), {"Font": {"F1": font}})
    return w.save(xref="objects")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, {_NTH} AS page_idx, n_name AS chars, CAST(length(n_name) * 5 AS DOUBLE) AS width FROM nation WHERE n_name NOT LIKE '%!%'")
def composite_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), cid_texts)
    return relation(pdfs, "content_objects", space="default", kinds=["text"]).select("doc_id", "page_idx", "chars", F.round("displacement.x", 4).alias("width"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(g AS INTEGER) AS distance, CAST(CASE g WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN count(*) ELSE count(*) + 1 END AS BIGINT) AS n FROM nation, (VALUES (0), (1), (2), (3)) v(g) GROUP BY n_regionkey, g")
def catalog_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    objects = relation(pdfs, "objects", columns=["objid", "seq", "obj"])
    roots = objects.where("obj like '%\"Catalog\"%'").select("doc_id", "objid")
    return L.reference_closure(objects, roots).groupBy("doc_id", "distance").agg(F.count("*").alias("n"))


# exports, spans and searches over the relations


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, {_NTH} AS page_idx, '<span style=\"font-family: ''Helvetica''; font-size: 12pt\">' || n_name || '</span>' AS html FROM nation")
def styled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    return L.styled_spans(relation(pdfs, "content_objects", kinds=["text"])).select("doc_id", "page_idx", "html")


def drawn(_: int, rows: Rows) -> bytes:
    w = Writer()
    for r in rows:
        w.page(f"{r['n_nationkey']} 0 m {r['n_nationkey'] + 5} 9 l S".encode())
    return w.save()


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, {_NTH} AS page_idx, 'M' || n_nationkey || '.0,0.0 L' || (n_nationkey + 5) || '.0,9.0' AS d FROM nation")
def figure_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), drawn)
    return L.svg_paths(relation(pdfs, "content_objects", space="default", kinds=["path"])).select("doc_id", "page_idx", "d")


def hidden(_: int, rows: Rows) -> bytes:
    """Every third text is invisible, every other third is white."""
    w = Writer()
    body = [b"BT /F1 8 Tf 9 TL 20 800 Td"]
    for r in rows:
        k = r["s_suppkey"] % 3
        body.append((b"3 Tr 0 g ", b"0 Tr 1 g ", b"0 Tr 0 g ")[k] + latin(r["s_name"]) + b" '")
    w.page(b"\n".join([*body, b"ET"]), {"Font": {"F1": w.core_font()}})
    return w.save()


@query("SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_name AS chars, CASE s_suppkey % 3 WHEN 0 THEN 'invisible' ELSE 'white' END AS why FROM supplier WHERE s_suppkey % 3 < 2")
def hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_name"), hidden)
    t = relation(pdfs, "content_objects", kinds=["text"])
    why = F.when(F.col("gstate.render_mode") == 3, "invisible").when(F.col("gstate.ncolor.values")[0] == 1, "white")
    return t.select("doc_id", "chars", why.alias("why")).where("why is not null")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, min_by(n_name, n_nationkey) AS title FROM {_BY_NATION} GROUP BY 1")
def struct_find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.find_first(relation(supplier_trees(spark, sf_dir), "struct_nodes"), "Sect").select("doc_id", "title")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, kind, role, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n FROM (SELECT n_regionkey, 'element' AS kind, 'Document' AS role, 0 AS depth, 1 AS n FROM {_BY_NATION} GROUP BY 1 UNION ALL SELECT n_regionkey, 'element', 'Sect', 1, count(DISTINCT n_name) FROM {_BY_NATION} GROUP BY 1 UNION ALL SELECT n_regionkey, 'element', 'P', 2, count(*) FROM {_BY_NATION} GROUP BY 1 UNION ALL SELECT n_regionkey, 'item', NULL, 3, count(*) FROM {_BY_NATION} GROUP BY 1)")
def struct_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(supplier_trees(spark, sf_dir), "struct_nodes").groupBy("doc_id", "kind", "role", "depth").agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS k FROM customer) SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(i AS INTEGER) AS first_page, c_mktsegment AS prefix FROM b")
def label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_mktsegment"), same_labels)
    return relation(pdfs, "label_ranges").select("doc_id", "first_page", "prefix")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'Dests' AS tree, n_name AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS ordinal FROM nation")
def name_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(nation_links(spark, sf_dir), "name_entries").select("doc_id", "tree", "key", "ordinal")


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, {_NTH} AS page_idx, md5('BT /F1 12 Tf 14 TL 72 720 Td' || chr(10) || '(' || n_name || ') Tj' || chr(10) || 'ET') AS digest FROM nation")
def content_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    return relation(pdfs, "page_content").select("doc_id", "page_idx", F.md5("content").alias("digest"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(count(*) AS INTEGER) AS pages, string_agg(n_name, ',' ORDER BY n_nationkey) AS texts FROM nation GROUP BY 1")
def split_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts where every two pages are a task of their own."""
    from ..operators.relations import split_pages

    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    t = relation(split_pages(pdfs, 2), "page_text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda s: s.getField("text")), ",")
    return t.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"), said.alias("texts"))


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, {_NTH} AS page_idx, n_name AS text FROM nation")
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relations import register_functions

    register_functions(spark)
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    return spark.sql("SELECT t.doc_id, t.page_idx, t.text FROM {pdfs} p, LATERAL pdf_page_text(p.doc_id, p.content) t", pdfs=pdfs)


def with_type_3(_: int, rows: Rows) -> bytes:
    w = Writer()
    for r in rows:
        side = 100 + r["n_nationkey"]
        proc = w.stream(f"500 0 0 0 {side} {side} d1 0 0 {side} {side} re f".encode())
        font = {"Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "FontBBox": [0, 0, side, side], "CharProcs": {"sq": proc}, "Encoding": {"Differences": [97, Name("sq")]}, "FirstChar": 97, "Widths": [500]}
        w.page(b"BT /F 10 Tf 100 200 Td (aa) Tj ET", {"Font": {"F": w.add(font)}})
    return w.save()


@query(f"SELECT CAST(n_regionkey AS BIGINT) AS doc_id, {_NTH} AS page_idx, CAST(g AS INTEGER) AS glyph_idx, CAST(100 + 5 * g AS DOUBLE) AS x0, round(CAST(100 + 5 * g AS DOUBLE) + (100 + n_nationkey) / CAST(100 AS DOUBLE), 4) AS x1 FROM nation, (VALUES (0), (1)) v(g)".replace("OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)", "OVER (PARTITION BY n_regionkey, g ORDER BY n_nationkey)"))
def type_3_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey"), with_type_3)
    g = relation(pdfs, "glyph_contents", space="default")
    return g.select("doc_id", "page_idx", "glyph_idx", F.round("bbox.x0", 4).alias("x0"), F.round("bbox.x1", 4).alias("x1"))


# plain windows over the event table: additions, with the functions of the streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import event_windows as windows

    return windows(table(spark, sf_dir, "events"), "1 hour", streaming=False).withColumn("total", F.round("total", 2))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import event_sessions as sessions

    return sessions(table(spark, sf_dir, "events"), "30 minutes", streaming=False).select("user_id", "start", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, glyphs and text of every page of the nations' files."""
    pdfs = render(grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name"), one_name_a_page)
    text = relation(pdfs, "page_text").select("doc_id", "page_idx", "text")
    counts = relation(pdfs, "content_objects", kinds=["text"]).groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_texts"), F.sum("n_glyphs").alias("n_glyphs"))
    return text.join(counts, ["doc_id", "page_idx"])


