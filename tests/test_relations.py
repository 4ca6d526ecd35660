import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vellum.core.values import Name
from vellum.core.writer import Writer, show_lines
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import lookups as L
from vellum.operators.relations import READERS, SCHEMAS, column_names, relation, relations, split_pages
from vellum.plans import queries as plans
from vellum.sources import files
from vellum.streaming import ingest

SF = "/root/testdata/sf0.001"


def sample(pages=3):
    w = Writer()
    f = {"Font": {"F1": w.core_font()}}
    for k in range(pages):
        w.page(show_lines([f"page {k}", "more"]) + b"\n0 0 5 5 re f", f)
    return w.save()


@pytest.fixture(scope="module")
def pdfs(spark):
    return spark.createDataFrame([(1, bytearray(sample())), (2, bytearray(b"junk")), (3, None)], "doc_id bigint, content binary").cache()


def test_every_relation_has_its_schema(spark, pdfs):
    for name in READERS:
        df = relation(pdfs, name)
        assert df.columns == column_names(SCHEMAS[name])
        df.collect()
        assert relation(pdfs.where("false"), name).count() == 0


def test_bad_files_are_reported(spark, pdfs):
    rows = {r["doc_id"]: r for r in relation(pdfs, "documents").collect()}
    assert rows[1]["n_pages"] == 3 and rows[1]["error"] is None
    assert set(rows) == {1, 2, 3}
    w = Writer()
    w.page(b"")
    w.extra = {"Encrypt": w.add({"Filter": Name("Other"), "V": 9})}
    locked = spark.createDataFrame([(4, bytearray(w.save()))], "doc_id bigint, content binary")
    assert "EncryptionProblem" in relation(locked, "documents").first()["error"]
    assert relation(locked, "pages").count() == 0
    with pytest.raises(Exception, match="EncryptionProblem"):
        relation(locked, "pages", mode="failfast").collect()


def test_split_pages_gives_the_same_rows(spark, pdfs):
    whole = relation(pdfs, "page_text").orderBy("doc_id", "page_idx").collect()
    parts = relation(split_pages(pdfs, 2), "page_text").orderBy("doc_id", "page_idx").collect()
    assert whole == parts and len(whole) == 3


def test_sql_functions_and_data_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample())
    files.register(spark)
    df = spark.read.format("pdf").option("relation", "content_objects").load(str(tmp_path))
    assert {r[0] for r in df.select("object_type").distinct().collect()} == {"text", "path"}
    assert df.where("object_type = 'path'").count() == 3
    files.read_files(spark, str(tmp_path)).createOrReplaceTempView("pdf_files")
    assert spark.sql("SELECT p.page_idx, p.text FROM pdf_files f, LATERAL pdf_page_text(f.doc_id, f.content) p ORDER BY 1").collect()[1]["text"] == "page 1\nmore"


def test_corpus_and_sinks(spark, tmp_path):
    corpus = files.parse_pdf(spark, sample(2))
    assert [r["label"] for r in corpus.pages.orderBy("page_idx").collect()] == ["1", "2"]
    assert [r["w"] for r in corpus.map_pages(lambda doc, page: {"w": page.mediabox[2]}, "w double").collect()] == [612, 612]
    assert '"n_pages":2' in files.metadata_json(corpus.pdfs).first()["json"]
    w = Writer()
    mask = w.stream(b"\x80\x00", Subtype=Name("Image"), Width=2, Height=2, BitsPerComponent=1, ImageMask=True)
    im = w.stream(bytes(12), True, SMask=mask, Subtype=Name("Image"), Width=2, Height=2, BitsPerComponent=8, ColorSpace=Name("DeviceRGB"))
    program = w.stream(b"program")
    font = w.add({"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Own"), "FontDescriptor": {"FontFile2": program}})
    w.page(b"/I Do", {"XObject": {"I": im}, "Font": {"F": font}})
    corpus = files.parse_pdf(spark, w.save())
    image, mask = sorted(files.write_images(corpus.images, str(tmp_path / "i")).collect(), key=lambda r: r["path"])
    assert open(mask["path"], "rb").read() == b"P4\n2 2\n\x7f\xff"
    assert open(image["path"], "rb").read() == b"P6\n2 2\n255\n" + bytes(12)
    (written,) = files.write_fonts(corpus.table("fonts", programs=True), str(tmp_path / "f")).collect()
    assert os.path.basename(written["path"]).endswith("Own.ttf") and open(written["path"], "rb").read() == b"program"


def test_streaming_ingest(spark, tmp_path):
    source, to = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.pdf").write_bytes(sample(k + 1))
        ingest.ingest(ingest.arriving_files(spark, str(source)), "pages", str(to), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(to)).count() == (1, 3)[k]


def test_streams_of_events_and_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp"))

    def result(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table(name)

    own = result(ingest.event_windows(stream, "1 hour"), "windows", "complete")
    want = ingest.event_windows(events, "1 hour", streaming=False)
    assert own.count() == want.count() and own.agg(F.sum("n")).first()[0] == events.count()
    users = result(ingest.running_totals(stream.select("user_id", "value")), "totals", "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, users.collect())) == sorted(map(tuple, events.groupBy("user_id").count().collect()))
    (tmp_path / "f").mkdir()
    for name in "ab":
        (tmp_path / "f" / f"{name}.pdf").write_bytes(sample())
    assert result(ingest.first_of_content(ingest.arriving_files(spark, str(tmp_path / "f"))).select("path"), "firsts", "append").count() == 1


def test_geometry_columns(spark):
    df = spark.createDataFrame([(90,), (0,), (180,), (270,)], "r int").withColumn("box", G.rect(F.lit(0), F.lit(0), F.lit(400), F.lit(600)))
    from vellum.core.geometry import initial_matrix

    for space in ("screen", "page", "default"):
        for r in df.select("r", G.initial_matrix(F.col("box"), F.col("r"), space).alias("m")).collect():
            assert tuple(r["m"]) == pytest.approx(initial_matrix((0, 0, 400, 600), r["r"], space))
    one = df.limit(1).select(G.overlaps(F.col("box"), G.rect(F.lit(400), F.lit(0), F.lit(500), F.lit(9))).alias("edge"), G.contains_point(F.col("box"), F.lit(400), F.lit(0)).alias("corner")).first()
    assert (one["edge"], one["corner"]) == (False, True)


def test_text_columns(spark):
    df = spark.createDataFrame([(b"\xfe\xff\x00a\x20\xac",), (b"\x80b",), (None,)], "b binary")
    assert [r[0] for r in df.select(T.decode_text(F.col("b"))).collect()] == ["a€", "•b", None]
    df = spark.createDataFrame([("eacute",), (None,)], "n string")
    assert [r[0] for r in df.select(T.glyph_name_text(F.col("n"))).collect()] == ["é", None]
    df = spark.createDataFrame([(bytearray(b"4142>"), ["ASCIIHexDecode"]), (bytearray(b"x"), ["Unknown"])], "d binary, f array<string>")
    assert [r[0] for r in df.select(T.decode_stream(F.col("d"), F.col("f"))).collect()] == [b"AB", None]


def test_page_selection(spark):
    pages = spark.range(12).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_idx"))
    assert [r["page_idx"] for r in L.select_pages(pages, "2, 10-9,99").orderBy("page_idx").collect()] == [1, 8, 9]
    assert L.select_pages(pages, "all").count() == 12


def test_spatial_join_is_every_overlapping_pair_once(spark):
    import random

    r = random.Random(5)
    rows = [(1, k, (x := r.uniform(-200, 400)), (y := r.uniform(-200, 400)), x + r.uniform(0, 180), y + r.uniform(0, 180)) for k in range(60)]
    df = spark.createDataFrame(rows, "d int, k int, x0 double, y0 double, x1 double, y1 double").select("d", "k", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    found = sorted((a["k"], a["r_k"]) for a in L.spatial_join(df, df, ["d"]).select("k", "r_k").collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[4] > b[2] and b[4] > a[2] and a[5] > b[3] and b[5] > a[3])
    assert found == want


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["text_roundtrip", "glyph_positions", "page_rotation_space", "struct_find_all", "struct_climb", "outline_tree", "link_graph", "link_anchor_texts", "encrypted_text", "codec_chains", "text_boxes", "font_usage", "xref_latest_revision", "page_labels", "composite_fonts", "catalog_closure"])
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    own = sorted(repr(tuple(r)) for r in df.collect())
    want = con.sql(plans.ORACLES[name])
    assert want.columns == df.columns
    assert own == sorted(repr(r) for r in want.fetchall())


def test_the_rest_does_without_the_corpus_operators():
    import re
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    for p in (root / "vellum").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?:from|import)\s+[\w.]*\bllm\b", p.read_text()), p
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())


def forms_file():
    w = Writer()
    fonts = {"Font": {"F1": w.core_font()}}
    inner = [w.stream(b"BT /F1 9 Tf 1 0 0 1 40 500 Tm /P <</MCID 0>> BDC (form %d) Tj EMC ET" % k, Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 600, 800], Resources=fonts) for k in range(2)]
    w.page(b"/P <</MCID 0>> BDC BT /F1 9 Tf 1 0 0 1 40 700 Tm (page) Tj ET EMC /P <</MCID 1>> BDC /A Do EMC /B Do", fonts | {"XObject": {"A": inner[0], "B": inner[1]}}, StructParents=0)
    return w.save(), [r.objid for r in inner]


def test_sections_belong_to_their_stream(spark):
    data, (first, second) = forms_file()
    pdfs = spark.createDataFrame([(1, bytearray(data))], "doc_id bigint, content binary")
    rows = L.marked_content(relation(pdfs, "content_objects", kinds=["text"], columns=L.SECTION_COLUMNS)).collect()
    assert {(r["mcid_stream"], r["mcid"], r["text"]) for r in rows} == {(None, 0, "page"), (first, 0, "form 0"), (second, 0, "form 1")}


def test_only_what_is_asked_for_is_built(spark):
    data, _ = forms_file()
    pdfs = spark.createDataFrame([(1, bytearray(data))], "doc_id bigint, content binary")
    few = relation(pdfs, "content_objects", columns=["chars", "mcid"])
    assert few.columns == ["doc_id", "chars", "mcid"] and few.where("chars = 'page' and mcid = 0").count() == 1
    ops = relation(pdfs, "page_ops", ops=["Do", "BMC"]).collect()
    assert [(r["op"], r["args"]) for r in ops] == [("Do", '["A"]'), ("Do", '["B"]')]
    assert relation(pdfs, "objects", key="BBox", columns=["obj"]).count() == 2


def test_large_boxes_meet_without_cells(spark):
    import random

    r = random.Random(2)

    def box(size):
        x, y = r.uniform(-300, 300), r.uniform(-300, 300)
        return (x, y, x + r.uniform(1, size), y + r.uniform(1, size))

    sides = [[(k, n, box(1e9 if n % 7 == 0 else 200)) for k in range(2) for n in range(30)] for _ in range(2)]
    schema = "k int, n int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    a, b = (spark.createDataFrame(s, schema) for s in sides)
    found = sorted((x["k"], x["n"], x["r_n"]) for x in L.spatial_join(a, b, ["k"]).collect())
    over = lambda p, q: p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]
    assert found == sorted((k, n, m) for k, n, p in sides[0] for j, m, q in sides[1] if j == k and over(p, q))


def test_data_source_ids_columns_and_patterns(spark, tmp_path):
    data, _ = forms_file()
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "in/b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(data)
    files.register(spark)
    rows = spark.read.format("pdf").option("relation", "pages").option("columns", "page_idx").load(str(tmp_path))
    assert rows.columns == ["doc_id", "page_idx"]
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert spark.read.format("pdf").load(f"file://{tmp_path}/a.pdf").count() == 1 and spark.read.format("pdf").load(f"{tmp_path}/in/*.pdf").count() == 1
    assert spark.read.format("pdf").option("relation", "content_objects").load(str(tmp_path)).where("object_type = 'text'").count() == 6


def test_table_functions_take_options(spark):
    data, _ = forms_file()
    files.register(spark)
    spark.createDataFrame([(1, bytearray(data))], "doc_id bigint, content binary").createOrReplaceTempView("some_files")
    rows = spark.sql("SELECT t.op FROM some_files f, LATERAL pdf_page_ops(f.doc_id, f.content, map('ops', 'Tj,Do')) t").collect()
    assert sorted(r["op"] for r in rows) == ["Do", "Do", "Tj"]


def test_coercion_of_objects(spark):
    from vellum.functions import values as V

    said = ["true", "12", "-3", "2.5", '"a\\"b"', "[1,2]", '{"A":1}', '{"stream":{"L":2},"length":2}', "[1,2,3,4]", "[4,3,2,1]", "[1,0,0,1,5,6]", "null", '["x",2]']
    df = spark.createDataFrame([(s,) for s in said], "obj string")
    kinds = ("bool", "int", "uint", "number", "text", "list", "dict", "stream", "point", "rect", "matrix")
    out = {r["obj"]: r for r in df.select("obj", *(V.coerce(F.col("obj"), k).alias(k) for k in kinds)).collect()}
    filled = {s: {k for k in kinds if out[s][k] is not None} for s in said}
    assert filled["true"] == {"bool"} and filled["12"] == {"int", "uint", "number"} and filled["-3"] == {"int", "number"} and filled["2.5"] == {"number"} and filled['"a\\"b"'] == {"text"}
    assert filled["[1,2]"] == {"list", "point"} and filled['{"A":1}'] == {"dict"} and filled[said[7]] == {"stream"} and filled["null"] == set() and filled['["x",2]'] == {"list"}
    assert out["[4,3,2,1]"]["rect"].asDict() == {"x0": 2, "y0": 1, "x1": 4, "y1": 3} and out["[1,0,0,1,5,6]"]["matrix"]["f"] == 6 and out['"a\\"b"']["text"] == 'a"b'


def test_bytes_and_parts(spark):
    from vellum.functions import values as V

    df = spark.createDataFrame([(bytearray(b"\x01\x02"), [1, 2, 3, 4, 5]), (bytearray(), []), (None, None)], "b binary, a array<int>")
    rows = df.select(V.big_endian(F.col("b"), 7).alias("n"), V.chunks(F.col("a"), 2).alias("c")).collect()
    assert [(r["n"], r["c"]) for r in rows] == [(258, [[1, 2], [3, 4]]), (7, []), (None, None)]


def test_json_schemas(spark):
    from vellum.operators.export import json_schemas

    own = json_schemas()
    assert set(own) == set(READERS) and own["pages"]["properties"]["mediabox"]["properties"]["x0"] == {"type": "number"} and own["objects"]["properties"]["filters"]["items"] == {"type": "string"}


def test_order_identity_and_targets_of_the_structure(spark):
    customer = spark.createDataFrame([(1, "a name", "MACHINERY", 5.0, 0), (2, "b name", "BUILDING", 6.0, 0)], "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double, c_nationkey bigint")
    pdfs = plans.render(plans.grouped(customer, "c_nationkey", "c_custkey", "c_name", "c_mktsegment", "c_acctbal"), plans.with_forms)
    nodes, items = relation(pdfs, "struct_nodes"), relation(pdfs, "content_objects")
    places = L.content_order(nodes, L.marked_content(items)).orderBy("page_idx", "place").join(nodes.select("doc_id", "node_id", "kind", "stream_id"), ["doc_id", "node_id"]).orderBy("page_idx", "place").collect()
    assert [r["kind"] for r in places[:4]] == ["object", "item", "item", "item"] and places[1]["stream_id"] is None
    assert L.with_identity(nodes).select("identity").distinct().count() == nodes.count()
    targets = L.object_targets(nodes, relation(pdfs, "annotations"), items).collect()
    assert [(r["target"], r["page_idx"]) for r in sorted(targets, key=lambda r: r["page_idx"])] == [("image", 0), ("image", 1)]
    pages = relation(pdfs, "pages")
    refs = pages.select("doc_id", F.col("page_objid").alias("objid"), F.col("page_idx").alias("want"))
    assert L.page_by_objid(pages, refs).where("page_idx = want").count() == 2


def test_destinations_in_device_space(spark):
    w = Writer()
    page = w.page(b"", None, MediaBox=[0, 0, 600, 800])
    w.catalog["Dests"] = {"here": [page, Name("XYZ"), 100, 700, None], "part": [page, Name("FitR"), 10, 20, 30, 40]}
    pdfs = spark.createDataFrame([(1, bytearray(w.save()))], "doc_id bigint, content binary")
    rows = {r["name"]: r for r in L.device_destinations(relation(pdfs, "destinations"), relation(pdfs, "pages")).collect()}
    assert (rows["here"]["left"], rows["here"]["top"]) == (100, 100) and rows["part"]["bbox"].asDict() == {"x0": 10, "y0": 760, "x1": 30, "y1": 780}


def test_several_relations_from_one_pass(spark, pdfs):
    read = relations(pdfs, {"documents": {}, "pages": {"columns": ["page_idx", "mediabox"]}, "content_objects": {"kinds": ["text"]}}, space="default")
    assert sorted(map(str, read["documents"].collect())) == sorted(map(str, relation(pdfs, "documents").collect()))
    assert read["pages"].columns == ["doc_id", "page_idx", "mediabox"] and read["pages"].count() == 3
    assert sorted(map(str, read["content_objects"].collect())) == sorted(map(str, relation(pdfs, "content_objects", kinds=["text"], space="default").collect()))
    assert all(df.count() == 0 for df in relations(pdfs.where("false"), {"pages": {}, "fonts": {}}).values())


def test_fonts_and_tokens_of_forms(spark):
    data, forms = forms_file()
    pdfs = spark.createDataFrame([(1, bytearray(data))], "doc_id bigint, content binary")
    assert {r["form_objid"] for r in relation(pdfs, "fonts", forms=True).collect()} == {None, *forms} and relation(pdfs, "fonts").where("form_objid is null").count() == 1
    assert {r["stream_id"] for r in relation(pdfs, "tokens", of="forms").where("text = 'BDC'").collect()} == set(forms)
