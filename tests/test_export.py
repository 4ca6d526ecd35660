import json

from vellum import cli
from vellum.core.values import Name
from vellum.core.writer import Writer, show_lines
from vellum.operators import export as X
from vellum.operators.relations import relation
from vellum.plans import queries as plans
from vellum.sources import files


def book(spark):
    rows = [{"n_name": n, "n_nationkey": k, "s_suppkey": k * 10 + j, "s_name": f"{n}-{j}"} for k, n in enumerate("AB") for j in range(2)]
    return spark.createDataFrame([(0, bytearray(plans.structured(0, rows))), (1, bytearray(plans.with_outline(1, rows)))], "doc_id bigint, content binary")


def test_nested_json(spark):
    pdfs = book(spark)
    (tree,) = (json.loads(r["json"]) for r in X.structure_json(pdfs).collect())
    assert tree[0]["role"] == "Document" and [c["title"] for c in tree[0]["children"]] == ["A", "B"]
    assert tree[0]["children"][1]["children"][0]["children"][0]["text"] == "B-0"
    (outline,) = (json.loads(r["json"]) for r in X.outline_json(pdfs).collect())
    assert [c["title"] for c in outline[0]["children"]] == ["A-0", "A-1"] and outline[1]["dest_page_idx"] == 1
    catalogs = {r["doc_id"]: json.loads(r["json"]) for r in X.catalog_json(pdfs).collect()}
    assert catalogs[0]["Pages"]["Count"] == 2 and "Parent" not in catalogs[0]["Pages"]["Kids"][0]


def test_page_arrays_and_streams(spark):
    w = Writer()
    f = {"Font": {"F1": w.core_font()}}
    for k in range(2):
        w.page(show_lines([f"one {k}", "two"]), f, compress=True)
    pdfs = files.parse_pdf(spark, w.save()).pdfs
    pages = [json.loads(r["json"]) for r in X.texts_json(pdfs).orderBy("page_idx").collect()]
    assert [t["chars"] for t in pages[1]] == ["one 1", "two"] and pages[0][0]["gstate"]["fontsize"] == 12
    assert len(json.loads(X.texts_json(pdfs, glyphs=True).orderBy("page_idx").first()["json"])) == 8
    assert json.loads(X.objects_json(pdfs).first()["json"])[0]["object_type"] == "text"
    stream = relation(pdfs, "objects").where("kind = 'stream'").first()
    assert X.stream_bytes(pdfs, stream["objid"]).first()["decoded"] == stream["decoded"]


def test_outline_texts(spark):
    w = Writer()
    f = {"Font": {"F1": w.core_font()}}
    page = w.page(show_lines(["above"], y=700) + b"\n" + show_lines(["below"], y=300), f)
    item = w.add({"Title": b"T", "Dest": [page, Name("XYZ"), 0, 400, None]})
    w.catalog["Outlines"] = w.add({"First": item, "Last": item})
    assert X.outline_texts(files.parse_pdf(spark, w.save()).pdfs).first()["text"] == "below"


def test_type_3_glyphs(spark):
    w = Writer()
    proc = w.stream(b"500 0 0 0 400 400 d1 1 0 0 rg 0 0 400 400 re f")
    font = {"Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "FontBBox": [0, 0, 400, 400], "CharProcs": {"sq": proc}, "Encoding": {"Differences": [97, Name("sq")]}, "FirstChar": 97, "Widths": [500]}
    w.page(b"BT /F 10 Tf 100 200 Td (aa) Tj ET", {"Font": {"F": w.add(font)}})
    rows = relation(files.parse_pdf(spark, w.save()).pdfs, "glyph_contents", space="default").orderBy("glyph_idx").collect()
    assert [round(r["bbox"]["x0"], 3) for r in rows] == [100, 105] and round(rows[0]["bbox"]["y1"], 3) == 204


def test_command_line(spark, tmp_path, capsys):
    w = Writer()
    w.page(show_lines(["hello"]), {"Font": {"F1": w.core_font()}})
    (tmp_path / "a.pdf").write_bytes(w.save())
    for flags, said in ((["--text"], "hello"), ([], '"pdf_version":"1.7"'), (["--content-streams"], "Tj"), (["--catalog"], "Catalog"), (["--text-objects"], '"chars":"hello"'), (["--relation", "pages"], "612")):
        assert cli.main([*flags, str(tmp_path)], spark) == 0
        assert said in capsys.readouterr().out
    assert cli.main(["--text", "--pages", "2", "--output", str(tmp_path / "o"), str(tmp_path)], spark) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 0
