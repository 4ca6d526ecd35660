"""What a row costs: findings of larger tables."""

from vellum.core import codecs, crypto
from vellum.core.document import Document
from vellum.core.interp import Interpreter, text_record
from vellum.core.text import untagged_text
from vellum.core.writer import Writer, show_lines
from vellum.plans import queries as plans


def page_of(body):
    w = Writer()
    w.page(body, {"Font": {"F1": w.core_font()}})
    doc = Document(w.save())
    return doc, doc.pages()[0]


def test_a_text_without_boxes_is_a_run_not_glyphs():
    """F1"""
    doc, page = page_of(show_lines(["one line", "another line"]) + b"\nBT /F1 10 Tf 2 Tw 3 Tc 20 20 Td [(a b) -2000 (cd) 10 (e)] TJ ET")
    records = [text_record(t) for t in Interpreter(doc, page, kinds=("text",), boxes=False)]
    whole = [text_record(t) for t in Interpreter(doc, page, kinds=("text",))]
    assert [len(t["glyphs"]) for t in records] == [1, 1, 3]
    for a, b in zip(records, whole, strict=True):
        assert {k: v for k, v in a.items() if k != "glyphs"} == {k: v for k, v in b.items() if k != "glyphs"}
        assert a["glyphs"][0][1:3] == b["glyphs"][0][1:3] and a["glyphs"][-1][3:] == b["glyphs"][-1][3:]
    assert untagged_text(records) == untagged_text(whole) == "one line\nanother line\na b cde"


def test_blocks_are_chained_without_a_call_for_each(monkeypatch):
    """F1"""
    cipher, iv = crypto.Aes(bytes(range(32))), bytes(range(16))
    data = bytes(k % 251 for k in range(1600))
    expected, before = b"", iv
    for k in range(0, len(data), 16):
        before = cipher.encrypt(bytes(x ^ y for x, y in zip(data[k : k + 16], before, strict=True)))
        expected += before
    calls = []
    monkeypatch.setattr(crypto.Aes, "encrypt", lambda self, block: calls.append(block) or bytes(16))
    assert cipher.cbc_encrypt(data, iv) == expected
    assert cipher.cbc_decrypt(expected, iv) == data and not calls


def test_a_text_is_packed_once(monkeypatch):
    """F8"""
    calls, plain = [], plans.lzw_codes
    monkeypatch.setattr(plans, "lzw_codes", lambda raw: calls.append(raw) or plain(raw))
    texts = ["", "a", "aaaaaaaaaaaaaaaaaaa", "ünï " * 3000, "".join(chr(32 + k * k % 90) for k in range(9000))]
    doc = Document(plans.filtered_documents(0, [{"doc_id": k, "text": t} for k, t in enumerate(texts)]))
    assert len(calls) == len(texts)
    read = [doc.stream_bytes(v).decode().rstrip(" ") for _, _, _, _, v in doc.all_objects() if getattr(v, "attrs", {}).get("Item") is not None]
    assert read == [t.rstrip(" ") for t in texts for _ in range(4)]


def test_lzw_beyond_its_table_and_with_damage():
    """F8: long repeats, thousands of codes without a clear code, and codes that no entry has."""
    raw = bytes(700_000)
    assert codecs.lzw(plans.lzw_codes(raw)) == raw
    bits = "".join(f"{c:09b}" for c in (256, 65, 258, 259, 66, 400, 67))
    assert codecs.lzw(int(bits + "0", 2).to_bytes(8, "big")) == b"A" + b"AA" + b"AAA" + b"B"
    assert codecs.lzw(b"") == codecs.lzw(b"\x80") == b""


def test_plain_objects_need_no_parser(monkeypatch):
    """objects and trailers of a file with many revisions."""
    from vellum.core import lexer

    w = Writer()
    w.page(b"")
    ref = w.add({"Order": -1})
    data = w.save(revisions=[{ref.objid: {"Order": k, "Total": b"(%d)" % k, "Next": ref}} for k in range(20)])
    made, plain = [], lexer.Parser.__init__
    monkeypatch.setattr(lexer.Parser, "__init__", lambda self, *a, **k: made.append(1) or plain(self, *a, **k))
    doc = Document(data)
    orders = [v["Order"] for _, objid, _, _, v in doc.all_objects() if objid == ref.objid]
    assert orders == [-1, *range(20)] and doc.get(ref.objid) == {"Order": 19, "Total": b"(19)", "Next": ref} and len(doc.trailers) == 21
    assert not made


def test_sections_need_one_window_and_no_boxes(spark):
    """F5"""
    from vellum.operators import lookups as L

    row = "struct('P' as tag, 0 as mcid, cast(null as string) as props)"
    items = spark.sql(f"select 1L as doc_id, 0 as page_idx, cast(id as int) as item_seq, 'text' as object_type, cast(if(id = 2, 1, 0) as int) as mcid, cast(null as bigint) as mcid_stream, array({row}) as mcstack, cast(id as string) as chars from range(5)")
    found = L.marked_content(items)
    assert {(r.mcid, r.text, r.n_items, r.first_seq) for r in found.collect()} == {(0, "34", 2, 3), (1, "2", 1, 2)}
    assert "bbox" not in found.columns


def test_paths_are_built_by_the_columns_asked_for():
    """F7"""
    doc, page = page_of(b"q 2 0 0 2 10 20 cm 10 3 5 4 re S 20 1 -7 2 re f Q")
    whole = list(Interpreter(doc, page, kinds=("path",)))
    boxes = list(Interpreter(doc, page, kinds=("path",), states=False, segments=False))
    assert [(x.bbox, x.stroke, x.fill) for x in boxes] == [(x.bbox, x.stroke, x.fill) for x in whole]
    assert [len(x.segments) for x in whole] == [5, 5] and not any(x.segments for x in boxes)


def test_rendered_files_leave_in_small_batches():
    """F12, F10"""
    import pyarrow as pa

    from vellum.plans import synth

    class Groups:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            rows = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "rows": [[{"k": 1}]] * 9})
            return list(run(iter([rows])))

    found = synth.render(Groups(), lambda doc_id, rows: bytes(1 << 20))
    assert [b.num_rows for b in found] == [4, 4, 1] and [i for b in found for i in b.column(0).to_pylist()] == list(range(9))
