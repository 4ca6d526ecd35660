import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.core import codecs, crypto, lexer
from vellum.core.document import Document
from vellum.core.encodings import core_font, core_widths, glyph_text
from vellum.core.fonts import CMap
from vellum.core.geometry import initial_matrix, multiply, transform_rect
from vellum.core.interp import Interpreter, text_record
from vellum.core.layout import LayoutParams, analyse
from vellum.core.text import letters, numeral, roman, untagged_text
from vellum.core.values import EncryptionProblem, Name, Ref, Stream, SyntaxProblem, WrongPassword, plain, shown_bytes, text_of
from vellum.core.writer import Writer, literal, show_lines, written


@pytest.mark.parametrize(
    "data, kinds",
    [
        (b"1 2.5 -.5 +7", [1, 2.5, -0.5, 7]),
        (b"(a(b)c\\051) <41 4> /a#20b", [b"a(b)c)", b"A@", "a b"]),
        (b"(a\\\nb) (a\r\nb) (\\8) (\\400)", [b"ab", b"a\nb", b"8", b""]),
        (b"true false % x\n endobj", [True, False, "endobj"]),
        (b"(open", [b"open"]),
    ],
)
def test_tokens(data, kinds):
    assert [t.value for t in lexer.tokens(data)] == kinds


def test_objects():
    value = lexer.parse_one(b"<</A [1 0 R null (x)] /B <</C null>> /D /E>>")
    assert value == {"A": [Ref(1), None, b"x"], "B": {}, "D": Name("E")}
    with pytest.raises(SyntaxProblem):
        lexer.parse_one(b"<</A>>", strict=True)
    assert lexer.parse_one(b"<</A 1 /B>>") == {"A": 1}


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=12) | st.text("abcXYZ #()/é", max_size=8).map(Name),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text("abcd", min_size=1, max_size=4), inner.filter(lambda v: v is not None), max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(values)
def test_written_values_come_back(value):
    assert lexer.parse_one(written(value)) == value


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=600))
def test_filters_round_trip(data):
    import base64

    assert codecs.flate(zlib.compress(data)) == data
    assert codecs.ascii85(base64.a85encode(data) + b"~>") == data
    assert codecs.asciihex(data.hex().encode() + b">") == data
    runs = b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128)) + b"\x80"
    assert codecs.runlength(runs) == data


def test_lzw_and_damaged_flate():
    assert codecs.lzw(bytes.fromhex("800b6050220c0c8501")) == bytes.fromhex("2d2d2d2d2d412d2d2d42")
    whole = zlib.compress(bytes(range(256)) * 40)
    assert codecs.flate(whole[:-20]).startswith(bytes(range(200)))


def test_predictors():
    row = bytes(range(10, 18))
    assert codecs.png_rows(b"\x01" + bytes([10] + [1] * 7), 1, 8, 8) == row
    assert codecs.tiff_rows(bytes([10] + [1] * 7), 1, 8, 8) == row


def test_fax():
    # Group 4: an all-white line is "V0"; then the end mark
    bits = "1" * 4 + "000000000001" * 2
    bits += "0" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert codecs.decode_fax(data, {"K": -1, "Columns": 16, "Rows": 4}) == b"\xff\xff" * 4
    # Group 3, one line: 4 white, 4 black
    bits = "1011" + "011" + "0" * 1
    assert codecs.decode_fax(int(bits, 2).to_bytes(1, "big"), {"K": 0, "Columns": 8, "Rows": 1, "BlackIs1": True}) == b"\x0f"


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.Aes(bytes(range(16))).encrypt(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.Aes(bytes(range(32))).encrypt(block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.Aes(bytes(range(32))).decrypt(bytes.fromhex("8ea2b7ca516745bfeafc49904b496089")) == block


def aes256(password, owner, r):
    from hashlib import sha256

    def digest(p, salt, extra=b""):
        return crypto.hash_r6(p, salt, extra) if r == 6 else sha256(p + salt + extra).digest()

    key = bytes(range(32))
    u = digest(password, b"a" * 8) + b"a" * 8 + b"b" * 8
    ue = crypto.Aes(digest(password, b"b" * 8)).cbc_encrypt(key, bytes(16))
    o = digest(owner, b"c" * 8, u) + b"c" * 8 + b"d" * 8
    oe = crypto.Aes(digest(owner, b"d" * 8, u)).cbc_encrypt(key, bytes(16))
    return key, {"Filter": Name("Standard"), "V": 5, "R": r, "O": o, "U": u, "OE": oe, "UE": ue, "P": -4, "CF": {"StdCF": {"CFM": Name("AESV3")}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}


@pytest.mark.parametrize("r", [5, 6])
def test_aes_256(r):
    key, encrypt = aes256(b"user", b"owner", r)
    for password in ("user", "owner"):
        assert crypto.Security(encrypt, b"", password).key == key
    with pytest.raises(WrongPassword):
        crypto.Security(encrypt, b"", "other")
    with pytest.raises(EncryptionProblem):
        crypto.Security(encrypt | {"V": 3}, b"", "user")


def two_pages(**save):
    w = Writer()
    f = {"Font": {"F1": w.core_font()}}
    w.page(show_lines(["Hello (World)", "second line"]), f)
    w.page(show_lines(["Page two"]), f, compress=True)
    return w.save(**save)


def texts(doc, space="screen"):
    return [untagged_text((text_record(t) for t in Interpreter(doc, p, space, ("text",))), space) for p in doc.pages()]


@pytest.mark.parametrize("save", [{}, {"xref": "stream"}, {"xref": "objects"}, {"damaged": True}, {"xref": "objects", "damaged": True}])
def test_any_cross_reference(save):
    doc = Document(two_pages(**save))
    assert texts(doc) == ["Hello (World)\nsecond line", "Page two"]
    assert doc.rebuilt == bool(save.get("damaged"))


def test_junk_before_the_header():
    doc = Document(b"x" * 86 + two_pages())
    assert (doc.offset, doc.rebuilt, len(doc.pages())) == (86, False, 2)


def test_truncated_and_empty_files():
    assert len(Document(two_pages()[:-200]).pages()) == 2
    assert Document(b"").pages() == []
    assert Document(b"%PDF-1.4\nnothing").pages() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 900), st.binary(min_size=1, max_size=30))
def test_damage_never_stops_a_reader(at, junk):
    data = two_pages()
    doc = Document(data[:at] + junk + data[at + len(junk) :])
    try:
        texts(doc)
        list(doc.all_objects())
    except (EncryptionProblem, SyntaxProblem):
        pass


def page_of(content, resources=None, **attrs):
    w = Writer()
    f = {"Font": {"F1": w.core_font("Courier")}} | (resources(w) if resources else {})
    w.page(content, f, **attrs)
    doc = Document(w.save())
    return doc, doc.pages()[0]


def items(content, space="default", resources=None, **attrs):
    doc, page = page_of(content, resources, **attrs)
    return list(Interpreter(doc, page, space))


def test_text_state():
    (t,) = items(b"BT /F1 10 Tf 1 Tc 2 Tw 50 Tz 5 Ts 100 200 Td (a b) Tj ET")
    assert [round(g.matrix[4], 6) for g in t.glyphs] == [100, 103.5, 108]
    assert t.matrix[5] == 205
    assert t.state.scaling == 50


def test_adjustments_move_the_pen():
    a, b = items(b"BT /F1 10 Tf [-1000] TJ (a) Tj [(b) 500 (c)] TJ ET")
    assert round(a.matrix[4], 6) == 10
    assert [round(g.matrix[4], 6) for g in b.glyphs] == [16, 17]


def test_paths_and_states():
    p, q = items(b"q 2 w 0 0 10 5 re B Q 0 0 m 5 5 l s n")
    assert (p.stroke, p.fill, p.bbox, p.state.linewidth) == (True, True, (0, 0, 10, 5), 2)
    assert [op for op, _ in q.segments] == ["m", "l", "h"] and q.state.linewidth == 1


def test_unknown_and_broken_operators():
    found = items(b"nonsense /F1 Tf (x) w BT /F1 9 Tf (ok) Tj ET 1 cm Q Q")
    assert [t.chars for t in found] == ["ok"]


def test_inline_image_and_marks():
    im, tag, t = items(b"BI /W 2 /H 2 /BPC 8 /CS /G ID \x00EI\xff EI /T MP /P <</MCID 3>> BDC BT /F1 9 Tf (x) Tj ET EMC")
    assert im.stream.raw == b"\x00EI\xff" and tag.mark.tag == "T" and t.mcid == 3


def test_extended_state():
    def state(w):
        return {"ExtGState": {"G": {"LW": 10, "LC": 1, "LJ": 2, "D": [[20], 10], "BM": [Name("Screen"), Name("Normal")], "CA": 0.8, "ca": 0.6, "Font": [w.core_font("Times-Roman"), 7]}}}

    (p,) = items(b"/G gs 0 0 m 1 1 l S", resources=state)
    s = p.state
    assert (s.linewidth, s.linecap, s.linejoin, s.dash, s.dash_phase, s.blend_mode, s.salpha, s.nalpha, s.fontsize) == (10, 1, 2, (20,), 10, ("Screen", "Normal"), 0.8, 0.6, 7)


def test_patterns():
    (p,) = items(b"/Cs cs 0.7 0.6 0.5 /P1 scn 0 0 1 1 re f", resources=lambda w: {"ColorSpace": {"Cs": [Name("Pattern"), Name("DeviceRGB")]}})
    assert (p.state.ncolor, p.state.npattern) == ((0.7, 0.6, 0.5), "P1")


@pytest.mark.parametrize("rotate, corner", [(0, (0, 0)), (90, (0, 600)), (180, (400, 600)), (270, (400, 0))])
def test_rotation(rotate, corner):
    m = initial_matrix((0, 0, 400, 600) if rotate % 180 == 0 else (0, 0, 600, 400), rotate, "page")
    assert (m[4], m[5]) == corner
    s = initial_matrix((10, 20, 410, 620), 0, "screen")
    assert transform_rect(s, (10, 20, 410, 620)) == (0, 0, 400, 600)


def test_matrices():
    assert multiply((2, 0, 0, 2, 0, 0), (1, 0, 0, 1, 5, 6)) == (2, 0, 0, 2, 5, 6)
    for a in (-0.5, -1, 1, 0.5, 0):
        for b in (-1, 0, 1):
            x0, y0, x1, y1 = transform_rect((a, b, -b, a, 0, 0), (0, 0, 100, 100))
            assert x1 - x0 == pytest.approx(100 * (abs(a) + abs(b))) and y1 - y0 == pytest.approx(100 * (abs(a) + abs(b)))


def test_numerals():
    assert [roman(n) for n in (1, 4, 9, 14, 40, 90, 400, 1990, 3999)] == ["i", "iv", "ix", "xiv", "xl", "xc", "cd", "mcmxc", "mmmcmxcix"]
    assert [letters(n) for n in (1, 26, 27, 28, 52, 703)] == ["a", "z", "aa", "ab", "az", "aaa"]
    assert [numeral(5, s) for s in ("D", "R", "r", "A", "a", None)] == ["5", "V", "v", "E", "e", ""]
    with pytest.raises(ValueError):
        roman(4000)


def test_strings():
    assert text_of(b"\xfe\xff\x00a\x20\xac") == "a€" and text_of(b"\x80\xe9") == "•é"
    assert shown_bytes(b"abc") == "abc" and shown_bytes(b"\xff\x01") == "base64:/wE="
    assert plain({"A": [Ref(3), b"x", Name("n"), Stream({}, b"1")]}) == {"A": ["<ref:3>", "x", "n", {"stream": {}, "length": 1}]}


def test_glyph_names_and_core_fonts():
    assert [glyph_text(n) for n in ("A", "eacute", "uni20AC", "u1F600", "f_i", "alpha", "A.alt", "nothing")] == ["A", "é", "€", "😀", "fi", "α", "A", ""]
    assert (core_widths("Helvetica")["W"], core_widths("Times-Roman")["é"]) == (944, 444)
    assert [core_font(n) for n in ("Arial,BoldItalic", "TimesNewRoman", "CourierNewPS-BoldMT", "Foo")] == ["Helvetica-BoldOblique", "Times-Roman", "Courier-Bold", None]


def test_cmaps():
    m = CMap.parse(b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 begincidrange <8000> <80FF> 100 endcidrange 1 beginbfrange <8000> <8002> [<0041> <0042> <D83DDE00>] endbfrange 1 beginbfchar <41> <00660069> endbfchar")
    assert list(m.codes(b"A\x80\x01")) == [(1, 0x41), (2, 0x8001)]
    assert m.cid(2, 0x8001) == 101 and m.texts == {0x8000: "A", 0x8001: "B", 0x8002: "😀", 0x41: "fi"}


def test_tree_lookup_by_limits():
    w = Writer()
    w.page(b"")
    leaves = [w.add({"Nums": [x for k in range(a, a + 10) for x in (k, k * 2)], "Limits": [a, a + 9]}) for a in (0, 10, 20)]
    doc = Document(w.save())
    root = {"Kids": leaves}
    assert doc.tree_lookup(root, 17, "Nums") == 34 and doc.tree_lookup(root, 99, "Nums") is None
    assert [k for k, _ in doc.number_tree(root)] == list(range(30))


def test_layout():
    body = show_lines(["left one", "left two"], size=10, leading=11, y=700) + b"\n" + show_lines(["right one"], size=10, x=400, y=700)
    doc, page = page_of(body)
    boxes = [p for p in analyse(Interpreter(doc, page, "page")) if p.kind == "textbox"]
    assert [(b.index, b.text) for b in boxes] == [(0, "left one\nleft two\n"), (1, "right one\n")]
    assert [b.text for b in analyse(Interpreter(doc, page, "page"), LayoutParams(boxes_flow=None)) if b.kind == "textbox"] == ["right one\n", "left one\nleft two\n"]
    with pytest.raises(ValueError):
        LayoutParams(boxes_flow=2)


def test_layout_paths():
    found = analyse(iter(items(b"0 0 m 9 0 l S 0 0 5 5 re f 0 0 m 1 2 3 4 5 6 c S", "page")))
    assert [p.kind for p in found] == ["line", "rect", "curve"]


def test_indirect_objects():
    assert lexer.indirect_object(b"7 0 obj << /Length 3 >> stream\nabc\nendstream endobj", 0)[2].raw == b"abc"
    assert lexer.indirect_object(b"7 0 obj << /Length 99 >> stream\r\nabc\nendstream endobj", 0)[2].raw == b"abc"
    assert lexer.indirect_object(b"7 0 obj [1 2", 0)[2] == [1, 2]
    with pytest.raises(SyntaxProblem):
        lexer.indirect_object(b"7 0 obj 5", 0, strict=True)


def test_literal_escapes():
    assert list(lexer.tokens(literal(b"a\\b(c)\rd")))[0].value == b"a\\b(c)\rd"


def test_predefined_cmaps(tmp_path):
    """Texts by the CMap's character set; CIDs from a CMap file where a folder has one."""

    def file(encoding, codes):
        w = Writer()
        child = w.add({"Type": Name("Font"), "Subtype": Name("CIDFontType0"), "BaseFont": Name("X"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Japan1", "Supplement": 2}})
        font = w.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("X"), "Encoding": Name(encoding), "DescendantFonts": [child]})
        w.page(b"BT /F1 10 Tf 0 0 Td <" + codes.hex().encode() + b"> Tj ET", {"Font": {"F1": font}})
        return w.save()

    said = "日本語 ABC"
    for encoding, codes in (("90ms-RKSJ-H", said.encode("cp932")), ("UniJIS-UCS2-H", said.encode("utf-16-be")), ("GBK-EUC-H", said.encode("gbk")), ("H", "日本語".encode("euc_jp").translate(bytes(b & 127 for b in range(256)))), ("KSCms-UHC-V", "한국어".encode("cp949"))):
        doc = Document(file(encoding, codes))
        assert [t.chars for t in Interpreter(doc, doc.pages()[0])] == [said if encoding[0] not in "HK" or len(codes) > 8 else "日本語" if encoding == "H" else "한국어"]
        assert any("no CMap" in x for x in doc.warnings)
    doc = Document(file("Nobody-Knows-H", b"\0A\0B"))
    assert [t.chars for t in Interpreter(doc, doc.pages()[0])] == [""]
    (tmp_path / "90ms-RKSJ-H").write_bytes(b"1 begincodespacerange <8140> <9ffc> endcodespacerange 1 begincidrange <93fa> <93fa> 3284 endcidrange")
    doc = Document(file("90ms-RKSJ-H", "日".encode("cp932")))
    doc.cmap_folder = str(tmp_path)
    (item,) = Interpreter(doc, doc.pages()[0])
    assert [(g.cid, g.text) for g in item.glyphs] == [(3284, "日")]


def test_layout_of_a_huge_glyph_ends():
    w = Writer()
    font = w.core_font()
    w.page(b"BT /F1 1000000 Tf (AB) Tj ET BT /F1 9 Tf 1 0 0 1 40 500 Tm (usual) Tj ET", {"Font": {"F1": font}})
    doc = Document(w.save())
    assert {p.kind for p in analyse(Interpreter(doc, doc.pages()[0], "page"))} == {"textbox"}


def test_attribute_revisions():
    """The highest revision counts alone."""
    doc = Document(Writer().save())
    assert doc._attributes([{"O": Name("A"), "X": 1}, 0, {"O": Name("A"), "Y": 2}, 3]) == {"O": "A", "Y": 2}


def test_passwords_that_cannot_be():
    assert crypto.prepared("a b­c") == "a bc" and crypto.prepared("Ⅸ") == "IX"
    for bad in ("a\u0007", "ا1", ""):
        with pytest.raises(WrongPassword):
            crypto.prepared(bad)


def test_forms_of_values():
    from vellum.core import values

    class Odd(bytes):
        pass

    values.register_form(Odd, lambda v: ["odd", len(v)])
    try:
        assert plain({"A": [Odd(b"xy"), b"xy"]}) == {"A": [["odd", 2], "xy"]}
    finally:
        values._FORMS.clear()


def test_glyph_names_and_widths_of_symbols():
    assert {n: glyph_text(n) for n in ("kahiragana", "smallhiragana", "acyrillic", "alefhebrew", "onecircle", "Amonospace", "fivesuperior", "kadeva")} == {"kahiragana": "か", "smallhiragana": "", "acyrillic": "а", "alefhebrew": "א", "onecircle": "①", "Amonospace": "Ａ", "fivesuperior": "⁵", "kadeva": "क"}
    assert core_widths("Symbol")["α"] == 631 and core_widths("ZapfDingbats")["✁"] == 974 and core_widths("Symbol")["∞"] == 713


def test_figures_have_their_own_parts():
    w = Writer()
    fonts = {"Font": {"F1": w.core_font()}}
    inner = w.stream(b"BT /F1 9 Tf 1 0 0 1 40 500 Tm (in) Tj ET 0 0 5 5 re f", Type=Name("XObject"), Subtype=Name("Form"), BBox=[0, 0, 600, 800], Resources=fonts)
    w.page(b"BT /F1 9 Tf 1 0 0 1 40 700 Tm (out) Tj ET /A Do", fonts | {"XObject": {"A": inner}})
    doc = Document(w.save())
    shape = lambda parts: [(q.kind, q.text, shape(q.parts) if q.kind == "figure" else None) for q in parts]
    read = lambda params: shape(analyse(Interpreter(doc, doc.pages()[0], "page"), params))
    assert read(LayoutParams()) == [("textbox", "out\n", None), ("figure", "", [("char", "i", None), ("char", "n", None), ("rect", "", None)])]
    assert read(LayoutParams(all_texts=True)) == [("textbox", "out\n", None), ("figure", "", [("textbox", "in\n", None), ("rect", "", None)])]
