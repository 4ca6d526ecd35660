"""PDF files to relations: one table function for each, over any DataFrame with doc_id and content.

A relation reads only what it needs of a file, in a worker, Arrow batch by Arrow batch, without a
shuffle; everything that follows is DataFrame work. A file that can't be read has a row with its
error in `documents` and none elsewhere, unless mode is "failfast". A null content is a file that
can't be read; an empty table gives empty relations.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..core.document import Document, Page
from ..core.fonts import Font
from ..core.interp import FORM, IMAGE, PATH, TAG, TEXT, Interpreter, Item, image_attrs, text_record
from ..core.layout import LayoutParams, analyse
from ..core.layout import rows as layout_rows
from ..core.lexer import content_operations
from ..core.lexer import tokens as lexer_tokens
from ..core.text import tagged_text, untagged_text
from ..core.values import PdfError, Ref, Stream, kind_of, plain

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
POINT = "struct<x:double,y:double>"
MARK = "struct<tag:string,mcid:int,props:string>"
COLOR = "struct<space:string,values:array<double>,pattern:string>"
GSTATE = (
    "struct<linewidth:double,linecap:int,linejoin:int,miterlimit:double,dash:array<double>,dash_phase:double,intent:string,stroke_adjustment:boolean,blend_mode:array<string>,smask:string,salpha:double,"
    f"nalpha:double,alpha_source:boolean,black_pt_comp:string,flatness:double,scolor:{COLOR},ncolor:{COLOR},fontname:string,fontsize:double,charspace:double,wordspace:double,scaling_pct:double,"
    "leading:double,render_mode:int,rise:double,knockout:boolean>"
)
SCHEMAS: dict[str, str] = {
    "documents": "doc_id bigint, length bigint, header_offset bigint, pdf_version string, is_tagged boolean, is_encrypted boolean, is_printable boolean, is_modifiable boolean, is_extractable boolean, xref_kind string, n_objects int, n_pages int, error string, warnings array<string>",
    "xref_entries": "doc_id bigint, section_rank int, kind string, objid bigint, genno int, pos bigint, stream_id bigint, stream_index int, is_free boolean",
    "objects": "doc_id bigint, seq int, objid bigint, genno int, pos bigint, container_id bigint, kind string, obj string, raw_length bigint, filters array<string>, decoded binary",
    "tokens": "doc_id bigint, stream_id bigint, pos bigint, kind string, text string, num double, bytes binary",
    "pages": f"doc_id bigint, page_idx int, page_objid bigint, label string, mediabox {RECT}, cropbox {RECT}, rotate int, struct_parents int, n_streams int, resources string",
    "page_ops": "doc_id bigint, page_idx int, op_seq int, pos bigint, op string, args string",
    "content_objects": f"doc_id bigint, page_idx int, op_seq int, item_seq int, xobj_path array<bigint>, object_type string, bbox {RECT}, ctm {MATRIX}, mcid int, mcid_stream bigint, mcstack array<{MARK}>, parent_key int, own_key int, gstate {GSTATE}, chars string, n_glyphs int, matrix {MATRIX}, origin {POINT}, displacement {POINT}, vertical boolean, fontbase string, size double, segments array<struct<op:string,points:array<{POINT}>>>, stroke boolean, fill boolean, evenodd boolean, name string, stream_id bigint, width int, height int, bits int, colorspace string, imagemask boolean, filters array<string>, tag {MARK}",
    "glyphs": f"doc_id bigint, page_idx int, op_seq int, item_seq int, xobj_path array<bigint>, glyph_idx int, cid int, text string, matrix {MATRIX}, dx double, dy double, bbox {RECT}, fontname string",
    "fonts": f"doc_id bigint, page_idx int, form_objid bigint, ordinal int, resource_name string, font_objid bigint, fontname string, fontbase string, font_type string, vertical boolean, ascent double, descent double, default_width double, flags int, bbox {RECT}, embedded_kind string, program binary",
    "annotations": f"doc_id bigint, page_idx int, annot_idx int, objid bigint, annot_type string, rect {RECT}, contents string, name string, mtime string, struct_parent int, action_type string, uri string, dest_name string, dest_page_idx int",
    "destinations": f"doc_id bigint, ordinal int, name string, page_idx int, display string, top double, left double, bbox {RECT}, zoom double",
    "outline_items": "doc_id bigint, node_id int, parent_id int, depth int, path array<int>, title string, action_type string, uri string, dest_page_idx int, display string, top double, left double, element_objid bigint",
    "struct_nodes": f"doc_id bigint, node_id int, parent_id int, last_node int, ancestors array<int>, depth int, path array<int>, kind string, type string, role string, page_idx int, mcid int, stream_id bigint, objid bigint, title string, lang string, alt string, expansion string, actual_text string, class_name string, attributes string, bbox {RECT}",
    "parent_tree": "doc_id bigint, parent_key int, mcid int, element_objid bigint",
    "label_ranges": "doc_id bigint, first_page int, style string, prefix string, start int",
    "name_entries": "doc_id bigint, tree string, ordinal int, key string, value string",
    "layout_items": f"doc_id bigint, page_idx int, item_id int, parent_id int, kind string, ordinal int, reading_index int, writing_mode string, text string, bbox {RECT}",
    "page_text": "doc_id bigint, page_idx int, label string, text string",
    "images": f"doc_id bigint, page_idx int, item_seq int, part string, name string, stream_id bigint, width int, height int, bits int, colorspace string, imagemask boolean, suffix string, bytes binary, bbox {RECT}",
    "glyph_contents": f"doc_id bigint, page_idx int, item_seq int, glyph_idx int, part_seq int, object_type string, bbox {RECT}, ctm {MATRIX}, chars string",
    "page_content": "doc_id bigint, page_idx int, content binary",
}
#: Output rows that a worker gathers before it hands them on, and the bytes that end a batch sooner.
BATCH = 2048


def _rect(r: Any) -> dict[str, float] | None:
    return None if r is None else {"x0": r[0], "y0": r[1], "x1": r[2], "y1": r[3]}


def _matrix(m: Any) -> dict[str, float]:
    return dict(zip("abcdef", m, strict=True))


def _point(p: Any) -> dict[str, float]:
    return {"x": p[0], "y": p[1]}


def _json(value: Any) -> str:
    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))


def _mark(m: Any) -> dict[str, Any] | None:
    return None if m is None else {"tag": m.tag, "mcid": m.mcid, "props": _json(m.props) if m.props else None}


def _gstate(s: Any) -> dict[str, Any]:
    return {
        "linewidth": s.linewidth, "linecap": s.linecap, "linejoin": s.linejoin, "miterlimit": s.miterlimit, "dash": list(s.dash), "dash_phase": s.dash_phase, "intent": s.intent, "stroke_adjustment": s.stroke_adjustment,
        "blend_mode": list(s.blend_mode), "smask": s.smask, "salpha": s.salpha, "nalpha": s.nalpha, "alpha_source": s.alpha_source, "black_pt_comp": s.black_pt_comp, "flatness": s.flatness,
        "scolor": {"space": s.scs, "values": list(s.scolor), "pattern": s.spattern}, "ncolor": {"space": s.ncs, "values": list(s.ncolor), "pattern": s.npattern}, "fontname": s.font.name if s.font else None,
        "fontsize": s.fontsize, "charspace": s.charspace, "wordspace": s.wordspace, "scaling_pct": s.scaling, "leading": s.leading, "render_mode": s.render_mode, "rise": s.rise, "knockout": s.knockout,
    }


Options = dict[str, Any]


def documents(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    pages = doc.pages()
    p = doc.permissions
    kind = "rebuilt" if doc.rebuilt else doc.entries[0].kind if doc.entries else None
    yield {"length": len(doc.data), "header_offset": doc.offset, "pdf_version": doc.version, "is_tagged": doc.tagged, "is_encrypted": doc.security is not None, "is_printable": p[0], "is_modifiable": p[1], "is_extractable": p[2], "xref_kind": kind, "n_objects": len({e.objid for e in doc.entries if not e.free}), "n_pages": len(pages), "error": None, "warnings": doc.warnings}


def xref_entries(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for e in doc.entries:
        yield {"section_rank": e.section, "kind": e.kind, "objid": e.objid, "genno": e.genno, "pos": e.pos, "stream_id": e.container, "stream_index": e.index, "is_free": e.free}


def objects(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    """Option key: only dictionaries and streams with such a key."""
    wanted, key = o.get("columns"), o.get("key")
    for k, (pos, objid, genno, container, v) in enumerate(doc.all_objects()):
        attrs = v.attrs if isinstance(v, Stream) else v
        if key is not None and not (isinstance(attrs, dict) and key in attrs):
            continue
        row = {"seq": k, "objid": objid, "genno": genno, "pos": pos, "container_id": container, "kind": kind_of(v), "obj": _json(attrs) if wanted is None or "obj" in wanted else None, "raw_length": None, "filters": None, "decoded": None}
        if isinstance(v, Stream):
            row |= {"raw_length": len(v.raw), "filters": [f for f, _ in doc.filters(v)]}
            if wanted is not None and "decoded" not in wanted:
                yield row
                continue
            try:
                row["decoded"] = doc.stream_bytes(v)
            except PdfError as e:
                doc.warnings.append(f"object {objid}: {e}")
        yield row


def _token_rows(data: bytes, stream: int | None) -> Iterator[dict[str, Any]]:
    for t in lexer_tokens(data):
        v = t.value
        yield {"stream_id": stream, "pos": t.pos, "kind": t.kind, "text": v if isinstance(v, str) else None, "num": float(v) if isinstance(v, int | float) else None, "bytes": v if isinstance(v, bytes) else None}


def tokens(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    """Of the whole file, with `of="pages"` of the pages' streams, with `of="forms"` of the forms that pages use, each once."""
    if o.get("of") == "forms":
        seen: set[int] = set()
        for page in doc.pages():
            for objid, form in _forms(doc, doc.dict_of(page.attrs.get("Resources")), seen):
                yield from _token_rows(doc.stream_bytes(form), objid)
        return
    if o.get("of") != "pages":
        yield from _token_rows(doc.data, None)
        return
    for page in doc.pages():
        for s in page.contents:
            yield from _token_rows(doc.stream_bytes(s), s.objid)


def _forms(doc: Document, resources: dict[str, Any], seen: set[int]) -> Iterator[tuple[int, Stream]]:
    """(object number, form) of what resources name and what that names, each once."""
    stack = [resources]
    while stack:
        for ref in doc.dict_of(stack.pop().get("XObject")).values():
            form = doc.resolve(ref)
            if isinstance(ref, Ref) and isinstance(form, Stream) and ref.objid not in seen and doc.resolve(form.attrs.get("Subtype")) == "Form":
                seen.add(ref.objid)
                yield ref.objid, form
                stack.append(doc.dict_of(form.attrs.get("Resources")))


def pages(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for p in doc.pages():
        key = doc.resolve(p.attrs.get("StructParents"))
        yield {"page_idx": p.index, "page_objid": p.objid, "label": p.label, "mediabox": _rect(p.mediabox), "cropbox": _rect(p.cropbox), "rotate": p.rotate, "struct_parents": key if type(key) is int else None, "n_streams": len(p.contents), "resources": _json({k: sorted(doc.dict_of(v)) if isinstance(doc.resolve(v), dict) else doc.resolve(v) for k, v in doc.dict_of(p.attrs.get("Resources")).items()})}


def _body(doc: Document, page: Page) -> bytes:
    return b"\n".join(doc.stream_bytes(s) for s in page.contents)


def page_content(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for p in _selected(doc, o):
        yield {"page_idx": p.index, "content": _body(doc, p)}


def page_ops(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    """Option ops: only these operators; their numbers are those among all."""
    ops = o.get("ops")
    for p in _selected(doc, o):
        for k, (pos, op, args) in enumerate(content_operations(_body(doc, p))):
            if ops is not None and op not in ops:
                continue
            yield {"page_idx": p.index, "op_seq": k, "pos": pos, "op": op, "args": _json(args)}


def _selected(doc: Document, o: Options) -> list[Page]:
    """The pages from first_page up to but without end_page."""
    return doc.pages()[o.get("first_page") or 0 : o.get("end_page")]


def _items(doc: Document, o: Options, kinds: Any) -> Iterator[tuple[Page, int, Item]]:
    fonts: dict[int, Font] = {}
    for p in _selected(doc, o):
        for k, item in enumerate(Interpreter(doc, p, o.get("space", "screen"), kinds, o.get("flat", True), fonts, *("columns" not in o or c in o["columns"] for c in ("bbox", "gstate", "segments")))):
            yield p, k, item


#: Columns of content_objects that are built by themselves, without the rest of the row.
_PARTS: dict[str, Callable[[Page, int, Item], Any]] = {
    "page_idx": lambda p, k, x: p.index,
    "op_seq": lambda p, k, x: x.seq,
    "item_seq": lambda p, k, x: k,
    "object_type": lambda p, k, x: x.kind,
    "bbox": lambda p, k, x: _rect(x.bbox),
    "mcid": lambda p, k, x: x.mcid,
    "mcid_stream": lambda p, k, x: n.stream if (n := x.numbered) else None,
    "mcstack": lambda p, k, x: [_mark(m) for m in x.marks],
    "parent_key": lambda p, k, x: n.key if (n := x.numbered) else x.parent_key,
    "own_key": lambda p, k, x: x.own_key,
    "chars": lambda p, k, x: x.chars if x.kind == TEXT else None,
    "n_glyphs": lambda p, k, x: x.n_glyphs if x.kind == TEXT else None,
    "stroke": lambda p, k, x: x.stroke if x.kind == PATH else None,
    "fill": lambda p, k, x: x.fill if x.kind == PATH else None,
    "evenodd": lambda p, k, x: x.evenodd if x.kind == PATH else None,
}


def content_objects(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    if o.get("columns") is not None and _PARTS.keys() >= (own := {c for c in o["columns"] if c != "doc_id"}):
        parts = [(c, _PARTS[c]) for c in own]
        for p, k, x in _items(doc, o, o.get("kinds") or (TEXT, PATH, IMAGE, FORM, TAG)):
            yield {c: f(p, k, x) for c, f in parts}
        return
    blank = dict.fromkeys(("chars", "n_glyphs", "matrix", "origin", "displacement", "vertical", "fontbase", "size", "segments", "stroke", "fill", "evenodd", "name", "stream_id", "width", "height", "bits", "colorspace", "imagemask", "filters", "tag"))
    wanted = o.get("columns")
    for p, k, x in _items(doc, o, o.get("kinds") or (TEXT, PATH, IMAGE, FORM, TAG)):
        n = x.numbered
        row = blank | {"page_idx": p.index, "op_seq": x.seq, "item_seq": k, "xobj_path": list(x.forms), "object_type": x.kind, "bbox": _rect(x.bbox), "ctm": _matrix(x.ctm), "mcid": n.mcid if n else None, "mcid_stream": n.stream if n else None, "parent_key": n.key if n else x.parent_key, "own_key": x.own_key}
        if wanted is None or "mcstack" in wanted:
            row["mcstack"] = [_mark(m) for m in x.marks]
        if wanted is None or "gstate" in wanted:
            row["gstate"] = _gstate(x.state)
        if x.kind == TEXT:
            m, font = x.matrix, x.state.font
            vertical = bool(font and font.vertical)
            row |= {"chars": x.chars, "n_glyphs": x.n_glyphs, "matrix": _matrix(m), "origin": _point((m[4], m[5])), "displacement": _point((x.end[0] - m[4], x.end[1] - m[5])), "vertical": vertical, "fontbase": font.name.split("+")[-1] if font else None, "size": (m[0] ** 2 + m[1] ** 2) ** 0.5 if vertical else (m[2] ** 2 + m[3] ** 2) ** 0.5}
        elif x.kind == PATH:
            row |= {"segments": [{"op": op, "points": [_point(q) for q in ps]} for op, ps in x.segments] if wanted is None or "segments" in wanted else None, "stroke": x.stroke, "fill": x.fill, "evenodd": x.evenodd}
        elif x.kind in (IMAGE, FORM):
            row |= {"name": x.name, "stream_id": x.stream.objid if x.stream else None, "filters": [f for f, _ in doc.filters(x.stream)] if x.stream else None}
            if x.kind == IMAGE and x.stream:
                a = image_attrs(doc, x.stream)
                row |= {"width": a["width"], "height": a["height"], "bits": a["bits"], "colorspace": a["colorspace"], "imagemask": a["mask"]}
        else:
            row["tag"] = _mark(x.mark)
        yield row


def glyphs(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for p, k, x in _items(doc, o, (TEXT,)):
        for n, g in enumerate(x.glyphs):
            yield {"page_idx": p.index, "op_seq": x.seq, "item_seq": k, "xobj_path": list(x.forms), "glyph_idx": n, "cid": g.cid, "text": g.text, "matrix": _matrix(g.matrix), "dx": g.displacement[0], "dy": g.displacement[1], "bbox": _rect(g.bbox), "fontname": x.state.font.name if x.state.font else None}


def glyph_contents(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    """What the glyphs of Type 3 fonts paint."""
    known: dict[int, Font] = {}
    for p in _selected(doc, o):
        reader = Interpreter(doc, p, o.get("space", "screen"), (TEXT, PATH, IMAGE), fonts=known)
        for k, x in enumerate(reader):
            for n, g in enumerate(x.glyphs):
                for m, y in enumerate(reader.glyph_items(x, g)):
                    yield {"page_idx": p.index, "item_seq": k, "glyph_idx": n, "part_seq": m, "object_type": y.kind, "bbox": _rect(y.bbox), "ctm": _matrix(y.ctm), "chars": y.chars or None}


def fonts(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    """Of the pages' resources; option forms: of the forms they use as well."""
    known: dict[Any, Font] = {}
    for p in _selected(doc, o):
        resources = doc.dict_of(p.attrs.get("Resources"))
        reader = Interpreter(doc, p, fonts=known)
        below = ((objid, doc.dict_of(form.attrs.get("Resources"))) for objid, form in _forms(doc, resources, set())) if o.get("forms") else ()
        for form, k, name, f in ((form, k, name, reader.font(own, name)) for form, own in ((None, resources), *below) for k, name in enumerate(doc.dict_of(own.get("Font")))):
            program = f._bytes(f.program) if o.get("programs") and f.program is not None else None
            yield {"page_idx": p.index, "form_objid": form, "ordinal": k, "resource_name": name, "font_objid": f.objid, "fontname": f.name, "fontbase": f.name.split("+")[-1], "font_type": f.type, "vertical": f.vertical, "ascent": float(f.ascent), "descent": float(f.descent), "default_width": f.default_width, "flags": f.flags, "bbox": _rect([float(x) for x in f.bbox]), "embedded_kind": f.embedded, "program": program}


def annotations(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for p in _selected(doc, o):
        for a in doc.annotations(p):
            yield {"page_idx": p.index, "annot_idx": a["annot_idx"], "objid": a["objid"], "annot_type": a["type"], "rect": _rect(a["rect"]), "contents": a["contents"], "name": a["name"], "mtime": a["mtime"], "struct_parent": a["struct_parent"], "action_type": a["action"], "uri": a["uri"], "dest_name": a["dest_name"], "dest_page_idx": a["dest_page_idx"]}


def destinations(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for k, (name, value) in enumerate(doc.destinations()):
        d = doc.destination(value, False) or dict.fromkeys(("page_idx", "display", "top", "left", "bbox", "zoom"))
        yield {"ordinal": k, "name": name, **d, "bbox": _rect(d["bbox"])}


def outline_items(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for n in doc.outline():
        d = n["dest"] or {}
        yield {"node_id": n["node_id"], "parent_id": n["parent_id"], "depth": n["depth"], "path": n["path"], "title": n["title"], "action_type": n["action"], "uri": n["uri"], "dest_page_idx": d.get("page_idx"), "display": d.get("display"), "top": d.get("top"), "left": d.get("left"), "element_objid": n["element"]}


def struct_nodes(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for n in doc.structure():
        said = {k: n.get(k) for k in ("node_id", "parent_id", "depth", "path", "kind", "type", "role", "page_idx", "mcid", "stream_id", "objid", "title", "lang", "alt", "expansion", "actual_text", "class_name")}
        yield said | {"last_node": n["last"], "ancestors": n["ancestors"], "attributes": _json(n["attributes"]) if n.get("attributes") else None, "bbox": _rect(n.get("bbox"))}


def parent_tree(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for key, mcid, objid in doc.parent_tree():
        yield {"parent_key": key, "mcid": mcid, "element_objid": objid}


def label_ranges(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    for first, style, prefix, start in doc.label_ranges():
        yield {"first_page": first, "style": style, "prefix": prefix, "start": start}


def name_entries(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    from ..core.values import text_of

    for tree, root in doc.dict_of(doc.catalog.get("Names")).items():
        for k, (key, value) in enumerate(doc.name_tree(root)):
            yield {"tree": tree, "ordinal": k, "key": text_of(key), "value": _json(doc.resolve(value))}


def layout_items(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    params = LayoutParams(**(o.get("params") or {}))
    known: dict[int, Font] = {}
    for p in _selected(doc, o):
        for r in layout_rows(analyse(Interpreter(doc, p, o.get("space", "page"), fonts=known), params)):
            if o.get("chars") or r["kind"] != "char":
                yield {"page_idx": p.index, **r, "bbox": _rect(r["bbox"])}


def page_text(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    tagged, known = doc.tagged and o.get("bbox") is None, {}
    space = o.get("space", "screen")
    for p in _selected(doc, o):
        own = (text_record(t) for t in Interpreter(doc, p, space, (TEXT,), fonts=known, boxes=False, states=False) if t.n_glyphs)
        yield {"page_idx": p.index, "label": p.label, "text": tagged_text(own, space) if tagged else untagged_text(own, space, o.get("bbox"))}


def images(doc: Document, o: Options) -> Iterator[dict[str, Any]]:
    """Each image, then its masks and alternates, as files; `part` says which of these."""
    from ..core.images import companions, image_file

    for p, k, x in _items(doc, o, (IMAGE,)):
        for part, stream in [("image", x.stream), *companions(doc, x.stream)]:
            a = image_attrs(doc, stream)
            suffix, data = image_file(doc, stream, a)
            yield {"page_idx": p.index, "item_seq": k, "part": part, "name": x.name, "stream_id": stream.objid, "width": a["width"], "height": a["height"], "bits": a["bits"], "colorspace": a["colorspace"], "imagemask": a["mask"], "suffix": suffix, "bytes": data, "bbox": _rect(x.bbox)}


READERS: dict[str, Callable[[Document, Options], Iterator[dict[str, Any]]]] = {
    f.__name__: f
    for f in (
        documents, xref_entries, objects, tokens, pages, page_ops, page_content, content_objects, glyphs, fonts, annotations, destinations, outline_items, struct_nodes, parent_tree, label_ranges,
        name_entries, layout_items, page_text, images, glyph_contents,
    )
}


def rows_of(relation: str, doc_id: Any, content: bytes | None, options: Options) -> Iterator[dict[str, Any]]:
    """The rows of one file in a relation."""
    yield from guarded(relation, doc_id, content, options, [])


def guarded(relation: str, doc_id: Any, content: bytes | None, options: Options, held: list[Document]) -> Iterator[dict[str, Any]]:
    """As rows_of; held keeps the file as it was read, for its next relation."""
    try:
        if not held:
            held.append(Document(bytes(content or b""), options.get("password", ""), options.get("strict", False)))
            held[0].cmap_folder = options.get("cmap_folder")
        for row in READERS[relation](held[0], options):
            yield {"doc_id": doc_id, **row}
    except (PdfError, ValueError, TypeError, IndexError, KeyError, AttributeError, RecursionError, ArithmeticError) as e:
        if options.get("mode") == "failfast":
            raise
        if relation == "documents":
            yield {"doc_id": doc_id, "length": None if content is None else len(content), "error": f"{type(e).__name__}: {e}", "warnings": []}


def column_definitions(ddl: str) -> dict[str, str]:
    """The columns of a schema with their definitions, without a session to parse it."""
    found, depth, start = {}, 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            own = ddl[start:k].strip()
            found[own.split()[0]] = own
            start = k + 1
    return found


def column_names(ddl: str) -> list[str]:
    return list(column_definitions(ddl))


def batches(schema: pa.Schema, rows: Iterator[dict[str, Any]]) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, Any]] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def relation(pdfs: DataFrame, name: str, doc_id: str = "doc_id", content: str = "content", **options: Any) -> DataFrame:
    """A relation of the files of pdfs. Columns first_page and end_page, where pdfs has them, limit each row's pages.

    Option columns: only these columns (and doc_id) are built and returned.
    """
    ranged = [c for c in ("first_page", "end_page") if c in pdfs.columns]
    full = StructType.fromDDL(SCHEMAS[name])
    if (columns := options.get("columns")) is not None:
        options["columns"] = columns = ["doc_id", *(c for c in columns if c != "doc_id")]
        full = StructType([full[c] for c in columns])
    schema = to_arrow_schema(full)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict[str, Any]]:
            for b in arrived:
                for k in range(b.num_rows):
                    own = dict(zip(ranged, (b.column(2 + i)[k].as_py() for i in range(len(ranged))), strict=True))
                    yield from rows_of(name, b.column(0)[k].as_py(), b.column(1)[k].as_py(), options | own)

        yield from batches(schema, every())

    return pdfs.select(pdfs[doc_id].cast("bigint").alias("doc_id"), content, *ranged).mapInArrow(run, full)


def relations(pdfs: DataFrame, wanted: Mapping[str, Options], doc_id: str = "doc_id", content: str = "content", **options: Any) -> dict[str, DataFrame]:
    """Several relations, each with options of its own, from one pass over the files: their rows are written, one beside
    the other, to the shared folder that spark.checkpoint.dir names, and read from there as often as they are used."""
    shapes = {name: StructType.fromDDL(SCHEMAS[name]) for name in wanted}
    own: dict[str, Options] = {}
    for name, said in wanted.items():
        own[name] = options | dict(said)
        if (columns := said.get("columns")) is not None:
            own[name]["columns"] = columns = ["doc_id", *(c for c in columns if c != "doc_id")]
            shapes[name] = StructType([shapes[name][c] for c in columns])
    full = StructType([StructField("relation", StringType()), *(StructField(name, shape) for name, shape in shapes.items())])
    schema = to_arrow_schema(full)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict[str, Any]]:
            for b in arrived:
                for k in range(b.num_rows):
                    held: list[Document] = []
                    for name, said in own.items():
                        for row in guarded(name, b.column(0)[k].as_py(), b.column(1)[k].as_py(), said, held):
                            yield {"relation": name, name: row}

        yield from batches(schema, every())

    rows = stored(pdfs.select(pdfs[doc_id].cast("bigint").alias("doc_id"), content).mapInArrow(run, full))
    return {name: rows.where(rows["relation"] == name).select(f"{name}.*") for name in wanted}


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder; on one machine, where none is named, in a folder of its own."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_pages(pdfs: DataFrame, pages_per_row: int) -> DataFrame:
    """pdfs with a row for each range of so many pages, so that long files are interpreted by several tasks."""
    from pyspark.sql import functions as F

    counts = relation(pdfs, "documents").select(F.col("doc_id").alias("counted"), "n_pages")
    rows = pdfs.join(counts, F.col("doc_id") == F.col("counted")).drop("counted").where("n_pages > 0")
    return rows.withColumn("first_page", F.explode(F.expr(f"sequence(0, n_pages - 1, {pages_per_row})"))).withColumn("end_page", F.expr(f"least(n_pages, first_page + {pages_per_row})")).drop("n_pages")


def register_functions(spark: SparkSession) -> None:
    """SQL table functions pdf_<relation>(doc_id, content [, options]), for LATERAL joins; options is a map of strings:
    password, space, mode, and with commas kinds, ops, columns (others are null)."""
    from pyspark.sql.functions import udtf

    for name in READERS:

        def make(relation_name: str) -> type:
            columns = column_names(SCHEMAS[relation_name])

            class Reader:
                def eval(self, doc_id: int, content: bytes, options: dict[str, str] | None = None) -> Iterator[tuple]:
                    said: Options = {k: v.split(",") if k in ("kinds", "ops", "columns") else v for k, v in (options or {}).items()}
                    for row in rows_of(relation_name, doc_id, content, said):
                        yield tuple(row.get(c) for c in columns)

            return Reader

        spark.udtf.register(f"pdf_{name}", udtf(make(name), returnType=SCHEMAS[name]))
