"""The joins, searches, aggregates and orders over the relations, all as DataFrame work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

#: Side of a cell of the spatial joins, in units of user space.
CELL = 50.0
#: Cells of a box up to which it is joined by them: about four pages of letter size.
MOST_CELLS = 1024
#: What marked_content reads of content_objects.
SECTION_COLUMNS = ("doc_id", "page_idx", "item_seq", "object_type", "mcid", "mcid_stream", "mcstack", "chars", "bbox")


def latest_objects(xref: DataFrame) -> DataFrame:
    """The entry of each object from the newest section that has it in use."""
    w = Window.partitionBy("doc_id", "objid").orderBy("section_rank")
    return xref.where("not is_free").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, page_idx, label): each page by the last range that starts at or before it, as one sorted pass."""
    p = pages.select("doc_id", "page_idx", F.lit(None).cast("struct<first:int,style:string,prefix:string,start:int>").alias("r"), F.lit(1).alias("is_page"))
    r = ranges.select("doc_id", F.col("first_page").alias("page_idx"), F.struct(F.col("first_page").alias("first"), "style", "prefix", "start").alias("r"), F.lit(0).alias("is_page"))
    w = Window.partitionBy("doc_id").orderBy("page_idx", "is_page").rowsBetween(Window.unboundedPreceding, 0)
    at = p.unionByName(r).withColumn("own", F.last("r", ignorenulls=True).over(w)).where("is_page = 1")
    n = F.col("own.start") + F.col("page_idx") - F.col("own.first")
    said = F.when(F.col("own").isNull(), (F.col("page_idx") + 1).cast("string")).otherwise(F.concat(F.col("own.prefix"), T.numeral(n, F.col("own.style"))))
    return at.select("doc_id", "page_idx", said.alias("label"))


def page_by_label(pages: DataFrame) -> DataFrame:
    """The first page of each label."""
    return pages.groupBy("doc_id", "label").agg(F.min("page_idx").alias("page_idx"))


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """Pages by a list such as "all", "1,3-5" or "10-4", counted from 1; a backward range is turned round."""
    wanted: list[Column] = []
    for part in spec.split(","):
        part = part.strip()
        if part == "all":
            return pages
        a, _, b = part.partition("-")
        low, high = sorted((int(a), int(b or a)))
        wanted.append(F.col("page_idx").between(low - 1, high - 1))
    cond = wanted[0]
    for c in wanted[1:]:
        cond = cond | c
    return pages.where(cond)


def document_fonts(fonts: DataFrame) -> DataFrame:
    """One font for each name: the last that defines it."""
    rest = [c for c in fonts.columns if c not in ("doc_id", "fontname")]
    return fonts.groupBy("doc_id", "fontname").agg(F.max_by(F.struct(*rest), F.struct("page_idx", "ordinal")).alias("f")).select("doc_id", "fontname", "f.*")


def spatial_join(left: DataFrame, right: DataFrame, on: list[str], left_box: str = "bbox", right_box: str = "bbox", cell: float = CELL) -> DataFrame:
    """Pairs of overlapping boxes within equal keys, each once.

    Boxes of few cells meet by grid cell, each pair at its lower left one; a box of more than
    MOST_CELLS, which overlaps most of its page, meets the other side by the keys alone.
    Columns of the right side are prefixed with r_.
    """
    la, ra = F.col(left_box), F.col("r_" + right_box)

    def key(i: Column, j: Column, how: int) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(how).alias("how"))

    def meeting(box: Column, small: tuple[int, ...], large: tuple[int, ...]) -> Column:
        alone = lambda hows: F.array(*(key(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), h) for h in hows))
        grid = F.transform(G.cells(box, cell), lambda c: key(c.getField("i"), c.getField("j"), 0))
        return F.explode(F.when(G.cell_count(box, cell) <= MOST_CELLS, F.concat(grid, alone(small))).otherwise(alone(large)))

    # 0: by cell; 1: large ones of the left and all of the right; 2: small ones of the left and large ones of the right
    a = left.withColumn("cell_", meeting(la, (2,), (1,)))
    b = right.select(*(F.col(c).alias("r_" + c) for c in right.columns)).withColumn("r_cell_", meeting(ra, (1,), (1, 2)))
    first_i = F.greatest(F.floor(la.getField("x0") / cell), F.floor(ra.getField("x0") / cell))
    first_j = F.greatest(F.floor(la.getField("y0") / cell), F.floor(ra.getField("y0") / cell))
    once = (F.col("cell_.how") > 0) | (F.col("cell_.i") == first_i) & (F.col("cell_.j") == first_j)
    cond = (F.col("cell_") == F.col("r_cell_")) & G.overlaps(la, ra) & once
    for k in on:
        cond = cond & (F.col(k) == F.col("r_" + k))
    return a.join(b, cond).drop("cell_", "r_cell_")


def in_region(items: DataFrame, x0: float, y0: float, x1: float, y1: float, box: str = "bbox") -> DataFrame:
    return items.where(G.overlaps(F.col(box), G.rect(*map(F.lit, (x0, y0, x1, y1)))))


def marked_content(items: DataFrame) -> DataFrame:
    """(doc_id, page_idx, mcid_stream, mcid, text, bbox, n_items, first_seq): of runs with one mcid, the last counts.

    Numbers hold within a content stream; mcid_stream is the form's object number, null for the page itself.
    Items without a bbox give sections without one.
    """
    by = ["doc_id", "page_idx"]
    w = Window.partitionBy(*by).orderBy("item_seq")
    inner = F.try_element_at("mcstack", F.lit(-1))
    actual = F.get_json_object(inner.getField("props"), "$.ActualText")
    said = F.when(F.col("object_type") == "text", F.coalesce(actual, F.col("chars")))
    # only what is joined goes through the shuffle, and one sort serves the runs
    boxes = ["bbox"] if "bbox" in items.columns else []
    narrow = items.select(*by, "item_seq", "mcid", "mcid_stream", said.alias("said_"), *boxes)
    own = F.struct("mcid", "mcid_stream")
    runs = narrow.withColumn("new_", (~own.eqNullSafe(F.lag(own).over(w))).cast("int")).withColumn("run_", F.sum("new_").over(w)).where("mcid is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said_").isNotNull(), F.struct("item_seq", "said_")))), lambda s: s.getField("said_")), "")
    box = [G.union_boxes(F.col("bbox")).alias("bbox")] if boxes else []
    each = runs.groupBy(*by, "mcid_stream", "mcid", "run_").agg(T.without_soft_hyphens(joined).alias("text"), *box, F.count("*").alias("n_items"), F.min("item_seq").alias("first_seq"))
    last = each.groupBy(*by, "mcid_stream", "mcid").agg(F.max_by(F.struct("text", *boxes, "n_items", "first_seq"), "run_").alias("last_"))
    return last.select(*by, "mcid_stream", "mcid", "last_.*")


def find_elements(nodes: DataFrame, role: str | None = None, pattern: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """Elements by role, or by a pattern that the role starts with, in pre-order; within: subtrees (doc_id, node_id, last_node)."""
    found = nodes.where("kind = 'element'")
    if role is not None:
        found = found.where(F.col("role") == role)
    if pattern is not None:
        found = found.where(F.col("role").rlike(f"^(?:{pattern})"))
    if within is not None:
        tops = within.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("t_node"))
        lines = found.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("own_"), F.explode("ancestors").alias("t_node")).join(tops, ["t_doc", "t_node"], "left_semi")
        found = found.join(lines, (F.col("doc_id") == F.col("t_doc")) & (F.col("node_id") == F.col("own_")), "left_semi")
    return found


def find_first(nodes: DataFrame, role: str) -> DataFrame:
    """The first element of a role in each document."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    return find_elements(nodes, role).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def climb(nodes: DataFrame, start: DataFrame, role: str) -> DataFrame:
    """(doc_id, start_id, node_id): for each start (doc_id, start_id), the nearest element of a role at or above it.

    Each start goes to itself and its ancestors, so the work follows the tree's depth.
    """
    lines = nodes.select(F.col("doc_id").alias("n_doc"), F.col("node_id").alias("n_node"), F.explode(F.array_append("ancestors", F.col("node_id"))).alias("i_node"))
    own = start.select("doc_id", "start_id").join(lines, (F.col("doc_id") == F.col("n_doc")) & (F.col("start_id") == F.col("n_node")))
    targets = nodes.where((F.col("kind") == "element") & (F.col("role") == role)).select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("t_node"), "depth")
    pairs = own.join(targets, (F.col("doc_id") == F.col("t_doc")) & (F.col("i_node") == F.col("t_node")))
    return pairs.groupBy("doc_id", "start_id").agg(F.max_by("t_node", "depth").alias("node_id"))


def element_text(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, node_id, text, bbox) of each element, over all marked content below it.

    Each item goes to its ancestors, which struct_nodes lists, so the work follows the tree's depth.
    """
    items = nodes.where("kind = 'item'").select("doc_id", F.col("node_id").alias("item_id"), "page_idx", F.col("stream_id").alias("mcid_stream"), "mcid", F.col("ancestors").alias("above_"))
    s = sections.select(F.col("doc_id").alias("s_doc"), F.col("page_idx").alias("s_page"), F.col("mcid_stream").alias("s_stream"), F.col("mcid").alias("s_mcid"), "text", F.col("bbox").alias("box_"))
    same = (F.col("doc_id") == F.col("s_doc")) & (F.col("page_idx") == F.col("s_page")) & (F.col("mcid") == F.col("s_mcid")) & F.col("mcid_stream").eqNullSafe(F.col("s_stream"))
    said = items.join(s, same).select("doc_id", "item_id", "page_idx", "text", "box_", F.explode("above_").alias("i_node"))
    tops = nodes.where("kind = 'element'").select(F.col("doc_id").alias("t_doc"), "node_id", F.col("page_idx").alias("own_page"), F.col("bbox").alias("given_"))
    pairs = tops.join(said, (F.col("doc_id") == F.col("t_doc")) & (F.col("i_node") == F.col("node_id")), "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("item_id").isNotNull(), F.struct("item_id", "text")))), lambda s: s.getField("text")), "")
    box = G.union_boxes(F.when(F.col("page_idx") == F.col("own_page"), F.col("box_")))
    grouped = pairs.groupBy(F.col("t_doc").alias("doc_id"), "node_id").agg(text.alias("text"), F.coalesce(F.first("given_"), box).alias("bbox"))
    return grouped


def content_elements(items: DataFrame, parents: DataFrame) -> DataFrame:
    """Items with the object number of the structure element they belong to, or null.

    An image or form with an entry of its own in the parent tree belongs to that; else the entry of its section counts.
    """
    p = parents.select(F.col("doc_id").alias("p_doc"), F.col("parent_key").alias("p_key"), F.col("mcid").alias("p_mcid"), F.col("element_objid").alias("by_mcid_"))
    o = parents.where("mcid is null").select(F.col("doc_id").alias("o_doc"), F.col("parent_key").alias("o_key"), F.col("element_objid").alias("by_key_"))
    found = items.join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("parent_key") == F.col("p_key")) & (F.col("mcid") == F.col("p_mcid")), "left")
    found = found.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("own_key") == F.col("o_key")), "left")
    return found.withColumn("element_objid", F.coalesce("by_key_", "by_mcid_")).drop("p_doc", "p_key", "p_mcid", "by_mcid_", "o_doc", "o_key", "by_key_")


def page_by_objid(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (doc_id, objid, ...) with the page that is this object; the first page of a number counts."""
    first = pages.groupBy("doc_id", F.col("page_objid").alias("objid")).agg(F.min("page_idx").alias("page_idx"))
    return refs.join(first, ["doc_id", "objid"])


def device_destinations(destinations: DataFrame, pages: DataFrame, space: str = "screen") -> DataFrame:
    """Destinations with left, top and bbox in a device space of their pages."""
    m = G.initial_matrix(F.col("mediabox"), F.col("rotate"), space)
    at = G.apply_point(m, F.col("left"), F.col("top"))
    rest = [c for c in destinations.columns if c not in ("left", "top", "bbox")]
    own = destinations.join(pages.select("doc_id", "page_idx", "mediabox", "rotate"), ["doc_id", "page_idx"], "left")
    return own.select(*rest, at.getField("x").alias("left"), at.getField("y").alias("top"), G.transform_rect(m, F.col("bbox")).alias("bbox"))


def content_order(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Items and objects with their place on the page (doc_id, node_id, page_idx, place): objects first, then sections as the
    streams open them, and sections that aren't on the page last, each in the tree's order."""
    s = sections.select(F.col("doc_id").alias("s_doc"), F.col("page_idx").alias("s_page"), F.col("mcid_stream").alias("s_stream"), F.col("mcid").alias("s_mcid"), "first_seq")
    own = nodes.where("kind in ('item', 'object')")
    same = (F.col("doc_id") == F.col("s_doc")) & (F.col("page_idx") == F.col("s_page")) & (F.col("mcid") == F.col("s_mcid")) & F.col("stream_id").eqNullSafe(F.col("s_stream"))
    w = Window.partitionBy("doc_id", "page_idx").orderBy(F.col("kind") != "object", F.col("first_seq").asc_nulls_last(), "node_id")
    return own.join(s, same, "left").select("doc_id", "node_id", "page_idx", (F.row_number().over(w) - 1).alias("place"))


def with_identity(nodes: DataFrame) -> DataFrame:
    """Structure nodes with a hash that two rows share only if they are one element: by object number, else by place in the tree."""
    return nodes.withColumn("identity", F.xxhash64("doc_id", "kind", F.col("objid"), F.when(F.col("objid").isNull(), F.col("path"))))


def object_targets(nodes: DataFrame, annotations: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, node_id, objid, target, annot_idx, item_seq): what the tree's objects are, an annotation or the first image or form painted."""
    own = nodes.where("kind = 'object'").select("doc_id", "node_id", "objid")
    a = annotations.groupBy("doc_id", "objid").agg(F.min_by(F.struct("page_idx", "annot_idx"), F.struct("page_idx", "annot_idx")).alias("a"))
    x = items.where("object_type in ('image', 'xobject')").groupBy("doc_id", F.col("stream_id").alias("objid")).agg(F.min_by(F.struct("object_type", "page_idx", "item_seq"), F.struct("page_idx", "item_seq")).alias("x"))
    found = own.join(a, ["doc_id", "objid"], "left").join(x, ["doc_id", "objid"], "left")
    return found.select("doc_id", "node_id", "objid", F.when(F.col("a").isNotNull(), "annotation").otherwise(F.col("x.object_type")).alias("target"), F.coalesce("a.page_idx", "x.page_idx").alias("page_idx"), "a.annot_idx", "x.item_seq")


def link_graph(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, source, target, links): labels of pages that links lead from and to."""
    src = pages.select("doc_id", F.col("page_idx"), F.col("label").alias("source"))
    dst = pages.select("doc_id", F.col("page_idx").alias("dest_page_idx"), F.col("label").alias("target"))
    return annotations.where("annot_type = 'Link' and dest_page_idx is not null").join(src, ["doc_id", "page_idx"]).join(dst, ["doc_id", "dest_page_idx"]).groupBy("doc_id", "source", "target").agg(F.count("*").alias("links"))


def link_texts(annotations: DataFrame, items: DataFrame, box: str = "rect") -> DataFrame:
    """URI links with the texts they lie over, in stream order."""
    links = annotations.where("uri is not null").withColumnRenamed(box, "link_box")
    texts = items.where("object_type = 'text'").select("doc_id", "page_idx", "item_seq", "chars", "bbox")
    pairs = spatial_join(links, texts, ["doc_id", "page_idx"], "link_box", "bbox")
    return pairs.groupBy("doc_id", "page_idx", "annot_idx", "uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_item_seq", "r_chars"))), lambda s: s.getField("r_chars")), " ").alias("text"))


def named_targets(annotations: DataFrame, destinations: DataFrame) -> DataFrame:
    """Annotations with what their named destination shows; the first definition of a name counts."""
    d = destinations.groupBy("doc_id", F.col("name").alias("dest_name")).agg(F.min_by(F.struct("page_idx", "display", "top", "left", "zoom"), "ordinal").alias("target"))
    return annotations.join(d, ["doc_id", "dest_name"], "left")


def reference_closure(objects: DataFrame, roots: DataFrame, skip: tuple[str, ...] = ("Parent", "P"), rounds: int = 50) -> DataFrame:
    """(doc_id, objid, distance): what is reached from roots (doc_id, objid) by references, each object once.

    Keys in skip aren't followed. One join a level; a level that finds nothing new is the last, and
    references deeper than so many rounds are an error.
    """
    quoted = "|".join(skip)
    latest = objects.groupBy("doc_id", "objid").agg(F.max_by("obj", "seq").alias("obj"))
    text = F.regexp_replace("obj", f'"(?:{quoted})":"<ref:\\d+>"', "")
    edges = latest.select("doc_id", "objid", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r'"<ref:(\d+)>"'), F.lit(1)))).alias("to")).select("doc_id", "objid", F.col("to").cast("bigint").alias("to"))
    known = roots.select("doc_id", "objid", F.lit(0).alias("distance"))
    front = known
    for k in range(1, rounds):
        front = front.join(edges, ["doc_id", "objid"]).select("doc_id", F.col("to").alias("objid")).distinct().join(known.select("doc_id", "objid"), ["doc_id", "objid"], "left_anti").withColumn("distance", F.lit(k))
        front = front.checkpoint() if front.sparkSession.sparkContext.getCheckpointDir() else front.cache()
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    raise ValueError(f"references are deeper than {rounds} levels")


def styled_spans(items: DataFrame) -> DataFrame:
    """Texts as HTML spans with their font and size."""
    inner = F.replace(F.replace(F.replace("chars", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    style = F.concat(F.lit("<span style=\"font-family: '"), F.col("fontbase"), F.lit("'; font-size: "), F.bround("size").cast("int").cast("string"), F.lit('pt">'), inner, F.lit("</span>"))
    return items.where("object_type = 'text'").select("doc_id", "page_idx", "item_seq", style.alias("html"))


def svg_paths(items: DataFrame) -> DataFrame:
    """Paths as SVG path data, in device space."""
    letter = F.create_map(*[F.lit(x) for pair in (("m", "M"), ("l", "L"), ("c", "C"), ("v", "Q"), ("y", "Q"), ("h", "Z")) for x in pair])
    points = lambda s: F.array_join(F.transform(s.getField("points"), lambda p: F.concat_ws(",", F.round(p.getField("x"), 3), F.round(p.getField("y"), 3))), " ")
    data = F.array_join(F.transform("segments", lambda s: F.concat(letter[s.getField("op")], points(s))), " ")
    return items.where("object_type = 'path'").select("doc_id", "page_idx", "item_seq", data.alias("d"))
