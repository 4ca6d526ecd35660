"""HTML extraction by wrappers: union-free regular expressions inferred from same-host pages.

A page becomes a stream of structural tags and text tokens. Comments, scripts and styles
are left out; inline tags and end tags that HTML lets authors omit are read through, so
that broken markup aligns. Runs of equal neighbours are folded into repeated groups. The
different streams of a host, most frequent first, are aligned one after the other with
the host's wrapper: equal parts stay, one copy against a repeated group joins the group,
and a stretch that one side lacks becomes an optional group. Each step accepts all that
the one before did, so the final wrapper matches every page it was inferred from. Texts
that differ between pages are slots; texts that all pages of a host share are template.

A page's text is that of its slots outside navigation, header, footer, aside and form
elements and outside elements whose class names advertising or menus; its title is the
slot of its title element. Only streams (a few bytes a token) and the hashes of slots are
shuffled, both after map-side aggregation; wrappers are broadcast while their counted
size allows it; beyond that the pages are joined by host, where Spark's adaptive join splits a
hot host's pages. A long page costs memory for its nodes and, between two anchors, a byte for
each pair of nodes.

Defined results: a null or empty page has host and no text, no slots, and matched true;
a null or unusable URL belongs to the host ""; among equally good alignments the one that goes
on in the wrapper first counts, and of equally frequent streams the least; repeated rows are extracted each; a host
with a single page has no template texts; a page without tags is one slot; an empty table
gives an empty result. Whole pages are read. Only page_id, url and html are used, so other
columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

TEXT = "#"
INLINE = frozenset("b i u s em strong small big br wbr a span font img sub sup abbr cite code kbd q mark time label tt ins del".split())
OMITTED = frozenset("p li dt dd tr td th thead tbody tfoot option html body head colgroup rt rp".split())
VOID = frozenset("meta link base hr input col area embed param source track".split())
OUTSIDE = frozenset("head nav header footer aside form menu select button".split())
NOISE = re.compile(r"(?i)(?:^|[-_.])(?:ads?|advert\w*|banner|sponsor\w*|promo|cookie\w*|sidebar|menu|nav\w*|breadcrumb\w*|footer|share|social)(?:$|[-_.])")
#: Bytes of wrappers up to which they are broadcast.
BROADCAST_BYTES = 8 << 20
#: Streams of a host that one task makes a wrapper of; the wrappers of more are merged.
PART_STREAMS = 256
DROPPED = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)", re.S | re.I)
#: A tag up to its end, where quotes may hold ">"; only for pages with such quotes.
TAG = re.compile(r"""<(/?[a-zA-Z!?](?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|$)|<""")
NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HOST = r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
COLUMNS = "page_id bigint, host string, title string, text string, n_slots int, n_template int, matched boolean"

Node = str | tuple  # a token, or (kind "?" or "+", the nodes within); a "+" within "?" is a star


class Kinds(dict):
    """What a tag (without its brackets) is: a structural token, "" for none, " " for a break within a text."""

    def __missing__(self, tag: str) -> str:
        found = self.kind(tag)
        if len(tag) < 60:
            if len(self) > 50_000:
                self.clear()
            self[tag] = found
        return found

    @staticmethod
    def kind(tag: str) -> str:
        m = NAME.match(tag)
        if not m:
            return " "
        name = m[2].lower()
        if name in INLINE:
            return " " if name in ("br", "wbr", "img") else ""
        if m[1]:
            return " " * (name in OMITTED or name in VOID) * 2 or "/" + name
        c = CLASS.search(tag, m.end())
        own = ".".join(sorted((c[1] or c[2] or c[3] or "").split())) if c else ""
        return f"{name}.{own}" if own else name


KINDS = Kinds()


def pieces(html: str) -> Iterator[tuple[str | None, str]]:
    """(tag, text after it); the tag is None for a text before the first tag and for a bare "<"."""
    parts = html.split("<")
    split = [(p[0], *p.partition(">")) if p else ("", "", "", "") for p in parts[1:]]
    plain = all(not (first.isalpha() or first in "/!?") or end and "'" not in tag and not tag.count('"') % 2 for first, tag, end, _ in split[:-1] if first)
    if plain and "'" not in (last := split[-1] if split else ("", "", "", ""))[1] and not last[1].count('"') % 2:
        yield None, parts[0]
        for p, (first, tag, _, text) in zip(parts[1:], split, strict=True):
            yield (tag, text) if first.isalpha() or first and first in "/!?" else (None, "<" + p)
        return
    at, tag_ = 0, None
    for m in TAG.finditer(html):
        yield tag_, ("<" if at and tag_ is None else "") + html[at : m.start()]
        at, tag_ = m.end(), m[1]
    yield tag_, ("<" if at and tag_ is None else "") + html[at:]


def tokens(html: str | None) -> tuple[list[str], list[str]]:
    """The structural tokens of a page, and the text of each TEXT among them, in order."""
    kinds: list[str] = []
    texts: list[str] = []
    held: list[str] = []
    for tag, text in pieces(DROPPED.sub(" ", html or "")):
        if tag is not None and (kind := KINDS[tag]):
            if kind == " ":
                held.append(" ")
            else:
                if held and (said := " ".join(unescape("".join(held)).split())):
                    kinds.append(TEXT)
                    texts.append(said)
                held = []
                if kind != "  ":
                    kinds.append(kind)
        if text:
            held.append(text)
    if held and (said := " ".join(unescape("".join(held)).split())):
        kinds.append(TEXT)
        texts.append(said)
    return kinds, texts


def fold(nodes: Sequence[Node]) -> tuple[Node, ...]:
    """Neighbouring copies of a stretch of any length as one repeated group; shorter stretches first."""
    at = list(nodes)
    numbers: dict[Node, int] = {}
    ids = np.array([numbers.setdefault(n, len(numbers)) for n in at], np.int64)
    size = 1
    while 2 * size <= len(at):
        unlike = np.flatnonzero(ids[size:] != ids[:-size])
        # how far the list equals itself, moved by a stretch, from each place on
        bounds = np.concatenate([[-1], unlike, [len(at) - size]])
        if np.diff(bounds).max() - 1 < size:
            size += 1
            continue
        out: list[Node] = []
        k = 0
        for before, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            first = max(k, before + 1)
            if stop - first < size or size == 1 and (at[first] == TEXT or isinstance(at[first], tuple)):
                continue
            out += at[k:first]
            out.append(("+", tuple(at[first : first + size])))
            k = first + size * (1 + (stop - first) // size)
        out += at[k:]
        at = out
        ids = np.array([numbers.setdefault(n, len(numbers)) for n in at], np.int64)
        size += 1
    return tuple(at)


def show(nodes: Sequence[Node]) -> str:
    """One line for a stream or wrapper; read() is its inverse."""
    return " ".join(n if isinstance(n, str) else f"( {show(n[1])} ){n[0]}" for n in nodes)


def read(line: str) -> tuple[Node, ...]:
    stack: list[list[Node]] = [[]]
    for word in line.split():
        if word == "(":
            stack.append([])
        elif word in (")?", ")+"):
            inner = tuple(stack.pop())
            stack[-1].append((word[1], inner))
        else:
            stack[-1].append(word)
    return tuple(stack[0])


def optional(nodes: Sequence[Node]) -> list[Node]:
    """The nodes as one optional group; none for none."""
    if not nodes:
        return []
    if len(nodes) == 1 and isinstance(nodes[0], tuple) and nodes[0][0] == "?":
        return [nodes[0]]
    return [("?", tuple(nodes))]


def meet(a: Node, b: Node) -> Node | None:
    """A node that accepts both, where two nodes correspond; None where they don't."""
    if a == b:
        return a
    if isinstance(a, str) or isinstance(b, str):
        # one copy of a stretch, or an optional one, against a token
        for x, y in ((a, b), (b, a)):
            if isinstance(x, tuple) and x[1] == (y,):
                return x
        return None
    if a[1] == b[1]:
        return a if a[0] == b[0] else ("?", (("+", a[1]),))
    if a[0] == b[0] == "+" and a[1][0] == b[1][0] and isinstance(a[1][0], str) and a[1][0] != TEXT:
        return ("+", align(a[1], b[1]))
    for x, y in ((a, b), (b, a)):
        if x[0] == "?" and len(x[1]) == 1 and (inner := meet(x[1][0], y)) is not None:
            return ("?", (inner,))
    return None


def align(wrapper: Sequence[Node], sample: Sequence[Node]) -> tuple[Node, ...]:
    """A wrapper that accepts all that either side does.

    Equal nodes at both ends correspond, and so do nodes that each side has once, in the longest
    run of them that is in one order; between two of these, the best alignment of what is left.
    """
    n, m = len(wrapper), len(sample)
    low = 0
    while low < min(n, m) and wrapper[low] == sample[low]:
        low += 1
    high = 0
    while high < min(n, m) - low and wrapper[n - 1 - high] == sample[m - 1 - high]:
        high += 1
    mine, other = wrapper[low : n - high], sample[low : m - high]
    out = list(wrapper[:low])
    i = j = 0
    for p, q in [*anchors(mine, other), (len(mine), len(other))]:
        out += best_alignment(mine[i:p], other[j:q])
        if p < len(mine):
            out.append(mine[p])
        i, j = p + 1, q + 1
    return tuple([*out, *wrapper[n - high :]])


def anchors(mine: Sequence[Node], other: Sequence[Node]) -> list[tuple[int, int]]:
    """Places of the nodes that both sides have exactly once: the longest increasing run of them."""
    once = {x for x, c in Counter(mine).items() if c == 1} & {x for x, c in Counter(other).items() if c == 1}
    at = {x: q for q, x in enumerate(other) if x in once}
    pairs = [(p, at[x]) for p, x in enumerate(mine) if x in once]
    ends: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, q) in enumerate(pairs):
        t = bisect_left(ends, q)
        back.append(last[t - 1] if t else -1)
        ends[t : t + 1] = [q]
        last[t : t + 1] = [k]
    k = last[-1] if last else -1
    out = []
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def best_alignment(wrapper: Sequence[Node], sample: Sequence[Node]) -> list[Node]:
    """By dynamic programming over all pairs of nodes; of the steps, one byte a pair is kept."""
    n, m = len(wrapper), len(sample)
    if not n or not m:
        return [*optional_each(wrapper), *optional_each(sample)]
    met: dict[tuple[Node, Node], Node | None] = {}

    def both(i: int, j: int) -> Node | None:
        key = wrapper[i], sample[j]
        if key not in met:
            met[key] = meet(*key)
        return met[key]

    def body(group: Node) -> tuple[Node, ...]:
        """The stretch of more than one node that a group repeats or leaves out."""
        if isinstance(group, str):
            return ()
        inner = group[1]
        if group[0] == "?" and len(inner) == 1 and isinstance(inner[0], tuple) and inner[0][0] == "+":
            inner = inner[0][1]
        return inner if len(inner) > 1 else ()

    own, theirs = [body(g) for g in wrapper], [body(g) for g in sample]
    longest = max(1, *map(len, [*own, *theirs]))
    step = [bytearray(m + 1) for _ in range(n + 1)]  # 1 and 2: pass one node by; 3: they meet; 4 and 5: a group and a copy of its stretch
    rows: dict[int, list[int]] = {}
    for i in range(n, -1, -1):
        rows[i] = here = [0] * (m + 1)
        rows.pop(i + longest + 1, None)
        for j in range(m, -1, -1):
            top, how = -1, 0
            if i < n and j < m:
                if both(i, j) is not None:
                    top, how = (1 if wrapper[i] == TEXT else 2) + rows[i + 1][j + 1], 3
                k = len(own[i])
                if k and j + k <= m and tuple(sample[j : j + k]) == own[i] and (v := 2 * k + rows[i + 1][j + k]) > top:
                    top, how = v, 4
                k = len(theirs[j])
                if k and i + k <= n and tuple(wrapper[i : i + k]) == theirs[j] and (v := 2 * k + rows[i + k][j + 1]) > top:
                    top, how = v, 5
            if i < n and rows[i + 1][j] > top:
                top, how = rows[i + 1][j], 1
            if j < m and here[j + 1] > top:
                top, how = here[j + 1], 2
            here[j], step[i][j] = max(top, 0), how
    out: list[Node] = []
    i = j = 0
    mine: list[Node] = []
    other: list[Node] = []
    while i < n or j < m:
        how = step[i][j]
        if how == 1:
            mine.append(wrapper[i])
            i += 1
            continue
        if how == 2:
            other.append(sample[j])
            j += 1
            continue
        out += [*optional_each(mine), *optional_each(other)]
        mine, other = [], []
        if how == 3:
            out.append(both(i, j))  # type: ignore[arg-type]
            i, j = i + 1, j + 1
        elif how == 4:
            out.append(wrapper[i])
            i, j = i + 1, j + len(own[i])
        else:
            out.append(sample[j])
            i, j = i + len(theirs[j]), j + 1
    return [*out, *optional_each(mine), *optional_each(other)]


def optional_each(nodes: Sequence[Node]) -> list[Node]:
    """A stretch that one side lacks: groups already optional stay on their own."""
    out: list[Node] = []
    run: list[Node] = []
    for node in nodes:
        if isinstance(node, tuple) and node[0] == "?":
            out += [*optional(run), node]
            run = []
        else:
            run.append(node)
    return out + optional(run)


class Wrapper:
    """A wrapper as a program of jumps and tokens, run with backtracking that never tries a state twice."""

    def __init__(self, nodes: Sequence[Node]) -> None:
        self.code: list[tuple] = []
        self.outside: list[bool] = []
        self.titles: set[int] = set()
        self._emit(nodes)
        self.code.append(("end",))
        self._roles()

    def _emit(self, nodes: Sequence[Node]) -> None:
        for node in nodes:
            if isinstance(node, str):
                self.code.append(("is", node))
            elif node[0] == "+":
                start = len(self.code)
                self._emit(node[1])
                self.code.append(("or", start, len(self.code) + 1))
            else:
                at = len(self.code)
                self.code.append(())
                self._emit(node[1])
                self.code[at] = ("or", at + 1, len(self.code))

    def _roles(self) -> None:
        """For each place of a text, whether it lies outside a page's content."""
        stack: list[str] = []
        for k, op in enumerate(self.code):
            self.outside.append(False)
            if op[0] != "is":
                continue
            name = op[1]
            if name == TEXT:
                self.outside[k] = outside(stack)
                if stack and stack[-1].split(".")[0] == "title":
                    self.titles.add(k)
            else:
                opened(stack, name)

    def match(self, kinds: Sequence[str]) -> list[int] | None:
        """The place in the wrapper of each text of a page; None where the wrapper doesn't accept it."""
        code, n = self.code, len(kinds)
        seen: set[int] = set()
        size = len(code)
        back: list[tuple[int, int, tuple | None]] = [(0, 0, None)]
        while back:
            pc, at, trail = back.pop()
            while True:
                op = code[pc]
                if op[0] == "is":
                    if at < n and kinds[at] == op[1]:
                        if op[1] == TEXT:
                            trail = (pc, trail)
                        pc, at = pc + 1, at + 1
                        continue
                    break
                key = at * size + pc
                if key in seen:
                    break
                seen.add(key)
                if op[0] == "or":
                    back.append((op[2], at, trail))
                    pc = op[1]
                    continue
                if at == n:
                    out = []
                    while trail is not None:
                        out.append(trail[0])
                        trail = trail[1]
                    return out[::-1]
                break
        return None


def opened(stack: list[str], name: str) -> None:
    """The stack of open elements after a tag; what omits its end ends with its parent or a next of its kind."""
    if name[0] == "/":
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].split(".")[0] == name[1:]:
                del stack[k:]
                return
        return
    base = name.split(".")[0]
    if base in VOID:
        return
    if base == "body" or base == "html" or (base not in ("title", "meta", "link", "base") and stack and stack[-1].split(".")[0] == "head"):
        while stack and stack[-1].split(".")[0] == "head":
            stack.pop()
    if base in OMITTED and stack and stack[-1].split(".")[0] == base:
        stack.pop()
    stack.append(name)


def outside(stack: Sequence[str]) -> bool:
    return any(s.split(".")[0] in OUTSIDE or s.split(".")[0] == "title" or any(NOISE.search(c) for c in s.split(".")[1:]) for s in stack)


def infer(streams: Sequence[str]) -> str:
    """The wrapper, as a line, of a host's streams in the order given; it accepts each of them."""
    wrapper: tuple[Node, ...] | None = None
    program: Wrapper | None = None
    for line in streams:
        nodes = read(line)
        if wrapper is None:
            wrapper = nodes
        elif program is not None and program.match(unrolled(nodes)) is not None and all(program.match(v) is not None for v in variants(nodes)):
            continue
        else:
            wrapper = align(wrapper, nodes)
        program = Wrapper(wrapper)
    return show(wrapper or ())


def merged(lines: Sequence[str]) -> str:
    """A wrapper that accepts all that any of these wrappers does."""
    out = read(lines[0])
    for line in lines[1:]:
        out = align(out, read(line))
    return show(out)


def unrolled(nodes: Sequence[Node], copies: int = 1) -> list[str]:
    out: list[str] = []
    for n in nodes:
        out += [n] if isinstance(n, str) else copies * unrolled(n[1], copies)
    return out


def variants(nodes: Sequence[Node]) -> Iterator[list[str]]:
    """Pages of a stream with two and three copies of its groups."""
    if any(not isinstance(n, str) for n in nodes):
        yield unrolled(nodes, 2)
        yield unrolled(nodes, 3)


def signed(text: str) -> int:
    """A 64-bit hash of a text."""
    return int.from_bytes(blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def pages_of(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    return pages.select("page_id", host.alias("host"), "html")


def streams(own: DataFrame) -> DataFrame:
    """(host, stream, n): the different folded streams of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = pa.array([show(fold(tokens(h)[0])) for h in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), lines], ["host", "stream"])

    return own.select("host", "html").mapInArrow(run, "host string, stream string").groupBy("host", "stream").agg(F.count("*").alias("n"))


def wrappers(found: DataFrame) -> DataFrame:
    """(host, wrapper) from the streams of each host: of parts of them first, so that no task has all of a large host's."""

    def part(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("n").to_pylist(), group.column("stream").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        return pa.table({"host": group.column("host")[:1], "n": pa.array([sum(n for n, _ in rows)], pa.int64()), "wrapper": pa.array([infer([s for _, s in rows])], pa.string())})

    def whole(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("n").to_pylist(), group.column("wrapper").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([merged([w for _, w in rows])], pa.string())})

    parts = found.groupBy("host").agg(F.ceil(F.count("*") / PART_STREAMS).alias("parts"))
    rows = found.join(parts, "host").withColumn("part", F.expr("pmod(xxhash64(stream), parts)"))
    return rows.groupBy("host", "part").applyInArrow(part, "host string, n bigint, wrapper string").groupBy("host").applyInArrow(whole, "host string, wrapper string")


class Programs(dict):
    """Compiled wrappers by their line."""

    def __missing__(self, line: str) -> Wrapper:
        self[line] = Wrapper(read(line))
        return self[line]


def slot_hashes(joined: DataFrame) -> DataFrame:
    """(host, slot, low, high, n): over a host's texts at each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programs = Programs()
        known: dict[tuple[str, int], list[int]] = {}
        for b in batches:
            for host, html, line in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                kinds, texts = tokens(html)
                for slot, text in zip(programs[line].match(kinds) or (), texts, strict=False):
                    h = signed(text)
                    at = known.setdefault((host, slot), [h, h, 0])
                    at[0], at[1], at[2] = min(at[0], h), max(at[1], h), at[2] + 1
            if len(known) > 100_000:
                yield batch(known)
                known = {}
        yield batch(known)

    def batch(known: Mapping[tuple[str, int], list[int]]) -> pa.RecordBatch:
        columns = [[k[0] for k in known], [k[1] for k in known], *([v[i] for v in known.values()] for i in range(3))]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "slot", "low", "high", "n"])

    rows = joined.select("host", "html", "wrapper").mapInArrow(run, "host string, slot int, low bigint, high bigint, n bigint")
    return rows.groupBy("host", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def extracted(html: str | None, program: Wrapper, template: frozenset[int]) -> tuple[str | None, str | None, int, int, bool]:
    """(title, text, slots, template texts, matched) of a page."""
    kinds, texts = tokens(html)
    places = program.match(kinds)
    if places is None:  # no wrapper: every text is a slot
        return None, "\n".join(texts) or None, len(texts), 0, False
    title = next((t for p, t in zip(places, texts, strict=True) if p in program.titles), None)
    kept = [t for p, t in zip(places, texts, strict=True) if not program.outside[p] and p not in template]
    fixed = sum(p in template for p in places)
    return title, "\n".join(kept) or None, len(places) - fixed, fixed, True


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for every row of pages: its title and text by its host's wrapper."""
    own = pages_of(pages)
    found = checkpointed(wrappers(checkpointed(streams(own))))  # the streams are read twice, the pages aren't
    size = found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0

    def with_(rules: DataFrame) -> DataFrame:
        return own.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "host")

    counts = own.groupBy("host").agg(F.count("*").alias("pages"))
    fixed = slot_hashes(with_(found)).where("low = high and n > 1").join(counts, "host").where("n >= pages").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"))
    rules = checkpointed(found.join(fixed, "host", "left").select("host", "wrapper", F.coalesce("template", F.array().cast("array<int>")).alias("template")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programs = Programs()
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        for b in batches:
            rows = [(page, host, *extracted(html, programs[line], frozenset(slots))) for page, host, html, line, slots in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return with_(rules).select("page_id", "host", "html", "wrapper", "template").mapInArrow(run, COLUMNS)
