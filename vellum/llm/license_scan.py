"""License scan: an exact set-similarity join of text blocks with licence templates.

A block is a line of a text, or a run of neighbouring lines without a wordless line between
them that has at most ``LONGEST`` times as many words (counted each) as the template has
different ones, so that statements wrapped in any way are found; it and the templates are
sets of lower-case ASCII words. A block matches a template when it holds at least
``threshold`` of the template's words; of blocks within one another the shortest that match
are reported, each by its first line and number of lines. A template's words are ordered by their frequency over all lines of the corpus, rarest
first: with a needed overlap of o of n words, a block must have one of the first n - o + 1
(prefix filter), must have o words itself (length filter), and, with its first common word
at position p, can reach at most n - p of them (positional filter). What passes is
verified, so that the result is exactly that of comparing all pairs.

Defined results: null and empty texts have no blocks; a null doc_id is reported as null;
repeated rows give repeated results; of several templates a block matches, all are given;
an empty table gives an empty result. Only doc_id and text are read, so other columns may
have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
WORD = re.compile("[a-z0-9]+")
COLUMNS = "doc_id bigint, block int, lines int, template string, overlap int, template_words int, containment double"
#: Words of a run of lines against the template's different words.
LONGEST = 2
#: Templates up to this many words in all are shipped with the tasks; more are joined in parts.
PART_WORDS = 500_000

#: Statements by which licences are named or granted.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
}


def words(block: str) -> list[str]:
    return WORD.findall(block.lower())


def needed(n: int, threshold: float) -> int:
    """Words of n that the threshold asks for; 1 at least."""
    return max(1, math.ceil(threshold * n - 1e-9))


def template_frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """The number of blocks, over the whole table, that hold each word of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for block in text.lower().split("\n"):
                    found = vocabulary.intersection(WORD.findall(block))
                    if found:
                        n.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: n for w, n in rows}


class Index:
    """The templates' prefixes: word -> (template, position)."""

    def __init__(self, templates: Mapping[str, str], frequency: Mapping[str, int], threshold: float) -> None:
        self.ordered = {k: sorted(set(words(t)), key=lambda w: (frequency.get(w, 0), w)) for k, t in templates.items()}
        self.need = {k: needed(len(o), threshold) for k, o in self.ordered.items()}
        self.sets = {k: frozenset(o) for k, o in self.ordered.items()}
        self.at: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for k, o in self.ordered.items():
            for p, w in enumerate(o[: len(o) - self.need[k] + 1]):
                self.at[w].append((k, p))
        self.prefixes = frozenset(self.at)

    def matches(self, own: frozenset[str] | set[str], among: Mapping[str, int] | None = None) -> list[tuple[str, int, int, float]]:
        """(template, overlap, template words, containment) of a block's different words; among: the templates that may match."""
        first: dict[str, int] = {}
        for w in self.prefixes & own:
            for k, p in self.at[w]:
                if p < first.get(k, 1 << 30) and (among is None or k in among):
                    first[k] = p
        out = []
        for k, p in first.items():
            need, n = self.need[k], len(self.sets[k])
            if len(own) < need or n - p < need:
                continue
            overlap = len(self.sets[k] & own)
            if overlap >= need:
                out.append((k, overlap, n, overlap / n))
        return out

    def blocks(self, text: str) -> Iterator[tuple[int, int, str, int, int, float]]:
        """(first line, lines, template, ...) of every block that matches and holds no shorter one that does."""
        paragraph: list[list[str]] = []
        start = 0
        for k, line in enumerate([*text.lower().split("\n"), ""]):
            found = WORD.findall(line)
            if found:
                if not paragraph:
                    start = k
                paragraph.append(found)
            elif paragraph:
                for a, z, *match in self._in(paragraph):
                    yield start + a, z - a, *match
                paragraph = []

    def _in(self, lines: list[list[str]]) -> Iterator[tuple[int, int, str, int, int, float]]:
        if all(map(self.prefixes.isdisjoint, lines)):
            return
        possible = {k: 0 for line in lines for w in self.prefixes.intersection(line) for k, _ in self.at[w]}
        found: dict[str, list[tuple[int, int, str, int, int, float]]] = defaultdict(list)
        for a, line in enumerate(lines):
            for m in self.matches(set(line), possible):
                found[m[0]].append((a, a + 1, *m))
        if len(lines) > 1:
            for k in possible:
                singles = {a for a, *_ in found[k]}
                most, need, wanted = LONGEST * len(self.sets[k]), self.need[k], self.sets[k]
                hits = [len(wanted.intersection(line)) for line in lines]
                for a in range(len(lines) - 1):
                    if a in singles or not hits[a]:
                        continue  # a run that begins with nothing of the template holds a shorter one
                    own, total, sure = set(lines[a]), len(lines[a]), hits[a]
                    for z in range(a + 1, len(lines)):
                        total += len(lines[z])
                        if total > most or z in singles:
                            break
                        own.update(lines[z])
                        sure += hits[z]
                        if sure >= need and len(wanted & own) >= need:
                            found[k] += [(a, z + 1, *m) for m in self.matches(own, {k: 0})]
                            break
        for matched in found.values():
            last = 1 << 60
            for m in sorted(matched, key=lambda m: (-m[0], m[1])):
                if m[1] < last:  # no block that begins later ends within this one
                    last = m[1]
                    yield m


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each block and template that match. Two scans of the texts, no shuffle of them."""
    templates = {k: t for k, t in templates.items() if words(t)}
    parts: list[dict[str, str]] = [{}]
    size = 0
    for k, t in templates.items():
        size += len(words(t))
        if size > PART_WORDS:
            parts.append({})
            size = len(words(t))
        parts[-1][k] = t
    texts = docs.select("doc_id", "text").where("text is not null")
    found = None
    for part in parts:
        index = Index(part, template_frequencies(texts, {w for t in part.values() for w in words(t)}), threshold)
        rows = texts.mapInArrow(matcher(index), COLUMNS)
        found = rows if found is None else found.union(rows)
    return found


def matcher(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc_id, *m) for m in index.blocks(text)]
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def oracle(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL that compares all pairs of blocks and templates."""
    quoted = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{w}'" for w in sorted(set(words(t))))) for k, t in templates.items())
    return f"""
WITH templates(template, tw) AS (VALUES {quoted}),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(lower(text), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
split AS (SELECT r, doc_id, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS line FROM texts),
lines AS (SELECT r, doc_id, i, regexp_extract_all(line, '[a-z0-9]+') AS w FROM split),
counted AS (SELECT *, CAST(sum(len(w)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS upto, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS para FROM lines),
own AS (SELECT * FROM counted WHERE len(w) > 0),
widest AS (SELECT {LONGEST} * max(len(tw)) AS most FROM templates),
runs AS (
  SELECT a.r, a.doc_id, a.i, z.i AS j, z.upto - a.upto + len(a.w) AS total
  FROM own a JOIN own z ON a.r = z.r AND a.para = z.para AND z.i >= a.i, widest
  WHERE z.i = a.i OR z.upto - a.upto + len(a.w) <= most),
sets AS (
  SELECT r, runs.doc_id, runs.i, j, any_value(total) AS total, list_distinct(flatten(list(w))) AS bw
  FROM runs JOIN own USING (r) WHERE own.i BETWEEN runs.i AND j GROUP BY r, runs.doc_id, runs.i, j),
pairs AS (
  SELECT r, doc_id, i, j, template, len(list_intersect(bw, tw)) AS overlap, len(tw) AS n
  FROM sets, templates WHERE i = j OR total <= {LONGEST} * len(tw)),
matches AS (SELECT * FROM pairs WHERE overlap >= greatest(1, ceil({threshold} * n - 1e-9)))
SELECT doc_id, CAST(i AS INTEGER) AS block, CAST(j - i + 1 AS INTEGER) AS lines, template, CAST(overlap AS INTEGER) AS overlap,
       CAST(n AS INTEGER) AS template_words, CAST(overlap AS DOUBLE) / n AS containment
FROM matches m WHERE NOT EXISTS (
  SELECT 1 FROM matches s WHERE s.r = m.r AND s.template = m.template AND s.i >= m.i AND s.j <= m.j AND s.j - s.i < m.j - m.i)
"""
