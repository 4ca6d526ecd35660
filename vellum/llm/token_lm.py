"""Document scores by masked pseudo-likelihood over tokens.

Texts (lower case, white space as single spaces) become tokens of a public byte-level
vocabulary, so every string is spelled exactly: nothing is hashed and no word shares a
count or a score with another. Every token is predicted from the two before and the two
after it by a small window network: one embedding for each token and offset, their sum
through tanh, and a binary decision at every node of a Huffman tree over the tokens. The
tree follows the corpus's own counts (plus one), each node starts at the odds of its
two sides, and the leaf is the token itself, so all of it is predicted from its context.
A document's score is the sum of the log probabilities of its tokens.

The texts are encoded once and written; a first pass over that counts, a second trains
(each task fits a copy on the windows of its documents, and the copies are averaged row
by row, weighted by how often a copy trained the row, in two levels), a third scores.
Scores depend on how the table is split into tasks.

Defined results: a null or empty text has no words, score 0 and a null mean; the mean is
for a word, a run without white space; repeated rows are counted and scored each; tokens of
one count are joined in the tree by their numbers; a text of any length is one line of windows; a null
doc_id is scored like any other; an empty table gives an empty result. Whole texts are
read. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, checkpointed, encoding, load_ranks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WIDTH = 24
OFFSETS = (-2, -1, 1, 2)
REACH = 2
#: Share of each document's windows that is trained on (all), and those of one step.
SHARE = 1.0
STEP = 4096
RATE = 0.15
SEED = 7
#: Rows of the network in a shuffled block, and copies averaged in one group of the first level.
BLOCK = 1024
FAN_IN = 64
TOGETHER = 8192
#: Nodes of the tree, the most visited ones, that a step multiplies as matrices of up to so many; the rest go path by path.
TOP = 256
TOGETHER_NODES = 16
#: Rows of a stretch up to which all stretches are added row by row.
FEW = 3
#: common.PATTERN for texts without two white spaces in a row.
SPACED = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
COLUMNS = "doc_id bigint, n_words bigint, log_likelihood double, mean_log_likelihood double"


@lru_cache(maxsize=4)
def spaced(path: str) -> Any:
    """The tiktoken encoding of a vocabulary file for words with single spaces between them, made once in a process.
    On those its pattern cuts like the shared one, but without a look ahead, which takes half of the time."""
    import tiktoken

    return tiktoken.Encoding("spaced", pat_str=SPACED, mergeable_ranks=load_ranks(path), special_tokens={})


def encoded(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_words, tokens) of each row; tokens are 16-bit numbers in bytes."""
    path = f"{tokenizers}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = spaced(path)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                found = [(t or "").lower().split() for t in part.column(1).to_pylist()]
                tokens = [array("H", enc.encode_ordinary(" ".join(f))).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "n_words", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, tokens binary")


def count_tokens(rows: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                n += np.bincount(np.frombuffer(b"".join(b.column(0).slice(k, 512).to_pylist()), np.uint16), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for token, n in rows.select("tokens").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[token] = n
    return out


@dataclass
class Group:
    """Connected nodes of the tree's top. Way out e, a child that isn't one of them, has the leaves of
    rank bounds[e] to bounds[e + 1] under it, and sides[e] are the sides taken to it, 0 at nodes not passed."""

    nodes: np.ndarray
    bounds: np.ndarray
    sides: np.ndarray


@dataclass
class Tree:
    """A token's path, from its leaf up, is nodes[start[t] : start[t] + depth[t]], and the side it takes at each (1 or -1).
    rank is the token's place among the leaves from left to right."""

    start: np.ndarray
    depth: np.ndarray
    nodes: np.ndarray
    sides: np.ndarray
    odds: np.ndarray
    rank: np.ndarray
    groups: list[Group]


def grouped(children: list[tuple[int, int]], weights: list[int], size: int) -> tuple[np.ndarray, list[Group]]:
    """Ranks of the leaves, and TOP nodes at most in groups, from the root down to the most visited; children are leaves, or size and up for nodes."""
    leaves = [1] * size + [0] * (size - 1)
    for k, (x, y) in enumerate(children):
        leaves[size + k] = leaves[x] + leaves[y]
    first = [0] * (2 * size - 1)
    for k in range(size - 2, -1, -1):  # a node is made after its children
        x, y = children[k]
        first[x], first[y] = first[size + k], first[size + k] + leaves[x]
    rank = np.array(first[:size], np.uint16)
    groups: list[Group] = []
    roots, left = [(-weights[-1], 2 * size - 2)], TOP
    while roots and left > 0:
        inside: dict[int, int] = {}
        edge = [heapq.heappop(roots)]
        while edge and len(inside) < min(left, TOGETHER_NODES):
            k = heapq.heappop(edge)[1]
            inside[k] = len(inside)
            for child in children[k - size]:
                if child >= size:
                    heapq.heappush(edge, (-weights[child - size], child))
        for x in edge:
            heapq.heappush(roots, x)
        left -= len(inside)
        ways: list[tuple[int, np.ndarray]] = []
        open_ = [(next(iter(inside)), np.zeros(len(inside), np.float32))]
        while open_:
            k, taken = open_.pop()
            if k not in inside:
                ways.append((first[k], taken))
                continue
            for child, side in zip(children[k - size], (1, -1), strict=True):
                own = taken.copy()
                own[inside[k]] = side
                open_.append((child, own))
        ways.sort(key=lambda x: x[0])
        root = next(iter(inside))
        groups.append(Group(np.array([k - size for k in inside]), np.array([*(w for w, _ in ways), first[root] + leaves[root]]), np.array([t for _, t in ways])))
    return rank, groups


def huffman(counts: np.ndarray) -> Tree:
    size = len(counts)
    heap = [(int(n) + 1, k) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    weights: list[int] = []
    above, side, odds = np.zeros(2 * size - 1, np.int64), np.zeros(2 * size - 1, np.int8), np.zeros(size - 1, np.float32)
    for k in range(size - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        above[x] = above[y] = size + k
        side[x], side[y] = 1, -1
        odds[k] = np.log(a / b)
        children.append((x, y))
        weights.append(a + b)
        heapq.heappush(heap, (a + b, size + k))
    nodes: list[int] = []
    sides: list[int] = []
    depth = np.zeros(size, np.int64)
    up, taken, root = above.tolist(), side.tolist(), 2 * size - 2
    for t in range(size):
        before, k = len(nodes), t
        while k != root:
            sides.append(taken[k])
            k = up[k]
            nodes.append(k - size)
        depth[t] = len(nodes) - before
    return Tree(np.cumsum(depth) - depth, depth, np.array(nodes, np.uint16), np.array(sides, np.float32), odds, *grouped(children, weights, size))


@lru_cache(maxsize=1)
def start(size: int) -> np.ndarray:
    """The rows of a new network but for the odds, drawn once in a process."""
    rows = np.random.default_rng(SEED).normal(0, 0.1, (size - 1 + len(OFFSETS) * (size + 1), WIDTH + 1)).astype(np.float32)
    rows[: size - 1, :WIDTH] = 0
    return rows


class Network:
    """Rows of one matrix: the nodes' weights, then for each offset the embeddings of every token and of
    the border. A node's last column is its bias; an embedding's last column isn't used."""

    def __init__(self, tree: Tree, rows: np.ndarray) -> None:
        self.tree, self.rows, self.size = tree, rows, len(tree.depth)
        self.out, inputs = rows[: self.size - 1], rows[self.size - 1 :]
        self.inputs = inputs.reshape(len(OFFSETS), self.size + 1, WIDTH + 1)
        outside = np.ones(self.size - 1, bool)
        outside[np.concatenate([g.nodes for g in tree.groups])] = False
        self.below = np.add.reduceat(outside[tree.nodes], tree.start, dtype=np.int64)  # nodes of a path that are in no group; they come first
        self.bounds = np.concatenate([g.bounds for g in tree.groups])
        ends = np.cumsum([len(g.bounds) for g in tree.groups]).tolist()
        passed = [np.abs(g.sides) for g in tree.groups]
        self.groups = [(g.nodes, g.sides, p, slice(e - len(g.bounds), e - 1)) for g, p, e in zip(tree.groups, passed, ends, strict=True)]
        spare = np.zeros(self.size)
        for g, p in zip(tree.groups, passed, strict=True):
            spare[g.bounds[0] : g.bounds[-1]] += np.repeat(len(g.nodes) - p.sum(axis=1), np.diff(g.bounds))
        self.spare = spare.take(tree.rank) * np.log(2)  # of each token, the softplus of 0 at nodes of its groups that it doesn't pass

    @classmethod
    def fresh(cls, tree: Tree) -> Network:
        size = len(tree.depth)
        rows = start(size).copy()
        rows[: size - 1, WIDTH] = tree.odds
        return cls(tree, rows)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """context: (offset, window)."""
        h = self.inputs[0].take(context[0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += self.inputs[k].take(context[k], axis=0)
        h *= 2  # numpy's exp takes half the time of its tanh
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += 1
        np.divide(-2, h, out=h)
        h += 1
        h[:, WIDTH] = 1
        return h

    def ordered(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows' order by the rank of their targets, and context and target in it."""
        order = np.argsort(self.tree.rank.take(target), kind="stable")
        return order, context.take(order, axis=1), target.take(order)

    def spans(self, target: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each group that ordered targets pass: their windows' begin and end, how many take each way out, and the group's nodes, sides and nodes passed."""
        at = np.searchsorted(self.tree.rank.take(target), self.bounds)
        counts = at[1:] - at[:-1]
        where = at.tolist()
        for nodes, sides, passed, ways in self.groups:
            a, b = where[ways.start], where[ways.stop]
            if a < b:
                yield a, b, counts[ways], nodes, sides, passed

    def rest(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The nodes and sides of all targets' paths under the groups, and the window of each: first the lowest node of every
        path, longer paths first, then the second of those that have one, and so on; and where each of these parts ends."""
        depth = self.below.take(target)
        parts = len(target) - np.cumsum(np.bincount(depth))[:-1]
        ends = np.cumsum(parts)
        order = np.argsort((np.max(depth, initial=0) - depth).astype(np.uint8), kind="stable")
        place = np.arange(parts.sum()) - np.repeat(ends - parts, parts)
        of = order.take(place)
        at = self.tree.start.take(target).take(of) + np.repeat(np.arange(len(parts)), parts)
        return self.tree.nodes.take(at), self.tree.sides.take(at), of, ends.tolist()

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, context, target = self.ordered(context, target)
        h = self.hidden(context)
        nodes, sides, of, _ = self.rest(target)
        z = np.einsum("ij,ij->i", h.take(of, axis=0), self.out.take(nodes, axis=0))
        logs = self.spare.take(target) - np.bincount(of, weights=softplus(-sides * z), minlength=len(target))
        for a, b, n, nodes, sides, _ in self.spans(target):
            z = self.out.take(nodes, axis=0) @ h[a:b].T
            z *= np.repeat(-sides.T, n, axis=1)  # 0 at nodes not passed
            logs[a:b] -= softplus_sum(z)
        out = np.empty(len(target))
        out[order] = logs
        return out

    def train(self, context: np.ndarray, target: np.ndarray, squares: np.ndarray, times: np.ndarray, rate: float = RATE) -> None:
        """One AdaGrad step of the rows that the windows touch; times: how often each was."""
        _, context, target = self.ordered(context, target)
        h = self.hidden(context)
        dh = np.empty_like(h)  # gradients of the log probability, upwards
        grads, touched, top = [], [], []
        with np.errstate(over="ignore"):
            for a, b, n, nodes, sides, passed in self.spans(target):
                x, w, s = h[a:b], self.out.take(nodes, axis=0), np.repeat(sides, n, axis=0)
                z = x @ w.T
                z *= s
                np.exp(z, out=z)
                z += 1
                np.divide(s, z, out=z)
                if nodes[0] == self.size - 2:  # the root, which all windows pass and whose group comes first
                    np.matmul(z, w, out=dh)
                else:
                    dh[a:b] += z @ w
                grads.append(z.T @ x)
                touched.append(np.dot(n.astype(np.float32), passed))
                top.append(nodes)
        nodes, sides, of, ends = self.rest(target)
        if len(nodes):
            x, w = h.take(of, axis=0), self.out.take(nodes, axis=0)
            z = np.einsum("ij,ij->i", x, w) * sides
            g = (sides / (1 + np.exp(np.minimum(z, 60))))[:, None]
            w *= g
            for a, b in pairwise(ends):
                w[: b - a] += w[a:b]
            dh[of[: ends[0]]] += w[: ends[0]]
            x *= g
            self._move([nodes], [0], x, squares, times, rate)
        h *= h
        np.subtract(1, h, out=h)
        dh *= h
        dh = np.ascontiguousarray(dh[:, :WIDTH])
        self._step(np.concatenate(top), np.concatenate(grads), np.concatenate(touched), squares, times, rate)
        self._move(context.astype(np.uint16), [self.size - 1 + k * (self.size + 1) for k in range(len(OFFSETS))], dh, squares, times, rate)

    def _move(self, tables: Sequence[np.ndarray], bases: list[int], push: np.ndarray, squares: np.ndarray, times: np.ndarray, rate: float) -> None:
        """tables: in each, 16-bit numbers of the rows, from the table's base on, that the pushes are for; bases ascend by more than the numbers do."""
        orders = [np.argsort(t, kind="stable") for t in tables]
        ids = np.concatenate([t.take(o) + np.int64(base) for t, o, base in zip(tables, orders, bases, strict=True)])
        order = np.concatenate(orders)
        cuts = begins(ids)
        n = lengths(cuts, len(ids))
        grad = np.zeros((len(cuts), WIDTH + 1), push.dtype)
        grad[:, : push.shape[1]] = sums(push, order, cuts, n)
        self._step(ids.take(cuts), grad, n, squares, times, rate)

    def _step(self, at: np.ndarray, grad: np.ndarray, touched: np.ndarray, squares: np.ndarray, times: np.ndarray, rate: float) -> None:
        """at: rows, each once."""
        times[at] += touched
        total = grad * grad
        total += squares.take(at, axis=0)
        squares[at] = total
        np.sqrt(total, out=total)
        grad *= rate
        grad /= total
        grad += self.rows.take(at, axis=0)
        self.rows[at] = grad


def softplus(z: np.ndarray) -> np.ndarray:
    """log(1 + exp(z)), also where exp(z) is too large."""
    if z.size and z.max() > 80:
        return np.log(1 + np.exp(-np.abs(z))) + np.maximum(z, 0)
    out = np.exp(z)
    out += 1
    return np.log(out, out=out)


def softplus_sum(z: np.ndarray) -> np.ndarray:
    """The sum of softplus over the first axis: one logarithm of the product of two or four rows, if that can't be too large."""
    if z.size and z.max() > 20:
        return softplus(z).sum(axis=0)
    out = np.exp(z)
    out += 1
    for _ in range(2):
        if len(out) % 2 == 0:
            out = out[: len(out) // 2] * out[len(out) // 2 :]
    return np.log(out, out=out).sum(axis=0)


def begins(ids: np.ndarray) -> np.ndarray:
    """Where each stretch of equal ids begins."""
    other = np.empty(len(ids), bool)
    other[:1] = True
    np.not_equal(ids[1:], ids[:-1], out=other[1:])
    return np.flatnonzero(other)


def lengths(cuts: np.ndarray, size: int) -> np.ndarray:
    """How long the stretches are that begin at cuts."""
    n = np.empty_like(cuts)
    np.subtract(cuts[1:], cuts[:-1], out=n[:-1])
    n[-1] = size - cuts[-1]
    return n


def sums(rows: np.ndarray, order: np.ndarray, cuts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each stretch of n ordered rows that begins at a cut; the first cut is 0. Short ones are added row by row,
    all at once; in the others two columns are added as one complex number, if they are even."""
    out = rows.take(order.take(cuts), axis=0)
    few = np.flatnonzero((n > 1) & (n <= FEW))
    for k in range(1, FEW):
        out[few] += rows.take(order.take(cuts.take(few) + k), axis=0)
        few = few[n.take(few) > k + 1]
    if len(many := np.flatnonzero(n > FEW)):
        m = n.take(many)
        x = rows.take(order[np.repeat(n > FEW, n)], axis=0)
        if x.shape[1] % 2 == 0:
            x = x.view(np.result_type(x, np.complex64))
        out[many] = np.add.reduceat(x, np.cumsum(m) - m, axis=0).view(rows.dtype)
    return out


def lines(texts: list[np.ndarray], border: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of several texts with borders around each, and the positions of the tokens in that."""
    edge = np.full(REACH, border, np.int64)
    pieces = [edge]
    for t in texts:
        pieces += [t.astype(np.int64), edge]
    line = np.concatenate(pieces)
    return line, np.flatnonzero(line != border)


def drawn(tokens: np.ndarray, share: float) -> np.ndarray:
    """Which of a text's windows are trained."""
    if share >= 1:
        return np.ones(len(tokens), bool)
    return np.random.default_rng([SEED, len(tokens), int(tokens.sum(dtype=np.int64))]).random(len(tokens)) < share


def train_corpus(rows: DataFrame, tree: Tree, share: float = SHARE) -> Network:
    """The average of the tasks' networks."""
    size = len(tree.depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = Network.fresh(tree)
        squares, times = np.ones_like(net.rows), np.zeros(len(net.rows), np.float32)
        seen = 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                texts = [np.frombuffer(t, np.uint16) for t in b.column(0).slice(k, 256).to_pylist()]
                line, where = lines(texts, size)
                if share < 1 and len(where):
                    where = where[np.concatenate([drawn(t, share) for t in texts if len(t)])]
                where = np.random.default_rng([SEED, seen]).permutation(where)
                seen += len(where)
                for i in range(0, len(where), STEP):
                    w = where[i : i + STEP]
                    net.train(np.stack([line.take(w + o) for o in OFFSETS]), line.take(w), squares, times)
        if seen:
            part = TaskContext.get().partitionId()
            for k in range(0, len(times), BLOCK):
                if (n := times[k : k + BLOCK]).any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part % FAN_IN], pa.int32()), pa.array([k], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([net.rows[k : k + BLOCK].tobytes()], pa.binary())],
                        ["branch", "block", "weight", "vec"],
                    )

    def average(group: pa.Table) -> pa.Table:
        n = total = 0.0
        for w, v in zip(group.column("weight").to_pylist(), group.column("vec").to_pylist(), strict=True):
            own = np.frombuffer(w, np.float32).astype(float)
            n = n + own
            total = total + own[:, None] * np.frombuffer(v, np.float32).reshape(len(own), -1)
        vec = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
        out = {"branch": group.column("branch")[:1], "block": group.column("block")[:1], "weight": [n.astype(np.float32).tobytes()], "vec": [vec.tobytes()]}
        return pa.table(out, schema=pa.schema([("branch", pa.int32()), ("block", pa.int32()), ("weight", pa.binary()), ("vec", pa.binary())]))

    shape = "branch int, block int, weight binary, vec binary"
    copies = rows.select("tokens").mapInArrow(run, shape)
    merged = copies.groupBy("branch", "block").applyInArrow(average, shape).groupBy("block").applyInArrow(average, shape)
    net = Network.fresh(tree)
    for r in merged.toLocalIterator():  # one network in all
        n = np.frombuffer(r["weight"], np.float32)
        own = net.rows[r["block"] : r["block"] + BLOCK]
        own[n > 0] = np.frombuffer(r["vec"], np.float32).reshape(len(n), -1)[n > 0]
    return net


def scored(texts: list[np.ndarray], net: Network) -> np.ndarray:
    """The score of each text."""
    line, where = lines(texts, net.size)
    logs = np.zeros(len(where) + 1)
    for k in range(0, len(where), TOGETHER):
        w = where[k : k + TOGETHER]
        logs[k + 1 : k + 1 + len(w)] = net.log_probability(np.stack([line.take(w + o) for o in OFFSETS]), line.take(w))
    sums, ends = np.cumsum(logs), np.cumsum([len(t) for t in texts])
    return sums[ends] - sums[ends - [len(t) for t in texts]]


def score_documents(docs: DataFrame, share: float = SHARE, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row of scores for every row of docs, under a network trained on docs."""
    rows = checkpointed(encoded(docs, tokenizers))
    tree = huffman(count_tokens(rows, encoding(f"{tokenizers}/{VOCABULARY}").n_vocab))
    trained = train_corpus(rows, tree, share).rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(tree, trained)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n = part.column(1).to_numpy()
                s = scored([np.frombuffer(t, np.uint16) for t in part.column(2).to_pylist()], net)
                mean = pa.array(np.divide(s, n, where=n > 0, out=np.zeros(len(n))), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), mean], ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return rows.mapInArrow(run, COLUMNS)
