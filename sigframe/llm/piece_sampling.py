"""SentencePiece encoding by sampling from the piece lattice, and decoding.

Forward filtering sums, for every place in a word, the weights of all segmentations
up to it; backward sampling then walks from the end, drawing each last piece in
proportion to the weight of the ways that lead to it. Draws come from a hash of
(seed, row key, place in the row), so a row is segmented alike on every run, machine
and partitioning. Pieces never cross the start of a white-space run nor a character
that stands only for itself, so the lattice of a text is that of its words.

A piece's weight is 1 / (1 + its merge rank) to the power ``theta``: the file is a BPE
model, whose scores are negative ranks. Characters without a piece are spelled in
byte pieces, so decoding gives back the very text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import text_slices

THETA = 0.6
SEED = 11
SPACE = "▁"
# Edges of lattices kept by a worker; beyond this it starts anew.
MAX_EDGES = 1_500_000
# Weight of a character that must be spelled in byte pieces.
UNKNOWN_WEIGHT = 1e-6
SLICE = 250_000


class PieceLattice:
    """The pieces of one model file and the filtered lattices of the words seen."""

    def __init__(self, path: str, theta: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.weight, self.bytes_of, self.spelled = {}, {}, {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            self.spelled.append(None if special else piece)
            if model.is_byte(i):
                self.bytes_of[int(piece[3:5], 16)] = i
            elif not special:
                self.pieces[piece] = i
                self.weight[piece] = (1.0 - model.get_score(i)) ** -theta
        self.raw = [b"" if p is None else p.replace(SPACE, " ").encode() for p in self.spelled]
        for value, i in self.bytes_of.items():
            self.raw[i] = bytes([value])
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        single = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        self.words = re.compile(f"{SPACE}+[{single}]*|[{single}]+|[^{SPACE}{single}]")
        self._compile()
        self._restart()

    def _compile(self) -> None:
        """The pieces as a trie: a table of keys (node, character), their children, the piece
        that ends at a node."""
        nodes, ends = {}, [-1]
        for piece, i in self.pieces.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                node = nodes.setdefault(key, len(nodes) + 1)
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        # Keys lie in a table at a hash of theirs or, where it is taken, in the next free places.
        self.bits = max(8, (8 * len(nodes)).bit_length())
        keys, children = np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes))
        self.keys, self.children = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.children[at[put]] = keys[put], children[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, children, at = keys[rest], children[rest], at[rest] + 1 & len(self.keys) - 1
        self.ends = np.array(ends, np.int64)
        self.weights = np.zeros(len(self.spelled))
        for piece, i in self.pieces.items():
            self.weights[i] = self.weight[piece]
        self.max_size = max(map(len, self.pieces))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, keys: np.ndarray) -> np.ndarray:
        """Child node of each key (node, character), 0 where the trie has none."""
        out, left = np.zeros(len(keys), np.int64), None
        at = self._slot(keys)
        while True:
            held = self.keys[at]
            hit = held == keys
            if left is None:
                out = np.where(hit, self.children[at], 0)
            else:
                out[left[hit]] = self.children[at[hit]]
            on = np.flatnonzero((held >= 0) & ~hit)
            if not len(on):
                return out
            left = on if left is None else left[on]
            keys, at = keys[on], at[on] + 1 & len(self.keys) - 1

    def _restart(self) -> None:
        """An empty store. Node 0 is the start of every word; each other node is a place in
        a word and has edges to earlier places, kept as one sorted array of node number
        plus cumulative probability."""
        self.root: dict[str, int] = {"": 0}
        self.n_nodes, self.n_edges = 1, 0
        self.ranked, self.to, self.piece = np.empty(1 << 16), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.last = np.full(1 << 16, -1, np.int64)

    def spell(self, char: str) -> list[int]:
        return [self.bytes_of[b] for b in char.encode("utf-8", "surrogatepass")]

    def _edges(self, codes, stop):
        """(start, size, piece, weight) of all pieces in words; ``stop`` ends the word of each character."""
        at, node, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        alone = np.ones(len(codes), bool)
        for size in range(1, self.max_size + 1):
            inside = at + size <= stop[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            node = self._child(node << 21 | codes[at + size - 1])
            hit = node > 0
            at, node = at[hit], node[hit]
            piece = self.ends[node]
            full = piece >= 0
            out.append((at[full], np.full(int(full.sum()), size), piece[full], self.weights[piece[full]]))
            if size == 1:
                alone[at[full]] = False
        at = np.flatnonzero(alone)
        out.append((at, np.ones(len(at), np.int64), -codes[at] - 1, np.full(len(at), UNKNOWN_WEIGHT)))
        return [np.concatenate(x) for x in zip(*out)]

    def _build(self, words: list[str]) -> None:
        """Forward filtering of new words, all at once, place by place."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        offset = np.cumsum(sizes) - sizes
        begin = np.repeat(offset, sizes)
        start, size, piece, weight = self._edges(codes, np.repeat(offset + sizes, sizes))
        order = np.argsort(start + size, kind="stable")
        start, piece, weight, by_end = start[order], piece[order], weight[order], (start + size - 1)[order]
        head_by_end = begin[start] == start
        place = by_end - begin[by_end]
        longest = int(sizes.max())
        # short numbers are sorted in linear time
        order = np.argsort(place.astype(np.uint16) if longest < 1 << 16 else place, kind="stable")
        at_start, end, weight, head = start[order], by_end[order], weight[order], head_by_end[order]
        new = np.concatenate(([True], end[1:] != end[:-1]))
        groups = np.flatnonzero(new)
        upto = np.searchsorted(place[order], np.arange(longest + 1))
        among = np.searchsorted(groups, upto)
        alpha, share = np.zeros(len(codes)), np.empty(len(end))
        for p in range(longest):
            lo, hi = upto[p], upto[p + 1]
            w = weight[lo:hi] * np.where(head[lo:hi], 1.0, alpha[at_start[lo:hi] - 1])
            own = groups[among[p]:among[p + 1]]
            alpha[end[own]] = np.add.reduceat(w, own - lo)
            share[lo:hi] = w / alpha[end[lo:hi]]
            if p % 32 == 31:  # weights within reach of later places are brought back to about 1
                at = offset[sizes > p + 1] + p
                by = 1.0 / alpha[at]
                for back in range(self.max_size):
                    alpha[at - back] *= by
        end, head, placed = by_end, head_by_end, share
        share = np.empty(len(end))
        share[order] = placed
        final = np.concatenate((end[1:] != end[:-1], [True]))
        summed = np.cumsum(share)
        before = np.concatenate(([0.0], summed[final][:-1]))
        many = np.diff(np.concatenate(([-1], np.flatnonzero(final))))
        chance = np.clip(summed - np.repeat(before, many), 0.0, 1.0)
        chance[final] = 1.0
        n, m, base = self.n_edges, len(end), self.n_nodes
        for name, need in (("ranked", n + m), ("to", n + m), ("piece", n + m), ("last", base + len(codes))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate((held, np.empty(max(need, 2 * len(held)) - len(held), held.dtype))))
        self.ranked[n:n + m] = base + end + chance
        self.to[n:n + m] = np.where(head, 0, base + start - 1)
        self.piece[n:n + m] = piece
        self.last[base:base + len(codes)] = n + np.flatnonzero(final)
        self.n_edges, self.n_nodes = n + m, base + len(codes)
        for word, node in zip(words, (base + offset + sizes - 1).tolist()):
            self.root[word] = node

    def nodes(self, words: list[str]) -> np.ndarray:
        """Lattice node of each word, built where new."""
        if self.n_edges > MAX_EDGES:
            self._restart()
        root = self.root
        new = dict.fromkeys([w for w in words if w not in root])
        if new:
            self._build([*new])
        return np.fromiter(map(root.__getitem__, words), np.int64, len(words))

    def edge(self, node: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The first edge of each node that lies above its mark, or its last: a binary search
        among the few edges of the node."""
        lo, hi = self.last[node - 1] + 1, self.last[node]
        left = np.flatnonzero(lo < hi)
        a, b, mark = lo[left], hi[left], mark[left]
        while len(left):
            mid = a + b >> 1
            above = self.ranked[mid] > mark
            a, b = np.where(above, a, mid + 1), np.where(above, mid, b)
            lo[left] = a
            on = np.flatnonzero(a < b)
            left, a, b, mark = left[on], a[on], b[on], mark[on]
        return lo


def _uniform(keys: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from a hash of row key, place and step."""
    with np.errstate(over="ignore"):
        x = keys ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) * np.uint64(0xD1B54A32D192ED03))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


@functools.cache
def _lattice(path: str, theta: float) -> PieceLattice:
    return PieceLattice(path, theta)


def _marked(text: str) -> str:
    """White space as the model writes it, with its leading mark. The mark itself is a
    piece character: texts that hold it are spelled apart (see ``sample``)."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def sample(texts: list[str], keys: np.ndarray, path: str, theta: float = THETA) -> list[np.ndarray]:
    """Sampled piece ids of each text; ``keys`` (uint64) seed them."""
    own = _lattice(path, theta)
    words, n_words, marks = [], [], []
    for text in texts:
        before = len(words)
        for k, part in enumerate(text.split(SPACE)):
            if k:  # a mark in the text itself is no white space: it is spelled in bytes
                marks.append(len(words))
                words.append("")
            words += own.words.findall(_marked(part) if not k else part.replace(" ", SPACE))
        n_words.append(len(words) - before)
    n_words = np.array(n_words, np.int64)
    row = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    state = own.nodes(words)
    to, piece = own.to, own.piece
    drawn, active = [(np.array(marks, np.int64), np.full(len(marks), -ord(SPACE) - 1))], np.flatnonzero(state > 0)
    step = 0
    while len(active):
        node = state[active]
        r = _uniform(keys[row[active]], place[active], step)
        edge = own.edge(node, node + r)
        drawn.append((active, piece[edge].astype(np.int64)))
        state[active] = to[edge]
        active = active[state[active] > 0]
        step += 1
    at, ids = (np.concatenate(x) for x in zip(*drawn[::-1]))
    order = np.argsort(at, kind="stable")  # pieces of a word were drawn last first
    at, ids = at[order], ids[order]
    absent = np.flatnonzero(ids < 0)
    if len(absent):  # characters without a piece become byte pieces
        chars, which = np.unique(ids[absent], return_inverse=True)
        spelled = [own.spell(chr(-c - 1)) for c in chars.tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[absent] = np.array([len(x) for x in spelled])[which]
        begin = np.cumsum(sizes) - sizes
        at, ids = np.repeat(at, sizes), np.repeat(ids, sizes)
        table = np.array([x + [0] * (4 - len(x)) for x in spelled])
        for j in range(4):
            has = sizes[absent] > j
            ids[begin[absent[has]] + j] = table[which[has], j]
    ends = np.searchsorted(at, np.cumsum(n_words), side="left")
    return np.split(ids, ends[:-1]) if len(texts) else []


def decode(ids, path: str, theta: float = THETA) -> str:
    """The text of piece ids; the first mark stands for no character. Ids of control
    pieces give nothing."""
    raw = _lattice(path, theta).raw
    out = b"".join([raw[i] for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, path: str, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, decoded, lossless), one row per input row.

    ``ids`` is one sampled segmentation, ``decoded`` what decoding them gives and
    ``lossless`` whether that is the text. The row key is the id and the text's hash, so
    equal rows are segmented alike and rows that share an id are not. A null text counts
    as empty: no pieces, an empty decoded text. ``path`` must exist on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for first, texts in text_slices(batch.column(1), SLICE):
                keys = np.array([xxhash.xxh64_intdigest(f"{seed} {names[first + i].as_py()} {xxhash.xxh64_hexdigest(t.encode('utf-8', 'surrogatepass'))}") for i, t in enumerate(texts)], np.uint64)
                ids = sample(texts, keys, path, theta)
                back = [decode(x.tolist(), path, theta) for x in ids]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    names.slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(np.diff(offsets).astype(np.int64)), pa.array(back), pa.array([a == b for a, b in zip(texts, back)])],
                    ["doc_id", "ids", "n_pieces", "decoded", "lossless"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                .mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, decoded string, lossless boolean"))


def decoded(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text of its piece ids as ``text``; null ids give a null text."""
    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(lambda x: None if x is None else decode(x.tolist(), path))
    return encoded.withColumn("text", text_of(F.col(ids_col)))
