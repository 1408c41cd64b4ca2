"""Many fixed strings in one pass: an Aho-Corasick automaton as arrays, walked by batches of lines.

Strings are dealt out to blocks of bounded length; a block's automaton is built once in each Python worker, and a pass over the
files walks all lines of a batch at once, a character of each at a time. Long lines are cut into overlapping pieces, so that one
of them doesn't hold up a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore.functions.text import lines

#: Bytes of strings in a block: an automaton of as many states at most, each a row of as many numbers as bytes differ.
BLOCK_BYTES = 1 << 16
PIECE = 512

_built: list = [None, None]  # this worker's last block of strings, and its automaton


class Automaton:
    """``go``: the next state by state and class of byte; ``ends``: the string that ends in a state, or -1; ``link``: the next
    state back along failures where a string ends, or 0. State 0 is the root."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.longest = strings, max(map(len, strings))
        self.classes = np.zeros(256, np.uint8)
        for i, b in enumerate(sorted(set(b"".join(strings)))):
            self.classes[b] = i + 1
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for n, s in enumerate(strings):
            at = 0
            for c in self.classes[np.frombuffer(s, np.uint8)].tolist():
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = tree[at][c]
            ends[at] = n
        self.go = np.zeros((len(tree), int(self.classes.max()) + 1), np.int32)
        self.ends, self.link = np.array(ends), np.zeros(len(tree), np.int32)
        fail, level = [0] * len(tree), [0]
        while level:  # by depth, so that a failure's row is complete
            below = []
            for at in level:
                if at:
                    self.go[at] = self.go[fail[at]]
                    self.link[at] = fail[at] if ends[fail[at]] >= 0 else self.link[fail[at]]
                for c, child in tree[at].items():
                    fail[child] = int(self.go[at, c]) if at else 0
                    self.go[at, c] = child
                    below.append(child)
            level = below

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which strings stand in which of the stretches ``data[start:end]``: (stretch, string), each pair once."""
        code = self.classes[data]
        n = np.maximum(1, -(-(ends - starts) // PIECE))
        own = np.repeat(np.arange(len(starts)), n)
        begin = starts[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
        stop = np.minimum(begin + PIECE, ends[own])
        begin = np.maximum(begin - (self.longest - 1), starts[own])  # what crosses the cut ends in the later piece
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        own, begin, size = own[order], begin[order], (stop - begin)[order]
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        state = np.zeros(len(own), np.int32)
        met: list[np.ndarray] = []
        for step, k in enumerate(active.tolist()):
            state[:k] = self.go[state[:k], code[begin[:k] + step]]
            hit = np.flatnonzero((self.ends[state[:k]] >= 0) | (self.link[state[:k]] > 0))
            at, which = state[hit], own[hit]
            while len(at):
                some = self.ends[at] >= 0
                met.append(which[some] * len(self.strings) + self.ends[at[some]])
                at = self.link[at]
                at, which = at[at > 0], which[at > 0]
            if len(met) > 256:
                met = [_distinct(met)]
        pairs = _distinct(met)
        return pairs // len(self.strings), pairs % len(self.strings)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct numbers, by a sort: np.unique hashes, at ten times the price for these."""
    found = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return found[np.diff(found, prepend=-1) != 0]


def _blocks(strings: DataFrame) -> Iterator[list[str]]:
    """The distinct, not empty values of ``strings(term)`` in blocks of about ``BLOCK_BYTES``."""
    known = strings.select("term").where("term <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("term").cast("long"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        found = [r["term"] for r in known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).collect()]  # a block's, by its size
        if found:
            yield sorted(found)


def lines_with(files: DataFrame, strings: DataFrame, per_file: int, most_hits: int) -> DataFrame:
    """``(term, path, at)``: for each string of ``strings(term)`` and each of ``files(path, text)`` that holds it in a line, the numbers (from
    0) of its first ``per_file`` such lines.

    Of each string, what a batch of files holds beyond its first ``most_hits`` lines by path is left out: no order by path can
    come to these. Null texts have no lines; strings that end a line, or cross lines, are found as far as they are within one.
    """
    context = files.sparkSession.sparkContext
    rows = files.select("path", lines("text").alias("lines")).where(F.size("lines") > 0)
    found = None
    for block in _blocks(strings):
        sent = context.broadcast(block)

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = _automaton(sent)
            for batch in batches:
                yield _hits(known, sent.value, batch, per_file, most_hits)

        own = rows.mapInArrow(walk, "term string, path string, at array<int>")
        found = own if found is None else found.union(own)
    return files.sparkSession.createDataFrame([], "term string, path string, at array<int>") if found is None else found


def _automaton(sent) -> Automaton:
    if _built[0] is not sent.value:
        _built[:] = sent.value, Automaton([s.encode() for s in sent.value])
    return _built[1]


def strings_in(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """``texts(body, ...)`` with each ``term`` of ``strings(term)`` that its body holds; null bodies and empty strings match nothing."""
    found, shape = None, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema], "term string"])
    for block in _blocks(strings):
        sent = texts.sparkSession.sparkContext.broadcast(block)

        def walk(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = _automaton(sent)
            for batch in batches:
                row, term = known.find(*_bytes(batch.column("body").fill_null("")))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(sent.value, pa.string()).take(pa.array(term))], [*batch.schema.names, "term"])

        own = texts.mapInArrow(walk, shape)
        found = own if found is None else found.union(own)
    return texts.sparkSession.createDataFrame([], shape) if found is None else found


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of texts as bytes, with where each starts and ends."""
    flat = column.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def _hits(known: Automaton, strings: list[str], batch: pa.RecordBatch, per_file: int, most_hits: int) -> pa.RecordBatch:
    lists = batch.column("lines")
    line, term = known.find(*_bytes(lists.flatten()))
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    file = np.searchsorted(first, line, side="right") - 1
    place = np.empty(len(batch), np.int64)
    place[np.argsort(np.array(batch.column("path").to_pylist(), dtype=object), kind="stable")] = np.arange(len(batch))
    order = np.lexsort((line, place[file], term))
    line, term, file = line[order], term[order], file[order]
    at = np.arange(len(line))
    new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(file, prepend=-1) != 0))  # each term's each file
    run = np.repeat(new, np.diff(np.append(new, len(line))))
    keep = at - run < per_file
    line, term, file = line[keep], term[keep], file[keep]
    new = np.flatnonzero(np.diff(term, prepend=-1))
    of_term = np.arange(len(line)) - np.repeat(new, np.diff(np.append(new, len(line))))
    keep = of_term < most_hits
    line, term, file = line[keep], term[keep], file[keep]
    new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(file, prepend=-1) != 0))
    ends = np.append(new, len(line)).astype(np.int32)
    values = pa.array((line - first[file]).astype(np.int32)) if len(line) else pa.array([], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(strings, pa.string()).take(pa.array(term[new])), batch.column("path").take(pa.array(file[new])), pa.ListArray.from_arrays(pa.array(ends), values)], ["term", "path", "at"])
