"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced at stable boundaries.

Most texts are counted where they are read. A text of more than ``chunk_chars`` is cut into chunks that overlap, and the
chunks are dealt out to all tasks, so that one huge text isn't one task's work. Each chunk is encoded with offsets. Where two
neighbours meet, a boundary between two pieces of the splitter that stands at the same place in both is taken, and the
counts are spliced there. A seam without such a boundary makes the text's chunks overlap more, until all seams have one or
the text is one chunk.

Why such a boundary is stable. The vocabulary splits a text from left to right by a pattern that looks ahead but never back,
and merges within pieces only. So a chunk whose scan stands at place p goes on from p as the scan of the whole text
would, if that stands at p as well. The first chunk starts as the whole text does. What a chunk finds depends on what
follows by one character, or by a special string at most; so its boundaries are those of the whole text, from a place where it
agrees with it up to ``margin`` characters before its end. By induction each common boundary there is one of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import dropped, stored, whole_text
from sourcelore.llm.packing import byte_characters

#: The rules under which pieces are independent of each other, and scans of what stands before them.
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

#: Characters whose class is the same in all versions of Unicode: Latin letters, digits, white space and plain signs. Texts of
#: these are split here, by the vocabulary's own pattern; all others by its library.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f¡-©«-¬®-±´¶-¸»¿×÷‐-‧{_LETTERS}]*")
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+", re.ASCII)

_loaded: dict = {}


class _Known(dict):
    """Pieces and their numbers of tokens; a new piece is counted when it is first asked for, and kept unless it is long."""

    def __init__(self, count) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


class Vocabulary:
    """A vocabulary file and what counts with it: ``.json`` by tokenizers, ``.model`` by sentencepiece, special strings in texts
    as these handle them by default. ``spliced``: texts may be cut and spliced. ``margin``: see above."""

    def __init__(self, path: str | None, keep: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.keep, self.spliced, self.margin, self.added = keep, False, 0, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(model.encode(text, num_threads=1))
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [t["content"] for t in said["added_tokens"]]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in said["added_tokens"])
        self.spliced = plain and [said["normalizer"], said["pre_tokenizer"], said["post_processor"], said["model"]["dropout"]] == [None, _SPLITTER, None, None]
        self.margin = max([16, *(len(a) + 1 for a in self.added)])
        self.whole = lambda text: len(self.tokenizer.encode(text, add_special_tokens=False))
        tokenize = self.tokenizer.model.tokenize
        self.known = _Known(lambda piece: len(tokenize(byte_characters(piece))))

    def count(self, text: str) -> int:
        """The tokens of a text: of each of its pieces, if they can be told here, else by the library."""
        if not self.spliced or any(a in text for a in self.added) or not _PLAIN.fullmatch(text):
            return self.whole(text)
        if len(self.known) > self.keep:
            self.known.clear()
        return sum(map(self.known.__getitem__, _PIECES.findall(text)))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where pieces start, how many tokens stand before each, and the number of all tokens."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        n = len(e)
        words = np.fromiter(e.word_ids, np.int64, n)
        starts = np.fromiter((o[0] for o in e.offsets), np.int64, n)
        first = np.flatnonzero(np.diff(words, prepend=-1))
        return starts[first], first, n


def _vocabulary(path: str | None) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


_CHUNK = "row long, chunk int, last int, begin long, before long, after long, body string"
_ENDS = "row long, chunk int, last int, n long, head array<struct<at:long,n:long>>, tail array<struct<at:long,n:long>>"


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 10, widen: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens, n_chunks)`` of every row of ``docs``.

    Counts are those of the whole text by the vocabulary's library, without tokens that it would add. Texts of more than
    ``chunk_chars`` characters go in chunks that overlap by ``overlap_chars``; where a seam finds no stable boundary,
    the text is cut again with ``widen`` times the overlap, as often as it takes. Vocabularies with other rules (see
    Vocabulary) take whole texts. Null and empty texts have no bytes and no tokens (but a vocabulary may have tokens for an
    empty text). Rows that repeat an id, or id and text, are counted each for itself. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body"))
    spliced = _vocabulary(tokenizer_path).spliced
    is_long = (F.char_length("body") > chunk_chars) if spliced else F.lit(False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(tokenizer_path)
        for batch in batches:
            body = batch.column("body")
            n = pa.array([known.count(t.as_py()) for t in body], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n, pa.array(np.ones(len(n), np.int32))], ["id", "n_bytes", "n_tokens", "n_chunks"])

    kinds = "id long, n_bytes long, n_tokens long, n_chunks int"
    sized = texts.withColumn("n_bytes", F.octet_length("body").cast("long"))
    short = sized.where(~is_long).mapInArrow(count, kinds)
    if not spliced:
        return short.withColumnRenamed("id", id_col)

    # A row's number must outlive the task that gave it, so it is written with the text.
    huge = stored(sized.where(is_long).withColumn("row", F.monotonically_increasing_id()), "huge")
    parts, left, overlap = [short], huge, overlap_chars
    while not left.isEmpty():
        ends = stored(_encoded(left, tokenizer_path, max(chunk_chars, 2 * overlap), overlap), "ends")
        spread = lambda side, seam: ends.select("row", seam.alias("seam"), F.inline(side))
        meet = spread("tail", F.col("chunk")).withColumnRenamed("n", "a").join(spread("head", F.col("chunk") - 1).withColumnRenamed("n", "b"), ["row", "seam", "at"])
        seams = meet.groupBy("row", "seam").agg(F.min(F.struct("at", "a", "b")).alias("s")).groupBy("row").agg(F.count("*").alias("met"), F.sum(F.col("s.a") - F.col("s.b")).alias("shift"))
        whole = ends.where("chunk = last").select("row", "last", "n").join(seams, "row", "left")
        whole = stored(whole.select("row", "last", (F.coalesce("met", F.lit(0)) == F.col("last")).alias("fits"), (F.col("n") + F.coalesce("shift", F.lit(0))).alias("n_tokens")), "counted")
        done = whole.where("fits").select("row", "n_tokens", (F.col("last") + 1).alias("n_chunks"))
        parts.append(left.join(done, "row").select("id", "n_bytes", "n_tokens", "n_chunks"))
        left = left.join(whole.where("not fits"), "row", "left_semi")
        overlap *= widen
        dropped(ends)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumnRenamed("id", id_col)


def _encoded(huge: DataFrame, tokenizer_path: str | None, chunk_chars: int, overlap: int) -> DataFrame:
    """The texts' chunks with their tokens, and the boundaries where they overlap the chunk before (``head``) and the one
    after (``tail``), as places in the whole text and tokens of the chunk before them."""
    stride = chunk_chars - overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = _vocabulary(tokenizer_path).margin
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("body")):
                text = text.as_py()
                last = max(0, -(-(len(text) - overlap) // stride) - 1)
                for k in range(last + 1):
                    begin = k * stride
                    body = text[begin : begin + chunk_chars]
                    # seams lie in [begin, before] with the chunk before, and in [after, end - margin] with the one after
                    values = [row, k, last, begin, begin + overlap - margin if k else -1, begin + stride if k < last else -1, body]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()])], ["row", "chunk", "last", "begin", "before", "after", "body"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(tokenizer_path)
        pair = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                at, n, total = known.boundaries(x["body"])
                at = at + x["begin"]
                end = x["begin"] + len(x["body"]) - known.margin
                head = at <= x["before"]
                tail = (at >= x["after"]) & (at <= end) if x["after"] >= 0 else np.zeros(len(at), bool)
                zone = lambda m: [{"at": int(a), "n": int(b)} for a, b in zip(at[m], n[m])]  # noqa: B023, E731
                rows.append((x["row"], x["chunk"], x["last"], total, zone(head), zone(tail)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pair, pair]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["row", "chunk", "last", "n", "head", "tail"])

    chunks = huge.select("row", "body").mapInArrow(cut, _CHUNK)
    return chunks.repartition("row", "chunk").mapInArrow(encode, _ENDS)
