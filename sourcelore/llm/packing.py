"""Packing documents into sequences of fixed capacity by harmonic classes."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import whole_text

#: The rules of vocabularies whose texts can be encoded word by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

OUT = "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_loaded: dict = {}


#: Runs that the vocabulary's splitter keeps whole, whatever stands beside them: letters, a digit, signs but the apostrophe.
_RUNS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

#: Byte-level vocabularies write a byte as the character of its code if that is printable, and else as the next of U+0100 on.
_PLAIN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def byte_characters(text: str) -> str:
    """A text's bytes as byte-level vocabularies write them."""
    return text.encode().decode("latin-1").translate(_BYTES)


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins tokens across it, so a text's ids are the ids of its words at
    white space, one after the other; words are encoded once and kept (up to ``keep`` of them, then anew). Words of
    plain runs go straight to the vocabulary's merges; all others take the whole tokenizer. Vocabularies with other rules
    encode each text as a whole.
    """

    def __init__(self, path: str | None, keep: int = 400_000) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.known, self.runs, self.keep = Tokenizer.from_file(path), {}, {}, keep
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_word = [said["normalizer"], said["pre_tokenizer"], said["post_processor"], *[t["lstrip"] or t["rstrip"] for t in said["added_tokens"]]] == [_NORMALIZER, _SPLITTER, None, False, False]

    def run(self, run: str) -> bytes:
        plain = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.model.tokenize(plain)]
        found = self.runs[run] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def word(self, word: str) -> bytes:
        low = word.lower()
        runs = _RUNS.findall(low)
        if "".join(runs) != low or "<|" in low or len(low) > 200:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        known = self.runs.get
        if len(runs) == 1:
            return known(low) or self.run(low)
        return b"".join([known(r) or self.run(r) for r in runs])

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        # str.split() takes four separators more than the tokenizer for white space
        words = re.split(r"[ \t\n\x0b\x0c\r]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        known = self.known
        if len(known) > self.keep:
            known.clear()
        if len(self.runs) > self.keep:
            self.runs.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.word(w)
        return b"".join([known[w] for w in words])


#: Rests of a capacity's ``SMALLEST``-th or less are one class.
SMALLEST = 64


class Packer:
    """One task's bins. ``add`` takes documents; ``placed`` collects ``(piece, sequence, offset)``, in full sequences.

    A document's whole sequences are cut off. Its rest of r tokens is of class k = capacity // r, that is, between
    1/(k+1) and 1/k of the capacity, and a bin of class k holds k rests. What k rests leave free is filled from the document
    at hand: the one that comes when a bin is short of tokens is cut to fill it, and its remaining tokens fill the
    next bins. So at most one bin waits, and only these documents are cut.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made, self.placed = capacity, 0, []
        self.bins: dict[int, list[tuple]] = {}
        self.waiting, self.short = [], 0  # the bin that waits, and what it is short of
        self.filler: tuple | None = None

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.placed.append((p, self.made, offset))
            offset += len(p[2]) // 4
        self.made += 1

    def _fill(self) -> None:
        """Fill the bin that waits, as far as the filler goes."""
        if self.waiting and self.filler:
            doc, start, ids, total = self.filler
            n = min(self.short, len(ids) // 4)
            self.waiting.append((doc, start, ids[: 4 * n], total))
            self.short -= n
            self.filler = (doc, start + n, ids[4 * n :], total) if 4 * n < len(ids) else None
            if not self.short:
                self._close(self.waiting)
                self.waiting = []

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self._close([(doc, start, ids[4 * start : 4 * (start + self.capacity)], total)])
        if whole == total:
            return
        rest = (doc, whole, ids[4 * whole :], total)
        if self.waiting:  # then there is no filler left
            self.filler = rest
            self._fill()
            return
        k = min(self.capacity // (total - whole), SMALLEST)
        own = self.bins.setdefault(k, [])
        own.append(rest)
        if len(own) == k:
            del self.bins[k]
            self.short = self.capacity - sum(len(p[2]) for p in own) // 4
            if self.short:
                self.waiting = own
                self._fill()
            else:
                self._close(own)

    def finish(self) -> None:
        """What is left over fills sequences one after the other; the last part goes in falling powers of two."""
        left = [*self.waiting, *([self.filler] if self.filler else []), *(p for k in sorted(self.bins) for p in self.bins[k])]
        free = sum(len(p[2]) for p in left) // 4
        size = own = 0
        pieces: list[tuple] = []
        for doc, start, ids, total in left:
            while ids:
                if not size:
                    size = own = self.capacity if free >= self.capacity else 1 << (free.bit_length() - 1)
                n = min(size, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * n], total))
                start, ids, size = start + n, ids[4 * n :], size - n
                if not size:
                    self._close(pieces)
                    pieces, free = [], free - own
        self.bins, self.waiting, self.filler = {}, [], None


def pack(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(doc, start, length, ids, doc_tokens, sequence_id, offset)`` of every row of ``docs``.

    A document is its token ids and then ``end_id``; ``capacity`` is a power of two. Documents go to harmonic classes (see
    Packer), and each task fills its own bins of each class without looking at others: nothing is shuffled. Bins are
    filled up with parts of a document that is cut for it, so all sequences are full but, in each task, the last ones, of
    falling powers of two (11 at most for 2,048). No sequence needs padding.

    Null and empty texts are the end id alone. A very long text gives full sequences, one after the other; a task holds one
    text and a bin of each class at a time. Rows that repeat an id are packed each for itself. An empty table gives an
    empty result; other columns are ignored. ``ids`` are little-endian unsigned 32-bit ids. Which documents share a
    sequence, and ``sequence_id``, depend on how the rows are dealt out to tasks.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tokenizer_path
        if key not in _loaded:
            _loaded[key] = WordIds(key)
        encode = _loaded[key].encode
        end = np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        packer = Packer(capacity)

        def flush() -> pa.RecordBatch:
            rows = [(doc, start, len(ids) // 4, ids, total, base + sequence, offset) for (doc, start, ids, total), sequence, offset in packer.placed]
            packer.placed.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, encode(text.as_py()) + end)
                if len(packer.placed) >= 4096:
                    yield flush()
        packer.finish()
        if packer.placed:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc"), whole_text(text_col).alias("body")).mapInArrow(run, OUT)
