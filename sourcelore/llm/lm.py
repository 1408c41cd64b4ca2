"""Language-model scores by a weighted backoff automaton.

States are the start of a text, every frequent word, and the root. A state's arcs are the pairs kept for it; where a word
has no arc, the failure arc leads to the root at the state's backoff weight, and the root has an arc for every word. A
text is scored in one walk from left to right that carries the state and adds up log10 probabilities.

The whole model is too large for one place. Texts are dealt out to blocks of bounded size; a block asks for the counts of
its own words and pairs only, and gets the part of the automaton that its texts can walk through. A word goes by 63 bits
of its SipHash. Words and pairs are dealt out to buckets by their numbers; a block sends a bucket what it has, in order and
packed, and the answer is packed in the same order. So a word is one number from each block, however often it stands there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import stored, whole_text

#: The end of a text, and the id of the start. No word holds white space, and no word's id is negative.
END = "\n"
START = -1


def word_numbers(words: pa.Array) -> np.ndarray:
    """Words as numbers of 63 bits, by the SipHash of pandas with its fixed key."""
    return hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64) & ((1 << 63) - 1)


class Tokens:
    """A block's texts as codes: A-Z lower-cased words between ASCII white space, then the end, text by text. A word's code
    is its place among the block's sorted words, whatever the order of the texts; the end's is the last."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = lists.flatten()
        text = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        del lists
        full = pc.greater(pc.binary_length(flat), 0)
        text = text[full.to_numpy(zero_copy_only=False)]
        flat = flat.filter(full)
        coded = flat.dictionary_encode()
        del flat
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.words = pa.concat_arrays([coded.dictionary.take(pa.array(order)).cast(pa.string()), pa.array([END])])
        self.end = len(self.words) - 1
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        n = len(texts)
        self.codes = np.full(len(text) + n, self.end, dtype=np.int64)
        self.codes[np.arange(len(text)) + text] = place[coded.indices.to_numpy()]
        self.sizes = np.bincount(text, minlength=n) + 1
        self.text = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def numbers(self) -> np.ndarray:
        """Each code's word as a number of 63 bits."""
        return word_numbers(self.words)

    def pairs(self) -> np.ndarray:
        """(code before, or ``end + 1`` at the start) * (end + 2) + code, for every token."""
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.starts] = self.end + 1
        return before * (self.end + 2) + self.codes


class Automaton:
    """``arcs``: sorted state * width + code, with ``weights``, their log10 probabilities; ``back``: log10 weight of each state's
    failure arc; ``root``: log10 probability of each code. A code leads to its own state if it has one, else to the root."""

    def __init__(self, width: int, arcs: np.ndarray, weights: np.ndarray, back: np.ndarray, root: np.ndarray, is_state: np.ndarray) -> None:
        self.width, self.arcs, self.weights, self.back, self.root = width, arcs, weights, back, root
        self.next = np.where(is_state, np.arange(len(is_state)), -1)

    def walk(self, codes: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
        """The log10 probability of each token, texts from left to right. The state that a token is read in follows from the one
        before it alone, so all are carried on at once; each takes its arc, or fails to the root at the state's weight."""
        state = np.append(start, self.next[codes[:-1]])
        state[starts] = start
        asked = state * self.width + codes
        at = np.minimum(np.searchsorted(self.arcs, asked), max(len(self.arcs) - 1, 0))
        found = (state >= 0) & (self.arcs[at] == asked) if len(self.arcs) else np.zeros(len(codes), bool)
        return np.where(found, self.weights[at] if len(self.arcs) else 0.0, np.where(state >= 0, self.back[state], 0.0) + self.root[codes])


def _freed(out: pa.Table) -> pa.Table:
    """A group's result; what Arrow holds of the group goes back to the system, not to the worker's next group."""
    pa.default_memory_pool().release_unused()
    return out


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def _bytes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: what is small becomes runs of zeros."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _bucket(h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair of word ids."""
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of what is in order, and where each starts and ends."""
    buckets, starts = np.unique(bucket, return_index=True)
    return buckets, starts, np.append(starts[1:], len(bucket))


class Words:
    """A block's words, ordered by number and so by bucket."""

    def __init__(self, numbers: np.ndarray, buckets: int) -> None:
        self.order = np.argsort(numbers)
        self.numbers = numbers[self.order]
        self.buckets, self.starts, self.ends = _parts(((self.numbers >> 32) * buckets) >> 31)  # larger numbers, later buckets

    def counts(self, told: dict[int, bytes], buckets: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Each code's count and its id (-2 for fewer than ``least``), from the answers by bucket."""
        c, ids = np.empty(len(self.order), np.int64), np.full(len(self.order), -2, np.int64)
        for bucket, s, e in zip(self.buckets.tolist(), self.starts.tolist(), self.ends.tolist()):
            said = _numbers(told[bucket])
            own = self.order[s:e]
            c[own] = said[: e - s]
            ids[own[said[: e - s] >= least]] = said[e - s :] * buckets + bucket
        return c, ids


class Pairs:
    """A block's different pairs of states and words with ids, ordered by bucket and codes. ``ids``: of each code, -2 for none."""

    def __init__(self, t: Tokens, ids: np.ndarray, buckets: int) -> None:
        width = t.end + 2
        ids = np.append(ids, START)
        self.all = t.pairs()
        self.good = (ids[self.all // width] > -2) & (ids[self.all % width] > -2)
        every = np.unique(self.all[self.good])
        h, w = ids[every // width], ids[every % width]
        bucket = _bucket(h, w, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        self.every, self.order, self.h, self.w = every, order, h[order], w[order]
        self.buckets, self.starts, self.ends = _parts(bucket[order])

    def times(self, taken: np.ndarray) -> np.ndarray:
        """How often each occurs among the tokens for which ``taken`` holds."""
        learned, n = np.unique(self.all[self.good & taken], return_counts=True)
        times = np.zeros(len(self.every), np.int64)
        times[np.searchsorted(self.every, learned)] = n
        return times[self.order]


class Sums:
    """What the blocks sent to one bucket of words: its distinct words with their counts, and which of them each block has.
    Frequent words have places in the bucket, from 0 on: a word's id is its place times the number of buckets, plus the bucket."""

    def __init__(self, group: pa.Table, least: int) -> None:
        parts = [_numbers(x).reshape(2, -1) for x in group.column("packed").to_pylist()]
        self.words, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        self.c = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(self.words)).astype(np.int64)
        self.own = np.split(at, np.cumsum([p.shape[1] for p in parts])[:-1])
        self.frequent = self.c >= least
        self.place = np.cumsum(self.frequent) - 1


def score(docs: DataFrame, training: Column, min_word: int = 10, min_pair: int = 3, discount: float = 0.75, block_bytes: int = 8 << 20, least_blocks: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, learned boolean, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    The model learns from the rows for which ``training`` holds: all their words are counted, and all pairs of
    neighbours that occur ``min_word`` times each. A word's probability is (c - d) / N, with d the absolute discount
    n1 / (n1 + 2 n2); what is taken away goes to one unknown word. A pair found ``min_pair`` times keeps its discounted
    share of the state's count, and the rest of the state goes to the root as backoff weight; both add up, so every
    state's probabilities sum to 1. ``base_score`` is the add-one unigram score over the known words and an unknown one.

    Null and empty texts are the end alone. Rows that repeat an id are texts of their own. A very long text is walked as a
    whole, in its block. Words of equal count are treated alike, so ties need no order. With no training rows
    everything is unknown and scores 0. Empty tables give an empty result; other columns are ignored. No step gathers
    more than a block's texts and their own words and pairs, nor more of a word or pair than one number from each block.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body"), F.coalesce(training, F.lit(False)).alias("train"))
    size = texts.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    blocks = max(least_blocks, -(-size // block_bytes))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks)).cast("int"))

    buckets = 2 * blocks

    binary = "block int, bucket int, packed binary"

    def packed(block: int, buckets: np.ndarray, parts: list[bytes]) -> pa.Table:
        return _freed(pa.table([pa.array([block] * len(parts), pa.int32()), pa.array(buckets, pa.int32()), pa.array(parts, pa.binary())], ["block", "bucket", "packed"]))

    def count_words(group: pa.Table) -> pa.Table:
        t = Tokens(_column(group, "body"))
        train = _column(group, "train").to_numpy(zero_copy_only=False).astype(bool)
        n = np.bincount(t.codes[train[t.text]], minlength=t.end + 1)
        own = Words(t.numbers(), buckets)
        n = n[own.order]
        return packed(group.column("block")[0].as_py(), own.buckets, [_bytes(np.concatenate((np.diff(own.numbers[s:e], prepend=0), n[s:e]))) for s, e in zip(own.starts.tolist(), own.ends.tolist())])

    def sum_words(group: pa.Table) -> pa.Table:
        sums = Sums(group, min_word)
        m, c = len(sums.own), sums.c
        end = word_numbers(pa.array([END]))[0]
        said = [c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum(), c[sums.words == end].sum()]
        none = lambda kind: pa.nulls(1, kind)
        columns = [pa.concat_arrays((_column(group, "block"), none(pa.int32()))), pa.concat_arrays((_column(group, "bucket"), none(pa.int32()))), pa.concat_arrays((pa.array([_bytes(np.concatenate((c[own], sums.place[own][sums.frequent[own]]))) for own in sums.own], pa.binary()), none(pa.binary())))]
        columns += [pa.concat_arrays((pa.nulls(m, pa.int64()), pa.array([int(x)], pa.int64()))) for x in said]
        return _freed(pa.table(columns, ["block", "bucket", "packed", "n", "v", "n1", "n2", "texts"]))

    asked_words = stored(texts.groupBy("block").applyInArrow(count_words, binary), "words")
    counted = stored(asked_words.groupBy("bucket").applyInArrow(sum_words, f"{binary}, n long, v long, n1 long, n2 long, texts long"), "counts")
    total = counted.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n1", "n2", "texts")]).first()
    n, v, starts = total["n"], total["v"], total["texts"]
    taken = min(0.9, max(0.1, total["n1"] / (total["n1"] + 2 * total["n2"]))) if total["n1"] else 0.5
    counts = counted.where("block is not null").select("block", "bucket", "packed")

    def by_bucket(rows: pa.Table) -> dict[int, bytes]:
        return dict(zip(rows.column("bucket").to_pylist(), rows.column("packed").to_pylist()))

    def count_pairs(group: pa.Table, told: pa.Table) -> pa.Table:
        if not len(group):
            return packed(0, np.zeros(0, np.int32), [])
        t = Tokens(_column(group, "body"))
        own = Pairs(t, Words(t.numbers(), buckets).counts(by_bucket(told), buckets, min_word)[1], buckets)
        times = own.times(_column(group, "train").to_numpy(zero_copy_only=False).astype(bool)[t.text])
        return packed(group.column("block")[0].as_py(), own.buckets, [_bytes(np.concatenate((own.h[s:e], own.w[s:e], times[s:e]))) for s, e in zip(own.starts.tolist(), own.ends.tolist())])

    def sum_pairs(group: pa.Table) -> pa.Table:
        parts = [_numbers(x).reshape(3, -1) for x in group.column("packed").to_pylist()]
        size = [p.shape[1] for p in parts]
        h, h_at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        w, w_at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        n = np.concatenate([p[2] for p in parts])
        del parts
        key, at = np.unique(h_at * len(w) + w_at, return_inverse=True)
        c = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
        kept = c >= min_pair
        used = np.bincount(key[kept] // len(w), weights=c[kept] - discount, minlength=len(h))
        some = np.flatnonzero(used)
        answers = []
        for own in np.split(at, np.cumsum(size)[:-1]):
            answers.append(np.packbits(kept[own]).tobytes() + _bytes(c[own][kept[own]]))
        m, k = len(answers), len(some)
        none = lambda length, kind: pa.nulls(length, kind)
        columns = [(_column(group, "block"), none(k, pa.int32())), (_column(group, "bucket"), none(k, pa.int32())), (pa.array(answers, pa.binary()), none(k, pa.binary())), (none(m, pa.int64()), pa.array(h[some])), (none(m, pa.float64()), pa.array(used[some], pa.float64()))]
        return _freed(pa.table([pa.concat_arrays(x) for x in columns], ["block", "bucket", "packed", "h", "used"]))

    asked = texts.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(count_pairs, binary)
    pairs = stored(asked.groupBy("bucket").applyInArrow(sum_pairs, f"{binary}, h long, used double"), "pairs")
    used = stored(pairs.where("h is not null").groupBy("h").agg(F.sum("used").alias("used")), "used")
    start_used = used.where(F.col("h") == START).agg(F.max("used")).first()[0] or 0.0

    def share(group: pa.Table, used: pa.Table) -> pa.Table:
        """The mass that each block's frequent words keep for their arcs."""
        if not len(group):
            return packed(0, np.zeros(0, np.int32), [])
        sums = Sums(group, min_word)
        mass = np.zeros(int(sums.frequent.sum()))
        mass[_column(used, "h").to_numpy() // buckets] = _column(used, "used").to_numpy()
        parts = [_bytes(mass[sums.place[own][sums.frequent[own]]].view("<i8")) for own in sums.own]
        return _freed(pa.table([_column(group, "block"), _column(group, "bucket"), pa.array(parts, pa.binary())], ["block", "bucket", "packed"]))

    own_used = used.where(F.col("h") != START).select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), "h", "used")
    shares = asked_words.groupBy("bucket").cogroup(own_used.groupBy("bucket")).applyInArrow(share, binary)
    kind = lambda df, k: df.select("block", "bucket", "packed", F.lit(k).alias("kind"))
    model = kind(counts, 0).union(kind(shares, 1)).union(kind(pairs.where("h is null"), 2))

    def walk(group: pa.Table, model: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(group):
            return pa.table([pa.array([], k) for k in kinds], names)
        t = Tokens(_column(group, "body"))
        told = [by_bucket(model.filter(pc.equal(model.column("kind"), k))) for k in range(3)]
        own = Words(t.numbers(), buckets)
        c, ids = own.counts(told[0], buckets, min_word)
        is_state, mass = ids >= 0, np.full(t.end + 1, -1.0)
        at = own.order[is_state[own.order]]
        mass[at] = np.concatenate([_numbers(told[1][b]) for b in own.buckets.tolist()]).view("<f8")
        width = t.end + 2
        prob = np.where(c > 0, (c - taken) / max(n, 1), taken * v / n if n else 1.0)
        gamma = np.ones(width)
        gamma[:-1][is_state] = 1 - mass[is_state] / c[is_state]
        gamma[-1] = 1 - start_used / starts if starts else 1.0
        # the answers to this block's pairs, bucket by bucket
        pair, answer = Pairs(t, ids, buckets), told[2]
        seen = np.zeros(len(pair.every), np.int64)
        for bucket, s, e in zip(pair.buckets.tolist(), pair.starts.tolist(), pair.ends.tolist()):
            bits = -(-(e - s) // 8)
            at = s + np.flatnonzero(np.unpackbits(np.frombuffer(answer[bucket], np.uint8, bits), count=e - s))
            seen[at] = _numbers(answer[bucket][bits:])
        counted = np.zeros(len(pair.every), np.int64)
        counted[pair.order] = seen
        every, seen = pair.every[counted > 0], counted[counted > 0]
        h, w = every // width, every % width
        arc = np.log10((seen - discount) / np.append(c, starts)[h] + gamma[h] * prob[w])
        del own, pair, told, answer, model, ids
        automaton = Automaton(width, every, arc, np.log10(gamma), np.log10(prob), is_state)
        scores = np.bincount(t.text, weights=automaton.walk(t.codes, t.starts, t.end + 1), minlength=len(group))
        base = np.bincount(t.text, weights=np.log10(c + 1.0)[t.codes], minlength=len(group)) - t.sizes * np.log10(float(n + v + 1))
        known = np.bincount(t.text, weights=(c > 0)[t.codes], minlength=len(group)).astype(np.int64)
        return _freed(pa.table([_column(group, "id"), _column(group, "train"), pa.array(t.sizes, pa.int64()), pa.array(known), pa.array(np.full(len(group), n, np.int64)), pa.array(base), pa.array(scores, pa.float64())], names))

    scored = texts.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(walk, "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
