"""Phrases whose words stand together more often than their parts explain, by dynamic itemset counting.

Texts are cut into words once, in blocks, and blocks are dealt out to a few shards. Shards are scanned in a cycle, and one
scan counts phrases of all lengths at once: words from the first scan on, a longer phrase from the scan after both its
subphrases (all words but the last, all but the first) are seen to have been found often enough so far. A phrase is counted until it
has seen each block once, from wherever in the cycle it began. So most pairs and triples are complete shortly after the
words are, not a whole pass later for each length, and a phrase with a rare part is never counted.

A phrase of k words is a pair of ids: those of its subphrases. A block learns which of its own phrases are frequent by a join,
counts what that makes active, and sends one number for each phrase. So a common phrase is one row from each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelore.llm.common import dropped, stored, whole_text

#: A-Z become a-z; tab becomes space; all that ends a piece becomes a line feed.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))

_GRAMS = "block long, level int, left long, right long, n long"


def coded(texts: dict[str, list[bytes]]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """A block's words by number, text by text, with 0 where a piece ends; and of the words from number 1 on, most frequent
    first, the language, the word and how often it occurs. ``texts``: by language."""
    parts, known, langs, made = [np.zeros(1, np.int64)], [], [], 1
    for lang in sorted(texts):
        found = pa.array(b"\n".join(texts[lang]).translate(_LOWER).replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
        words = found.dictionary
        real = ~np.isin(np.arange(len(words)), [words.index(w).as_py() for w in (b"", b"\n")])
        number = np.where(real, np.cumsum(real) - 1 + made, 0)
        empty = words.index(b"").as_py()
        if empty >= 0:
            number[empty] = -1
        codes = number[found.indices.to_numpy()]
        parts += [codes[codes >= 0], np.zeros(1, np.int64)]
        known.append(words.filter(pa.array(real)).cast(pa.string()))
        langs.append(pa.array([lang], pa.string()).take(pa.array(np.zeros(len(known[-1]), np.int32))))
        made += len(known[-1])
    codes = np.concatenate(parts)
    n = np.bincount(codes, minlength=made)
    order = np.argsort(-n[1:], kind="stable")
    place = np.zeros(made, np.int64)
    place[order + 1] = np.arange(1, made)
    return place[codes], pa.concat_arrays(langs).take(pa.array(order)), pa.concat_arrays(known).take(pa.array(order)), n[1:][order]


def segments(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end where a piece ends, so that no phrase crosses them."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and _LOWER[text[end]] != 0x0A:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _bytes(codes: np.ndarray) -> bytes:
    """The low bytes of all numbers, then the next ones: most words are frequent ones, so the rest is mostly zeros."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def scan(codes: np.ndarray, known: list[tuple[np.ndarray, ...]], step: int, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What a visit at ``step`` counts in a block: for each length from 2 on, the phrases that have become active since the
    block was visited last, as ids of their subphrases and numbers. ``known``: for each length from 1 on, the block's
    frequent phrases as (key, key, id, step from which on the block could be told); words have their number as key, and 0."""
    number, _, ids, since = known[0]
    top = int(codes.max(initial=0)) + 1
    local = np.full(top, -1)  # the place of each word among the frequent ones
    local[number] = np.arange(len(ids))
    at = local[codes]
    out = []
    for level in range(len(known)):
        if level:
            left, right, ids_of, since_of = known[level]
            by_id = np.argsort(ids)
            place = lambda x: by_id[np.searchsorted(ids, x, sorter=by_id)]  # noqa: B023, E731
            key = place(left) * len(ids) + place(right) if len(left) else left
            by_key = np.argsort(key)
            both = (at[:-1] >= 0) & (at[1:] >= 0)
            asked = at[:-1] * len(ids) + at[1:]
            found = np.minimum(np.searchsorted(key, asked, sorter=by_key), max(len(key) - 1, 0))
            at = np.where(both & (key[by_key][found] == asked), by_key[found], -1) if len(key) else np.full(len(both), -1)
            ids, since = ids_of, since_of
        if len(at) < 2 or not len(ids):
            out.append((np.zeros(0, np.int64),) * 3)
            at = at[:0]
            continue
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        active = np.maximum(since[at[:-1]], since[at[1:]]) + 1
        new = both & (active > step - shards)
        pair, n = np.unique(at[:-1][new] * len(ids) + at[1:][new], return_counts=True)
        out.append((ids[pair // len(ids)], ids[pair % len(ids)], n))
    return out


def _blocks(docs: DataFrame, shards: int, block_bytes: int, lang_col: str, text_col: str) -> DataFrame:
    """``(block, number, lang, word, n, codes, shard)``: a row for each word of a block, and one with number 0 that has its codes;
    in folders by shard."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("body")).where("body <> ''")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        own: dict[str, list[bytes]] = {}
        held = made = 0

        def block() -> pa.RecordBatch:
            codes, langs, words, n = coded(own)
            m = len(words)
            none = lambda kind: pa.nulls(1, kind)
            columns = [pa.array(np.full(m + 1, (task << 33) + made)), pa.array(np.arange(m + 1)), pa.concat_arrays([none(pa.string()), langs]), pa.concat_arrays([none(pa.string()), words]), pa.concat_arrays([none(pa.int64()), pa.array(n)])]
            columns += [pa.concat_arrays([pa.array([_bytes(codes)], pa.binary()), pa.nulls(m, pa.binary())]), pa.array(np.full(m + 1, (task + made) % shards, np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["block", "number", "lang", "word", "n", "codes", "shard"])

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body")):
                for part in segments(body.as_buffer().to_pybytes(), block_bytes):
                    own.setdefault(lang, []).append(part)
                    held += len(part)
                    if held >= block_bytes:
                        yield block()
                        own, held, made = {}, 0, made + 1
        if own:
            yield block()

    cut_up = texts.mapInArrow(cut, "block long, number long, lang string, word string, n long, codes binary, shard int")
    return stored(cut_up, "blocks", by="shard")


def _scanned(blocks: DataFrame, answers: DataFrame, step: int, shards: int, max_words: int) -> DataFrame:
    """``_GRAMS`` of one scan."""

    def visit(block: pa.Table, told: pa.Table) -> pa.Table:
        names = ["block", "level", "left", "right", "n"]
        if not len(block) or not len(told):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names)
        level = told.column("level").to_numpy()
        columns = [told.column(c).to_numpy() for c in ("left", "right", "id", "since")]
        known = [tuple(c[level == k] for c in columns) for k in range(1, max_words)]
        found = scan(_codes(block.column("codes")[0].as_py()), known, step, shards)
        sizes = [len(f[0]) for f in found]
        which = np.repeat(np.arange(2, max_words + 1, dtype=np.int32), sizes)
        left, right, n = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.table([pa.array(np.full(len(n), block.column("block")[0].as_py())), pa.array(which), pa.array(left), pa.array(right), pa.array(n)], names)

    return blocks.select("block", "codes").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(visit, _GRAMS)


def count_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, shards: int = 2, block_bytes: int = 8 << 20, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)``: the words of each language; and for each length from 1 on, all phrases found ``min_count`` times, as
    ``(id, lang, words, n, prefixes, suffixes, left, right)``: counts of the first 1, 2, ... words and of the last ones, and
    the ids of the subphrases (null for words)."""
    blocks = _blocks(docs, shards, block_bytes, lang_col, text_col)
    words = blocks.where("number > 0").drop("codes")
    grams: list[DataFrame] = []  # by step
    #: By length less 1: what has been found min_count times so far, as key columns, n, id and since (the step that saw it reach that).
    frequent: list[DataFrame | None] = [None] * max_words
    told: dict[int, DataFrame] = {}  # what blocks know of their words, by shard, once all words are counted
    key = lambda level: ["lang", "word"] if level == 1 else ["left", "right"]
    seen, unseen = [False] * max_words, [False] * max_words
    step, changed = 0, -1  # the last step that told of something which may make longer phrases active
    while step < shards or step <= changed + shards:
        shard = step % shards
        if frequent[0] is not None:
            answers = told.get(shard)
            if answers is None:
                own = words.where(F.col("shard") == shard).drop("n").join(frequent[0].hint("shuffle_hash"), key(1))
                answers = own.select(F.col("block").alias("of"), F.lit(1).alias("level"), F.col("number").alias("left"), F.lit(0).cast("long").alias("right"), "id", "since")
                if step >= shards and max_words > 2:
                    answers = told[shard] = stored(answers, "told")
            for level in range(2, max_words):
                if frequent[level - 1] is not None:
                    for visit in range(shard, step, shards):  # a block is told of phrases that it has sent, from its next visit on
                        own = grams[visit].where(F.col("level") == level).join(frequent[level - 1].drop("n").hint("shuffle_hash"), key(level))
                        answers = answers.union(own.select(F.col("block").alias("of"), F.lit(level).alias("level"), "left", "right", "id", F.greatest("since", F.lit(visit))))
            grams.append(stored(_scanned(blocks.where((F.col("shard") == shard) & (F.col("number") == 0)), answers, step, shards, max_words), "grams"))
        else:
            grams.append(stored(docs.sparkSession.createDataFrame([], _GRAMS), "grams"))
        for level in range(1, max_words):
            if step < shards if level == 1 else not grams[-1].where(F.col("level") == level).isEmpty():
                unseen[level - 1], changed = True, step
            # looked at after the first scan that has any, and then at the end of each cycle: sums are over all scans so far
            if not unseen[level - 1] or (seen[level - 1] and shard < shards - 1):
                continue
            unseen[level - 1], seen[level - 1] = False, True
            counted = words.where(F.col("shard") <= step) if level == 1 else _of(grams, level)
            none = F.lit(None).cast("long")
            counted = counted.select(*key(level), "n", none.alias("id"), none.cast("int").alias("since"))
            if frequent[level - 1] is not None:
                counted = counted.union(frequent[level - 1].select(*key(level), F.lit(0).cast("long"), "id", "since"))
            found = counted.groupBy(*key(level)).agg(F.sum("n").alias("n"), F.max("id").alias("id"), F.max("since").alias("since")).where(F.col("n") >= min_count)
            new_id = F.monotonically_increasing_id() + F.lit(step << 56)
            found = stored(found.select(*key(level), "n", F.coalesce("id", new_id).alias("id"), F.coalesce("since", F.lit(step)).alias("since")), "frequent")
            frequent[level - 1] = None if found.isEmpty() else found
        step += 1

    sizes = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    if frequent[0] is None:
        return sizes, []
    none = F.lit(None).cast("long")
    levels = [frequent[0].select("id", "lang", F.array("word").alias("words"), "n", F.array("n").alias("prefixes"), F.array("n").alias("suffixes"), none.alias("left"), none.alias("right"))]
    for level in range(2, max_words + 1):
        if level < max_words and frequent[level - 1] is not None:
            total = frequent[level - 1].drop("since")
        else:  # the longest phrases make no others active, so they are summed up once, here
            total = _of(grams, level).groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).withColumn("id", none)
        of = lambda side, *names: levels[-1].select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names])  # noqa: B023, E731
        made = total.join(of("left", "lang", "words", "prefixes"), "left").join(of("right", "words", "suffixes"), "right")
        grown = lambda side, c: F.concat(f"{side}_{c}", F.array("n"))
        made = made.select("id", F.col("left_lang").alias("lang"), F.concat("left_words", F.slice("right_words", -1, 1)).alias("words"), "n", grown("left", "prefixes").alias("prefixes"), grown("right", "suffixes").alias("suffixes"), "left", "right")
        levels.append(stored(made, "phrases"))
    dropped(blocks, *grams, *told.values())
    return sizes, levels


def _of(grams: list[DataFrame], level: int) -> DataFrame:
    out = grams[0]
    for table in grams[1:]:
        out = out.union(table)
    return out.where(F.col("level") == level)


#: Each cut of a phrase as (score, words before it); exact, as decimals.
_CUTS = """transform(sequence(1, size(words) - 1), k -> struct(
    (1000000 * cast(n as decimal(15,0)) * cast(n as decimal(15,0))) div (cast(prefixes[k - 1] as decimal(19,0)) * cast(suffixes[size(words) - k - 1] as decimal(19,0))) as score, k as k))"""


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, within_percent: int = 50, top: int = 2000, shards: int = 2, block_bytes: int = 8 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, words, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``max_words`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and these into words at spaces and tabs. A
    candidate is found a >= ``min_count`` times within pieces, overlaps included. Its score is the least, over all cuts into
    a first and a last part found l and r times, of floor(10^6 a a / (l r)); equal cuts: the earliest. Candidates within a
    longer candidate that is found at least ``within_percent`` of a times are left out. Order: score, then a, falling, then
    phrase in byte order. n counts the language's words. All counts are exact, over all rows.

    Null texts are empty and have no words; a null language is ``und``. Rows that repeat are counted as often as they stand
    there. An empty table gives an empty result; other columns are ignored. Very long texts are cut where pieces end, so
    only a piece as long as a block is held whole. The result doesn't depend on ``shards`` and ``block_bytes``.
    """
    sizes, levels = count_phrases(docs, min_count, max_words, shards, block_bytes, lang_col, text_col)
    if len(levels) < 2:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, words array<string>, a long, l long, r long, n long, score long")
    found = None
    for shorter, longer in zip(levels[1:], [*levels[2:], None]):
        if longer is not None:  # a phrase within one two words longer is within one a word longer, found as often at least
            around = longer.select(F.col("left").alias("id"), F.col("n").alias("around")).union(longer.select("right", "n")).groupBy("id").agg(F.max("around").alias("around"))
            shorter = shorter.join(around, "id", "left").where(F.coalesce(100 * F.col("around") < within_percent * F.col("n"), F.lit(True)))
        shorter = shorter.select("lang", "words", "n", "prefixes", "suffixes")
        found = shorter if found is None else found.union(shorter)
    cut = found.withColumn("cut", F.array_min(F.expr(_CUTS)))
    cut = cut.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("n").alias("a"), F.expr("prefixes[cut.k - 1]").alias("l"), F.expr("suffixes[size(words) - cut.k - 1]").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = cut.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score")
