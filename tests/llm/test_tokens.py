"""Token counts against whole texts encoded by the library."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row
from tokenizers import Tokenizer

from sourcelore.llm import queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["word", " the", "  ", "\n", "\n\n  ", "don't", "'re", "'", "12", " 7", "é", "ñandú", "<|endoftext|>", "<|endof", "text|>", "!?", "—", "🙂", "中文", " ", "\x1c", "\t", "²", "ﬁ", "é", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def odd_texts(seed, n, most):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, k=draw.randrange(most))) for _ in range(n)]


def test_short_texts_as_the_library_counts(library):
    known = tokens.Vocabulary(None)
    texts = odd_texts(1, 1500, 12) + ["".join(random.Random(i).choices(PARTS[:10] + PARTS[15:17], k=30)) for i in range(500)]
    assert [known.count(t) for t in texts] == [whole(library, t) for t in texts]


def test_op13_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := whole(library, r.text), n > 512) for r in docs)
    df = queries.op13_tokens(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 20), (200, 60), (64, 17), (1000, 100)])
def test_chunks_are_spliced_to_the_whole(spark, library, chunk, overlap):
    texts = odd_texts(chunk, 60, 400) + ["x" * 3000, " " * 2500, "<|endoftext|>" * 90, "a <|endof" * 200, "né" * 999 + " end", "'re" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokens.count_tokens(docs, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: whole(library, t) for i, t in enumerate(texts)}
    assert len(got) == len(texts) and max(r.n_chunks for r in got) > 1


def test_overlaps_widen_until_a_boundary_is_found(spark, library):
    text = "some words first " * 20 + "x" * 2000 + " and words after " * 20
    docs = spark.createDataFrame([(1, text), (2, "plain words " * 200)], "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(docs, chunk_chars=256, overlap_chars=32).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {1: whole(library, text), 2: whole(library, "plain words " * 200)}
    assert got[1].n_chunks < len(text) // 256 and got[2].n_chunks == -(-(2400 - 32) // 224)


def test_odd_rows(spark, library):
    shape = "doc_id long, text string, n_tokens string, row int, body string"
    given = [(1, None, "a", 1, "b"), (2, "", None, None, None), (None, "no id here", "", 1, ""), (3, "same words " * 40, "", 2, ""), (3, "same words " * 40, "", 2, ""), (3, "other", "", 3, "")]
    got = tokens.count_tokens(spark.createDataFrame(given, shape), chunk_chars=100, overlap_chars=30).collect()
    want = [(i, len((t or "").encode()), whole(library, t)) for i, t, *_ in given]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert tokens.count_tokens(spark.createDataFrame([], shape)).collect() == []


def test_other_vocabularies_take_whole_texts(spark):
    texts = ["Some words.", "", "né 🙂 " * 50]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path, chunk_chars=20).collect()} == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path, chunk_chars=20).collect()} == {i: whole(other, t) for i, t in enumerate(texts)}
