"""The numbered queries against their SQL or plain Python over whole tables, and the pipeline stage by stage."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lm import direct
from test_substrings import brute as brute_repeats
from test_text_operators import brute_components, brute_lines, brute_print
from test_vectors_and_pages import brute_links

import corpus_pipeline
from sourcelore.llm import html, packing, queries, toxicity
from sourcelore.llm.common import stored


def rows(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in rows(spark, sf_dir, "documents")]


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    got = con.execute(queries.ORACLES[name])
    names = [c[0] for c in got.description]
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(text(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(text, r)) for r in got.fetchall())


def test_op1(spark, sf_dir, documents):
    prints = [brute_print(t) for _, t in documents]
    want = zip([i for i, _ in documents], [f"{p:016x}" for p in prints], brute_components([i for i, _ in documents], prints, 4))
    assert sorted(map(tuple, queries.op1_simhash(spark, sf_dir).collect())) == sorted(want)


def test_op2(spark, sf_dir):
    df = queries.op2_html(spark, sf_dir)
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = {r.page_id: (r.url, html.main_text(r.html or "", html.tree())) for r in rows(spark, sf_dir, "pages")}
    assert {r.page_id: (r.url, r.text) for r in df.collect()} == want and all(r.n_chars == len(r.text) for r in df.collect())


def test_op3(spark, sf_dir, documents):
    want = [(i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(documents, brute_repeats([t.encode() for _, t in documents], 400))]
    df = queries.op3_suffixes(spark, sf_dir)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and sorted(map(tuple, df.collect())) == sorted(want)


def test_op4(spark, sf_dir, documents):
    found = queries.op4_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in documents)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_op4_scores_equal_a_plain_machine(spark, sf_dir, documents):
    """The same training rows gathered in plain Python, and every pair of terms taken one by one."""
    marks = {}
    for r in rows(spark, sf_dir, "labels"):
        if r.doc_id is not None and r.toxic is not None and crc(r.doc_id, 5):
            marks[r.doc_id] = max(marks.get(r.doc_id, 0), int(r.toxic > 0))
    texts = dict(documents)
    own = sorted(i for i in marks if i in texts)
    bias, places, w, v = toxicity.train([toxicity.text_terms(texts[i]) for i in own], np.array([marks[i] for i in own], float))
    at = {int(p): i for i, p in enumerate(places)}
    assert len(at) > 10
    for r in queries.op4_toxicity(spark, sf_dir).collect():
        held = [at[p] for p in toxicity.text_terms(texts[r.doc_id]).tolist() if p in at]
        z = bias + sum(w[i] for i in held) + sum(float(v[i] @ v[j]) for n, i in enumerate(held) for j in held[:n])
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)


def test_op5_recall_with_production_values(spark, sf_dir):
    vectors = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in rows(spark, sf_dir, "embeddings")}
    ids, x = np.array(list(vectors)), np.stack(list(vectors.values()))
    got = {}
    for r in queries.op5_nearest(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        score = (x * vectors[q]).sum(1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit, total = hit + len(set(best) & {f[1] for f in found}), total + len(best)
        assert [f[0] for f in sorted(found)] == list(range(1, 21)) and all(f[2] == score[ids == f[1]][0] for f in found)
    assert hit / total >= 0.9


def test_op7(spark, sf_dir, documents):
    want = direct(documents, 10, 3)
    got = sorted((str(r.doc_id), not r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in queries.op7_lm(spark, sf_dir).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9) and [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-6)


def test_op8(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in documents}
    done, bins = Counter(), {}
    for r in queries.op8_packing(spark, sf_dir).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length
        done[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert done == {i: len(x) for i, x in ids.items()}
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048 and not ends[-1] & (ends[-1] - 1)


def test_op9(spark, sf_dir):
    own = [(r.vec_id, r.embedding, r.label) for r in rows(spark, sf_dir, "embeddings")]
    df = queries.op9_vectors(spark, sf_dir)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"] and sorted(map(tuple, df.collect())) == brute_links(own)


LONG = "A shared line of well over forty characters, as notices have it."


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    """Documents with nulls, empties, repeats, copies, a very long text and a column more; words that mark the toxic ones."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(420):
        toxic = i % 4 == 0
        body = rng.sample(words, 25) + ["vermin", "scum"] * toxic
        rng.shuffle(body)
        docs.append((i, " ".join(body) + (f"\n{LONG}" if i % 30 == 1 else ""), "en", f"s{i % 3}"))
        if i < 360:
            labels.append((i, 1, int(toxic)))
    docs += [(1000, docs[1][1], "en", "s1"), (1001, docs[2][1] + " end", "en", "s2"), (1002, None, "en", "s0"), (1003, "", None, None), (None, "no id " + " ".join(words[:30]), "en", "s0")]
    docs += [docs[5], (7, "another text of id seven " + " ".join(words[50:80]), "en", "s1"), (1004, " ".join(f"very{i % 977} long{i % 811}" for i in range(60_000)), "en", "s0")]
    at = tmp_path_factory.mktemp("corpus")
    table = spark.createDataFrame([(*d, len(d[1] or ""), "x", 3) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, line_count string, bucket int")
    table.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), docs


def brute_copies(docs):
    """The inverse of the Poisson distribution at a number from the MD5 of seed, id and part."""
    size = Counter()
    for _, t, source in docs:
        size[source] += len(t)
    roots, whole = sum(n**0.5 for n in size.values()), sum(size.values())
    out = []
    for i, _, source in docs:
        rate = size[source] ** 0.5 / roots * whole / size[source] if size[source] else 0.0
        parts, n = max(1, math.ceil(rate / 8)), 0
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"42:{'' if i is None else i}:{part}".encode()).hexdigest()[:13], 16) / 2**52
            p = below = math.exp(-rate / parts)
            k = 0
            while below <= u and k < 61 and rate:
                k += 1
                p *= rate / parts / k
                below += p
            n += k
        out.append(n)
    return out


def test_pipeline_stage_by_stage(spark, corpus):
    at, docs = corpus
    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    now = spark.read.parquet(f"{at}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, now, at), "test")
        steps.append((now, after))
        if name != "packing":
            assert after.columns == now.columns
        now = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]
    clean = [(i, t) for i, t, _, _ in docs if "vermin" not in (t or "")]
    assert key(steps[0][1]) == sorted((str(i), t or "") for i, t in clean)
    got = brute_lines([(i, t, "") for i, t in clean])
    assert key(steps[1][1]) == sorted((i, t) for i, _, _, t in got)
    assert all(r.n_chars == len(r.text or "") for r in steps[1][1].collect())
    before = key(steps[1][1])
    prints = [brute_print(t) for _, t in before]
    root = brute_components(list(range(len(before))), prints, 4)
    kept = key(steps[2][1])
    groups = {}
    for (i, t), r in zip(before, root):
        groups.setdefault(r, []).append((i == "None", int(i) if i != "None" else 0, t))
    assert len(kept) == len(groups) and all(sum((str(i) if not none else "None", t) in kept for none, i, t in set(own)) == 1 for own in groups.values())
    assert all(min(i for none, i, _ in own if not none) in {int(k) for k, _ in kept if k != "None"} for own in groups.values() if not all(o[0] for o in own))
    rest = [(r.doc_id, r.text or "", r.source) for r in steps[2][1].collect()]
    assert Counter(key(steps[3][1])) == Counter({(str(i), t): n for (i, t, _), n in zip(rest, brute_copies(rest)) if n})
    pieces = steps[4][1]
    encode = packing.WordIds(None).encode
    want = Counter()
    for r in steps[3][1].collect():
        want[str(r.doc_id), len(encode(r.text or "")) // 4 + 1] += len(encode(r.text or "")) // 4 + 1
    assert {(str(r.doc_id), r.doc_tokens): r.n for r in pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()} == want
    ran = corpus_pipeline.run(spark, at)
    digest = lambda df: df.select("doc_id", "doc_tokens").distinct().count()
    assert digest(ran) == digest(pieces) and ran.columns == pieces.columns


def test_pipeline_on_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{corpus[0]}/documents.parquet").drop("n_chars").limit(30).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/some/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() > 0
