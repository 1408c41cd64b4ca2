"""SimHash, line dedup, mixing, packing and toxicity against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sourcelore.llm import lines, mixing, packing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, row int, line_count int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 2, 3) for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "One", "b"), (5, "One", "b"), (6, "é ß Straße   x\x1cy", "a"), (7, "w " * 30_000, "b"), (None, "no id", None)]


def brute_print(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = x if least.get(r) is None else least[r] if x is None else min(least[r], x)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id + 100, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    ids, prints = [r[0] for r in rows], [brute_print(r[1]) for r in rows]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    want = sorted(zip([str(i) for i in ids], prints, brute_components(ids, prints, 4)), key=str)
    assert sorted(((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("most", [100, 2_000_000])
def test_balls_meet_exactly_within_the_radius(most):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centre for _ in range(12)})
    a, b = simhash.meet(np.array(prints, np.uint64), np.full(len(prints), 2), list(range(64)), np.array(prints, np.uint64), 4, most)
    label = simhash.local_components(len(prints), a, b)
    assert [prints[i] for i in label] == brute_components(prints, prints, 4)


def test_links_of_skewed_fingerprints(spark):
    rng = random.Random(6)
    prints = sorted({sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    table = spark.createDataFrame([((p + 2**63) % 2**64 - 2**63,) for p in prints], "fp long")
    found = {r.node % 2**64: r.root for r in simhash.components(simhash.links(table, per_bucket=8)).collect()}
    groups = {}
    for p, c in zip(prints, brute_components(prints, prints, 4)):
        groups.setdefault(c, set()).add(found.get(p, p if p < 2**63 else p - 2**64))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_one_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "a"), (2, text, "a"), (2, text, "a"), (3, "quite another text of its own kind", "a"), (3, "quite another text of its own kind", "a"), (None, "no id here at all", "b")]
    kept = simhash.keep_one(docs_of(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None"] and len(kept[0]) == 8


def test_keep_one_decides_by_row(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, text("a"), "a"), (None, text("b"), "a"), (None, text("b"), "b"), (7, text("c"), "a"), (7, text("d"), "a"), (1, text("e"), "a"), (5, text("e"), "a"), (5, text("f"), "a"), (None, text("f"), "a")]
    for part in (rows, rows[::-1]):
        kept = simhash.keep_one(docs_of(spark, part)).collect()
        want = [("1", text("e")), ("5", text("f")), ("7", text("c")), ("7", text("d")), ("None", text("a")), ("None", text("b"))]
        assert sorted((str(r.doc_id), r.text) for r in kept) == want


def brute_lines(rows, least=5, chars=40):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, _ in rows:
        for s in (t or "").split("\n"):
            if i is not None and len(key(s)) >= chars:
                held.setdefault(key(s), set()).add(i)
    out = []
    for i, t, _ in rows:
        ls = (t or "").split("\n")
        kept = [s for s in ls if not (i is not None and len(held.get(key(s), ())) >= least and i != max(held[key(s)]))]
        out.append((str(i), len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    shared, other = "A common line of more than forty characters, é", "ANOTHER line " * 5
    rows = ODD + [(i, f"own {i}\n  {shared.upper() if i % 2 else shared}\t\n\n{other if i > 7 else 'short'}\n{shared}\n", "s") for i in range(10, 17)]
    rows += [(10, other, "s"), (12, f"{other}\n{other}", "s")] + [(20 + i, "short but common", "s") for i in range(6)] + [(None, shared, "s")]
    got = lines.drop_common_lines(docs_of(spark, rows)).collect()
    want = brute_lines([(i, t, s) for i, t, s in rows])
    # upper-cased é is another key for ASCII folding: brute_lines says so too
    assert sorted((str(r.doc_id), r.line_count, r.lines_dropped, r.text) for r in got) == want
    assert any(w[2] for w in want)


def test_mixing_hits_its_targets(spark):
    rows = [(i, "x" * (10 + i % 7), f"s{0 if i % 2 else i % 5}") for i in range(4000)] + ODD
    docs = docs_of(spark, rows).repartition(3)
    mixed = mixing.mix(docs, seed=3)
    size = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(F.char_length(F.coalesce("text", F.lit(""))))).collect()}
    got = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.char_length(F.coalesce("text", F.lit(""))))).collect()}
    roots = {s: n**0.5 for s, n in size.items() if n}
    for s in ("s0", "s2", "s4"):
        assert got[s] == pytest.approx(sum(size.values()) * roots[s] / sum(roots.values()), rel=0.12)
    again = mixing.mix(docs.repartition(5), seed=3)
    key = lambda df: sorted(map(str, df.select("doc_id", "source", "mix_copy", "mix_key").collect()))
    assert key(mixed) == key(again) and {"bucket", "row", "mix_rate", "mix_copies"} <= set(mixed.columns)
    counts = mixing.mix(docs.where("source = 's2'").limit(400), {"s2": 1.0}, total=20.0).groupBy("doc_id").count().collect()
    values = np.array([r["count"] for r in counts])
    assert values.mean() == pytest.approx(20, rel=0.05) and values.var() == pytest.approx(20, rel=0.3)
    assert mixing.mix(docs, {"absent": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0})


def test_packing_is_an_exact_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r.doc_id + 100, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ODD
    rows += [(50, "It's I'LL é Å  x 123 naïve y ... 　漢字 \x1d", "a"), (51, "<|endoftext|>a <|startoftext|>", "a")]
    want = sorted([(str(i), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, _ in rows])
    pieces = packing.pack(docs_of(spark, rows).repartition(3)).collect()
    sequences, parts = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        parts.setdefault((str(p.doc), p.doc_tokens, p.start), []).append(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    got = []
    for doc, total in {k[:2] for k in parts}:
        starts = sorted(k[2] for k in parts if k[:2] == (doc, total))
        for copy in range(len(parts[doc, total, 0])):
            ids = np.concatenate([parts[doc, total, s][copy] for s in starts])
            assert len(ids) == total
            got.append((doc, tuple(ids.tolist())))
    assert sorted(got) == want


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_full_and_hold_a_fixed_number_of_rests(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, rng.randrange(1, 300), rng.randrange(1, 3000), 64, 128]) for _ in range(rng.choice([0, 1, 7, 3000]))]
    packer = packing.Packer(128)
    for doc, n in enumerate(sizes):
        packer.add(doc, np.arange(n, dtype="<u4").tobytes())
    packer.finish()
    got, bins = {}, {}
    for (doc, start, ids, total), sequence, offset in packer.placed:
        n = len(ids) // 4
        assert total == sizes[doc] and n and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + n))
        got[doc] = got.get(doc, 0) + n
        bins.setdefault(sequence, []).append((offset, n))
    assert [got.get(i, 0) for i in range(len(sizes))] == sizes
    for own in bins.values():
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
    filled = [sum(n for _, n in own) for own in bins.values()]
    assert sum(f != 128 for f in filled) <= 7 and all(f & (f - 1) == 0 for f in filled)
    pieces = [0] * len(sizes)
    for (doc, _, _, _), _, _ in packer.placed:
        pieces[doc] += 1
    if len(sizes) > 1000:
        assert np.median([p for p, n in zip(pieces, sizes) if n <= 128]) == 1


def test_other_vocabularies_encode_whole_texts():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "It's  a test,\n of   spaces é"
    assert np.frombuffer(packing.WordIds(path).encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_toxicity_learns_pairs_and_held_out_documents(spark):
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        words = rng.sample(filler, 20)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["rotten"] * a + ["folk"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(a and b)))
    docs = docs_of(spark, rows)
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, table, toxicity.training_rows())
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs_of(spark, rows + ODD), machine).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    none = toxicity.fit(docs, table.limit(0), toxicity.training_rows())
    assert {r.toxicity for r in toxicity.score(docs_of(spark, ODD), none).collect()} == {0.5}


def test_empty_tables(spark):
    empty = docs_of(spark, ODD).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert lines.drop_common_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_digest_helpers():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
