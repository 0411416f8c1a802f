"""The training-data operators on small inputs: edge cases, brute force, round trips."""

import hashlib
import io
import math
import os
import random
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import attention_lm, bpe, common, components, jaccard_join, language_id, media, mixing, quality_crf, quality_rules, subwords, suffix_dedup, token_store

EDGE = [None, "", "   \n\t", "one", "It's DON'T we're.", "a.b,c.. D.,., İstanbul ΣΑΣ ОДОС. x́ é.,", "<|endoftext|>Hello<|startoftext|>", "日本語 テスト。 123 4,5.", "é" * 900, "x" * 3000 + " y", "🙂🙂. 🙂,", "same text here " * 40, "same text here " * 40, "a b\x1cc\x85d e"]


def frame(spark, texts, extra=True):
    """Rows with an id each and a column whose name clashes with the operators' own."""
    rows = [(i, t, None if i % 5 == 0 else f"src{i % 3}", None if i % 4 == 0 else ("en", "de")[i % 2], 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens long")
    return df if extra else df.drop("n_tokens")


@pytest.fixture(scope="module")
def corpus(spark):
    common.ship_package(spark)
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def empty(corpus):
    return corpus.limit(0)


def words(text):
    return (text or "").encode().split()


def test_rules_counts(corpus, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(corpus).collect()}
    for i, t in enumerate(EDGE):
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(cover))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_good(corpus).columns == corpus.columns


def test_cascade_order_never_changes_a_verdict(corpus):
    n = len(quality_rules.RULES)
    a, b = (sorted((r["doc_id"], r["kept"]) for r in quality_rules.judge(corpus, order).collect()) for order in (list(range(n)), list(range(n))[::-1]))
    assert a == b


def test_rules_are_ordered_by_rejections_a_second():
    seconds, rejects = np.array([[1.0, 1.0, 0.1]] * 4), np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    assert quality_rules.order_rules(seconds, rejects) == [2, 0, 1]
    assert quality_rules.order_rules(seconds[:0], rejects[:0]) == [0, 1, 2]


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    m = quality_crf.Model(np.zeros(quality_crf.CELLS, np.float32), np.zeros(0), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = quality_crf.split_lines(["a\nb\nc\nd", "e"])
    score = rng.normal(size=5)
    p, _ = quality_crf.marginals(x, score, m)
    total, mass = 0.0, np.zeros(4)
    for code in range(16):
        y = [(code >> k) & 1 for k in range(4)]
        v = math.exp(m.start[y[0]] + sum(score[k] * y[k] for k in range(4)) + sum(m.trans[y[k], y[k + 1]] for k in range(3)))
        total, mass = total + v, mass + v * np.array(y)
    assert np.allclose(p[:4], mass / total)


def test_crf_learns(corpus, spark, empty):
    good, bad = "The cat sat on the mat with a friend.\nIt was fine.", "!!! ### $$$ ***\n%%% &&& !!!"
    docs = spark.createDataFrame([(i, (good, bad)[i % 2] + f"\nline {i}") for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_crf.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, model).collect()}
    assert all((s >= 0.5) == (i % 2 == 0) for i, s in got.items())
    assert all(0 <= r["score"] <= 1 for r in quality_crf.score(corpus, model).collect())
    assert quality_crf.score(empty, model).count() == 0
    one = quality_crf.fit(docs, labels.filter("quality = 1"))
    assert all(r["score"] > 0.5 for r in quality_crf.score(docs, one).collect())


def test_crf_on_held_out_rows(spark):
    """Labels of the test table: fitted on two thirds of the ids, looked at on the rest."""
    if not Path("/root/testdata/sf0.01/labels.parquet").exists():
        pytest.skip("no test table")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality_crf.fit(docs, labels.filter(~held))
    rows = quality_crf.score(docs.filter(held), model).join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) >= 0.93


@pytest.mark.parametrize("bits", [1, 5, 13, 15, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits - 1, size=1000, endpoint=True).astype(np.uint32)
    out = io.BytesIO()
    writer, counts, at = token_store.ShardWriter(out, bits, block_ids=64), [0, 5, 200, 1, 700, 94], 0
    for k, n in enumerate(counts):
        writer.add(None if k == 3 else k, ids[at : at + n])
        at += n
    writer.close()
    shard = token_store.Shard.open(out)
    assert shard.docs == [0, 1, 2, None, 4, 5] and list(shard.counts) == counts
    for a, b in ((0, 1000), (3, 9), (63, 65), (100, 531), (999, 1000), (5, 5)):
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_token_store(corpus, empty, spark):
    folder = common.scratch_path(spark, "test-shards")
    got = {r["doc_id"]: r for r in token_store.read_store(token_store.encode_store(corpus, folder, partitions=3), folder).collect()}
    t, start = subwords.load(), 0
    for i, text in enumerate(EDGE):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.read_store(token_store.encode_store(empty, folder), folder).count() == 0


def test_bpe_matches_the_tokenizer(corpus, empty):
    t = subwords.load()
    for r in bpe.encode_decode(corpus, with_ids=True).collect():
        ids = t.encode(EDGE[r["doc_id"]] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert list(r["ids"]) == ids and r["decoded"] == text and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(empty).count() == 0


def _coded(coder, texts):
    return [(n, ids.decode()[1:], text.decode()[1:]) for n, ids, text in coder.code([t.encode() for t in texts])]


def test_joins_are_mended_until_both_chunks_agree():
    coder, t, rng = bpe.ChunkCoder(), subwords.load(), random.Random(6)
    word = lambda: "".join(rng.choices("abcdé.,'日", k=rng.choice([1, 3, 8, 40, 600])))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts += [texts[0][100:] + " " + texts[1], "x" * 5000, " \n" + texts[2] + "\t"]
    for text, (n, ids, decoded) in zip(texts, _coded(coder, texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == t.decode(want, skip_special_tokens=False)
    assert coder.encoded > 20 and coder.reused and coder.joints
    # Where a word's ids are not those of the stretch, the stretch is widened, and nothing is taken unseen.
    near, far = "one two three four ".encode(), " five six seven eight".encode()
    coder._learn(set(near.split() + far.split()))
    honest = coder.words[b"four"]
    coder.words[b"four"] = coder._piece([5, 6])
    with pytest.raises(ValueError):
        coder._mend({(b"four", b"word", b"five"): ([b"three", b"four"], [b"five", b"six"])})
    assert coder.widened == 1
    coder.words[b"four"] = honest
    coder._mend({(b"four", b"word", b"five"): ([b"three", b"four"], [b"five", b"six"])})
    assert coder.joints[b"four", b"word", b"five"][1].decode().split() == list(map(str, t.encode("word", add_special_tokens=False).ids))


def test_words_are_kept_as_packed_ids():
    coder, t = bpe.ChunkCoder(), subwords.load()
    (n, ids, _), = coder.code([b"the quick brown fox, unbelievably quick. " * 40])
    assert coder.words[b"quick."] == np.array(t.encode("quick.", add_special_tokens=False).ids, coder.ids.dtype).tobytes()
    pieces = [c.piece for c in coder.chunks.values() if c is not None]
    assert pieces and all(isinstance(p, bytes) for p in pieces)
    assert n == len(ids.split()) and n * coder.ids.dtype.itemsize >= max(map(len, pieces))


def test_text_without_white_space(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklmnop", k=400_000))
    row = bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_tokens"] == len(subwords.load().encode(text, add_special_tokens=False).ids)


def test_chunks_are_cut_by_content():
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcdef ") for _ in range(5000))
    a, b = b"x" * 37 + passage, b"other start " * 9 + passage
    cuts = [set(len(t) - bpe.cut_points(np.frombuffer(t, np.uint8), np.array([0]))) for t in (a, b)]
    assert len(cuts[0] & cuts[1]) >= len(cuts[0]) - 2


def edited(rng, n_vocabulary=400):
    vocabulary = [f"w{i}" for i in range(n_vocabulary)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    docs = [None, "", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f", "a b c d e f g"]
    for i in range(70):
        w = list(base) if i < 40 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append(" ".join(w + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12) * (rng.random() < 0.3))]))
    return docs + rng.sample(docs[8:], 6)


def test_signatures_miss_no_similar_pair():
    rng, none, pairs = random.Random(3), np.zeros(0, np.uint64), 0
    for n in [*range(1, 50), *range(1, 50), 100, 200, 500, 1000]:
        a = {rng.randrange(2**63) for _ in range(n)}
        for _ in range(4):
            b = set(a)
            for x in rng.sample(sorted(a), rng.randint(0, max(1, n // 4))):
                b.discard(x) if rng.random() < 0.5 else b.add(rng.randrange(2**63))
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            if jaccard_join.similar(x, y):
                pairs += 1
                frequent = np.sort(x[:: rng.randint(1, 3)])
                for f in (none, frequent):
                    assert len(np.intersect1d(jaccard_join.signatures(x, f), jaccard_join.signatures(y, f)))
                assert 7 * jaccard_join.sketch_distance(jaccard_join.sketch(x), jaccard_join.sketch(y)) <= len(x) + len(y)
    assert pairs > 150


def test_jaccard_join(spark, empty):
    docs = list(enumerate(edited(random.Random(1))))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == jaccard_join.brute_force(docs)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_keep_one_keeps_one(spark):
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    near = lambda t: t + " more"
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(1, a), (1, a), (2, near(a)), (3, b), (3, near(b)), (None, b), (None, c), (None, c), (None, d), (None, near(d)), (4, d), (5, e), (5, f), (None, e)]
    rows += [(6, None), (6, None), (None, " "), (None, " "), (7, "")]
    df = spark.createDataFrame([(*r, len(r[1] or "") + k) for k, r in enumerate(rows)], "doc_id long, text string, extra long").repartition(3)
    # All pairs, on the numbers of the rows: ids play no part in what links.
    groups = jaccard_join.brute_force([(k, t) for k, (_, t) in enumerate(rows)])
    members = {}
    for k, (n, lead) in groups.items():
        members.setdefault(lead if n else ("bare", k), []).append(rows[k])
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(got) == len(members)
    order = lambda r: (r[0] is None, r[0] or 0)
    for m in members.values():
        best = {r for r in m if order(r) == min(map(order, m))}
        assert len(m) == 1 or sum(r in m for r in got) == 1
        assert best & set(got)


def test_jaccard_large_groups_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common_part, docs = [word() for _ in range(84)], []
    for _ in range(24):
        own = [word() for _ in range(20)]
        docs.append(common_part + own)
        docs += [common_part + own[:-1] + [word()] for _ in range(2)]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert jaccard_join._index(df).filter("kind = 2").count() > 16
    want = jaccard_join.brute_force(docs)
    assert len({c for _, c in want.values()}) > 4
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 12), (12, 10), (7, 7), (20, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 3, 10: 10, 11: 10, 12: 10}


def test_common_prefix():
    rng = random.Random(4)
    for _ in range(2000):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30)))
        b = bytearray(a + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))))
        if b and rng.random() < 0.7:
            b[rng.randrange(len(b))] ^= 3
        want = len(os.path.commonprefix([a, bytes(b)]))
        assert suffix_dedup._common(a, bytes(b), rng.randint(0, want)) == want


def test_loser_tree_merges():
    rng, runs, everything = random.Random(5), [], []
    for _ in range(7):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40)))
        everything += strings
        runs.append(suffix_dedup.Run(suffix_dedup.shared(strings, 12).tolist(), strings, [b""] * len(strings), None, None, None))
    run_of, number, lcp = suffix_dedup.merge_runs(runs)
    merged = [runs[r].right[i] for r, i in zip(run_of, number, strict=True)]
    assert merged == sorted(everything)
    assert lcp[1:] == [len(os.path.commonprefix(list(p))) for p in zip(merged[:-1], merged[1:], strict=True)]


def test_suffix_dedup(spark, empty):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [None, "", "a" * 399, "a" * 400, "a" * 401, "ab" * 1000, base[:1000], base[300:1500], base[700:1099] + "x" + base[100:499], base[2000:2400], base[2000:2400], base[2599:2999], base[2600:3000], "é" * 500, "x" + "é" * 300]
    for _ in range(30):
        texts.append("".join(base[(i := rng.randrange(2500)) : i + rng.randint(300, 700)] + rng.choice(["", "x", "yz" * 9]) for _ in range(rng.randint(1, 4))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()}
    assert [got[i] for i in range(len(texts))] == suffix_dedup.brute_force(texts)
    assert suffix_dedup.digest(empty).count() == 0


def test_suffixes_take_little_memory(monkeypatch):
    def peak(f, *args):
        tracemalloc.start()
        out = f(*args)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 5 << 20, np.uint8).tobytes().decode()
    pieces = list(suffix_dedup._pieces([text]))
    assert peak(suffix_dedup.find_items, pieces[0])[1] < 50e6
    doc, place = rng.integers(0, 9, (60_000, 2)), rng.integers(400, 10_000, 60_000)
    flags = np.zeros((60_000, 300), bool)
    flags[::7, 20:90] = flags[::5, 250:] = True
    (whole, first, stop), most = peak(suffix_dedup._spans, doc, place, flags, 400)
    assert most < 30e6
    monkeypatch.setattr(suffix_dedup, "FLAGGED", 1 << 20)
    again = suffix_dedup._spans(doc, place, flags, 400)
    assert all((a == b).all() for a, b in zip((whole, first, stop), again, strict=True)) and len(first) == len(flags[::7]) + len(flags[::5])


def test_only_items_that_share_a_mark_are_sorted(spark):
    rng = random.Random(13)
    own = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    part = own(430)
    texts = [own(5000) for _ in range(6)] + [own(700) + part + own(900), own(30) + part, part[:399] + own(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "owner long, text string").repartition(3)
    marks = {r["owner"]: np.sort(np.frombuffer(b"".join(r["marks"]), np.uint64)) for r in suffix_dedup.repeated_marks(df, suffix_dedup.BYTES, 5).collect()}
    assert {6, 7} <= set(marks) <= {6, 7, 8}
    whole = [suffix_dedup.find_items([(0, 0, t.encode())]) for t in texts]
    some = [suffix_dedup.find_items([(0, 0, texts[i].encode())], wanted=marks[i]) for i in (6, 7)]
    assert sum(map(len, whole)) > 150 and all(0 < len(x) <= 8 for x in some)
    for x, begin in zip(some, (700, 30), strict=True):  # every window of the part is served
        served = {p - o for p, o, left in zip(x.place, x.least, x.left, strict=True) for o in range(o, len(left) + 1)}
        assert set(range(begin, begin + 31)) <= served


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 4)))
    own = lambda k: " ".join(word() for _ in range(k))
    passage, many = [word() for _ in range(51)], [word() for _ in range(90)]
    texts = [own(70) + " " + " ".join(passage) + " " + own(9), " ".join(passage[:50]) + " " + own(80), own(5) + "\n" + "\t ".join(passage), " ".join(many[:60]), own(3) + " " + "\n".join(many[5:90]), " ".join(many[40:]) + " " + own(60), own(50), None, " ", "x " * 52, "y " * 51]
    lists, seen = [(t or "").encode().split() for t in texts], Counter()
    for w in lists:
        seen.update(tuple(w[i : i + 51]) for i in range(len(w) - 50))
    want = []
    for w in lists:
        gone = {k for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for k in range(i, i + 51)}
        want.append([x for k, x in enumerate(w) if k not in gone])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["_kept"]).split() for r in suffix_dedup.remove_repeats(df, characters=True, passages=True).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert [len(lists[i]) - len(want[i]) for i in (0, 1, 2, 3, 4, 5, 9, 10)] == [51, 0, 51, 55, 55, 0, 52, 0]


def test_short_passages_are_counted_and_kept(spark):
    rng = random.Random(14)
    own = lambda k: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(k))
    passage = own(55)  # 274 bytes
    texts = [own(60) + " " + passage + " " + own(9), passage.replace(" ", "\n"), passage[:249] + " " + own(20), own(120), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in suffix_dedup.digest(df, count=True).collect()}
    assert [got[i]["n_repeated"] for i in range(6)] == [55, 55, 0, 0, 0, 0]
    assert [tuple(got[i])[1:5] for i in range(6)] == suffix_dedup.brute_force(texts)


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, total, done = set(order), float(sum(sizes.values())), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > epochs * sizes[s]}
        if not over:
            return done | {s: level * weight[s] for s in left}
        for s in over:
            done[s] = float(epochs * sizes[s])
            total -= done[s]
        left -= over
    return done


def test_mixing(spark, corpus, empty):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["b", "a", None, "c", "tiny"]) if i else "tiny") for i in range(300)] + [(299, "repeated row", "a")] * 2
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 20]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, schedule = mixing.mix(df, min_slots=64)
    again = mixing.mix(df.repartition(3), min_slots=64)[0]
    got = got.collect()
    assert sorted(got, key=str) == sorted(again.collect(), key=str)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and len(got) == len(rows)
    assert schedule.agg(F.sum(F.col("to_word") - F.col("from_word"))).first()[0] == sum(taken.values())
    assert mixing.mix(corpus)[0].count() == len(EDGE) and mixing.mix(empty)[0].count() == 0
    assert mixing.mix(corpus.withColumn("text", F.lit(None).cast("string")))[0].agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 32, 576 * 33 + 5, 100_000])
def test_media_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    payload = media.pad(data)
    stored = media.wrap_video(payload)
    (track,) = media.tracks(stored)
    assert media.read_samples(stored, track) == payload and track.codec == "raw " and len(track.sizes) * 576 == len(payload)
    for _, a, b in track.keyframes:
        assert stored[a:b] in (payload[i : i + 576] for i in range(0, len(payload), 576 * media.KEY_EVERY))
    assert media.tracks(stored[:40]) == []


def test_media_query(corpus, empty):
    got = {r["doc_id"]: r for r in media.read_media(media.store_as_media(corpus)).collect()}
    for i, t in enumerate(EDGE):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[11]["feature"] == got[12]["feature"]
    assert media.read_media(media.store_as_media(empty)).count() == 0


def test_language_id(spark, corpus, empty):
    rng = random.Random(8)
    make = lambda syllables: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(40))
    kinds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ñor", "ció", "que"]}
    rows = [(k, make(v)) for k, v in kinds.items() for _ in range(20)]
    langs, prototypes = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert langs == ["aa", "bb", "cc"]
    test = spark.createDataFrame([(i, make(v), k) for i, (k, v) in enumerate(list(kinds.items()) * 5)], "doc_id long, text string, lang string")
    got = language_id.predict(test, langs, prototypes).join(test, "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(corpus, langs, prototypes).collect()}
    assert [edge[i] for i in (0, 1, 2, 10)] == ["und"] * 4 and edge[3] in langs and edge[7] in langs
    one = language_id.predict(spark.createDataFrame([(1, "z")], "doc_id long, text string"), langs, prototypes).first()
    assert one["lang_pred"] in langs
    assert language_id.predict(empty, langs, prototypes).count() == 0
    none = language_id.fit(empty.select("text", "lang"))
    assert language_id.predict(corpus, *none).filter("lang_pred <> 'und'").count() == 0


def test_languages_of_many_letters():
    """A table of all texts and all n-grams would take gigabytes."""
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(300)) for _ in range(200)]
    part, grams = language_id.bundles(texts, np.arange(200), 200)
    assert (grams == 300).all()
    alone, _ = language_id.bundles(texts[7:8], np.zeros(1, np.int64), 1)
    assert np.allclose(part[7], alone[0])


def test_attention_gradient():
    w = {k: v.astype(np.float64) for k, v in attention_lm.new_weights(50, 3, 4, 6).items()}
    rng = np.random.default_rng(0)
    ids, live = rng.integers(0, 50, (3, 6)), np.ones((3, 6), bool)
    live[0, 4:] = False
    target = np.where(live, rng.integers(0, 9, (3, 6)), -1)
    _, grads, met = attention_lm.step(w, ids, target)
    full = np.zeros_like(w["embed"])
    full[met] = grads["embed"]
    grads["embed"] = full
    for k in w:
        for _ in range(4):
            at = (ids[0, rng.integers(0, 4)], rng.integers(0, 4)) if k == "embed" else tuple(rng.integers(0, s) for s in w[k].shape)
            keep = w[k][at]
            values = []
            for e in (1e-5, -1e-5):
                w[k][at] = keep + e
                values.append(attention_lm.step(w, ids, target)[0])
            w[k][at] = keep
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(grads[k][at], abs=1e-5)


def test_attention_sees_nothing_ahead():
    w = attention_lm.new_weights(50, 3, 4, 6)
    ids = np.random.default_rng(1).integers(0, 50, (1, 6))
    other = ids.copy()
    other[0, 4:] = (other[0, 4:] + 1) % 50
    a, b = (attention_lm.attend(w, x)[0] for x in (ids, other))
    assert np.allclose(a[:, :4], b[:, :4])


def test_windows_score_each_id_once_with_half_a_context():
    assert attention_lm.CLASSES >= 128 and attention_lm.OVERLAP >= attention_lm.CONTEXT // 2
    new = attention_lm.CONTEXT - attention_lm.OVERLAP
    for n in (1, 2, 15, 16, 17, 31, 32, 33, 200):
        x = attention_lm.Sequences.of(np.arange(n - 1), np.array([n - 1]), 500)
        seq, first = x.windows(new)
        assert [p for f in first for p in range(f, min(n, f + new))] == list(range(n))
        follow, live = x.grid(seq, first, new, 1)
        assert follow[live].tolist() == [*range(n - 1), 500]


def _tree_model(counts, near, size):
    group, within = attention_lm.classes(counts, near)
    rng = np.random.default_rng(2)
    weights = {k: x + 0.3 * rng.standard_normal(x.shape).astype(np.float32) for k, x in attention_lm.new_weights(size).items()}
    return attention_lm.Model(group, within, weights)


def test_attention_scores_are_probabilities():
    """Of all ids that may follow, the probabilities add up to one; windows side by side give what each place gives alone."""
    size, rng = 600, np.random.default_rng(4)
    counts, near = rng.integers(0, 50, size + 1), rng.integers(0, 9, (size + 1, 2 * attention_lm.NEAR))
    model = _tree_model(counts, near, size)
    assert np.allclose(np.bincount(model.group, np.exp(model.within), minlength=attention_lm.CLASSES)[np.unique(model.group)], 1)
    scorer = attention_lm.Scorer(model)
    rows = [rng.integers(0, size, n) for n in (0, 3, 16, 40, 90)]
    x = attention_lm.Sequences.of(np.concatenate(rows), np.array([len(r) for r in rows]), size)
    got = scorer.score(x)
    w, want = model.weights, []
    for r in rows:
        ids, total = np.concatenate([[size + 1], r]), 0.0
        for i, follow in enumerate([*r, size]):
            first = max(0, i // 16 * 16 - 16)
            z = attention_lm.attend(w, ids[None, first : i + 1])[0][0, -1].astype(np.float64)
            upper = z @ w["o1"] + w["b1"]
            lower = [z @ w["o2"][g] + w["b2"][g] for g in range(attention_lm.BRANCH)]
            share = lambda v: v - np.log(np.exp(v).sum())
            every = (share(upper)[:, None] + np.array([share(v) for v in lower])).ravel()[model.group] + model.within
            if i == len(r) - 1:
                used = np.unique(model.group)
                assert np.exp((share(upper)[:, None] + np.array([share(v) for v in lower])).ravel()).sum() == pytest.approx(1)
                assert np.exp(every).sum() == pytest.approx(np.exp((share(upper)[:, None] + np.array([share(v) for v in lower])).ravel()[used]).sum())
            total += every[follow]
        want.append(total / np.log(10))
    assert got == pytest.approx(want, rel=1e-4)


def test_language_model_learns_from_all_rows(spark):
    rng = random.Random(12)
    cycle, texts = "one two three four five six seven eight".split(), []
    for _ in range(60):
        k = rng.randrange(8)
        texts.append((cycle[k:] + cycle[:k]) * 6)
    scores = []
    for make in (list, sorted):
        rows = [(i, " ".join(make(t)), True) for i, t in enumerate(texts)] + [(100, " ".join(cycle * 4), False)]
        df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(2)
        scores += [r["score"] for r in attention_lm.score_corpus(df, fit_rows=0).filter("doc_id = 100").collect()]
    # The words and their counts are the same, and no row is drawn for the start.
    assert scores[0] > scores[1] + 0.01
    table = subwords.word_ids()
    encoded = table.encode([" ".join(t).encode() for t in texts])
    df = spark.createDataFrame([(i, " ".join(t), True) for i, t in enumerate(texts)], "doc_id long, text string, train boolean").repartition(3)
    blocks = attention_lm.text_blocks(df)
    counts, near = attention_lm.profiles(blocks, table.size)
    want = np.zeros((table.size + 1, 2 * attention_lm.NEAR))
    for r in encoded:
        whole = [table.size + 1, *r.tolist(), table.size]
        for a, b in zip(whole[:-1], whole[1:], strict=True):
            want[b, a % attention_lm.NEAR] += 1
            if a <= table.size:
                want[a, attention_lm.NEAR + b % attention_lm.NEAR] += 1
    assert np.array_equal(near[: table.size], want[: table.size])
    assert np.array_equal(counts, np.bincount(np.concatenate([*encoded, np.full(60, table.size)]), minlength=table.size + 1))
    group, _ = attention_lm.classes(counts, near)
    start = attention_lm.new_weights(table.size)
    got = attention_lm.train_on_all(blocks, start, group, table.size)
    parts, shares = [[attention_lm.Block.unpack(bytes(r["rows"])) for r in part] for part in blocks.filter("rows IS NOT NULL AND n_train > 0").select("rows").rdd.glom().collect()], []
    for p, found in enumerate(parts):
        w = {k: x.copy() for k, x in start.items()}
        shares.append((w, *attention_lm.train_rows(w, (b.sequences(b.train, table.size) for b in found), group, table.size, p)))
    for k in start:
        n = [many if k != "embed" else seen[:, None] for _, many, seen in shares]
        total = np.maximum(sum(n), 1)
        want = np.where(np.asarray(sum(n)) > 0, sum(w[k] * x for (w, *_), x in zip(shares, n, strict=True)) / total, start[k])
        assert np.allclose(got[k], want, atol=1e-4)


def test_language_model_beats_counts_without_context(spark):
    """Held-out texts of the test table: the model against counts of subword ids."""
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no test table")
    docs = spark.read.parquet(str(path)).withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    got = {r["doc_id"]: r["score"] for r in attention_lm.score_corpus(docs).collect()}
    table, rows = subwords.word_ids(), docs.collect()
    ids = {r["doc_id"]: table.encode([(r["text"] or "").encode().lower()])[0] for r in rows}
    counts = np.bincount(np.concatenate([ids[r["doc_id"]] for r in rows if r["train"]]), minlength=table.size + 1) + 1.0
    counts[table.size] = sum(r["train"] for r in rows)
    share = np.log10(counts / counts.sum())
    held = [r["doc_id"] for r in rows if not r["train"]]
    assert sum(got[i] for i in held) > sum(share[ids[i]].sum() + share[table.size] for i in held)


def test_language_model_scores(corpus, empty):
    known = corpus.withColumn("train", F.col("doc_id") % 3 != 2)
    got = {r["doc_id"]: r for r in attention_lm.score_corpus(known, fit_rows=20).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(EDGE)}
    counts = Counter(w for i, x in tokens.items() if i % 3 != 2 for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(counts[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x))
        assert r["score"] < 0
    assert attention_lm.score_corpus(known.limit(0)).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices(["th", "an", "er", "on", "re"], k=3)) for _ in range(30)) + "."
    shared = "\n".join(line() for _ in range(5))
    texts = ["\n".join(line() for _ in range(6)) for _ in range(30)]
    texts += [texts[3], texts[4] + " more", shared + "\n" + "\n".join(line() for _ in range(20)), "\n".join(line() for _ in range(20)) + "\n" + shared, "###*** junk", None]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, ""), "test")
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
        if name == "suffix-array dedup":
            assert not any(shared[:400] in (r["text"] or "") for r in out.collect())
    assert kept["quality rules"] == set(range(34))
    assert kept["n-gram Jaccard join"] == set(range(34)) - {30, 31}
    assert kept["suffix-array dedup"] == kept["n-gram Jaccard join"]
    assert kept["BPE encoding"] == kept["source mix"] <= kept["suffix-array dedup"]


def test_pipeline_stages_with_odd_rows(spark):
    """Clashing names, repeated rows, null ids and texts, characters at cuts."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(8)
    passage = " ".join("".join(rng.choices("éabcdefgh", k=7)) for _ in range(80))
    own = lambda k: " ".join("".join(rng.choices("ijklmnopq", k=6)) for _ in range(k))
    a, b = own(30) + " \ufffd " + passage + " €" + own(5), own(12) + passage + own(20)
    rows = [(1, a), (1, a), (2, b), (None, own(15)), (3, None), (4, ""), (5, own(40)), (5, own(41)), (6, "x")]
    schema = "doc_id long, text string, source string, _doc int, _hash int, _id int, _kept string, _spans int, _n_bytes int, _size int, _copy int, _words int, _row int"
    df = spark.createDataFrame([(i, t, "s", *[k if n != 3 else str(k) for n in range(10)]) for k, (i, t) in enumerate(rows)], schema)
    once = stages["n-gram Jaccard join"](spark, df, "")
    assert once.columns == df.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in once.collect())
    assert got == sorted({(i is not None, i or 0, t or "") for i, t in rows})
    cut = stages["suffix-array dedup"](spark, once, "")
    assert cut.columns == df.columns
    kept = {r["doc_id"]: r["text"] for r in cut.filter("doc_id < 3").collect()}
    assert passage[:300] not in kept[1] and passage[:300] not in kept[2] and kept[1].count("\ufffd") == 1 and kept[2].count("\ufffd") == 0
    assert cut.count() == once.count()
    mixed = stages["source mix"](spark, df, "")
    assert mixed.columns == df.columns
    counts = Counter((r["doc_id"], r["_doc"]) for r in mixed.collect())
    assert set(counts.values()) == {1} and len(counts) == 7
    assert stages["BPE encoding"](spark, df, "").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0, name


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_jaccard_join"])
def test_queries_equal_their_sql(spark, name):
    """On the smallest test table."""
    import duckdb

    from cuemill.llm import queries

    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test table")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet'")
    sql = c.execute(queries.SQL[name])
    names = sorted(d[0] for d in sql.description)
    df = queries.QUERIES[name](spark, path)
    assert sorted(df.columns) == names
    want = sorted(tuple(r[[d[0] for d in sql.description].index(n)] for n in names) for r in sql.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want
