"""Vector codes, toxicity and alignment of tokenizers against brute force, with their edge cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuemill.llm import alignment, common, queries, toxicity, vector_codes

ODD = [None, "", " ", "\n", "  two  blanks ", "a b", "It's <s> <unk> </s> <0x0A> <|endoftext|> ok.", "▁piece x▁y", "日本語 テスト。 123 4,5.", "é" * 300, "x" * 2000 + " y", "🙂🙂. 🙂,", "tab\tand\r\nline  \n x", "same text here " * 30, "same text here " * 30, "a b\x1cc\x85d\xa0e", "nul\x00byte", " lead", "trail ", " wide   blanks", "İstanbul ΣΑΣ x́ é"]


@pytest.fixture(scope="module")
def texts(spark):
    common.ship_package(spark)
    rng = random.Random(3)
    more = [" ".join("".join(rng.choice(["th", "er", "qu", "ßi", "én", "st", "a"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 60))) + rng.choice([".", "\n", ""]) for _ in range(60)]
    rows = [(i, t, 5, 6) for i, t in enumerate([*ODD, *more])] + [(7, "repeated id", 5, 6), (None, "no id", 5, 6), (7, "repeated id", 5, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a long, block long").repartition(3)


def brute_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_alphabet()
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for i, t in rows:
        x = a.encode(f" {t}", add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        wx, wy = [bytes(letters[c] for c in a.id_to_token(k)) for k in x], [spell_b(k) for k in y]
        if not t or b"".join(wx) != f" {t}".encode() or b"".join(wy) != f" {t}".encode():
            docs.append((i, [], [], []))
            continue
        ex, ey = np.cumsum([len(w) for w in wx]).tolist(), np.cumsum([len(w) for w in wy]).tolist()
        ends = sorted(set(ex) & set(ey))
        groups, links, low = [], [], 0
        for e in ends:
            groups.append(",".join(str(k) for k, z in zip(x, ex, strict=True) if low < z <= e) + "|" + ",".join(str(k) for k, z in zip(y, ey, strict=True) if low < z <= e))
            low = e
        links = [(k, m) for k, z in zip(x, ex, strict=True) for m, v in zip(y, ey, strict=True) if z == v]
        count.update(links)
        docs.append((i, x, y, groups, links))
    top = Counter()
    for (_, m), n in count.items():
        top[m] = max(top[m], n)
    out = []
    for d in docs:
        if not d[1]:
            out.append((d[0], 0, 0, 0, 0, 0, 0, ""))
        else:
            i, x, y, groups, links = d
            out.append((i, len(x), len(y), len(groups), len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 500, alignment.BLOCK])
def test_alignment_equals_brute_force(texts, block):
    got = alignment.align(texts, block=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([(r["doc_id"], r["text"]) for r in texts.collect()])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_alignment_of_nothing_and_of_a_long_text(spark, texts):
    assert alignment.align(texts.limit(0)).count() == 0
    long = ("ein sehr langer Text ohne Ende. " * 20000) + "x" * 100000
    rows = spark.createDataFrame([(1, long), (2, "ein sehr langer")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align(rows).collect()}
    assert got[1]["n_groups"] > 100000 and got[1]["n_links"] == got[1]["n_groups"] and got[2]["n_a"] > 0


def test_alignment_keeps_nothing_between_cuts(texts):
    kept, alignment.KEEP = alignment.KEEP, 3
    try:
        code = alignment.Aligner()
        rows = [r["text"] for r in texts.limit(30).collect()]
        small = [code.block([t])[0].drop(columns="groups").values.tolist()[0] for t in rows]
        alignment.KEEP = kept
        assert small == alignment.Aligner().block(rows)[0].drop(columns="groups").values.tolist()
    finally:
        alignment.KEEP = kept


def test_link_counts_are_those_of_all_links(texts):
    blocks = alignment.group_blocks(texts)
    pairs = alignment.link_counts(blocks)
    links = alignment.align(texts).agg(F.sum("n_links").alias("n")).first()["n"]
    assert pairs.agg(F.sum("links").alias("n")).first()["n"] == links


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted([(math.inf if i is None else i, [math.floor(256 * x) for x in v], i, y) for i, v, y in kept], key=lambda r: (r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [c[p] for c, o in zip(cut, own, strict=True) if o == j]) else old for j, old in enumerate(books[p])]
    out = []
    for c, (_, _, i, y) in zip(cut, kept, strict=True):
        got = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), y))
    sums = Counter()
    for r in out:
        sums[r[3]] += r[2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, code, e, sums[y], sha) for i, code, e, y in out], key=str)


def vector_rows(n, seed, grain=64):
    """Vectors on a coarse grid, so that distances tie often."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-6, 6) / grain for _ in range(32)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [None, *rows[6][1][1:]], 2)
    rows[7] = (7, [float("nan"), *rows[7][1][1:]], None)
    rows[8] = (8, [float("inf"), *rows[8][1][1:]], 1)
    return [*rows, rows[10], (11, rows[12][1], 3), (None, rows[13][1], 1)]


def test_codes_equal_plain_lloyd(spark, tmp_path):
    common.ship_package(spark)
    for n, seed in ((400, 1), (30, 2)):
        rows = vector_rows(n, seed)
        folder = tmp_path / str(n)
        folder.mkdir()
        spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, x int").write.parquet(str(folder / "embeddings.parquet"))
        got = queries.op11_vector_codes(spark, str(folder))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


def test_codes_of_more_rounds_and_of_nothing(spark):
    common.ship_package(spark)
    rows = vector_rows(300, 4, grain=512)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress(df, parts=8, entries=20, rounds=5, groups=4)
    want = brute_codes(rows, 8, 20, 5)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == [r[:3] for r in want] and books.sha256() == want[0][4]
    near = {r["vec_id"]: r["vector"] for r in vector_codes.decode(coded, books).collect()}
    given = {i: v for i, v, _ in rows if i == 20}
    assert np.abs(np.array(near[20]) - np.array(given[20])).max() < 0.05
    none, no_books = vector_codes.compress(df.filter("vec_id IN (5, 6, 7, 8)"))
    assert none.count() == 0 and no_books is None
    with pytest.raises(ValueError):
        vector_codes.compress(df, parts=7)


def test_bounds_leave_groups_out_and_stay_exact():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 3, (500, 4)) for c in ([0, 0, 0, 0], [90, 0, 0, 0], [0, 90, 0, 0], [0, 0, 90, 90])]).astype(np.int64)
    start = x[rng.permutation(len(x))[:24]]
    books = vector_codes.Codebooks(start[None], vector_codes.cluster(start, 4)[None])
    code, best, low, done = vector_codes.assign(x, books, 0)
    assert done == len(x) * 24
    for _ in range(4):
        new = np.stack([x[code == j].sum(axis=0) // max((code == j).sum(), 1) if (code == j).any() else books.entries[0, j] for j in range(24)])
        books = vector_codes.Codebooks(new[None], books.group, books.entries)
        code, best, low, done = vector_codes.assign(x, books, 0, code, low)
        d = vector_codes.squared(x, new)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        for g in range(int(books.group.max()) + 1):
            other = np.where((books.group[0] == g)[None, :] & (np.arange(24)[None, :] != code[:, None]), d, np.iinfo(np.int64).max).min(axis=1)
            assert (low[:, g] <= np.sqrt(other.astype(float))).all()
    assert done < 0.6 * len(x) * 24


INSULTS = ["idiot", "moron", "scum"]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "or", "in", "re", "sta", "ble"]) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(8, 200))]
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(1 + len(ws) // 30):
                ws[rng.randrange(len(ws))] = rng.choice(INSULTS) + rng.choice(["", "s", "ish"])
        out.append((i, " ".join(ws) + ".", y))
    return out


def brute_toxicity(rows, order=4, discount=0.75):
    """The ratio of each symbol with plain dictionaries."""
    def walk(t):
        s = "".join(c.lower() if c.isalpha() else "\0" for c in f"\0{t}\0")
        while "\0\0" in s:
            s = s.replace("\0\0", "\0")
        return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]

    pad = lambda g: g.rjust(order, "\0")  # noqa: E731  a key's missing symbols are 0
    counts = {order: Counter()}
    for t, y in rows:
        for g in walk(t):
            counts[order][pad(g), y] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter()
        for g, y in counts[k + 1]:
            counts[k][g[1:], y] += 1
    both = Counter(g[1:] for g in {g for g, _ in counts[2]})
    base = lambda s: (both[s] + 0.5) / (sum(both.values()) + 0.5 * (len(both) + 1))
    total, types = Counter(), Counter()
    for k in range(2, order + 1):
        for (g, y), n in counts[k].items():
            total[g[:-1], y] += n
            types[g[:-1], y] += 1

    def p(g, y):
        if len(g) == 1:
            return base(g)
        n = total[g[:-1], y]
        return p(g[1:], y) if not n else (max(counts[len(g)][g, y] - discount, 0) + discount * types[g[:-1], y] * p(g[1:], y)) / n

    return lambda t: [math.log(p(pad(g), 1) / p(pad(g), 0)) for g in walk(t)]


def test_ratios_equal_plain_kneser_ney(spark):
    common.ship_package(spark)
    rows = toxic_rows(40, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_counts(toxicity.gram_counts(df))
    plain = brute_toxicity([(t, y) for _, t, y in rows])
    some = [*[t for _, t, _ in rows[:4]], "new idioten words, Zürich!", "a", "..", "", None, "x1y"]
    total, n = model.sums(some)
    for t, a, b in zip(some, total, n, strict=True):
        want = plain(t or "")
        assert b == len(want)
        assert abs(a - sum(want)) < 1e-3 * max(1, len(want))


def test_toxicity_on_rows_held_out(spark, tmp_path):
    common.ship_package(spark)
    rows = toxic_rows(800, 6)
    spark.createDataFrame([(i, t, "de", 0.5) for i, t, _ in rows] + [(900, None, None, None), (901, "", "x", 1.0), (901, "", "x", 1.0), (None, "an idiot", "x", 0.0)], "doc_id long, text string, lang string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(950, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op12_toxicity(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == 804 and all(0 <= r["score"] <= 1 and r["held_out"] is not None and r["predicted"] == (r["score"] >= 0.5) for r in found)
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert sum(r["predicted"] for r in held if not truth[r["doc_id"]]) <= 0.02 * len(held)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs, some)
        assert all(r["score"] < 0.5 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_a_text_is_scored_alike_in_any_batch():
    model = toxicity.Model()
    key, row = toxicity.symbols(["ab c", None, "", "Ab"])
    alone = [toxicity.symbols([t])[0].tolist() for t in ["ab c", None, "", "Ab"]]
    assert [key[row == i].tolist() for i in range(4)] == alone
    assert model.sums(["x"])[0].tolist() == [0.0]
