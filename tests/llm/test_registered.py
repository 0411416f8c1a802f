"""The registered queries on a small folder: their columns, splits and rows, recomputed the plain way."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuemill.llm import common, language_id, queries

TEXTS = [None, "", " \n", "It's DON'T we're.", "é" * 700, "x" * 3000 + " y", "🙂🙂. 🙂,", "日本語 テスト。", "same text here " * 40, "same text here " * 40, "nul\x00 byte", "İstanbul ΣΑΣ"]


def prose(rng, lang):
    parts = {"en": ["th", "er", "on", "an", "re"], "de": ["sch", "ei", "ung", "ber", "ch"], "fr": ["eau", "oi", "que", "ée", "ou"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 80)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    common.ship_package(spark)
    rng, rows = random.Random(5), []
    for i, t in enumerate(TEXTS):
        rows.append((i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 1))
    for i in range(len(TEXTS), 130):
        lang = rng.choice(["en", "de", "fr"])
        rows.append((i, prose(rng, lang), None if i % 10 == 0 else lang, f"s{i % 3}", 2))
    rows += [(40, "a repeated id", "en", "s1", 3), (40, "a repeated id", "en", "s1", 3), (None, "no id at all", None, None, 4)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long").repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(r[0], int((r[0] or 0) % 3 > 0), int((r[0] or 0) % 5 == 0)) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


SPLITS = {"op2_quality_crf": (3, 1), "op6_attention_lm": (7, 2), "op10_language_id": (5, 0), "op12_toxicity": (5, 0)}
COLUMNS = {
    "op2_quality_crf": "doc_id held_out score predicted",
    "op6_attention_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op12_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(SPLITS))
def test_learned_queries_keep_their_rows_and_splits(spark, folder, name):
    path, rows = folder
    got = queries.QUERIES[name](spark, path)
    assert got.columns == COLUMNS[name].split()
    found = got.collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((r[0] for r in rows), key=str)
    m, rest = SPLITS[name]
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"], m) == rest)
        if name != "op6_attention_lm":
            assert 0 <= r["score"] <= 1
        if "predicted" in got.columns:
            assert r["predicted"] == int(r["score"] >= 0.5)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_store_equals_whole_texts(spark, folder, tokenizer):
    path, rows = folder
    got = queries.op3_token_store(spark, path).collect()
    want, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        ids = [*ids_of(tokenizer, t), 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    at = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got)
    for s, n, _ in at:
        assert s == start
        start += n
    known = [i for _, _, i in at if i >= 0]
    assert known == sorted(known)


def test_bpe_equals_whole_texts(spark, folder, tokenizer):
    path, rows = folder
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = ids_of(tokenizer, r[1])
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    got = queries.op5_bpe(spark, path)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == sorted(want, key=str)


def test_media_payloads_are_the_texts(spark, folder):
    path, rows = folder
    got = queries.op9_iso_media(spark, path)
    assert set("doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()) <= set(got.columns)
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], []).append(r)
    same = {}
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        for r in found[i]:
            if r["n_bytes"] == len(data):
                assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
                assert same.setdefault(t or "", (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    assert sum(map(len, found.values())) == len(rows)


def test_sources_are_mixed_as_told(spark, folder):
    path, rows = folder
    got = queries.op8_source_mix(spark, path).collect()
    assert len(got) == len(rows)
    size, target, taken = {}, {}, {}
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
        assert r["taken"] <= 3 * r["size"]
    for i, t, _, source, _ in rows:
        n = len((t or "").encode().split())
        r = next(x for x in by_id[i] if x["size"] == n)
        size[source] = size.get(source, 0) + n
        target[source] = r["target"]
        assert r["source_size"] >= 0
    for r in got:
        source = next(x[3] for x in rows if x[0] == r["doc_id"] and len((x[1] or "").encode().split()) == r["size"])
        taken[source] = taken.get(source, 0) + r["taken"]
        assert r["source_size"] == size[source]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values()) + 1e-6
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= max(3, 0.1 * target[s])


def slow_vector(text, dims):
    """Letter by letter: runs of other characters as one space, trigrams of at most one space, permuted and multiplied."""
    letters = ["\0"]
    for c in text:
        c = c.lower()[0] if c.isalpha() else "\0"
        if c != "\0" or letters[-1] != "\0":
            letters.append(c)
    if letters[-1] != "\0":
        letters.append("\0")
    total = np.zeros(dims)
    n = 0
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b == "\0":
            continue
        v = [language_id.letter_vectors(np.array([ord(x)]), dims)[0] for x in (a, b, c)]
        total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        n += 1
    return total, n


def test_languages_equal_the_slow_form(spark, folder):
    path, rows = folder
    dims = language_id.DIMS
    sums, cache = {}, {}
    for i, t, lang, *_ in rows:
        cache[t or ""] = slow_vector(t or "", dims) if (t or "") not in cache else cache[t or ""]
        if lang is not None and t is not None and not (i is not None and crc(i, 5) == 0):
            sums[lang] = sums.get(lang, 0) + cache[t][0]
    langs = sorted(sums)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    protos = unit(np.array([sums[x] for x in langs]))
    protos = unit(protos - protos.mean(axis=0))
    for r in queries.op10_language_id(spark, path).collect():
        texts = [t or "" for i, t, *_ in rows if i == r["doc_id"]]
        wants = []
        for t in texts:
            v, n = cache[t]
            cosine = unit(v[None])[0] @ protos.T if n else None
            wants.append(("und", 0.0) if cosine is None else (langs[int(cosine.argmax())], float(np.clip((cosine.max() + 1) / 2, 0, 1))))
        assert any(r["lang_pred"] == w[0] and abs(r["score"] - w[1]) < 1e-4 for w in wants), (r, wants)


def test_very_long_texts(spark, tmp_path):
    """A text of some megabytes beside short ones goes through the linear operators whole."""
    long = " ".join(f"word{i % 5000}" for i in range(600_000))
    rows = [(0, long, "en", "a"), (1, "short text", "en", "a"), (2, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    n = {r["doc_id"]: r for r in queries.op13_alignment(spark, str(tmp_path)).collect()}
    assert n[0]["n_a"] > 600_000 and n[0]["n_links"] == n[0]["n_groups"] and n[2]["n_a"] == 0
    for name in ("op3_token_store", "op9_iso_media", "op10_language_id", "op12_toxicity", "op8_source_mix", "op1_quality_rules"):
        got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == {0, 1, 2}
    assert got[0]["n_words"] == 600_000


def test_pairs_are_verified_alike_without_broadcasts(spark, folder):
    from cuemill.llm import jaccard_join

    path, _ = folder
    want = sorted(map(tuple, queries.op4_jaccard_join(spark, path).collect()), key=str)
    kept, jaccard_join.BROADCAST_ROWS = jaccard_join.BROADCAST_ROWS, 0
    try:
        assert sorted(map(tuple, queries.op4_jaccard_join(spark, path).collect()), key=str) == want
    finally:
        jaccard_join.BROADCAST_ROWS = kept
    linked = [r for r in want if r[0] is not None and r[2] != r[0]]
    assert linked
