"""The pipeline's stages one after the other, against what each must do with its own input."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from barscreen.llm import copies, mixing, packing
from barscreen.llm.common import RELEASE
from barscreen.sources.shared import shared_folder

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen, texts = [], {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, DATA), "test-stage")
        assert tuple(docs.columns) == pipeline.COLUMNS
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        seen.append(set(texts[name]))
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] and len(seen[0]) > len(seen[3]) > 0
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & seen[0]) >= 0.97 * len(good) and len(seen[0] & {i for i, q in labels.items() if q == 0}) <= 2
    packed = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == seen[3]


def test_run(spark):
    if os.path.isdir(DATA):
        assert pipeline.run(spark, DATA).count() > 0


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_drops_all_near_copies(spark):
    """Planted copies with edits, which differ in more than 3 bits of a fingerprint, against brute force."""
    r, texts = random.Random(7), [None, "", "a b", "A  b", "a b c", "one two three four five", "one two three four five six"]
    for _ in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(20, 400))]
        texts.append(" ".join(words))
        for _ in range(r.randrange(4)):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = f"new{r.randrange(9)}"
            texts.append(" ".join(own))
    base = [f"b{k}" for k in range(100)]
    texts += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 100, 2)]  # one family
    r.shuffle(texts)
    sets, comp = [plain_shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    for _ in range(20):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {x["doc_id"] for x in pipeline.near_dedup(spark, docs, DATA).collect()}
    assert kept == {i for i in range(len(texts)) if comp[i] == i} | {None}
    assert pipeline.near_dedup(spark, docs.limit(0), DATA).count() == 0


def test_near_dedup_verifies_near_pairs_only(spark, monkeypatch):
    """Long texts that share half of their words, and shingles of their prefixes too, aren't brought together with all their shingles."""
    texts, asked = {}, []
    half = lambda name: " ".join(f"{name}{k}" for k in range(120))
    for k in range(36):
        texts[k] = f"{half(f'a{k % 6}x')} {half(f'b{k // 6}x')}"  # each half is in six texts
        if k % 6 == 0:
            texts[100 + k] = f"{texts[k]} more"
    verified = copies._verified
    monkeypatch.setattr(copies, "_verified", lambda pairs, *more: asked.extend(pairs.collect()) or verified(pairs, *more))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {tuple(x) for x in copies.near_copies(docs).collect()} == {(100 + k, k) for k in range(0, 36, 6)}
    assert sorted(map(tuple, asked)) == [(100 + k, k) for k in range(0, 36, 6)]


def test_sketches_never_differ_more_than_their_sets():
    r = np.random.default_rng(2)
    for n, m, common in ((0, 0, 0), (0, 3, 0), (1, 1, 1), (50, 70, 40), (300, 1000, 250), (5000, 5000, 4500), (900, 1100, 0)):
        h = np.unique(r.integers(0, 2**64, n + m + 9, np.uint64))
        a, b = h[:n], h[n - common : n - common + m]
        assert copies.off(copies.sketch(a), copies.sketch(b)) <= n + m - 2 * common
    assert copies.off(copies.sketch(a), copies.sketch(b)) > 0.2 * (n + m)  # nothing in common: over what a similarity of 0.8 allows


def test_near_dedup_takes_what_line_dedup_leaves_of_near_copies(spark, tmp_path):
    """Of a copy with a changed line that line is left, which is like nothing; the whole document is still a copy."""
    r = random.Random(5)
    line = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(12))
    texts, copies = {}, set()
    for k in range(12):
        own = [line() for _ in range(20)]
        texts[k] = "\n".join(own)
        if k % 3:
            texts[100 + k] = "\n".join([*own[:7], line(), *own[8:]])
            copies.add(100 + k)
        texts[200 + k] = "\n".join([*own[:10], *[line() for _ in range(10)]])  # half of it is its own
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(101, texts[101], "en", "s", 1), (None, texts[0], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = pipeline.written(pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)), "test-stage")
    left = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert set(left) == {*texts, None} and all("\n" not in left[i] for i in copies)
    kept = {x["doc_id"]: x["text"] for x in pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {i: t for i, t in left.items() if i not in copies}


def test_near_dedup_leaves_no_large_tables_behind(spark, tmp_path):
    """Whole texts, shingles and line sets, each as large as a good part of the input, go as soon as nothing reads them."""
    r = random.Random(3)
    texts = ["\n".join(" ".join(f"w{r.randrange(300)}" for _ in range(9)) for _ in range(8)) for _ in range(40)]
    texts += ["\n".join([*t.split("\n")[:7], f"a new end {k}"]) for k, t in enumerate(texts[:20])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    folder, setting = shared_folder(spark).removeprefix("file://"), spark.conf.get(RELEASE)
    before = set(os.listdir(folder))
    docs = pipeline.written(pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)), "test-stage")
    assert pipeline.near_dedup(spark, docs, str(tmp_path)).count() == 40
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "near-copies" in left
    assert not left & {"line-sets", "matched-lines", "texts-as-they-came", "shingle-prefixes", "shingle-sets", "shared-shingles", "shingles"}
    assert spark.conf.get(RELEASE) == setting


ODD = [
    (1, None, "en", "src1", 5, "w", "k", 1), (2, "", None, None, None, None, None, None), (3, "one two three four five six", "en", "src1", 27, "w", "k", 1), (3, "one two three four five six", "en", "src1", 27, "w", "k", 1),
    (None, "a b c\nd e f", "de", "src2", 11, "w", "k", 1), (4, None, None, None, None, None, None, None), (5, "lone words here " * 2000, "en", "src1", -3, "w", "k", 1), (6, " \n\t\n", "fr", "other", 4, "w", "k", 1),
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_nulls_empties_repeats_and_clashes(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, line string, h1 int")
    rows = sorted(((r[0], r[1]) for r in ODD), key=repr)
    stages = dict(pipeline.STAGES)
    found = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert tuple(out.columns) == pipeline.COLUMNS
        found[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert set(found["quality"]) <= set(rows)
    assert found["line dedup"] == rows  # repeated rows are one document, and no line of another one matches
    assert {i for i, _ in found["near dedup"]} == {1, 3, None, 5}  # null and blank texts are alike
    assert set(found["mixing"]) <= set(rows)
    packed = stages["packing"](spark, docs, DATA).collect()
    assert sum(p["piece"] == 0 for p in packed) == len(ODD) and all(p["offset"] + p["length"] <= 1024 for p in packed)
    assert stages["packing"](spark, docs.limit(0), DATA).count() == 0


def test_mixing_and_packing_take_long_runs_of_white_space(spark):
    """tiktoken's search fails on a million of white space in a row; ids are still those of tokenizers."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, n = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), 1_200_000
    texts = ["a b c", "a" + " " * n + "b", "a" + "\n \t" * (n // 3) + "　 !", "one two" + " " * n, " " * n + "<|endoftext|>\n"]
    docs = spark.createDataFrame([(i, t, "en", f"src{i}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    taken = {r["doc_id"]: r["tokens"] for r in mixing.mixed(docs, share=1.0, max_epochs=1).select("doc_id", "tokens").collect()}
    got = pipeline.packing(spark, docs, DATA).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) == taken[i] + 1
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + k].tobytes()) for s, k in zip(own.start, own.length, strict=True)]


def test_near_dedup_never_pairs_a_family_whole(spark, monkeypatch):
    """The earliest texts of a large family have many edits and are like none of it; the others are still not paired with each other."""
    r, asked, n = random.Random(4), [], 240
    base, texts = [f"w{k}" for k in range(300)], []
    for k in range(n):
        words = list(base)
        for _ in range(12 if k < 20 else r.choice((1, 2, 3, 4, 6))):
            words[r.randrange(300)] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets, comp = [plain_shingles(t) for t in texts], list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    for _ in range(20):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    near = copies._near_sketches
    monkeypatch.setattr(copies, "_near_sketches", lambda found, *more: asked.append(found.count()) or near(found, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {tuple(x) for x in copies.near_copies(docs).collect()} == {(i, c) for i, c in enumerate(comp) if i != c}
    assert len(pairs) > 20 * n and sum(asked) < 10 * n, asked
