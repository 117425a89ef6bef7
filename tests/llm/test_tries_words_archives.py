"""Operators 11 to 13 against brute force, with their defined results for nulls, ties, repeats, long texts and empty tables."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from barscreen.llm import spelling, trie, warc

# -- 11 ---------------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, id bigint, bytes int, depth int, parent string"


def plain_trie(rows):
    said = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))) for p, m in members.items()}
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, 7, "p") for r in rows], TURNS)


def odd_conversations():
    r = random.Random(11)
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, 1, "user", "é ß"), (3, 1, "user", "é ß"), (3, 1, "assistant", "tie"), (8, 0, "user", "x" * 30_000), (-7, 0, "user", "hi"), (-5, 0, "user", "base")]
    for c in range(10, 130):  # shared openings, copies and short ones
        shared = r.choice(["a", "a", "a", "b"])
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"{shared}{k if k < 4 else r.randrange(3)}") for k in range(r.choice([1, 2, 6, 9, 9]))]
    rows += [(c, k, "user", "same") for c in range(200, 300) for k in range(3)]
    rows += [(c, k, "user", f"deep {k}" if k < 40 else f"{c}") for c in range(405, 436, 5) for k in range(42)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("local", "digits"), [(trie.LOCAL, trie.DIGITS), (40, trie.DIGITS), (12, (1, 2)), (1, (1, 4))])
def test_op11_trie(spark, local, digits):
    rows = odd_conversations()
    got = trie.prefix_trie(conversations(spark, rows), local, digits)
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_op11_large_prefixes_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(trie, "BROADCAST_PREFIXES", 0)
    monkeypatch.setattr(trie, "HOT_SHARE", 5)
    rows = odd_conversations()
    assert Counter(tuple(r) for r in trie.prefix_trie(conversations(spark, rows), 30).collect()) == plain_trie(rows)


def test_op11_empty_and_turnless(spark):
    assert trie.prefix_trie(conversations(spark, [])).count() == 0
    assert trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    alone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)  # its base isn't there
    got = trie.prefix_trie(conversations(spark, [(alone, 0, "user", "x")])).collect()
    assert [tuple(r) for r in got] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_op11_quicksort_emits_every_prefix_once():
    r = random.Random(4)
    seqs = sorted({tuple([1, *(r.randrange(3) for _ in range(r.randrange(6)))]) for _ in range(200)})
    nodes = trie.multikey_quicksort([(s, [1] * len(s), 1, k, "e") for k, s in enumerate(seqs)], 0)
    assert len(nodes) == len({s[:d] for s in seqs for d in range(1, len(s) + 1)})
    assert nodes[0][3] == len(seqs) and sum(n[7] == "e" for n in nodes) == len(seqs)


# -- 12 ---------------------------------------------------------------------------------------------------------------


def plain_edit(a, b):
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain_words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    for a, b in itertools.combinations(n, 2):
        if plain_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items()}
    form = {w: f for w, f in best.items() if n[f] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items())


def odd_words():
    r = random.Random(12)
    stems = ["".join(r.choices("abcdeé", k=r.randrange(6, 12))) for _ in range(40)] + ["aaaaaaaa", "ÀÉÎõüÿß", "Internationale"]
    stems += ["gemeinsam" + x for x in "abcdefgh"] + ["x" * 400]
    rows = [(None, None), (1, ""), (2, "short words only"), (3, "× ÷ naïveté naïveté")]
    for d in range(4, 60):
        said = []
        for _ in range(60):
            w = stems[min(int(r.expovariate(0.15)), len(stems) - 1)]
            k = r.randrange(len(w))
            said.append(r.choice([w] * 9 + [w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "y" + w[k + 1 :]]))
        rows.append((d, r.choice([" ", "\n", "_", "7"]).join(said)))
    rows += [rows[-1], (None, "Internationale Internationale"), (70, "chained " + "uvwxyzabc " * 400 + "uvwxyzab " * 30 + "uvwxyza " * 2)]
    return rows


DOCS = "doc_id bigint, text string, word string, n bigint, length int, a int"


@pytest.mark.parametrize("shard_words", [1, 6, spelling.SHARD_WORDS])
def test_op12_words(spark, shard_words):
    rows = odd_words()
    got = spelling.grouped(spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], DOCS), shard_words).collect()
    expected = plain_words(rows)
    assert sorted(tuple(r) for r in got) == expected
    assert any(r[1] and r[2] != r[1] for r in expected)  # a form that has a form itself


def test_op12_shards_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_SHARDS", 0)
    rows = odd_words()
    got = spelling.grouped(spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], DOCS), 6).collect()
    assert sorted(tuple(r) for r in got) == plain_words(rows)


def test_op12_empty(spark):
    assert spelling.grouped(spark.createDataFrame([], DOCS)).count() == 0


def test_op12_merge_counts_and_comparison():
    r = random.Random(3)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randrange(0, 20))) for _ in range(r.randrange(1, 8))]
        least = r.randrange(1, 7)
        count = Counter(itertools.chain(*lists))
        assert list(spelling.merged(lists, least)) == sorted(k for k, c in count.items() if c >= least)
    for _ in range(3000):
        a, b = ("".join(r.choices("ab", k=r.randrange(1, 6))) for _ in "xy")
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(a) - len(b) <= 1 and a != b:
            assert spelling.one_edit(a, b) == plain_edit(a, b), (a, b)


# -- 13 ---------------------------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, digest string, bytes int, payload string"


def odd_pages():
    long = "<p>long</p>" * 1_800_000  # its member's last byte isn't zero
    shared = "<html>" + "shared " * 40
    rows = [(1, "http://a/1", None), (2, None, ""), (3, "http://a/b c\r\nX: y", "é" * 60), (4, "u", "é" * 60), (5, "u", "tiny"), (6, "u", "tiny"), (9, "u9", long)]
    rows += [(20, "u/b", shared), (20, "u/a", shared), (20, "u/a", shared), (21, None, shared), (None, "n", shared), (None, "n", "n" * 200), (None, None, "n" * 200), (30, "x", "n" * 200)]
    return rows + [(40 + k, f"http://x/{k}", f"<p>{k % 7}</p>" * 30) for k in range(60)]


def plain_records(rows):
    by = defaultdict(list)
    for p, _, html in rows:
        by[(html or "").encode()].append(p)
    out = []
    for payload, pages in by.items():
        digest, pages = hashlib.sha256(payload).hexdigest(), sorted(pages, key=lambda p: (p is None, p or 0))
        for k, p in enumerate(pages):
            first = k == 0 or len(payload) < 100
            out.append((p, len(payload), digest, "response" if first else "revisit", None if first else pages[0]))
    return sorted(out, key=str)


@pytest.fixture
def small_ranges(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("broadcast", [0, warc.BROADCAST_SHARED])
def test_op13_round_trip(spark, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_SHARED", broadcast)
    pages = spark.createDataFrame([(*r, "d", 1, "p") for r in odd_pages()], PAGES).repartition(3)
    got = warc.read_back(pages).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_records(odd_pages())
    assert all(r.intact for r in got)


def test_op13_archives_hold_what_was_written(spark, tmp_path, small_ranges):
    rows = odd_pages()
    warc.write_archives(spark.createDataFrame([(*r, "d", 1, "p") for r in rows], PAGES).coalesce(2), f"{tmp_path}/a")
    files = [f for f in os.listdir(f"{tmp_path}/a") if f.startswith("part-")]
    whole = b"".join(gzip.open(f"{tmp_path}/a/{f}").read() for f in files)  # other readers can read them too
    assert whole.count(b"WARC/1.1\r\n") == len(rows) + len(files)
    found = warc.read_archives(spark, f"{tmp_path}/a").collect()
    kinds = Counter(r.kind for r in found)
    assert kinds["warcinfo"] == len(files) and kinds["response"] + kinds["revisit"] == len(rows) and len(kinds) == 3
    ids = [r.record_id for r in found]
    assert len(set(ids)) == len(ids)
    responses = {r.record_id: r for r in found if r.kind == "response"}
    assert Counter(bytes(r.payload).decode() for r in responses.values()) == Counter((h or "") for _, _, h in rows if len((h or "").encode()) < 100) + Counter({h for _, _, h in rows if h and len(h.encode()) >= 100})
    for r in found:
        if r.kind == "revisit":
            assert r.refers_to in responses and responses[r.refers_to].payload_sha256 == r.payload_sha256 and r.payload is None
    assert "http://a/b%20c%0D%0AX:%20y" in {r.target_uri for r in found}


def stored(content):
    """A member whose bytes are those of its content: whatever is inside shows outside."""
    made = zlib.compressobj(0, zlib.DEFLATED, 31)
    return made.compress(content) + made.flush()


def foreign(payload, key):
    return warc.record("resource", key, "2020-01-01T00:00:00Z", payload, "application/octet-stream", WARC_Payload_Digest="sha256:" + hashlib.sha256(payload).hexdigest())


def test_op13_magic_inside_members_and_damage(spark, tmp_path, small_ranges):
    r = random.Random(13)
    inner = b"".join(stored(foreign(b"inner" + bytes(r.randbytes(300)), f"<urn:inner:{k}>")) for k in range(20))
    payloads = [inner if k % 4 == 0 else b"\x1f\x8b\x08".join(r.randbytes(r.randrange(900)) for _ in range(9)) for k in range(40)]
    payloads += [b"", b"\x1f\x8b\x08" * 2000]
    os.makedirs(f"{tmp_path}/w")
    members = [stored(foreign(p, f"<urn:x:{k}>")) for k, p in enumerate(payloads)]
    with open(f"{tmp_path}/w/a.warc.gz", "wb") as out:
        out.write(b"".join(members))
    with open(f"{tmp_path}/w/one.warc.gz", "wb") as out:  # one member with all records, named, zeros behind it
        with gzip.GzipFile("named", "wb", fileobj=out) as whole:
            whole.write(b"".join(foreign(p, f"<urn:y:{k}>") for k, p in enumerate(payloads)))
        out.write(b"\0\0\0")
    split = spark.read.options(**warc.AS_IT_IS).text(f"{tmp_path}/w").select("_metadata.file_name", "_metadata.file_block_start").distinct()
    assert split.filter("file_name = 'a.warc.gz' AND file_block_start > 0").count() > 10  # whatever their names, archives are split
    found = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert {x.kind for x in found} == {"resource"} and all(x.intact for x in found)
    for letter in "xy":
        got = {x.record_id: bytes(x.payload) for x in found if x.record_id.startswith(f"<urn:{letter}:")}
        assert got == {f"<urn:{letter}:{k}>": p for k, p in enumerate(payloads)}
    assert len(found) == 2 * len(payloads)
    # a cut, foreign bytes and a changed payload: what is whole is still found
    bad = foreign(b"changed", "<urn:z:bad>").replace(b"changed", b"CHANGED")
    parts = [b"junk", members[1], zlib.compress(b"no member"), warc.member(bad), warc.member(foreign(b"good", "<urn:z:good>")), warc.member(b"no record"), members[2][:-40]]
    os.makedirs(f"{tmp_path}/d")
    with open(f"{tmp_path}/d/d.warc.gz", "wb") as out:
        out.write(b"".join(parts))
    found = {x.record_id: x for x in warc.read_archives(spark, f"{tmp_path}/d").collect()}
    assert set(found) == {"<urn:x:1>", "<urn:z:bad>", "<urn:z:good>", None}
    assert found["<urn:z:good>"].intact and not found["<urn:z:bad>"].intact and found[None].kind == "damaged"


def test_op13_empty(spark, tmp_path):
    assert warc.read_back(spark.createDataFrame([], PAGES)).count() == 0


def test_op4_rows_that_share_a_doc_id_are_told_apart_by_their_texts(spark):
    from barscreen.llm import packing

    rows = [(k % 2 or None, f"{'a' if k % 3 else 'b'} {k} end") for k in range(60)] + [(7, "same"), (7, "same")]
    found = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        found.append(Counter(tuple(r) for r in packing.pack(docs).collect()))
    assert found[0] == found[1] and sum(found[0].values()) == len(rows)
    pieces = packing.pieces(spark.createDataFrame(rows, "doc_id bigint, text string"))
    sizes = Counter(r["length"] for r in pieces.collect())
    ranks = packing.ranked(pieces, sizes, share_rows=4).collect()
    assert Counter((r["length"], r["rank"]) for r in ranks) == Counter((n, k) for n, c in sizes.items() for k in range(c))


# -- 3 ----------------------------------------------------------------------------------------------------------------

ALPHABETS = {
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "BASE36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_op3_precision_and_recall_on_planted_tokens(spark):
    """Random tokens without a keyword, one in each document of the table: found, and little else."""
    from pyspark.sql import functions as F

    from barscreen.llm import secrets

    r, texts = random.Random(33), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text").collect()
    rows, planted = [], {}
    for k, (doc_id, text) in enumerate(texts):
        name = sorted(ALPHABETS)[k % len(ALPHABETS)]
        token = "".join(r.choices(ALPHABETS[name], k=r.choice([16, 20, 24, 32, 40, 64])))
        words = text.split(" ")
        words.insert(r.randrange(len(words) + 1), token)
        rows.append((doc_id, " ".join(words)))
        planted[doc_id] = (name, token)
    found = secrets.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).filter(F.col("n_random") > 0)
    texts, true, false, hits = dict(rows), 0, 0, Counter()
    for doc in found.collect():
        for span in doc["spans"].split(","):
            kind, start, end = span.split(":")
            if kind == "random":
                name, token = planted[doc["doc_id"]]
                hit = texts[doc["doc_id"]][int(start) : int(end)] == token
                true, false = true + hit, false + (not hit)
                hits[name] += hit
    assert true >= 0.97 * len(planted) and false <= 0.01 * true
    assert min(hits[name] / sum(n == name for n, _ in planted.values()) for name in ALPHABETS) >= 0.93


# -- 5 ----------------------------------------------------------------------------------------------------------------


def test_op5_added_spans_on_sentences_held_out_and_alone_or_in_a_batch():
    from barscreen.llm import personal

    weights = personal.fitted()
    texts, labels = personal._sentences(400, 77)
    bases = [personal.base_spans(t) for t in texts]
    added = personal.field_spans(texts, bases, weights)
    assert added[:60] == [personal.field_spans([t], [b], weights)[0] for t, b in zip(texts[:60], bases[:60], strict=True)]
    true, false, missed = 0, 0, 0
    for own, base, spans in zip(labels, bases, added, strict=True):
        meets = lambda x, s: x[0] < s[2] and s[1] < x[1]
        for s in spans:
            met = [x for x in own if meets(x, s)]
            hit = bool(met) and all(x[2] and personal.ADDED[x[2] - 1] == s[0] for x in met)
            true, false = true + hit, false + (not hit)
        missed += sum(x[2] > 0 and not any(meets(x, s) for s in (*base, *spans)) for x in own)
    assert true > 150 and false <= 0.05 * true and missed <= 0.05 * true


# -- empty tables of earlier operators --------------------------------------------------------------------------------


def test_empty_tables_give_no_rows(spark):
    from barscreen.llm import chat, copies, personal, pivots

    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert personal.scanned(docs).count() == 0 and copies.near_copies(docs).count() == 0
    assert chat.digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert pivots.near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
