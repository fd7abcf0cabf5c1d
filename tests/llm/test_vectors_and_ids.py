"""Clustering, files of token ids and importance resampling against brute force."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glyphlake.llm import centroids, idfiles, queries, resampling
from glyphlake.llm.common import gathered


def clustered(rows, k, rounds, scale, salt):
    """Brute force over (vec_id, x): {place in rows: (cluster, distance)}, centroids."""
    whole = [[math.floor(v * scale) for v in x] for _, x in rows]
    order = sorted((i for i, (d, _) in enumerate(rows) if d is not None), key=lambda i: (sha256(f"{salt}{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    order += sorted((i for i, (d, _) in enumerate(rows) if d is None), key=lambda i: rows[i][1])
    now = [whole[i] for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), n) for n, c in enumerate(now)) for w in whole]

    for _ in range(rounds):
        found = assign()
        for n in range(len(now)):
            own = [w for w, (_, m) in zip(whole, found, strict=True) if m == n]
            if own:
                now[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return assign(), now


@pytest.mark.parametrize("case", ["plain", "copies", "few", "huge"])
def test_clustering_matches_brute_force(spark, case):
    random.seed(case)
    middles = [[random.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [m + random.gauss(0, 0.2) for m in random.choice(middles)]) for i in range(150)]
    if case == "copies":  # a third is one vector, ids repeat, one is missing, vectors tie
        rows = [(i % 90, [1.0, 0.0, -1.0, 0.5] if i % 3 == 0 else [float(random.randrange(2)) for _ in range(4)]) for i in range(150)] + [(None, [0.0] * 4)]
    if case == "few":
        rows = rows[:3]
    if case == "huge":
        rows += [(500, [1e9, -1e9, 0.0, 7.0]), (501, [1e9, -1e9, 1.0, 7.0]), (502, [float(1 << 17)] * 4)]
    broken = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [float("inf"), 0.0, 2.0, 3.0]), (905, [])]
    frame = spark.createDataFrame([(a, b, 0, 0) for a, b in rows + broken], "vec_id long, embedding array<double>, cluster int, pivots int").repartition(5)
    found = centroids.cluster(centroids.kept_vectors(frame, "vec_id", "embedding", 4), k=8, rounds=10, scale=1024, dims=4, salt="3:")
    want, middles = clustered(rows, 8, 10, 1024, "3:")
    got = centroids.summary(found).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter((d, n, s) for (d, _), (s, n) in zip(rows, want, strict=True))
    assert [[int(v) for v in c] for c in found.centroids] == middles
    sums = Counter()
    for s, n in want:
        sums[n] += s
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == sha256(",".join(map(str, middles[r.cluster])).encode()).hexdigest()
    assert 0 < found.exact_share <= 1
    if case == "plain":  # vectors in groups: most centroids are passed over
        assert found.exact_share < 0.5


def test_clustering_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.summary(centroids.cluster(centroids.kept_vectors(empty, "vec_id", "embedding", 4), 8, 10, 1024, 4, "3:")).count() == 0


def test_bounds_never_pass_over_the_nearest():
    rng = np.random.default_rng(3)
    for _ in range(20):
        rows, points = rng.integers(-40, 40, (300, 3)), list(rng.integers(-40, 40, (12, 3)))
        pivots = centroids.fixed_pivots(points, rows[:50], 3, 5)
        which, best, done = centroids.nearest(rows, centroids.pivot_table(rows, pivots), points, np.stack([centroids.pivot_table(p[None, :], pivots)[0] for p in points]))
        every = np.stack([centroids.squared(rows, p) for p in points], 1)
        assert (best == every.min(1)).all() and (which == every.argmin(1)).all() and done < every.size


WORDS = queries.WORD_TOKENIZER
TEXTS = ["", None, "a", " ", "Ünï ﬁ İΣͅ ΑΣ ς é e ́x", "it's we'll don 't 'S  x y z\x1c\x1d\x85q", "<|endoftext|> a<|startoftext|>b <|endoftext |>", "日本語 텍스트 १२३ 4567\n\n\t8\r\n9", "word " * 3000 + "end", "x" * 5000, "\U0001f600‍\U0001f525 !!! ...a.b", "a\u0000b � ﻿"]


def test_words_encode_as_whole_texts_do():
    random.seed(4)
    texts = TEXTS + ["".join(random.choice(" \n'abÄß́ſ1٣,。가가 <|>é") for _ in range(80)) for _ in range(300)]
    whole = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    texts += [chr(c) + m for c in range(0x21, 0x250) for m in ("", ".", "a", "!?", "Z-", "'s", "s'")] * 2  # letters and marks are looked up apart
    whole += [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts[len(whole) :], add_special_tokens=False)]
    for by_words in (True, False):
        assert [np.frombuffer(b, "<u2").tolist() for b in idfiles.encoded_texts(texts, WORDS, "<u2", by_words)] == whole


def test_what_is_known_is_bounded():
    known = idfiles.Recent(10)
    for i in range(100):
        known.turn()
        assert i < 12 or not known.unknown({"often"})
        for w in known.unknown({"often", f"w{i}"}):
            known[w] = i
        assert len(known) + len(known.old) <= 24
    batches = [pa.record_batch([pa.array(["x" * 100] * n, pa.string())], ["t"]) for n in (1, 5, 0, 3, 200, 2)]
    merged = list(gathered(iter(batches), 700))
    assert [b.num_rows for b in merged] == [9, 200, 2] and list(gathered(iter([]))) == []


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000, idfiles.BLOCK_IDS):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 33, n)).astype("<u4")
        block = idfiles.coded(ranks)
        assert (idfiles.decoded(block, n) == ranks).all()
        assert len(block) == -(-n // 4) + sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks.tolist())
        if n:
            with pytest.raises(ValueError):
                idfiles.decoded(block[:-1], n)
    parts = [np.arange(300_000, dtype="<u4"), np.zeros(0, "<u4"), np.array([1 << 31], "<u4")]
    content = idfiles.packed([5, None, -7], parts)
    ids, counts, ranks = idfiles.unpacked(content)
    assert (ids, counts.tolist()) == ([5, None, -7], [300_000, 0, 1]) and (ranks == np.concatenate(parts)).all()
    for bad in (content[:-1], b"XLID" + content[4:], content[:60]):
        with pytest.raises(Exception):  # noqa: B017
            idfiles.unpacked(bad)


def test_files_of_ids_hold_all_documents_in_order(spark, tmp_path, monkeypatch):
    random.seed(8)
    rows = [(i * 7 % 101 - 20, random.choice(TEXTS), "x") for i in range(101)] + [(None, "no id", "x"), (3, "again", "x"), (3, "again", "x"), (3, TEXTS[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(6)
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t, _ in rows:
        want[d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    monkeypatch.setattr(idfiles, "FILE_IDS", 4000)
    idfiles.write_ids(docs, f"file://{tmp_path}/ids", WORDS, 1, by_words=True)
    read = idfiles.read_ids(spark, f"file://{tmp_path}/ids").orderBy("file", "place").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in read) == want
    order = [r.doc_id for r in read]
    assert order[0] is None and order[1:] == sorted(order[1:])
    got = idfiles.digests(docs, WORDS, 1, by_words=True).orderBy("start").collect()
    at = 0
    for r, back in zip(got, read, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32, r.doc_id) == (at, back.n, zlib.crc32(bytes(back.ids)), back.doc_id)
        at += r.n_tokens
    assert idfiles.digests(docs.limit(0), WORDS, 1).count() == 0


def test_spans_are_the_runs_of_words():
    words = resampling.collapsed("Über-Haus, x9\tÀ É\x7f\x00z ZZ. zz").split(b" ")
    assert [w.decode() for w in words] == ["Über", "haus", "x9", "À", "É", "z", "zz", "zz"]
    for n, p in enumerate(resampling.patterns(1, 4), 1):
        assert [m.group() for m in p.finditer(b" ".join(words), overlapped=True)] == [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    assert resampling.collapsed(None) == resampling.collapsed(" .- ") == b"" and not len(resampling.Buckets(1, 3, 7).count(b""))


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 3), (2, 2)])
def test_resampling_matches_brute_force(spark, ngrams):
    random.seed(5)
    texts = [" ".join(random.choice(["Ab", "é", "zz", "9", "q-r", "the", "THE", "w%d" % random.randrange(40)]) for _ in range(random.randrange(60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (7, texts[7]), (300, None), (301, "")] + [(i, texts[9]) for i in range(400, 500)]
    target = [(random.choice(texts),) for _ in range(12)] + [(None,)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def cut(t):
        return "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in (t or "").translate(low)).split()

    def features(t):
        w = cut(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 100 for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for r in x for b in features(r)) for x in ([r[1] for r in rows], [r[0] for r in target]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 100) / ((s[b] + 1) * (sum(t.values()) + 100)))) for b in range(100)}
    want = []
    for d, x in rows:
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features(x))
        want.append((d, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(cut(x))))
    best = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = 10 * len(best) // 100
    ranks = {}
    for i, r in enumerate(best[:drawn]):
        ranks.setdefault(r[:4], []).append(i + 1)
    expected = Counter()
    for r in want:
        expected[(*r[:4], ranks[r[:4]].pop(0) if r[4] >= 20 and ranks.get(r[:4]) else None)] += 1
    docs = spark.createDataFrame([(d, x, 1, 2) for d, x in rows], "doc_id long, text string, score int, rank int").repartition(5)
    got = resampling.resample(docs, spark.createDataFrame(target, "text string"), ngrams=ngrams, buckets=100)
    assert Counter(map(tuple, got.collect())) == expected and drawn > 10
    assert resampling.resample(docs.limit(0), docs, buckets=100).count() == 0


def test_sql_twins_are_whole(spark, tmp_path):
    """The SQL twins of clustering and resampling agree on rows with copies, ties and gaps."""
    random.seed(6)
    vectors = [(i, [float(random.randrange(-2, 3)) for _ in range(64)] if i % 5 else [0.5] * (64 if i % 2 else 63)) for i in range(120)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(i, None if i % 40 == 1 else " ".join(random.choice(["Ä", "Bc", "d-e", "中", "x́"]) for _ in range(random.randrange(50)))) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Bc bc Ä"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op11_centroid_clustering", "op13_importance_resampling"):
        rows = queries.QUERIES[name](spark, str(tmp_path))
        want = con.sql(queries.ORACLES[name])
        assert sorted(rows.columns) == sorted(want.columns)
        assert Counter(map(tuple, rows.select(*want.columns).collect())) == Counter(want.fetchall()) and rows.count() > 0
