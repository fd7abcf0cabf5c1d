"""Lines, near duplicates, mixing, urls and top-k against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import lines, minhash, mixing, queries, topk, urls
from glyphlake.llm.common import connected_components


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    random.seed(9)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = union(edges, range(60))
    assert all(got.get(n, n) == want[n] for n in range(60))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    random.seed(11)
    base = [[random.choice("abcdefghijklmnopqrstuvwxyz") + str(random.randrange(40)) for _ in range(random.choice((1, 2, 5, 40)))] for _ in range(25)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(25, 120):  # chains of small changes
        w = random.choice(texts)[1].split()
        w[random.randrange(len(w))] = "new" + str(random.randrange(50))
        texts.append((i, " ".join(w) if i % 5 else " ".join(w).upper() + " \n"))
    texts += [(200, ""), (201, None), (202, "  "), (5, texts[5][1]), (203, texts[7][1]), (203, texts[9][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, component_id string")
    sets = []
    for _, t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False)))
    pairs = [(texts[i][0], texts[j][0]) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union(pairs, {i for i, _ in texts})
    rows = minhash.near_duplicates(d, shingle=2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_lines_keep_one_of_each_group(spark):
    first = "Alpha bravo charlie delta echoes foxtrot golfing hotels india juliet"
    near = first.replace("hotels", "hostel")
    data = [(1, f"{first}\nonly here once and for all\nyes"), (2, f"  {first.upper()}  \nanother line that stands alone here"), (3, f"{near}\nyes\n{first}"), (4, None), (5, ""), (6, first), (None, first)]
    d = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, key int")
    got = {r.doc_id: r for r in lines.dedup_lines(d).collect()}
    assert got[1].text == data[0][1] and got[2].text == "another line that stands alone here" and got[6].text == ""
    assert got[3].text.split("\n")[-1] == "yes" and got[4].text is None and got[5].text == "" and got[None].text == first
    assert got[3]._dropped in (1, 2) and got[1]._lines == 3
    assert lines.dedup_lines(d.limit(0)).count() == 0


def test_rows_that_repeat_an_id_keep_their_unique_lines(spark):
    d = spark.createDataFrame([(1, "same line here\nonly in the first"), (1, "same line here\nonly in the other"), (2, "twice the same\n\nmore"), (2, "twice the same\n\nmore")], "doc_id long, text string")
    rows = sorted((r.text, r._dropped) for r in lines.dedup_lines(d.selectExpr("*", "1 as _gone", "2 as hash", "3 as _lines")).collect())
    kept = "\n".join(t for t, _ in rows).split("\n")
    assert all(kept.count(x) == 1 for x in ("same line here", "only in the first", "only in the other", "twice the same", "more"))
    assert [n for _, n in rows].count(2) == 1 and ("", 2) in rows
    assert rows.count(("twice the same\n\nmore", 0)) == 1


def prose(words, least):
    line = random.choice(words)
    while len(line) < least:
        line += " " + random.choice(words)
    return line


def edited(line, kind, share):
    """A copy of which a share of the characters, or of the words, is replaced, at least one."""
    parts = list(line) if kind == "characters" else line.split(" ")
    for i in random.sample(range(len(parts)), max(1, int(share * len(parts)))):
        parts[i] = "".join(random.choice("klmnopqrst") for _ in parts[i])
    return (" " if kind == "words" else "").join(parts)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


#: Pairs found of those that brute force finds, in percent at least, by length in characters, kind of edit and share.
RECALL = {(40, "characters", 0.01): 90, (40, "words", 0.1): 65, (90, "characters", 0.05): 75, (90, "words", 0.1): 90, (200, "characters", 0.01): 95, (200, "words", 0.05): 95, (200, "words", 0.1): 95, (450, "words", 0.15): 90, (600, "characters", 0.01): 95, (90, "characters", 0.15): 0, (200, "characters", 0.05): 35, (200, "characters", 0.15): 0, (20, "characters", 0.1): 80}


def test_edited_lines_are_found_at_all_lengths(spark):
    random.seed(13)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randrange(3, 11))) for _ in range(3000)]
    data, cases = [], []
    for case in RECALL:
        for _ in range(40):
            line = prose(words, case[0])
            other = edited(line, *case[1:])
            if 100 * distance(line, other) <= 20 * max(len(line), len(other)):
                cases.append((case, len(data) + 1))
                data += [(len(data), line), (len(data) + 1, other)]
    got = {r.doc_id: r._dropped for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert not any(got[i - 1] for _, i in cases)  # nothing else goes
    shares = {case: 100 * sum(got[i] for c, i in cases if c == case) / sum(c == case for c, _ in cases) for case in RECALL}
    print(shares)
    assert all(shares[case] >= least for case, least in RECALL.items()), shares


def test_lines_whose_words_all_differ_by_a_letter_are_one_group(spark):
    words = ["abcdefghijklm", "bdfhjlnprtvxz", "acegikmoqsuwy", "mnopqrstuvwxy", "zyxwvutsrqpon", "qwertyuiopasd", "lkjhgfdsapoiu"]
    data = [(1, " ".join(words)), (2, " ".join(w[:-1] + "0" for w in words)), (3, " ".join(w[::-1] for w in words))]
    assert [r._dropped for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).orderBy("doc_id").collect()] == [0, 1, 0]


def test_no_list_is_left_before_all_its_lines_are_compared(spark, monkeypatch):
    random.seed(17)
    monkeypatch.setattr(lines, "GROUP", 4, raising=False)
    texts = [prose(["".join(random.choice("abcdefghij") for _ in range(8)) for _ in range(9)], 60) for _ in range(30)]
    texts += [edited(t, "characters", 0.01) for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as hash", "text")
    keys = {r.text: r.hash for r in docs.collect()}
    one_list = lines.classes(docs, 0).withColumn("tokens", F.array(F.lit(1).cast("long")))
    got = {r.node: r.component for r in lines._links(one_list, docs, 80).collect()}
    assert set(got) == {keys[t] for t in texts[:3] + texts[30:]}
    assert all(got[keys[texts[i]]] == got[keys[texts[30 + i]]] for i in range(3)) and len(set(got.values())) == 3


def test_pairs_of_a_long_list_are_looked_at_in_portions(spark, monkeypatch):
    random.seed(23)
    monkeypatch.setattr(lines, "GROUP", 4, raising=False)
    monkeypatch.setattr(lines, "PORTION", 60, raising=False)
    similar, seen = lines._similar, []

    def counted(pairs, *more):
        seen.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(lines, "_similar", counted)
    texts = [prose(["".join(random.choice("abcdefghij") for _ in range(8)) for _ in range(9)], 60) for _ in range(60)]
    texts += [edited(t, "characters", 0.01) for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as hash", "text")
    keys = {r.text: r.hash for r in docs.collect()}
    got = {r.node: r.component for r in lines._links(lines.classes(docs, 0).withColumn("tokens", F.array(F.lit(1).cast("long"))), docs, 80).collect()}
    assert len(got) == 6 and all(got[keys[texts[i]]] == got[keys[texts[60 + i]]] for i in range(3)) and len(set(got.values())) == 3
    assert sum(seen) > 1000 and max(seen) < 300  # all pairs of the list, but not together


def test_short_exact_copies_go(spark):
    data = [(1, "ok\nRead more\n\n这一行没有空格"), (2, "\nread  MORE\nOK\nother"), (3, "这一行没有空格\n \nx")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"), spared=0).collect()}
    assert [got[i].text for i in (1, 2, 3)] == [data[0][1], "\nother", " \nx"]
    assert [got[i]._dropped for i in (1, 2, 3)] == [0, 2, 1]


def edf(ticks, cycle):
    """Slots by simulation: the earliest deadline among released blocks, ties to the first source."""
    done, out = {s: 0 for s in ticks}, []
    for t in range(cycle):
        ready = [(-(-(done[s] + 1) * cycle // q), s) for s, q in sorted(ticks.items()) if done[s] < q and done[s] * cycle // q <= t]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def test_schedule_is_edf_and_deviates_by_less_than_a_block(spark):
    ticks = {"a": 37, "b": 5, "c": 1, "d": 21}
    rows = mixing.cycle_schedule(spark.createDataFrame([(s, 64, q) for s, q in ticks.items()], "source string, cycle long, q long")).collect()
    got = [r.source for r in sorted(rows, key=lambda r: r.slot)]
    assert got == edf(ticks, 64)
    for t in range(65):
        assert all(abs(got[:t].count(s) - t * q / 64) < 1 for s, q in ticks.items())


def test_shares_deviate_from_the_weights_by_less_than_a_block(spark):
    sizes = {"a": 900, "b": 1700, **{f"s{i:02}": 40 for i in range(18)}}
    data = [(n * 10_000 + i, s) for n, (s, size) in enumerate(sizes.items()) for i in range(size)]
    d = spark.createDataFrame(data, "doc_id long, source string")
    for weights in ({"a": 0.3, "b": 0.52}, {"a": 0.05, "b": 0.55}, {"a": 0.9, "b": 0.1}):
        rest = 1_000_000 - round(1_000_000 * sum(weights.values()))
        whole = {s: round(1_000_000 * weights[s]) if s in weights else rest // 18 for s in sizes}
        total = sum(whole.values())
        rows = mixing.mixed_order(d, weights=weights, block=4).select("_source", "_block", "_slot").distinct().collect()
        assert {r._source for r in rows if r._slot is None} == {s for s in sizes if not whole[s]}
        placed = sorted((r._slot, r._source) for r in rows if r._slot is not None)
        assert len({t for t, _ in placed}) == len(placed)
        done = dict.fromkeys(sizes, 0)
        # Until the first source runs out every slot is filled.
        for t, (slot, source) in enumerate(placed):
            done[source] += 1
            if slot != t or done[source] * 4 > sizes[source]:
                break
            assert all(abs(n * total - (t + 1) * whole[s]) < total for s, n in done.items())
        else:
            raise AssertionError("no source ran out")
        assert t > 20


def test_mixing_matches_its_sql(spark, tmp_path):
    import duckdb

    data = [(i * 7, s) for s, n in (("x", 700), ("y", 90), (None, 33), ("z", 1)) for i in range(n)]
    spark.createDataFrame(data, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    twin = duckdb.sql(mixing.oracle_sql())
    got = queries.op5_source_mixing(spark, str(tmp_path)).select(*twin.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(twin.fetchall(), key=str)


def test_mix_keeps_every_row_in_its_window(spark):
    random.seed(3)
    data = [(random.randrange(10**6), random.choice(["big"] * 8 + ["mid", "small", None])) for _ in range(900)] + [(None, "mid"), (7, "mid"), (7, "mid")]
    d = spark.createDataFrame([(i, s, "x") for i, s in data], "doc_id long, source string, slot string")
    for weights in (None, {"big": 0.5, "mid": 0.3}):
        rows = mixing.mixed_order(d, weights=weights).collect()
        assert sorted(map(str, ((r.doc_id, r.source) for r in rows))) == sorted(map(str, data))
        assert all(r._release <= r._slot < r._deadline for r in rows)
        taken = {(r._slot, r._row) for r in rows}
        assert len(taken) == len(rows)
    assert mixing.mixed_order(d.limit(0)).count() == 0
    mixed = mixing.mix(d)
    assert mixed.columns == [*d.columns, "_slot", "_row"] and sorted(map(str, mixed.select(*d.columns).collect())) == sorted(map(str, d.collect()))
    clash = mixing.mixed_order(d.selectExpr("*", "1 as _part", "2 as _k", "3 as _q", "4 as _slot")).collect()
    assert sorted((r._slot, r._row) for r in clash) == sorted((r._slot, r._row) for r in mixing.mixed_order(d).collect()) and all(r._part == 1 and r._q == 3 for r in clash)


PAGES = [
    (1, "HTTP://Good.ORG/a?x", '<a href="http://far.net/x">f</a>'),
    (2, "x://a.example.org/es/1#t", "<a class=b href='https://spam.net'>s</a>"),
    (3, "x://far.net/", '<a href="//FRIEND.net/q">'),
    (4, "x://spam.net/p", None),
    (5, "x://friend.net", ""),
    (6, "no scheme", None),
    (7, None, None),
    (8, "x://shop.com/de/1", '<a href="x">'),
    (9, "x://shop.com/en/1", ""),
    (10, "x://links-to-shop.net/", '<a href="http://shop.com/">'),
    (10, "x://links-to-shop.net/", '<a href="http://shop.com/">'),
    (11, "x://org", None),
]


def test_urls_match_their_sql(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, verdict string")
    got = sorted(map(tuple, urls.judge_urls(pages).collect()), key=str)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert got == sorted(con.execute(urls.oracle_sql()).fetchall(), key=str)
    by = {r[0]: r for r in got}
    assert by[1][1:] == ("good.org", "/a", "org/", "allow") and by[2][3:] == ("example.org/es/", "block") and by[11][3] is None
    assert by[9][4] == "block" and by[10][4] == "block" and by[3][4] == "allow" and by[6][1:] == ("", "", None, "allow")
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "PER_PASS", 1)
    monkeypatch.setattr(topk, "BLOCK", 4)
    random.seed(8)
    data = [(i, [random.uniform(-0.5, 0.5) for _ in range(6)]) for i in range(300)]
    data += [(300 + i, data[i][1]) for i in range(20)] + [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, data[0][1]), (405, [0.1, 0.2])]
    v = topk.whole_vectors(spark.createDataFrame([(i, x, 1) for i, x in data], "vec_id long, embedding array<float>, rank int"), "vec_id", "embedding")
    rows = {tuple(r) for r in v.collect() and [(r.vec_id, tuple(r.v)) for r in v.collect()]}
    assert len(rows) == 321
    want = set()
    for q, x in rows:
        if q % 25 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(v, v.where("vec_id % 25 = 0")).collect()}
    assert got == want
    assert topk.exact_top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_holds_rows_of_the_own_id_apart(spark):
    data = [(0, [100, 100])] * 40 + [(i, [50 - i % 7, i % 5]) for i in range(1, 200)]
    v = spark.createDataFrame(data, "vec_id long, v array<long>")
    scored = sorted((-100 * (x + y), i) for i, (x, y) in data if i)
    got = topk.exact_top_k(v, v.where("vec_id = 0")).orderBy("rank").collect()
    assert [(-r.score, r.vec_id) for r in got] == scored[:5]


def test_a_chunk_answers_a_block_of_queries_at_once():
    rng = np.random.default_rng(8)
    for rows in (rng.integers(-150, 150, (900, 16)), rng.integers(-(1 << 28), 1 << 28, (300, 64)), np.zeros((50, 3), np.int64), rng.integers(-9, 9, (3, 4))):
        ids = rng.permutation(len(rows)) // 2
        chunk, pick = topk.Chunk(ids, rows), rng.integers(0, len(rows), 40)
        got = {place: (list(scores), list(near)) for place, scores, near in chunk.best(rows[pick], ids[pick], 5)}
        for place, p in enumerate(pick):
            scored = sorted((-int(s), int(i)) for s, i in zip(rows @ rows[p], ids, strict=True) if i != ids[p])[:5]
            assert got[place] == ([-s for s, _ in scored], [i for _, i in scored])
        assert len(got) == 40


def test_components_beyond_the_range_fail_loudly(spark):
    d = spark.createDataFrame([(1, [0.5, 1.0]), (2, [float(1 << 21), 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond 1048576 in the vector of id 2"):
        topk.whole_vectors(d, "vec_id", "embedding").collect()
    assert topk.whole_vectors(d.where("vec_id = 1"), "vec_id", "embedding").count() == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_is_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name.split("_")[0][2:].isdigit()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    random.seed(1)
    text = lambda: "\n".join(" ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(3))
    data = [(i, text(), "en", f"s{i % 3}", 0) for i in range(40)]
    data += [(40, data[0][1], "en", "s0", 0), (41, data[1][1].replace("a", "b", 1), "en", "s1", 0), (42, "", "en", "s1", 0), (43, None, "en", None, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "sentencepiece":
            assert now.columns == docs.columns
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) and set(range(40)) <= set(ids) and 40 not in ids
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(ids)


def test_pipeline_keeps_only_the_stage_that_is_read(spark, tmp_path):
    import os

    import corpus_pipeline

    data = [(i, f"some words of a text that has the number {i}", "en", "s", 0) for i in range(8)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(where))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    new = [f.split("-")[1] for f in set(os.listdir(where)) - before]
    assert "source_mixing" in new and not {"toxicity", "line_dedup", "minhash_near_dedup"} & set(new)


def _signed(spark, texts, shingle=2):
    """Classes and postings of texts with ids from 1, as near_duplicates makes them."""
    d = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    classes = minhash.signatures(d, "doc_id", "text", shingle, 64).withColumnRenamed("doc_id", "rep").localCheckpoint()
    return classes, minhash._postings(classes, 64, 34).localCheckpoint()


def test_pairs_that_cannot_be_links_do_not_leave_a_list(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(100), 6):
            words[k] = f"v{i}-{k}"
        texts.append(" ".join(words))
    texts += [texts[0] + " one", texts[1] + " two"]
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    links = {(i + 1, j + 1) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    classes, postings = _signed(spark, texts)
    found = minhash._all_agreeing(postings, classes, spark.createDataFrame([], "node long, component long"), 80, 34)
    got = {(r.a, r.b) for r in found.collect()}
    assert found.count() == len(got)
    assert links <= got and len(links) == 2 and len(got) < 300  # of 1,891 pairs, nearly all of which agree in 34 coordinates


def test_each_document_meets_one_head_a_round(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(w if rng.random() > 0.04 else f"v{rng.randrange(4)}" for w in base) for _ in range(200)]
    _, postings = _signed(spark, texts)
    none = spark.createDataFrame([], "node long, component long")
    for turn in (0, 1):
        assert 150 <= minhash._head_pairs(postings, none, 80, turn).count() <= 200


def test_near_duplicates_lose_no_sparse_link(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = {}
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(100), 5):
            words[k] = f"v{rng.randrange(3)}"
        texts[i + 1] = " ".join(words)
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, t in texts.items() for w in [t.split()]}
    root = {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in texts:
        for b in range(a + 1, len(texts) + 1):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=2, percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in texts}
    assert 1 < len({find(i) for i in texts}) < len(texts)
