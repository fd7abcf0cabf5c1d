"""Near-duplicate documents by a signature-coordinate inverted join.

Every document gets one MinHash value for each of ``coordinates`` hash functions and is posted under
its (coordinate, value) pairs. Two documents of Jaccard similarity s agree in about s of their
coordinates, so only pairs that agree in at least ``matches`` of them are retained, and those are
confirmed on their full shingle sets.

* Prefix: pairs that agree in ``matches`` of K coordinates share one of the first K - matches + 1
  under any common order of the pairs. The order puts frequent pairs last, so common phrases are
  hardly ever posted and posting lists stay short unless the documents really are near copies.
* One head a document: of the heads of its posting lists, the documents there whose signatures agree most
  with what the others have in each coordinate, every document is first held against one, and the
  components of these links are worked out. Rounds of this go on while one adds many links; they only
  spare work, and what they do not link is compared in full.
* In full: lists whose documents then hang together are skipped. In the others the signatures of all
  pairs of different components are compared, a list at a time as arrays and long lists as pairs of
  blocks. Only pairs leave it that agree in enough coordinates and whose sets, counted by BUCKETS of
  their shingles' hashes, do not differ by more than the similarity allows: sets differ in as many
  shingles at least as their counts do, so no link is lost by that. Those likely to be links are confirmed
  first, the rest where their documents still lie apart. Nothing ends before all lists are done.
* Texts of one shingle set are one class from the start and travel once.

Missed links: a pair at similarity 0.8 agrees in fewer than 34 of 64 coordinates with a probability
of about 3e-7; more similar pairs less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import connected_components, discard, setting, short_batches, written

#: Documents of a block of a long posting list; pairs whose signatures are compared at once; lists that go to Python in a batch.
BLOCK, PAIRS, LISTS = 4096, 1 << 18, 100
#: Buckets of a set's counts, two of four bits in a byte; pairs whose counts are compared at once.
BUCKETS, COUNTED = 256, 1 << 14
#: Rounds of heads go on while one adds at least this share of the links so far.
WORTH = 0.1
#: Up to so many document ids (8 bytes each) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1 << 21
#: Words are hashed in runs of about this many, to bound memory on very long texts.
RUN = 1 << 18


def _words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes.lower and bytes.split do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_sets(texts: list, shingle: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its shingles."""

    def some(lists: list[list[bytes]]) -> Iterator[np.ndarray]:
        flat = np.array([w for ws in lists for w in ws], dtype=object)
        hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
        start = 0
        for ws in lists:
            own = hashed[start : start + len(ws)]
            start += len(ws)
            if not len(own):
                yield own
                continue
            size = min(shingle, len(own))
            mixed = np.full(len(own) - size + 1, np.uint64(size))
            for k in range(size):
                mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - size + 1 + k])
            yield np.unique(mixed)

    lists, n = [], 0
    for text in texts:
        lists.append(ws := _words(text))
        n += len(ws)
        if n >= RUN:
            yield from some(lists)
            lists, n = [], 0
    yield from some(lists)


def _multipliers(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(1, coordinates + 1, dtype=np.uint64)
    return _mixed(steps) | np.uint64(1), _mixed(steps + np.uint64(1 << 32))


def _signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.uint64(2**64 - 1))
    width = max(1, (1 << 18) // len(a))
    for i in range(0, len(hashes), width):
        least = np.minimum(least, (hashes[None, i : i + width] * a[:, None] + b[:, None]).min(1))
    return (least >> np.uint64(33)).astype(np.int32)


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall in each bucket, 15 at most, two buckets in a byte."""
    n = np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 15).astype(np.uint8)
    return (n[::2] | n[1::2] << 4).view(np.int8)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much the counts of rows differ in all: the sets differ in as many shingles at least."""
    far = [np.abs((x >> bits & 15).astype(np.int8) - (y >> bits & 15).astype(np.int8)).sum(1, dtype=np.int64) for bits in (0, 4)]
    return far[0] + far[1]


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, class_key, signature, counts); without words the key is null, the signature and the counts are empty."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _multipliers(coordinates)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                n, keys, sigs, counts = [], [], [], []
                for hashes in _hashed_sets(list(part["text"]), shingle):
                    n.append(len(hashes))
                    if len(hashes):
                        one, two = int(hashes.sum(dtype=np.uint64)), int(_mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                        keys.append(f"{len(hashes):x}-{one:x}-{two:x}")
                        sigs.append(_signature(hashes, a, b))
                        counts.append(_counts(hashes))
                    else:
                        keys.append(None)
                        sigs.append(np.zeros(0, np.int32))
                        counts.append(np.zeros(0, np.int8))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").values, "n_shingles": n, "class_key": keys, "signature": sigs, "counts": counts})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(kernel, "doc_id long, n_shingles long, class_key string, signature array<int>, counts array<byte>")


def _postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, rep, n, weight): each class under the K - matches + 1 rarest pairs of its signature, unless it has them alone.

    Pairs that only one class has come first in the order and are not posted; what is left of the
    prefix is taken from the others, rarest first. A pair's number of classes is exact. The weight of
    a class is the sum of these numbers: how far its signature is that of most.
    """
    token = F.shiftleft(F.col("i").cast("long"), 32) + F.col("v")
    every = classes.select("rep", "n_shingles", F.posexplode("signature").alias("i", "v")).select(token.alias("token"), "rep", "n_shingles")
    shared = every.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # A class has at most K pairs, so its list is bounded.
    own = every.join(shared, "token").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("often", F.xxhash64("token").alias("h"), "token"))).alias("tokens"), F.sum("often").alias("weight"))
    posted = F.slice("tokens", 1, F.greatest(F.size("tokens") - (matches - 1), F.lit(0)))
    return own.select("rep", "weight", F.col("n_shingles").alias("n"), F.explode(posted).alias("t")).select(F.col("t.token").alias("token"), "rep", "n", "weight")


def _wanted(texts: DataFrame, near: DataFrame) -> DataFrame:
    """The texts of the pairs' documents, picked without moving the others if their ids are few enough to broadcast."""
    ids = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rep", "left_semi")


def _short(classes: DataFrame) -> DataFrame:
    """(rep, signature) by the low bits of the values, which are enough here: they agree wherever the values do."""
    return classes.select("rep", F.transform("signature", lambda v: v.bitwiseAND(F.lit(127)).cast("byte")).alias("signature"))


def _agreeing(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Of pairs (a, b) those that agree in enough coordinates."""
    own = _short(classes)
    sized = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return sized.where(agree >= matches).select("a", "b")


def _head_pairs(postings: DataFrame, labels: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each class with the head of one of the posting lists in which it lies apart from the head, so at most as many as there are classes.

    In the first round the heads are the classes of the most weight, later those that come first in the
    round's order of all classes. A class takes the head that it meets in most of its lists.
    """
    now = postings.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    order = F.xxhash64("rep", F.lit(turn)) if turn else -F.col("weight")
    head = F.min(F.struct(order.alias("order"), F.xxhash64("rep"), "component", "rep", "n")).alias("head")
    mixed = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), head).where("lo < hi").select("token", "head")
    met = now.join(mixed, "token").where(f"component <> head.component and 100 * least(head.n, n) >= {percent} * greatest(head.n, n)")
    often = met.groupBy("rep", "head").agg(F.count(F.lit(1)).alias("lists"))
    one = often.groupBy("rep").agg(F.min(F.struct(-F.col("lists"), "head.order", F.xxhash64("head.rep"), "head.rep")).alias("head"))
    return one.select(F.least("head.rep", "rep").alias("a"), F.greatest("head.rep", "rep").alias("b")).distinct()


def _all_agreeing(postings: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b, agree) of all pairs of different components that share a posting list, agree in enough coordinates and can be similar by their counts.

    A pair leaves only the first list that both are posted in, so it comes once however many they share.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy()
            rep, n, component, side, values, counts = lists.flatten().flatten()
            rep, n, component, side = (c.to_numpy() for c in (rep, n, component, side))
            values, counts = (c.flatten().to_numpy().reshape(len(rep), -1) for c in (values, counts))
            counts = counts.view(np.uint8)
            signature = ((values ^ values >> 31) & 127).astype(np.int8)  # low bits are enough here: they agree wherever the values do
            coordinate = np.repeat(batch.column(1).to_numpy(), size)
            cross = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
            after = np.repeat(np.cumsum(size), size) - np.arange(len(rep)) - 1  # rows that follow in the list
            upto = np.cumsum(after)
            lo = 0
            while lo < len(rep):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
                own = after[lo:hi]
                x = np.repeat(np.arange(lo, hi), own)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
                ok = (component[x] != component[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (~cross[x] | (side[x] != side[y]))
                x, y, lo = x[ok], y[ok], hi
                agree = (signature[x] == signature[y]).sum(1, dtype=np.int32)
                ok = agree >= matches
                x, y, agree = x[ok], y[ok], agree[ok]
                far = [_apart(counts[x[i : i + COUNTED]], counts[y[i : i + COUNTED]]) for i in range(0, len(x), COUNTED)]
                if len(x):
                    ok = np.concatenate(far) * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
                    x, y, agree = x[ok], y[ok], agree[ok]
                if len(x):
                    ok = ((values[x] == values[y]) & (values[x] < 0)).argmax(1) == coordinate[x]
                    x, y, agree = x[ok], y[ok], agree[ok]
                if len(x):
                    yield pa.record_batch([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y])), pa.array(agree)], names=["a", "b", "agree"])

    # Values that a class is posted under stand as their complements, which are negative.
    posted = postings.groupBy("rep").agg(F.collect_set("token").alias("posted"))  # bounded by the coordinates
    token = lambda v, i: F.shiftleft(i.cast("long"), 32) + v
    values = F.transform("signature", lambda v, i: F.when(F.array_contains("posted", token(v, i)), F.bitwise_not(v)).otherwise(v))
    signed = classes.join(posted, "rep").select("rep", values.alias("values"), "counts")
    known = signed.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = postings.join(known.select("rep", "component"), "rep").groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("long")).where("lo < hi")
    blocks = mixed.select("token", F.ceil(F.col("long") / BLOCK).cast("int").alias("blocks"))
    dealt = postings.join(blocks, "token").join(known, "rep").withColumn("side", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = F.struct("rep", "n", "component", "side", "values", "counts")
    keyed = dealt.groupBy("token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).agg(F.collect_list(row).alias("rows"))  # bounded by two blocks
    return keyed.select(F.expr("i <> j").alias("across"), F.expr("cast(shiftright(token, 32) as int)").alias("coordinate"), "rows").mapInArrow(kernel, "a long, b long, agree int").distinct()


def _confirmed(near: DataFrame, texts: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """Of pairs (a, b) those that agree on full sets in percent."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}

        def sets(ids, texts):
            missing = {i: t for i, t in zip(ids, texts, strict=True) if (i, len(t or "")) not in kept}
            kept.update(zip(((i, len(t or "")) for i, t in missing.items()), _hashed_sets(list(missing.values()), shingle), strict=True))
            return [kept[i, len(t or "")] for i, t in zip(ids, texts, strict=True)]

        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i : i + 200]
                kept.clear()
                left, right = sets(part["a"], part["ta"]), sets(part["b"], part["tb"])
                ok = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.loc[ok, ["a", "b"]]

    some = written(_wanted(texts, near), "texts")
    held = near.join(some.toDF("b", "tb"), "b").join(some.toDF("a", "ta"), "a")
    with short_batches(near.sparkSession):
        links = written(held.select("a", "b", "ta", "tb").mapInPandas(kernel, "a long, b long").distinct(), name)
    discard(some)
    return links


def _versions(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one doc_id, where rows of different texts repeat it."""
    rows = sigs.where("class_key is not null and doc_id is not null").select("doc_id", "class_key")
    several = rows.groupBy("doc_id").agg(F.min("class_key").alias("lo"), F.max("class_key").alias("hi")).where("lo < hi").select("doc_id", "lo")
    reps = classes.select("class_key", "rep")
    return rows.join(several, "doc_id").join(reps.toDF("class_key", "a"), "class_key").join(reps.toDF("lo", "b"), "lo").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, coordinates: int = 64, matches: int = 34) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept.

    A document's set is its distinct shingles of ``shingle`` words (white space between words, A-Z
    lower-cased), or its whole word sequence if it has fewer. Documents are linked if 100 * |A and B|
    >= percent * |A or B|; component_id is the smallest doc_id reachable and kept tells whether that
    is the document itself.

    Null, empty or blank texts have an empty set, are linked with nothing and kept. Rows that repeat
    a doc_id are texts of one document, linked with whatever any of them is linked with; a row with a null doc_id belongs to its text's
    component, with a null component_id and kept if no row with an id does. Columns beside the two
    that are named are ignored, whatever they are called. An empty table gives an empty result.
    """
    with short_batches(docs.sparkSession):
        sigs = written(signatures(docs, id_col, text_col, shingle, coordinates), "signatures")
    # One row per distinct set that has an id; rep is its smallest doc_id.
    classes = written(
        sigs.where("class_key is not null and doc_id is not null").groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.min("counts").alias("counts")),
        "classes",
    )
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    postings = _postings(classes.where("n_shingles > 0"), coordinates, matches)
    postings = written(postings, "postings")

    labels = written(connected_components(written(_versions(sigs, classes), "versions"), "components"), "components")

    def joined(labels: DataFrame, near: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The components once those of the pairs that are links have come to them, and how many are; what hung together before goes in as one link a document."""
        links = _confirmed(near, texts, shingle, percent, name)
        new = links.count()
        if not new:
            discard(links)
            return labels, 0
        after = written(connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "components"), "components")
        discard(labels, links)
        return after, new

    turn, every, new = 0, 0, 1
    while new and new >= WORTH * every:
        near = written(_agreeing(_head_pairs(postings, labels, percent, turn), classes, matches), "near")
        labels, new = joined(labels, near, f"links-{turn}")
        discard(near)
        turn, every = turn + 1, every + new

    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(LISTS)):
        near = written(_all_agreeing(postings.select("token", "rep", "n"), classes, labels, percent, matches), "near")
    discard(postings)
    likely = F.col("agree") * 100 >= percent * coordinates
    labels, _ = joined(labels, near.where(likely).select("a", "b"), "links-likely")
    ends = [labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    apart = near.where(~likely).select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    rest = written(apart, "near")
    discard(near)
    labels, _ = joined(labels, rest, "links-rest")
    discard(rest)
    labels = labels.withColumnRenamed("node", "rep")

    named = classes.select("class_key", "rep").join(labels, "rep", "left").select("class_key", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "class_key").join(named, "class_key", "left")
    component = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
