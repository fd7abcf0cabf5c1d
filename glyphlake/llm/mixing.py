"""Mixing sources to target weights by Pfair scheduling.

Target weights are whole numbers and their sum is the cycle, so that a source's share is its weight's
and nothing is rounded; a source of weight q has its block k
released at slot floor(k * cycle / q) and due before slot ceil((k + 1) * cycle / q). The earliest
deadline among the released blocks gets each slot, so at every slot every source is less than one
block away from its exact share. All windows repeat with the cycle, so the schedule of one cycle,
or of as much of it as there are blocks for, places every block of any corpus. Its length is bounded by
the precision of the weights and the number of sources, not by the corpus:
block k goes to slot (k div q) * cycle + (slot of block k mod q in the cycle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import written

#: Steps of the default weights, and of named ones; documents of a block, parts into which each source is dealt.
STEPS, UNIT, BLOCK, PARTS = 256, 1_000_000, 16, 1024
#: Slots in a run of the schedule: its list is copied at every slot.
RUN = 1024
ADDED = ("_source", "_block", "_release", "_deadline", "_slot", "_row")


def _parted(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Adds _source (null counts as empty) and _part, PARTS parts by a hash of the id, so that no source is one sort."""
    mixed = F.expr(f"(pmod(coalesce(`{id_col}`, 0L), 2147483647L) * 2654435761L % 4294967296L) div {(1 << 32) // PARTS}")
    return docs.withColumn("_source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("_part", mixed.cast("int"))


def _ticks(counts: DataFrame, weights: dict[str, float] | None, block: int) -> DataFrame:
    """(source, cycle, q, horizon): whole weights, their sum, and the slots until all blocks are placed.

    ``counts`` is one row per source. Without ``weights`` a source weighs the square root of its number
    of documents, in 256ths of the largest one. Named weights count in millionths of a share; sources that
    are not named divide what those leave of 1 equally. A source that gets nothing has no row.
    """
    one = W.partitionBy()  # A table of the sources, not of documents.
    if weights is None:
        root = F.floor(F.sqrt(F.col("n").cast("double"))).cast("long")
        weighed = counts.withColumn("root", root).withColumn("q", F.greatest(F.lit(1), F.expr("root * %d div max(root) over ()" % STEPS)).cast("long"))
    else:
        whole = {s: int(round(w * UNIT)) for s, w in sorted(weights.items())}
        if min(whole.values(), default=0) < 0:
            raise ValueError("weights must not be negative")
        rest = max(0, UNIT - sum(whole.values()))
        named = F.element_at(F.create_map(*(x for s, w in whole.items() for x in (F.lit(s), F.lit(w)))), F.col("source")).cast("long") if whole else F.lit(None).cast("long")
        weighed = counts.withColumn("named", named).withColumn("others", F.count_if(F.col("named").isNull()).over(one))
        weighed = weighed.withColumn("q", F.coalesce("named", F.expr(f"{rest}L div others"))).where("q > 0")
    summed = weighed.withColumn("cycle", F.sum("q").over(one))
    due = F.expr(f"((n + {block - 1}) div {block} * cycle + q - 1) div q")
    return summed.select("source", "cycle", "q", F.least("cycle", F.max(due).over(one)).alias("horizon"))


def cycle_schedule(ticks: DataFrame) -> DataFrame:
    """(source, cycle, q, k, slot) of one cycle, or its first ``horizon`` slots where that is a column: earliest deadline first, ties to the first source by name."""
    horizon = F.col("horizon") if "horizon" in ticks.columns else F.col("cycle")
    packed = ticks.select("source", "q", "cycle", horizon.alias("horizon")).groupBy("cycle", "horizon").agg(F.array_sort(F.collect_list(F.struct("source", "q"))).alias("s"))
    packed = packed.select("cycle", "horizon", F.col("s.source").alias("sources"), F.col("s.q").alias("qs"))
    due = "if(d < qs[j] and d * cycle div qs[j] <= t, named_struct('due', ((d + 1) * cycle + qs[j] - 1) div qs[j], 'j', j), null)"
    pick = f"coalesce(array_min(filter(transform(s.done, (d, j) -> {due}), x -> x is not null)).j, -1)"
    slot = f"(s, t) -> transform(array({pick}), p -> named_struct('done', transform(s.done, (d, i) -> if(i = p, d + 1, d)), 'picks', concat(s.picks, array(bigint(p)))))[0]"
    none = "cast(array() as array<bigint>)"
    some = f"aggregate(sequence(c * {RUN}, least(horizon, (c + 1) * {RUN}) - 1), named_struct('done', r.done, 'picks', {none}), {slot})"
    state = "struct<done: array<bigint>, runs: array<array<bigint>>>"
    runs = f"(r, c) -> transform(array({some}), x -> named_struct('done', x.done, 'runs', concat(r.runs, array(x.picks))))[0]"
    start = f"cast(named_struct('done', transform(qs, x -> 0L), 'runs', array()) as {state})"
    run = packed.select("cycle", "sources", "qs", F.expr(f"aggregate(sequence(0L, (horizon - 1) div {RUN}), {start}, {runs}).runs").alias("runs"))
    slots = run.select("cycle", "sources", "qs", F.posexplode("runs").alias("c", "picks")).select("cycle", "sources", "qs", "c", F.posexplode("picks").alias("i", "pick")).where("pick >= 0")
    named = slots.select(F.expr("sources[int(pick)]").alias("source"), "cycle", F.expr("qs[int(pick)]").alias("q"), (F.col("c").cast("long") * RUN + F.col("i")).alias("slot"))
    return named.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("slot")).cast("long") - 1)


def mixed_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` with _source, _block, _release, _deadline, _slot and _row.

    Order by (_slot, _row) is the mix; blocks hold ``block`` documents of a source, in an order of
    its own that a hash of the ids deals. No row is dropped or repeated: once a source runs out, its
    slots stay empty and the others keep their proportions. A source whose target weight is 0 has no
    slot; its rows have a null _slot, _release and _deadline and come after the mix. A null source counts as the empty one, a
    null id as 0; rows that repeat an id each have a place; an empty table gives an empty result.
    Columns of the input may have any names; those of an added column are replaced.
    """
    # The row travels whole beside the columns that are worked with, so its names are free.
    whole = docs.select(docs[id_col].cast("long").alias("_id"), docs[source_col].alias("_of"), F.struct(*(docs[c] for c in docs.columns)).alias("_whole"))
    parted = _parted(whole, "_id", "_of")
    sizes = written(parted.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # PARTS rows per source: the prefix sums run over a table of the sources.
    before = F.coalesce(F.sum("n").over(W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_source", "_part", before.alias("_before"))
    ticks = _ticks(sizes.groupBy("_source").agg(F.sum("n").alias("n")).withColumnRenamed("_source", "source"), weights, block)
    schedule = written(cycle_schedule(ticks), "schedule")
    rates = ticks.select(F.col("source").alias("_source"), F.col("cycle").alias("_cycle"), F.col("q").alias("_q"))
    offsets = offsets.join(rates, "_source", "left")
    place = F.row_number().over(W.partitionBy("_source", "_part").orderBy(F.asc_nulls_first("_id")))
    placed = parted.withColumn("_place", place.cast("long") - 1).join(offsets, ["_source", "_part"])
    placed = placed.withColumn("_place", F.col("_place") + F.col("_before")).withColumn("_block", F.expr(f"_place div {block}"))
    placed = placed.withColumn("_row", F.expr(f"_place % {block}")).withColumn("_k", F.expr("_block % _q"))
    # A row a slot of the cycle, which the precision of the weights bounds.
    slots = schedule.select(F.col("source").alias("_source"), F.col("k").alias("_k"), F.col("slot").alias("_at"))
    out = placed.join(slots, ["_source", "_k"], "left")
    out = out.withColumn("_slot", F.expr("_block div _q * _cycle + _at")).withColumn("_release", F.expr("_block * _cycle div _q")).withColumn("_deadline", F.expr("((_block + 1) * _cycle + _q - 1) div _q"))
    return out.select(*(F.col("_whole")[c].alias(c) for c in docs.columns if c not in ADDED), "_source", "_block", "_release", "_deadline", "_slot", "_row")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with _slot and _row, dealt into ordered partitions by them; see ``mixed_order``."""
    order = mixed_order(docs, id_col, source_col, weights)
    kept = [c for c in order.columns if c not in ("_source", "_block", "_release", "_deadline")]
    last = (F.asc_nulls_last("_slot"), F.col("_source"), F.col("_block"), F.col("_row"))
    return order.repartitionByRange(*last).sortWithinPartitions(*last).select(*kept)


def oracle_sql(block: int = BLOCK) -> str:
    """The places of all rows of the view ``documents``, with the default weights."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, (((coalesce(doc_id, 0) % 2147483647) + 2147483647) % 2147483647) * 2654435761 % 4294967296 // {(1 << 32) // PARTS} AS part FROM documents),
      c AS (SELECT source, count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM d GROUP BY 1),
      f AS (SELECT source, n, CAST(greatest(1, root * {STEPS} // (SELECT max(root) FROM c)) AS BIGINT) AS q FROM c),
      q AS (SELECT source, n, q, CAST((SELECT sum(q) FROM f) AS BIGINT) AS cycle FROM f),
      h AS (SELECT least(max(cycle), max(((n + {block - 1}) // {block} * cycle + q - 1) // q)) AS horizon FROM q),
      l AS (SELECT list(source ORDER BY source) AS ss, list(q ORDER BY source) AS qs, max(cycle) AS cycle FROM q),
      r AS (SELECT CAST(-1 AS BIGINT) AS t, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM l
        UNION ALL
        SELECT t + 1, list_transform(range(1, len(qs) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
          SELECT r.t, r.done, l.qs, list_min(list_filter(list_transform(range(1, len(l.qs) + 1), lambda j: CASE WHEN r.done[j] < l.qs[j] AND r.done[j] * l.cycle // l.qs[j] <= r.t + 1
            THEN {{'due': ((r.done[j] + 1) * l.cycle + l.qs[j] - 1) // l.qs[j], 'j': j}} END), lambda x: x IS NOT NULL)).j AS p FROM r, l WHERE r.t + 1 < (SELECT horizon FROM h)) y),
      s AS (SELECT l.ss[r.pick] AS source, r.t AS pos, row_number() OVER (PARTITION BY r.pick ORDER BY r.t) - 1 AS k FROM r, l WHERE r.t >= 0),
      p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY part, doc_id NULLS FIRST) - 1 AS place FROM d)
      SELECT p.doc_id, p.source, place // {block} AS block, (place // {block}) * cycle // q AS release, ((place // {block} + 1) * cycle + q - 1) // q AS deadline,
        place // {block} // q * cycle + pos AS slot, place % {block} AS row_in_block
      FROM p JOIN q ON p.source = q.source JOIN s ON s.source = p.source AND s.k = place // {block} % q"""
