"""The repair loop: audit the boxes, grow those that clip their own ink, and keep the best round of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.ownership import audit, proposals
from glyphlake.sources.durable import discard, kept, shuffled

#: A box that misses more than this share of its own ink is clipped; while a run has one, its repair goes on.
CLIPPED, MOST_ROUNDS = 0.02, 8
SIDES = ("x0", "y0", "x1", "y1")


def refined(labelled: DataFrame, boxes: DataFrame, tile: int, pinned: DataFrame | None = None, runs: DataFrame | None = None, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(page_id, box_id, x0, y0, x1, y1, round, missing): the boxes of each run's best round, and what that round misses on all pages of the run.

    ``labelled`` is ink (page_id, y, x, root), ``pinned`` (page_id, box_id) names boxes set by hand,
    which never move, ``runs`` (page_id, run_id) the pages that are repaired together; without it a page
    is a run of its own, and so is one that it does not name. In a round the boxes grow as proposed by
    the round before. A run is settled once none of its boxes is clipped or nothing is proposed for it,
    and its pages then leave the loop, which ends with the last run or after ``rounds``. The best round
    misses least, the first of equal ones. Pages without boxes give nothing.
    """
    of_run = boxes.select("page_id").distinct()
    own = F.to_json(F.struct(F.lit("page").alias("of"), F.col("page_id").alias("id")))
    if runs is None:
        of_run = of_run.withColumn("run_id", own)
    else:
        given = runs.select("page_id", F.to_json(F.struct(F.lit("run").alias("of"), F.col("run_id").alias("id"))).alias("run_id"))
        of_run = of_run.join(given, "page_id", "left").withColumn("run_id", F.coalesce("run_id", own))
    of_run = kept(of_run, "runs")
    now = kept(boxes.select("page_id", "box_id", *SIDES).join(of_run, "page_id"), "boxes")
    ink = kept(labelled.join(of_run.select("page_id"), "page_id", "left_semi"), "labelled")
    tried, scores = [], []
    for n in range(rounds):
        judged = kept(audit(ink, now.drop("run_id"), tile).select("page_id", "box_id", "missing", "clipped").join(of_run, "page_id"), "judged")
        score = kept(judged.groupBy("run_id").agg(F.sum("missing").alias("missing"), F.max("clipped").alias("clipped")).withColumn("round", F.lit(n)), "score")
        discard(judged)
        tried.append(now.withColumn("round", F.lit(n)))
        scores.append(score)
        if n == rounds - 1:
            break
        grown = proposals(ink, now.drop("run_id"), tile).join(of_run, "page_id").join(score.where(F.col("clipped") > CLIPPED).select("run_id"), "run_id", "left_semi")
        if pinned is not None:
            grown = grown.join(pinned, ["page_id", "box_id"], "left_anti")
        grown = kept(grown.select("run_id", "page_id", "box_id", *(F.col(c).alias(f"g{c}") for c in SIDES)), "grown")
        open_ = grown.select("run_id").distinct()
        if not grown.limit(1).count():
            discard(grown)
            break
        sides = (F.coalesce(f"g{c}", c).alias(c) for c in SIDES)
        then = now.join(open_, "run_id", "left_semi").join(grown.drop("run_id"), ["page_id", "box_id"], "left")
        now = kept(then.select("page_id", "box_id", *sides, "run_id"), "boxes")
        left = kept(ink.join(now.select("page_id").distinct(), "page_id", "left_semi"), "labelled")
        discard(ink, grown)
        ink = left
    every, all_scores = tried[0], scores[0]
    for t, s in zip(tried[1:], scores[1:], strict=True):
        every, all_scores = every.unionByName(t), all_scores.unionByName(s)
    best = all_scores.groupBy("run_id").agg(F.min(F.struct("missing", "round")).alias("best")).select("run_id", "best.*")
    result = kept(every.join(shuffled(best), ["run_id", "round"]).select("page_id", "box_id", *SIDES, "round", "missing"), "refined")
    discard(of_run, ink, *{id(t): t for t in (*tried, *scores)}.values())
    return result
