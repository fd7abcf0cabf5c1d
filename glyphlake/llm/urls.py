"""URL filters: host and path rules first, then trust and distrust over the host link graph.

Pages that a rule allows make their hosts trusted seeds, pages that a rule blocks make theirs
distrusted ones, one UNIT a page. Trust follows links (personalised PageRank), distrust goes against
them, from a host to those that link to it. Both are whole numbers, so every run gives the same
masses whatever the order of the sums. A host is blocked where its distrust outweighs its trust;
that verdict holds for its pages that no rule fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import discard, written

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Mass of one seed page, share of it that follows links (percent). Whole numbers of 64 bits hold that of 10^12 pages.
UNIT, DAMPING = 1_000_000, 85
#: Rounds of propagation: less than a thousandth of the mass is on its way after them (0.85^43). Fewer, where nothing moves any more.
ROUNDS = 43
#: Host of an absolute link of an anchor.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    nothing = F.lit(None).cast("string")
    return (nothing if rule is None else rule), (nothing if verdict is None else verdict)


def _spread(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(host, mass) after the rounds: mass = seed share + damped mass along edges (src, dst, n)."""
    part = lambda share: f"((mass div 100) * {share} + (mass % 100) * {share} div 100)"  # noqa: E731  divided first: no overflow
    own = seeds.select("host", F.expr(part(100 - DAMPING)).alias("own")).where("own > 0")
    weights = edges.join(edges.groupBy("src").agg(F.sum("n").alias("out")), "src")
    weights = written(weights.select("src", "dst", "n", "out"), "links")
    first = mass = own.withColumnRenamed("own", "mass")
    for _ in range(rounds):
        moved = weights.join(mass, weights["src"] == mass["host"]).select(F.col("dst").alias("host"), F.expr(f"{part(DAMPING)} div out * n").alias("mass"))
        now = written(own.withColumnRenamed("own", "mass").unionByName(moved).groupBy("host").agg(F.sum("mass").alias("mass")), "mass")
        settled = not now.join(mass.withColumnRenamed("mass", "before"), "host", "left").where("not (mass <=> before)").limit(1).count()
        if mass is not first:
            discard(mass)
        mass = now
        if settled:  # whole numbers: what stays the same once stays so
            break
    return mass


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins and
    gives its verdict, else the host's masses do: block where distrust exceeds trust, else allow.
    Pages without a host (null url or no ``://``) are allowed unless a rule fits. Null html has no
    links, links to the page's own host are no edges, repeated links and pages weigh as often as they
    occur. Other columns are ignored; an empty table gives an empty result. Only host counts are
    shuffled, summed before the exchange, so a host with a third of all pages is no hot spot.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rule, said = _by_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = base.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    seeds = written(
        judged.where("said is not null and host <> ''").groupBy("host").agg(
            F.sum(F.when(F.col("said") == "allow", UNIT).otherwise(0)).alias("trust"), F.sum(F.when(F.col("said") == "block", UNIT).otherwise(0)).alias("distrust")
        ),
        "seeds",
    )
    links = base.where("host <> '' and html is not null").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    edges = links.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    edges = written(edges, "edges")
    turns = rounds if edges.limit(1).count() else 0
    trust = _spread(edges, seeds.select("host", F.col("trust").alias("mass")), turns)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = _spread(against, seeds.select("host", F.col("distrust").alias("mass")), turns)
    blocked = distrust.withColumnRenamed("mass", "bad").join(trust, "host", "left").where("bad > coalesce(mass, 0)").select("host", F.lit("block").alias("by_host"))
    out = judged.join(blocked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "by_host", F.lit("allow")).alias("verdict"))


def oracle_sql(rules: list[tuple[str, str, str]] | None = None, rounds: int = ROUNDS) -> str:
    """The same over the view ``pages``, its rounds unrolled."""
    listed = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", said, h + p) for said, h, p in listed]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, _, name in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{said}'" for f, said, _ in fits) + " END"
    link = LINK.replace("'", "''")
    ctes = [
        rf"""b AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages)""",
        f"j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS said FROM b)",
        f"""e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst
          FROM b WHERE host <> '') x WHERE src <> dst GROUP BY 1, 2)""",
    ]
    for kind, said, src, dst in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        ctes.append(f"{kind}s AS (SELECT host, {UNIT} * count(*) * {100 - DAMPING} // 100 AS mass FROM j WHERE said = '{said}' AND host <> '' GROUP BY 1)")
        ctes.append(f"{kind}w AS (SELECT {src} AS src, {dst} AS dst, n, sum(n) OVER (PARTITION BY {src}) AS o FROM e)")
        ctes.append(f"{kind}0 AS (SELECT * FROM {kind}s)")
        for i in range(rounds):
            ctes.append(
                f"""{kind}{i + 1} AS (SELECT host, sum(mass) AS mass FROM (SELECT * FROM {kind}s UNION ALL
              SELECT dst, (mass * {DAMPING} // 100) // o * n FROM {kind}w JOIN {kind}{i} ON src = host) x GROUP BY 1)"""
            )
    last = rounds
    return f"""WITH {", ".join(ctes)}
      SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.said, CASE WHEN d.mass > coalesce(t.mass, 0) THEN 'block' END, 'allow') AS verdict
      FROM j LEFT JOIN d{last} d ON j.host = d.host LEFT JOIN t{last} t ON j.host = t.host"""
