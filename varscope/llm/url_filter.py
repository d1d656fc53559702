"""URL filters: rules by host and path, and trust and distrust that spread over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from varscope.llm.common import checkpointed, written

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a score that follows links, the rest returns to the seeds.
DAMPING = 0.85
#: What the rounds still to come may change any one score by at most when they end.
CLOSE = 1e-6
#: A host is blocked where distrust exceeds trust by this share of what a seed keeps for itself.
THRESHOLD = 0.5


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows (host, fits): for each host the rules of the host and of the domains above it, longest first."""
    table = hosts.sparkSession.createDataFrame(
        [(h, p, v, h + p, len(h + p), len(h)) for v, h, p in rules],
        "above string, rule_path string, rule_verdict string, rule string, size int, host_size int")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    joined = hosts.select("host", F.explode(above).alias("above")).join(table, "above")
    best_first = F.sort_array(F.collect_list(F.struct("size", "host_size", "rule_path", "rule_verdict", "rule")), asc=False)
    return joined.groupBy("host").agg(best_first.alias("fits"))


def host_links(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """Rows (src, dst, weight): links between different hosts, the weights of a source adding up to one."""
    href = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'<>]+)"
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(href), F.lit(1))
    target = F.regexp_replace("link", r"^(?i)([a-z][a-z0-9+.-]*:)?//", "x://")
    pairs = (pages.select(F.col(host_col).alias("src"), F.explode(links).alias("link"))
             .select("src", host_and_path(target)[0].alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
             .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    total = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    return pairs.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def spread_trust(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: rows (host, trust, distrust) from seeds (host, trusted, blocked), each between 0 and 1.

    Trust follows links from trusted seeds. Distrust follows them backwards from blocked seeds: a host takes on the
    distrust of the hosts it links to by the share of its links, so that many links to a blocked host do not thin it.
    Both run in the same jobs, told apart by ``side``. One row per host and side moves in a round.

    Rounds go on until no score can change by ``CLOSE`` any more, or for ``rounds`` where given. A round passes on at
    most ``damping`` of the sum of all changes in trust, and of the largest change in distrust (the weights of a host's
    links add up to one), so both bound what follows, whatever the number of seeds that never move.
    """
    ends = [F.struct(F.lit(side).alias("side"), F.col(a).alias("from"), F.col(b).alias("to"))
            for side, a, b in (("t", "src", "dst"), ("d", "dst", "src"))]
    steps = checkpointed(links.select(F.inline(F.array(*ends)), "weight"))
    start = seeds.select("host", F.explode(F.create_map(F.lit("t"), "trusted", F.lit("d"), "blocked")).alias("side", "seed")).where(
        "seed > 0")
    start = checkpointed(start.select("side", "host", (F.col("seed") * (1 - damping)).alias("score")))
    now, moves = start, not steps.isEmpty()
    done = 0
    while moves and (rounds is None or done < rounds):
        sent = now.join(steps.withColumnRenamed("from", "host"), ["side", "host"]).select(
            "side", F.col("to").alias("host"), (F.col("score") * F.col("weight") * damping).alias("score"))
        new = checkpointed(sent.unionByName(start).groupBy("side", "host").agg(F.sum("score").alias("score")))
        moved = new.unionByName(now.withColumn("score", -F.col("score"))).groupBy("side", "host").agg(
            F.abs(F.sum("score")).alias("by"))
        change = moved.agg(F.greatest(F.sum(F.when(F.col("side") == "t", F.col("by"))), F.max(F.when(F.col("side") == "d", F.col("by"))))).first()[0]
        now, done = new, done + 1
        if (change or 0.0) * damping < CLOSE * (1 - damping):
            break
    score = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("score"))), F.lit(0.0))
    return now.groupBy("host").agg(score("t").alias("trust"), score("d").alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    ``rules`` are (verdict, host, path); one fits its host and all subdomains where the path begins with the rule's;
    the longest wins, then the one with the longer host. Where none fits, the host decides. Hosts most of whose pages
    a rule allows are trusted seeds and hosts most of whose pages a rule blocks are blocked seeds, by their share;
    scores spread over links between hosts (``spread_trust``) and a host is blocked where distrust minus trust reaches
    ``threshold`` times ``1 - damping``. Links within a host and relative links move nothing. A null url, one without
    ``://`` or with an empty host has an empty host, no rule, no scores and is allowed. Null or empty html has no
    links; repeated pages count as often as they occur; no rows give no rows; other columns are not read.
    """
    host, path = host_and_path(url_col)
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    links = written(host_links(split, "host", "html"), "host-links")
    fits = host_rules(split.select("host").distinct(), rules)
    # One row per host on the right; a host with a third of the pages is split by adaptive skew handling.
    fit = F.filter("fits", lambda r: F.col("path").startswith(r["rule_path"]))
    ruled = split.drop("html").join(fits, "host", "left").withColumn("best", F.try_element_at(fit, F.lit(1))).drop("fits")
    ruled = written(ruled.select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("said")),
                    "url-rules")
    share = lambda verdict: F.avg((F.coalesce("said", F.lit("")) == verdict).cast("double"))
    shares = ruled.where("host <> ''").groupBy("host").agg(share(ALLOW).alias("trusted"), share(BLOCK).alias("blocked"))
    most = lambda name: F.when(F.col(name) > 0.5, F.col(name)).otherwise(0.0).alias(name)
    scores = spread_trust(shares.select("host", most("trusted"), most("blocked")), links, damping)
    out = ruled.join(scores, "host", "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ("trust", "distrust")})
    bad = F.col("distrust") - F.col("trust") >= threshold * (1 - damping)
    verdict = F.coalesce("said", F.when(bad, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
