"""URL filters by rules, and by the link graph of hosts where no rule fits.

Hosts are nodes; a page's links to other hosts are edges, weighted by the pages that have them. Allowing and blocking
rules make seeds: the share of a host's pages that they allow or block. Personalised PageRank carries trust from the
allowed along links, and distrust from the blocked against them (who links to blocked hosts is distrusted). Both run
in one loop of joins and aggregations until nothing moves by more than TOLERANCE.

What flows is split among a host's links, so scores shrink with their number; they are therefore taken relative to what
the same links carry if every host is a whole seed. A host's level of distrust is its own share, and for the rest the
mean of the relative distrust of the hosts that it links to; of trust, that of the hosts that link to it. A host of
which the distrust exceeds the trust by more than MARGIN is blocked, and so are its pages that no rule fits.

Urls that are null or have no `://` have an empty host and path, fit no rule, are in no graph and are allowed. Null
html has no links. Repeated rows each get a row, and count as pages of their host. Other columns don't matter. Very long
urls and pages are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import common

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
DAMPING, MARGIN, TOLERANCE = 0.85, 0.5, 1e-6
ROUNDS = 4  # steps between checks of what has moved
BROADCAST_HOSTS = 200_000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_fit(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; else null. A rule is a host and the start of a path. rules: a list that a person keeps."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: pages of src with a link to the other host dst."""
    src, _ = host_path(F.col(url))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1)), lambda x: common.ascii_lower(F.regexp_replace(x, r"^.*@|:\d*$", ""))))
    links = pages.select(src.alias("src"), F.explode(targets).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust, and most_trust and most_distrust: the same if every host is a whole seed.

    seeds: host, allowed, blocked (shares from 0 to 1) of all hosts that count; edges: src, dst, n. Steps go on until none
    of the numbers moves by more than TOLERANCE in ROUNDS of them, which DAMPING makes sure of: what a step changes is at
    most DAMPING times what the one before did. All four are then within 3 * TOLERANCE of their limits.
    """
    out_of, into = edges.groupBy("src").agg(F.sum("n").alias("all")), edges.groupBy("dst").agg(F.sum("n").alias("all"))
    ahead = edges.join(out_of, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all")).alias("w"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("all")).alias("w"))
    flow = common.cut(ahead.unionByName(back))
    ends = flow.select("kind", "a").unionByName(flow.select("kind", F.col("b").alias("a"))).distinct()
    own = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("allowed"), F.lit("distrust"), F.col("blocked")))).select(F.col("key").alias("kind"), F.col("host").alias("a"), F.col("value").cast("double").alias("value"))
    # Every host, with its share of the seeds, and with a whole one.
    given = common.cut(own.join(ends, ["kind", "a"], "full").select("kind", "a", ((1 - DAMPING) * F.coalesce("value", F.lit(0.0))).alias("seed")))
    score = given.select("kind", "a", F.col("seed").alias("s"), F.lit(1 - DAMPING).alias("m"))
    before = None
    while True:
        new = score
        for _ in range(ROUNDS):
            got = flow.join(new, ["kind", "a"]).groupBy("kind", F.col("b").alias("a")).agg(F.sum(F.col("w") * F.col("s")).alias("got_s"), F.sum(F.col("w") * F.col("m")).alias("got_m"))
            grown = lambda own, c: (own + DAMPING * F.coalesce(c, F.lit(0.0))).alias(c[-1])
            new = given.join(got, ["kind", "a"], "left").select("kind", "a", grown(F.col("seed"), "got_s"), grown(F.lit(1 - DAMPING), "got_m"))
        both = common.cut(new.join(score.select("kind", "a", F.col("s").alias("old_s"), F.col("m").alias("old_m")), ["kind", "a"]))
        moved = both.agg(F.max(F.greatest(F.abs(F.col("s") - F.col("old_s")), F.abs(F.col("m") - F.col("old_m"))))).first()[0]
        score, last = both.select("kind", "a", "s", "m"), before
        before = both
        if last is not None:
            common.discard(last)
        if not moved or moved <= TOLERANCE:
            break
    of = lambda c, kind, base: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(base))
    return score.groupBy(F.col("a").alias("host")).agg(of("s", "trust", 0.0).alias("trust"), of("s", "distrust", 0.0).alias("distrust"), of("m", "trust", 1 - DAMPING).alias("most_trust"), of("m", "distrust", 1 - DAMPING).alias("most_distrust"))


def levels(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust, from 0 to 1, of every host. seeds and edges as for propagate()."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).select("host", F.lit(0.0).alias("allowed"), F.lit(0.0).alias("blocked"))
    every = common.cut(seeds.select("host", "allowed", "blocked").unionByName(ends).groupBy("host").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")))
    score = propagate(every, edges).select("host", F.col("trust").alias("s_allowed"), F.col("distrust").alias("s_blocked"), F.col("most_trust").alias("m_allowed"), F.col("most_distrust").alias("m_blocked"))

    def relative(own: str) -> Column:
        got, could = F.col(f"s_{own}") - (1 - DAMPING) * F.col(own), F.col(f"m_{own}") - (1 - DAMPING)
        share = F.when(could > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), got / could))).otherwise(0.0)
        return F.col(own) + (1 - F.col(own)) * share

    known = common.cut(every.join(score, "host").select("host", "allowed", "blocked", relative("allowed").alias("r_allowed"), relative("blocked").alias("r_blocked")))
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    ahead = edges.join(known.withColumnRenamed("host", "dst"), "dst").groupBy(F.col("src").alias("host")).agg(mean("r_blocked").alias("l_blocked"))
    back = edges.join(known.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(mean("r_allowed").alias("l_allowed"))
    level = lambda own: F.col(own) + (1 - F.col(own)) * F.coalesce(f"l_{own}", F.lit(0.0))
    return known.join(ahead, "host", "left").join(back, "host", "left").select("host", level("allowed").alias("trust"), level("blocked").alias("distrust"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row for each of pages: page_id, host, path, rule, verdict (allow or block)."""
    host, path = host_path(F.col(url))
    rule, verdict = first_fit(F.col("host"), F.col("path"), rules)
    ruled = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("ruled"))
    share = lambda action: F.avg((F.coalesce("ruled", F.lit("")) == action).cast("double"))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    bad = common.cut(levels(common.cut(seeds), common.cut(host_edges(pages, url, html))).where(F.col("distrust") - F.col("trust") > MARGIN).select("host", F.lit(True).alias("bad")))
    # Beyond the bound both sides are shuffled, and a host with very many pages is split.
    side = F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad
    return ruled.join(side, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
