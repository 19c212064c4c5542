"""URL filtering by rules, and by trust and distrust that spread over host links.

Rules name a host and a path prefix and hold for the host and its subdomains;
the longest rule that fits decides. For urls without a rule the host decides:
personalised PageRank carries trust from trusted hosts along links (who is
linked from trusted hosts is trusted) and distrust from blocked hosts against
them (who links to blocked hosts is distrusted). Every seed starts with its
share of one; ``score = (1 - DAMPING) * seed + DAMPING * (sum over neighbours,
by link share)``, walks end at hosts without further links. Beside either walk
goes plain PageRank, the same sums with every host as a seed. What a host gets
of trust or distrust through links, divided by what it gets of plain PageRank
through links, is its relative mass: the part of the walks reaching it that
began at such seeds. It lies between 0 and 1, whatever the graph's size and
however many others link to the same host. A host's blame is the larger of its
relative mass of distrust and its own share of blocked urls, its faith likewise
of trust; it is blocked if its blame exceeds its faith by ``THRESHOLD`` or more.

Seeds are the hosts that have urls which a rule allows (trusted) or blocks
(blocked), each by the share of its urls, or tables given by the caller (without
a ``share``, each counts whole). Host edges are the absolute and
protocol-relative links in the pages' html to another host, counted per pair
of hosts, so a host that holds a third of all pages is one node with few
edges. Every other iteration the scores are written under the shared checkpoint
folder, which cuts the lineage.

Inputs and their results: a null url, or one without ``://``, has an empty host
and path, no rule, and is allowed; null html has no links; the host is
everything between ``://`` and the first of ``/ ? #``, with A-Z lower-cased;
repeated rows are judged alike and count as often; a null page_id is kept;
columns other than page_id, url and html are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.common import join_on_hot_key, read, stored

#: (verdict, rule)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
DAMPING = 0.85
#: Iterations at most; each carries scores one link further, with DAMPING ** n left after n.
ITERATIONS = 40
#: Largest change of any score, relative to the host's plain one, at which iteration ends; looked at every CHECK_EVERY iterations.
TOLERANCE, CHECK_EVERY = 1e-4, 2
#: Blame less faith from which a host is blocked.
THRESHOLD = 1 / 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits (among equally long ones the first by name), else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules or RULES, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=None) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules or RULES:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from host to another host, counted."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst") \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, trusted: DataFrame, blocked: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust, faith, blame) of all hosts with a link or a seed; seeds are tables of distinct ``host``, with or without ``share``.

    Both directions run together (``way`` is out for trust, in for distrust),
    the personalised and the plain score of a host in one row. A host with very
    many links is answered by broadcast, the others meet their links in a join.
    """
    given, taken = edges.groupBy("src").agg(F.sum("n").alias("given")), edges.groupBy("dst").agg(F.sum("n").alias("taken"))
    step = lambda way, a, b, total: F.struct(F.lit(way).alias("way"), F.col(a).alias("a"), F.col(b).alias("b"), (F.col("n") / F.col(total)).alias("part"))
    links = join_on_hot_key(edges, given.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")), "src"), ["src"], "deg", edges.count()).drop("deg")
    links = join_on_hot_key(links, taken.join(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("deg")), "dst"), ["dst"], "deg", edges.count()).drop("deg")
    steps = stored(links.select(F.explode(F.array(step("out", "src", "dst", "given"), step("in", "dst", "src", "taken"))).alias("x")).select("x.*"), "url-steps")
    n_steps = steps.count()

    def of(hosts, way):
        share = F.col("share").cast("double") if "share" in hosts.columns else F.lit(1.0)
        return hosts.select(F.lit(way).alias("way"), F.col("host").alias("a"), share.alias("own"), F.lit(0).cast("bigint").alias("deg"))

    degree = steps.groupBy("way", "a").agg(F.count(F.lit(1)).alias("deg")).withColumn("own", F.lit(0.0))
    ends = steps.select("way", F.col("b").alias("a")).distinct().select("way", "a", F.lit(0.0).alias("own"), F.lit(0).cast("bigint").alias("deg"))
    nodes = stored(of(trusted, "out").unionByName(of(blocked, "in")).unionByName(degree).unionByName(ends)
                   .groupBy("way", "a").agg(F.max("own").alias("own"), F.max("deg").alias("deg")), "url-nodes")
    rest = F.lit(1 - DAMPING)
    seeds = nodes.select("way", "a", (rest * F.col("own")).alias("score"), rest.alias("plain"), "deg")
    scores = last = seeds
    for i in range(1, iterations + 1 if n_steps else 1):
        moved = join_on_hot_key(steps, scores, ["way", "a"], "deg", n_steps).select(
            "way", F.col("b").alias("a"), *[(F.lit(DAMPING) * F.col(c) * F.col("part")).alias(c) for c in ("score", "plain")], F.lit(0).cast("bigint").alias("deg"))
        scores = moved.unionByName(seeds).groupBy("way", "a").agg(F.sum("score").alias("score"), F.sum("plain").alias("plain"), F.max("deg").alias("deg"))
        if i % CHECK_EVERY == 0 or i == iterations:
            scores = stored(scores, "url-scores")
            # the scores only grow: what the last iterations have added bounds the change
            change = scores.join(last.select("way", "a", F.col("plain").alias("was")), ["way", "a"]).agg(
                F.max((F.col("plain") - F.col("was")) / F.col("plain"))).first()[0] or 0.0
            if change < TOLERANCE:
                break
            last = scores
    told = scores.join(nodes.select("way", "a", "own"), ["way", "a"])
    through = F.col("plain") - rest
    mass = F.when(through > 1e-12, F.least((F.col("score") - rest * F.col("own")) / through, F.lit(1.0))).otherwise(F.lit(0.0))
    told = told.withColumn("relative", F.greatest(F.col("own"), mass))
    pick = lambda way, c: F.coalesce(F.max(F.when(F.col("way") == way, F.col(c))), F.lit(0.0))
    return told.groupBy(F.col("a").alias("host")).agg(pick("out", "score").alias("trust"), pick("in", "score").alias("distrust"),
                                                     pick("out", "relative").alias("faith"), pick("in", "relative").alias("blame"))


def judge_urls(pages: DataFrame, rules=None, trusted: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (of the host) for every page."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = stored(rows.withColumn("by_rule", verdict_of(F.col("rule"), rules)), "url-rows")
    hosts = stored(rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum((F.col("by_rule") == "allow").cast("int")).alias("allowed"),
        F.sum((F.col("by_rule") == "block").cast("int")).alias("blocked")), "url-hosts")
    named = hosts.where("host <> ''")
    trusted = named.where("allowed > 0").select("host", (F.col("allowed") / F.col("n_pages")).alias("share")) if trusted is None else trusted
    blocked = named.where("blocked > 0").select("host", (F.col("blocked") / F.col("n_pages")).alias("share")) if blocked is None else blocked
    edges = stored(host_edges(pages.select(url.alias("url"), F.col("html").cast("string").alias("html"))), "url-edges")
    scores = propagate(edges, trusted.dropDuplicates(["host"]), blocked.dropDuplicates(["host"]))
    scored = ["trust", "distrust", "faith", "blame"]
    judged = hosts.select("host", "n_pages").join(scores, "host", "left").select(
        "host", "n_pages", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in scored])
    out = join_on_hot_key(rows, judged, ["host"], "n_pages", rows.count())
    by_host = F.when(F.col("blame") - F.col("faith") >= THRESHOLD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
