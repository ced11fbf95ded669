"""URL filtering: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix.
A host's bad rate is shrunk toward its domain's, the domain's toward its
suffix's, and the suffix's toward the rate of all labelled pages, each through
a beta prior.  The prior's strength at a level comes from the spread of the
rates below it (method of moments for the beta-binomial).  A page is blocked
when even the lower bound of its host's posterior exceeds a limit.

DataFrame functions only; the large table is never shuffled: outcomes shrink
to one row per host by partial aggregation before anything is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.llm.common import col, pick

#: (kind, host, path); the host stands for itself and its subdomains
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


@dataclass(frozen=True)
class Limits:
    """bad_rate: a host is blocked when its posterior mean less ``deviations``
    posterior standard deviations lies above this rate.  weakest, strongest:
    bounds of the prior's strength in pages."""

    bad_rate: float = 0.2
    deviations: float = 1.0
    weakest: float = 2.0
    strongest: float = 1000.0


def _lower(c: Column) -> Column:
    """A-Z only, as host names compare."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url", long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds host, path, domain and suffix; all are empty for null or relative urls.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, the
    path from there to ``?``, ``#`` or the end.  The suffix is the last label
    of the host, or the one of ``long_suffixes`` (such as ``co.uk``) it ends
    with; the registered domain has one label more.
    """
    u = F.coalesce(col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    out = pages.withColumns({"host": host, "path": path})
    labels = F.lit(1)
    for s in long_suffixes:
        labels = F.when(F.col("host").endswith("." + s), F.lit(s.count(".") + 1)).otherwise(labels)
    parts = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    return out.withColumns({"domain": last(labels + 1), "suffix": last(labels)})


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    name = verdict = None
    for kind, h, p in sorted(rules or RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def _strength(rate: Column, var: Column, limits: Limits) -> Column:
    """Prior pages whose beta has the mean ``rate`` and the variance ``var``."""
    s = F.when(var > 0, rate * (1 - rate) / var - 1).otherwise(limits.strongest)
    return F.least(F.greatest(s, F.lit(limits.weakest)), F.lit(limits.strongest))


def reputations(outcomes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Posterior per host of ``outcomes`` (host, domain, suffix, bad 0/1).

    Columns host, n, mean, bound.  Rows with a null outcome don't count.  The
    prior of a level has the parent's posterior mean; its strength follows from
    the spread of the children's rates about it, weighted by their pages and
    less the binomial part.
    """
    all_pages = F.lit("").alias("root")     # the level above the suffixes
    hosts = (outcomes.filter(F.col("bad").isNotNull()).groupBy(all_pages, "suffix", "domain", "host")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("b")))
    counted = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    domains = counted(hosts, "root", "suffix", "domain")
    suffixes = counted(domains, "root", "suffix")

    def shrunk(children: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
        """Children with the strength of their prior and their posterior mean."""
        c = children.join(parents, by)
        m, n, k = F.col("parent"), F.col("n"), F.count(F.lit(1))
        d = F.col("b") / n - m
        # sums of integers don't depend on the order of addition
        millionths = F.sum(F.round(n * d * d * 1000000).cast("long"))
        s = c.groupBy(*by, "parent").agg(millionths.alias("ss"), F.sum("n").alias("sn"), k.alias("k"))
        var = F.greatest(F.lit(0.0), (F.col("ss") / 1000000 - F.col("k") * m * (1 - m)) / F.col("sn"))
        c = c.join(s.select(*by, _strength(m, var, limits).alias("strength")), by)
        return c.withColumn("mean", (F.col("b") + F.col("strength") * m) / (n + F.col("strength")))

    top = counted(suffixes, "root").select("root", (F.col("b") / F.col("n")).alias("parent"))
    s = shrunk(suffixes, top, ["root"]).select("suffix", F.col("mean").alias("parent"))
    d = shrunk(domains, s, ["suffix"]).select("suffix", "domain", F.col("mean").alias("parent"))
    h = shrunk(hosts, d, ["suffix", "domain"])
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return h.select("host", "n", "mean", (F.col("mean") - limits.deviations * deviation).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url",
           outcome_id: str = "page_id", bad: str = "bad", rules=None, limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, posterior bound, verdict.

    ``outcomes`` labels some pages (``bad`` 0/1; null: unlabelled; repeated
    labels of a page count once, as their largest).  A fitting rule decides;
    else a page is blocked when the posterior bound of its host exceeds
    ``limits.bad_rate``.  Hosts without labels, empty hosts and an empty label
    table give allow.  Rows with a null page_id are judged like the others.
    """
    p = with_parts(pick(pages, page_id=page_id, url=url))
    labels = (pick(outcomes, page_id=outcome_id, bad=bad).filter(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
              .groupBy("page_id").agg(F.max("bad").alias("bad")))
    labelled = p.select("page_id", "host", "domain", "suffix").filter("host <> ''").join(labels, "page_id")
    known = reputations(labelled, limits).select("host", "bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = p.join(known, "host", "left")
    own = F.when(F.col("bound") > limits.bad_rate, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), "bound", F.coalesce(verdict, own).alias("verdict"))
