"""URL filters: empirical-Bayes host reputation in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stored

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null. The rules are a parameter, so few."""
    fits = None
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    for name, start, verdict in order:
        ok = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(ok, value) if fits is None else fits.when(ok, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if fits is None else fits


def _shrunk(level: DataFrame, key: str, up: str | None, above: DataFrame | None, overall: float) -> DataFrame:
    """(key, up, n, bad, a, b): the beta posterior of every key of a level.

    The prior of a key has the posterior mean of what lies above it and the strength m of a beta-binomial fitted by
    moments to the level's labelled rates; a key without a label has that prior itself.
    """
    if above is None:
        level = level.withColumn("prior", F.lit(overall))
    else:
        level = level.join(above.select(up, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")), up, "left")
    noise = F.col("prior") * (1 - F.col("prior"))
    # E[n * (rate - prior)^2] = prior * (1 - prior) * (1 + (n - 1) * rho)
    row = level.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("ss"), F.sum(noise).alias("one"), F.sum((F.col("n") - 1) * noise).alias("room")).first()
    rho = min(0.999, max(1e-3, (row.ss - row.one) / row.room)) if row.room else 0.5
    m = 1 / rho - 1
    return level.select("*", (F.col("bad") + m * F.col("prior")).alias("a"), (F.col("n") - F.col("bad") + m * (1 - F.col("prior"))).alias("b")).drop("prior")


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, a, b, mean, low, high, overall) of each host among outcomes(host, bad), bad being 0, 1 or null (no label).

    Counts go up from host to registered domain (the last two labels) to suffix (the last label); posteriors come
    down the same way, each level's prior centred on the posterior mean above it. low and high bound the chance of a
    bad page at z standard deviations of the beta posterior. Hosts without a label get their prior. Counting is
    pre-aggregated by host, so that a hot host is one row from each task before any shuffle.
    """
    parts = F.split("host", r"\.")
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.select("host", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(parts, -1).alias("suffix"), "n", "bad")
    hosts = stored(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1)
    top = _shrunk(suffixes, "suffix", None, None, overall)
    middle = _shrunk(domains, "domain", "suffix", top, overall)
    out = _shrunk(hosts, "host", "domain", middle, overall)
    total = F.col("a") + F.col("b")
    mean, sd = F.col("a") / total, F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return out.select("host", "n", "bad", "a", "b", mean.alias("mean"), F.greatest(F.lit(0.0), mean - z * sd).alias("low"), F.least(F.lit(1.0), mean + z * sd).alias("high"), F.lit(overall).alias("overall"))


def judge_urls(pages: DataFrame, outcomes: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, limit: float = 1.0, z: float = 1.645) -> DataFrame:
    """Every row of pages(page_id, url, ...) with host, path, rule, verdict and the reputation behind it.

    outcomes(page_id, bad) labels pages 0 (good) or 1 (bad); null is no label. A rule decides where one fits, of equally
    long ones the first by name; elsewhere a host is blocked if even the lower posterior bound of its bad share is above
    `limit` times the share of bad pages of all labelled ones. null and malformed urls have host and path '' and form the
    host '' of their own; urls of any length are read as a whole. Repeated rows stay, an empty table gives an empty one;
    extra columns of pages are dropped, so none can clash.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if outcomes is None:
        labelled = rows.select("host", F.lit(None).cast("long").alias("bad"))
    else:
        marks = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
        labelled = rows.join(marks, "page_id", "left").select("host", F.col("bad").cast("long").alias("bad"))
    reputation = host_reputation(labelled, z).select("host", F.col("n").alias("host_labels"), "mean", "low", "high", "overall")
    out = rows.join(reputation, "host", "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("low") > limit * F.col("overall"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "host_labels", "mean", "low", "high")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page is bad if the document whose number ends its path is labelled toxic or of low quality; a page
    whose document has neither label has null, one without a labelled document no row."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.html|/)?$", 1)
    of = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)).alias("bad"))
    return of.join(marks, "doc_id").select("page_id", "bad")
