"""URL filtering by rules and by empirical-Bayes host reputation (DataFrame operations only).

Pages that a rule decides are the labelled outcomes (block = 1). Their counts are shrunk down a hierarchy: the suffix's
rate is a beta-binomial posterior under the corpus-wide prior, the registered domain's under its suffix's rate, the host's
under its domain's. The strength of each prior comes from the spread of the rates below it by the method of moments.
A page that no rule decides is blocked when the lower bound of its host's posterior is over ``threshold``.

Pages are counted once into a stored table of hosts, from which all levels are made: counts and the sums that the spread needs go up,
rates and strengths come down. Keys that more than one row in ``HOT`` has are broadcast (fewer than ``HOT`` exist), the others are shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored_at

#: verdict, host, path
Rule = tuple[str, str, str]

#: Keys of more than one row in so many are broadcast.
HOT = 10_000
#: Suffixes of two labels under which domains are registered. All others are the last label.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pk", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ltd.uk", "ne.jp", "net.au", "net.br", "net.cn", "nhs.uk",
    "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.uk", "org.za", "sch.uk",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as ``host/path``; null where none does. Equally long ones: the first."""
    out = F.lit(None).cast("string")
    for _, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(rule_host + rule_path)).otherwise(out)
    return out


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user part, port and trailing dots.

    The suffix is the last two labels if ``suffixes`` has them, else the last; the domain has one label more. Addresses (IPv4, or in
    brackets) are their own domain and suffix. An empty host has empty levels.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*\z", ""), r"\.+\z", "")
    parts = F.split(bare, r"\.")
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - (k - 1), F.lit(1)), k), ".")
    address = bare.rlike(r"^(\[.*\]|\d+(\.\d+){3})\z")
    two = last(2).isin(list(suffixes)) if suffixes else F.lit(False)
    return F.when(address, bare).when(two, last(3)).otherwise(last(2)), F.when(address, bare).when(two, last(2)).otherwise(last(1))


def _kept(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name, release=False)[0]


def looked_up(rows: DataFrame, table: DataFrame, key: str, *, weight: str, many: int, own: Sequence[str], name: str) -> DataFrame:
    """``rows`` with column ``name``: a struct of the other columns of ``table``, which has one row per ``key``; null without a match.

    ``weight`` is the number of rows that a key of ``table`` has. Keys with more than ``many`` are broadcast; a row that has found its
    own there, or has no key, takes part in the second lookup under a salt from the columns ``own``, so that it is not sent to its key's task.
    """
    value = F.struct(*[c for c in table.columns if c != key])
    hot = table.where(F.col(weight) > many).select(key, value.alias("_hot"))
    cold = table.where(F.col(weight) <= many).select(key, F.lit(0).cast("long").alias("_salt"), value.alias("_cold"))
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*own))
    found = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).join(cold, [key, "_salt"], "left")
    return found.withColumn(name, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_salt")


def _share(table: DataFrame, weight: str) -> int:
    """One in ``HOT`` of the rows that ``weight`` counts."""
    return int(table.agg(F.sum(weight)).first()[0] or 0) // HOT + 1


def _strength(prior: Column, n: Column, bad: Column, k: Column, squares: Column) -> Column:
    """Pages that a prior is worth, 1 to 1000, by the method of moments: between-group variance over binomial variance.

    ``squares`` sums bad * bad / n over the ``k`` groups below, so the spread about the prior needs no second pass over them.
    """
    var = prior * (1 - prior)
    between = F.greatest(F.lit(0.0), squares - 2 * prior * bad + prior * prior * n) / n
    bounded = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), (var - between) / F.greatest(between - var * k / n, F.lit(1e-9))))
    return F.when(var <= 0, F.lit(1000.0)).otherwise(bounded)


def _posterior(rows: DataFrame, prior: Column, strength: Column, z: float) -> DataFrame:
    """``rows`` with alpha, beta, rate and lower, from n and bad under a prior."""
    out = rows.withColumn("alpha", F.col("bad") + strength * prior).withColumn("beta", F.col("n") - F.col("bad") + strength * (1 - prior))
    total = F.col("alpha") + F.col("beta")
    rate = F.col("alpha") / total
    return out.withColumns({"rate": rate, "lower": F.greatest(F.lit(0.0), rate - z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1))))})


def _up(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of a level from those of the level below."""
    square = F.col("bad") * F.col("bad") / F.col("n")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("k"), F.sum(square).alias("squares"))


def _reputation(hosts: DataFrame, z: float) -> dict[str, DataFrame]:
    """``host_reputation`` from a stored table of host, domain, suffix, n and bad; n is positive."""
    domains = _kept(_up(hosts, "domain", "suffix"), "url-domains")
    suffixes = _kept(_up(domains, "suffix"), "url-suffixes")
    n, bad, k, squares = _up(suffixes).first()
    prior = F.lit(((bad or 0) + 1) / ((n or 0) + 2))
    suffixes = _posterior(suffixes, prior, _strength(prior, F.lit(n or 1), F.lit(bad or 0), F.lit(k), F.lit(squares or 0.0)), z)
    strength = _strength(F.col("rate"), F.col("n"), F.col("bad"), F.col("k"), F.col("squares")).alias("strength")
    above = lambda rows, key: rows.select(key, F.col("rate").alias("prior"), strength, "k")
    known = looked_up(domains, above(suffixes, "suffix"), "suffix", weight="k", many=_share(suffixes, "k"), own=["domain"], name="up")
    domains = _kept(_posterior(known, F.col("up.prior"), F.col("up.strength"), z).drop("up"), "url-domain-rates")
    known = looked_up(hosts, above(domains, "domain"), "domain", weight="k", many=_share(domains, "k"), own=["host"], name="up")
    hosts = _posterior(known, F.col("up.prior"), F.col("up.strength"), z).drop("up")
    return {"suffix": suffixes, "domain": domains, "host": hosts}


def _counted(rows: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Stored table of hosts: host, domain, suffix, n and bad of the rows with an outcome, number of open rows without."""
    one = rows.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count_if(F.col("bad").isNull()).alias("open")
    )
    domain, suffix = levels(F.col("host"), suffixes)
    return _kept(one.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad", "open"), "url-hosts")


def host_reputation(labelled: DataFrame, *, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> dict[str, DataFrame]:
    """Tables ``suffix``, ``domain``, ``host`` with n, bad, alpha, beta, rate, lower.

    ``labelled`` has host and bad (0 or 1); rows with a null are ignored. ``lower`` is the rate less ``z`` posterior
    standard deviations. An empty input gives empty tables.
    """
    return _reputation(_counted(labelled.select("host", "bad").where("host is not null and bad is not null"), suffixes), z)


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, reputation.

    ``rule`` decides where one fits. Otherwise ``reputation``, the lower posterior bound of the most specific level with
    outcomes (host, registered domain, suffix), blocks when over ``threshold``; with no outcomes at any level it is 0 and
    the page is allowed, as it is 0 for pages that a rule decides. Null or malformed urls have empty host and path, no rule, and are allowed. Repeated rows count as
    often as they occur. An empty table gives no rows; other columns are ignored whatever their names.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    base = base.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    blocks = [h + p for v, h, p in rules if v == "block"]
    bad = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocks).cast("long") if blocks else F.lit(0).cast("long"))
    hosts = _counted(base.where("host <> ''").select("host", bad.alias("bad")), suffixes)
    rep = _reputation(hosts.where("n > 0"), z)
    # Hosts with an outcome have their own bound; the others look for their domain's, then their suffix's.
    small = others = hosts.where("n = 0").select("host", "domain", "suffix", "open")
    for key in ("domain", "suffix"):
        table = _kept(rep[key].select(key, "lower").join(others.groupBy(key).agg(F.count(F.lit(1)).alias("w")), key), f"url-{key}-bounds")
        small = looked_up(small, table, key, weight="w", many=_share(table, "w"), own=["host"], name=f"_{key}")
    lower = F.coalesce("_domain.lower", "_suffix.lower", F.lit(0.0)).alias("lower")
    bounds = _kept(rep["host"].where("open > 0").select("host", "lower", "open").unionAll(small.select("host", lower, "open")), "url-bounds")
    keyed = base.withColumn("_host", F.when(F.col("rule").isNull() & (F.col("host") != ""), F.col("host")))
    bounds = bounds.withColumnRenamed("host", "_host")
    found = looked_up(keyed, bounds, "_host", weight="open", many=_share(bounds, "open"), own=["id", "path"], name="_bound")
    reputation = F.coalesce("_bound.lower", F.lit(0.0))
    rule_verdict = F.when(F.col("rule").isin(blocks), "block").otherwise("allow") if blocks else F.lit("allow")
    verdict = F.when(F.col("rule").isNotNull(), rule_verdict).when(reputation > threshold, "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), reputation.alias("reputation"))
