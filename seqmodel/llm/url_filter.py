"""URL filters: path rules first, else the reputation of the host by empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmodel.sources.scratch import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered; all others have one label.
WIDE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.mx")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class Prior:
    """Bounds of the method: a host is blocked where the lower bound of its bad share exceeds ``most_bad``."""

    z: float = 1.645
    most_bad: float = 0.3
    least_correlation: float = 0.001
    most_correlation: float = 0.5


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls; of rules of one length the first in text order."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def domain_of(host: Column, wide_suffixes: tuple[str, ...] = WIDE_SUFFIXES) -> Column:
    labels = F.split(host, r"\.")
    wide = F.substring_index(host, ".", -2).isin(*wide_suffixes) if wide_suffixes else F.lit(False)
    return F.when(wide & (F.size(labels) > 2), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column, wide_suffixes: tuple[str, ...] = WIDE_SUFFIXES) -> Column:
    wide = F.substring_index(host, ".", -2).isin(*wide_suffixes) if wide_suffixes else F.lit(False)
    return F.when(wide, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame, prior: Prior) -> float:
    """Weight of the parent's mean, in outcomes: (1 - r) / r, r being the correlation of outcomes inside a group by moments.

    ``groups`` has n and bad of every group and the mean of its parent; one row comes back.
    """
    m, n, k = F.col("mean"), F.col("n"), F.col("bad")
    row = groups.agg(
        F.sum(F.pow(k - n * m, 2) - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("of")
    ).first()
    r = row["over"] / row["of"] if row["of"] else prior.least_correlation
    r = min(max(r, prior.least_correlation), prior.most_correlation)
    return (1 - r) / r


def host_reputation(hosts: DataFrame, prior: Prior = Prior(), wide_suffixes: tuple[str, ...] = WIDE_SUFFIXES) -> DataFrame:
    """``hosts`` (host, n, bad: labelled outcomes) with ``mean`` and ``bound`` of the bad share of each host.

    Counts are summed to domains, suffixes and one total. The total's mean is the prior of the suffixes, each
    suffix's posterior mean that of its domains, each domain's that of its hosts. A host without outcomes has its
    domain's mean. ``bound`` is mean - z sd of the host's beta posterior.
    """
    named = hosts.withColumns({"domain": domain_of(F.col("host"), wide_suffixes), "suffix": suffix_of(F.col("host"), wide_suffixes)})
    named = written(named, "hosts", lookup=True)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = written(named.groupBy("domain", "suffix").agg(*sums), "domains", lookup=True)
    suffixes = written(domains.groupBy("suffix").agg(*sums), "suffixes", lookup=True)
    total = suffixes.agg(*sums).first()
    top = ((total["bad"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    def posterior(groups: DataFrame) -> DataFrame:
        s = _strength(groups, prior)
        a, b = s * F.col("mean") + F.col("bad"), s * (1 - F.col("mean")) + F.col("n") - F.col("bad")
        return groups.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    suffixes = posterior(suffixes.withColumn("mean", F.lit(top)))
    domains = posterior(domains.join(suffixes.select("suffix", "mean"), "suffix"))
    found = posterior(named.join(domains.select("domain", "mean"), "domain"))
    size = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return found.withColumn("bound", F.col("mean") - prior.z * sd).select("host", "n", "bad", "mean", "bound")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...], prior: Prior = Prior(),
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``(id, host, path, rule, verdict, bad_share, bound)`` of every row of ``pages``.

    ``outcomes`` has ``id_col`` and a boolean ``bad``; several outcomes of a page count each, null ones not at all.
    Urls that are null or without ``://`` have an empty host and path and the reputation of the empty host. Rows
    of equal or null id are judged each. Hosts are counted before they are joined; the join that brings the
    verdict back to the pages is a plain one, whose large keys Spark splits. Without any outcome all pages
    no rule speaks of are judged by a share of one half, which gives ``allow`` only if the bound allows it.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labelled = (
        outcomes.select(F.col(id_col), F.col("bad").cast("int").alias("bad")).where("bad is not null")
        .groupBy(id_col).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    )
    counted = (
        seen.select(id_col, "host").join(labelled, id_col, "left").groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    reputation = written(host_reputation(counted, prior), "reputation", lookup=True)
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > prior.most_bad, "block").otherwise("allow")
    joined = seen.join(reputation.select("host", "mean", "bound"), "host", "left")
    return joined.select(
        F.col(id_col), "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("mean").alias("bad_share"), "bound",
    )


def sql(rules: tuple[Rule, ...], prior: Prior = Prior(), wide_suffixes: tuple[str, ...] = WIDE_SUFFIXES) -> str:
    """The same in DuckDB SQL over ``pages`` and ``labels``, without the two last columns."""
    case_rule, case_verdict = "", ""
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = f"(host = '{rule.host}' or ends_with(host, '.{rule.host}')) and starts_with(path, '{rule.path}')"
        case_rule += f" when {fits} then '{rule.text}'"
        case_verdict += f" when {fits} then '{rule.verdict}'"
    wide = ", ".join(f"'{s}'" for s in wide_suffixes)
    last = lambda k: f"array_to_string(l[-{k}:], '.')"
    strength = f"""(select (1 - r) / r from (select least(greatest(coalesce(
        sum(pow(bad - n * mean, 2) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0),
        {prior.least_correlation}), {prior.least_correlation}), {prior.most_correlation}) as r from"""
    return f"""
    with cut as (select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end as rest from pages),
    seen as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
    outcome as (select doc_id, count(*) as n, sum(((quality = 0) or (toxic = 1))::int) as bad from labels
        where ((quality = 0) or (toxic = 1)) is not null group by doc_id),
    host0 as (select host, coalesce(sum(n), 0)::double as n, coalesce(sum(bad), 0)::double as bad
        from seen left join outcome on page_id = doc_id group by host),
    labels_of as (select *, string_split(host, '.') as l from host0),
    hosts as (select host, n, bad,
        case when {last(2)} in ({wide}) and len(l) > 2 then {last(3)} else {last(2)} end as domain,
        case when {last(2)} in ({wide}) then {last(2)} else {last(1)} end as suffix from labels_of),
    domain0 as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by all),
    suffix0 as (select suffix, sum(n) as n, sum(bad) as bad from domain0 group by all),
    suffix1 as (select *, (select (sum(bad) + 1.0) / (sum(n) + 2.0) from suffix0) as mean from suffix0),
    suffix2 as (select suffix, (s * mean + bad) / (s + n) as mean from suffix1, {strength} suffix1)) as q(s)),
    domain1 as (select d.*, mean from domain0 d join suffix2 using (suffix)),
    domain2 as (select domain, (s * mean + bad) / (s + n) as mean from domain1, {strength} domain1)) as q(s)),
    host1 as (select h.*, mean from hosts h join domain2 using (domain)),
    host2 as (select host, s * mean + bad as a, s * (1 - mean) + n - bad as b from host1, {strength} host1)) as q(s)),
    host3 as (select host, a / (a + b) - {prior.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from host2)
    select page_id, host, path, case {case_rule} end as rule,
        case {case_verdict} else case when bound > {prior.most_bad} then 'block' else 'allow' end end as verdict
    from seen join host3 using (host)"""
