"""URL filter: explicit host and path rules, then empirical-Bayes host reputation.

Outcomes of labelled pages are counted per host. A beta-binomial prior of one strength, fitted by
moments over the hosts, shrinks suffixes towards the whole, registered domains towards their suffix
and hosts towards their domain. A host passes if the lower bound of its posterior stays above a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Second-level labels under which names of a country are registered.
_DOMAIN = r"([^.]+\.(?:(?:co|com|net|org|edu|gov|ac|or|ne|go)\.[a-z]{2}|[^.]+))$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, three under names like co.uk; a bare name or an address stands for itself."""
    found = F.regexp_extract(host, _DOMAIN, 1)
    return F.when(host.rlike(r"^[0-9.:]*$") | (found == ""), host).otherwise(found)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule overrides
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(verdict)
    return name, verdict


def reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, weakest: float = 2.0, strongest: float = 200.0) -> DataFrame:
    """(host, bound) for ``hosts``: lower posterior bound of a good page, from ``outcomes`` (host, good 0/1)."""
    seen = outcomes.where("good is not null and host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    h = (
        hosts.select("host").distinct().join(seen, "host", "left").na.fill(0, ["n", "g"])
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", F.regexp_extract("domain", r"^[^.]*\.(.*)$", 1))
    )
    # moments: between-host variance beyond the binomial one gives the strength k of the priors
    whole = h.agg(F.sum("n").alias("tn"), F.sum("g").alias("tg"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.expr("case when n > 0 then g * g / n else 0 end")).alias("gg"), F.count_if(F.col("n") > 0).alias("m"))
    whole = whole.select(
        ((F.col("tg") + 1.0) / (F.col("tn") + 2.0)).alias("m0"),
        F.expr("try_divide((gg - cast(tg as double) * tg / tn) - (m - 1) * (tg / tn) * (1 - tg / tn), (tn - cast(nn as double) / tn - (m - 1)) * (tg / tn) * (1 - tg / tn))").alias("rho"),
    ).select("m0", F.expr(f"case when rho is null or rho <= 0 then {strongest} else greatest({weakest}, least({strongest}, (1 - rho) / rho)) end").alias("k"))
    by_suffix = h.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("g").alias("sg")).crossJoin(F.broadcast(whole)).select("suffix", "k", ((F.col("k") * F.col("m0") + F.col("sg")) / (F.col("k") + F.col("sn"))).alias("ms"))
    by_domain = h.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("g").alias("dg")).join(by_suffix, "suffix").select("domain", "k", ((F.col("k") * F.col("ms") + F.col("dg")) / (F.col("k") + F.col("dn"))).alias("md"))
    ab = h.join(by_domain, "domain").select("host", (F.col("k") * F.col("md") + F.col("g")).alias("a"), (F.col("k") * (1 - F.col("md")) + F.col("n") - F.col("g")).alias("b"))
    return ab.select("host", F.expr(f"a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))").alias("bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, least: float = 0.5) -> DataFrame:
    """Every page with host, path, the rule that judged it or null, the verdict and the host's posterior bound.

    ``pages`` has page_id and url, ``outcomes`` page_id and good (0 or 1; nulls are ignored; the
    worst of repeated rows counts). A null url or one without ``://`` has empty host and path and is
    judged as host ''. Without outcomes the prior alone decides. Other columns are ignored; repeated
    rows come back as often. Hosts are aggregated per task before they move, and only (page_id, url) is read.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    good = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    bounds = reputation(rows.select("page_id", "host").join(good, "page_id").select("host", "good"), rows)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.join(bounds, "host").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.round("bound", 9) >= least, "allow").otherwise("block")).alias("verdict"),
        F.round("bound", 6).alias("bound"),
    )


SQL = r"""
with rows as (select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
good as (select doc_id as page_id, min(quality) as good from labels where doc_id is not null and quality is not null group by 1),
seen as (select host, count(good)::double as n, coalesce(sum(good), 0)::double as g from rows left join good using (page_id) group by 1),
h0 as (select *, regexp_extract(host, '([^.]+\.(?:(?:co|com|net|org|edu|gov|ac|or|ne|go)\.[a-z]{2}|[^.]+))$', 1) as found from seen),
h1 as (select *, case when regexp_matches(host, '^[0-9.:]*$') or found = '' then host else found end as domain from h0),
h as (select *, regexp_extract(domain, '^[^.]*\.(.*)$', 1) as suffix from h1),
w as (select sum(n) as tn, sum(g) as tg, sum(n * n) as nn, sum(case when n > 0 then g * g / n else 0 end) as gg, count(*) filter (n > 0) as m from h),
r as (select (tg + 1) / (tn + 2) as m0, ((gg - tg * tg / tn) - (m - 1) * (tg / tn) * (1 - tg / tn)) / nullif((tn - nn / tn - (m - 1)) * (tg / tn) * (1 - tg / tn), 0) as rho from w),
p as (select m0, case when rho is null or isnan(rho) or rho <= 0 then 200.0 else greatest(2.0, least(200.0, (1 - rho) / rho)) end as k from r),
s as (select suffix, k, (k * m0 + sum(g)) / (k + sum(n)) as ms from h, p group by suffix, k, m0),
d as (select domain, k, (k * ms + sum(g)) / (k + sum(n)) as md from h join s using (suffix) group by domain, k, ms),
ab as (select host, k * md + g as a, k * (1 - md) + n - g as b from h join d using (domain)),
bounds as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from ab),
fit as (select *, list_filter([
    {'n': 4, 'r': 'net/', 'v': 'block', 'f': (host = 'net' or host like '%.net') and path like '/%'},
    {'n': 15, 'r': 'example.net/en/', 'v': 'allow', 'f': (host = 'example.net' or host like '%.example.net') and path like '/en/%'},
    {'n': 15, 'r': 'example.com/de/', 'v': 'block', 'f': (host = 'example.com' or host like '%.example.com') and path like '/de/%'},
    {'n': 7, 'r': 'org/fr/', 'v': 'allow', 'f': (host = 'org' or host like '%.org') and path like '/fr/%'}], lambda x: x.f) as fits from rows),
best as (select page_id, host, path, list_sort(fits, 'desc')[1] as top from fit)
select page_id, host, path, top.r as rule, coalesce(top.v, case when round(bound, 9) >= 0.5 then 'allow' else 'block' end) as verdict, round(bound, 6) as bound
from best join bounds using (host)
"""
