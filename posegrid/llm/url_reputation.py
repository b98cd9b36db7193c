"""URL rules and host reputation by empirical Bayes.

Fixed rules come first: the longest rule that fits a url decides. The other urls are judged by what is
known of pages like them: labelled page outcomes (bad or not) are counted per host, registered domain
and suffix, and each level's rate is shrunk to the level above by a beta-binomial prior,

    suffix: Beta(k0 m, k0 (1 - m)) around the overall rate m,
    domain: Beta(k1 s, k1 (1 - s)) around its suffix's posterior mean s,
    host:   Beta(k2 d, k2 (1 - d)) around its domain's posterior mean d,

with the prior strengths k0, k1, k2 estimated from the spread of the rates of each level by the method
of moments, within ``STRENGTH``. Every host has a posterior, labelled or not: without labels it is its
domain's. A host is blocked when the lower posterior bound (mean less ``Z`` deviations) of its rate of
bad pages is above a limit that stands clear of the overall rate: ``ODDS`` times its odds of a bad page, or ``SURE`` where that is
less. So a host goes when it is, with a probability of about four in five, at least twice as likely bad as the web at large. More labels make
bounds narrow but move no limit: a host near the overall rate stays at any number of labels, and few labels on a host of an
ordinary domain leave a wide bound and an allowed host.

The registered domain is the label before the public suffix, which is the last label or one of
``SUFFIXES``. A port, a user name and a last dot are no part of the name; an address is its own domain.

All of it is DataFrame expressions. Outcomes are counted per host once, with map-side aggregation, and
written; the levels above are derived from that table, and three strengths and the overall rate come to
the driver. The join back to the pages is an equi-join on the host that Spark splits where one host has
many pages. The label table is joined on its key.

Defined cases: a null url, or one without ``://``, has host and path empty and is judged by the rate of
the empty host; a host without a dot is its own domain and suffix; no labels at all allow everything; equal rows are each returned, repeated labels each count; urls of any length are
read whole; other columns are not read; no pages, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Deviations between mean and bound, for a probability of four in five.
Z = 0.8416
#: Odds of a bad page, as a multiple of those of all pages, that block a host; and a rate that does so anyhow.
ODDS, SURE = 2.0, 0.9
#: Bounds of the estimated prior strengths, in pages: a prior never outweighs fifty labels of a host's own.
STRENGTH = (1.0, 50.0)
#: Public suffixes of two labels under which anyone can register a name.
SUFFIXES = tuple(
    "ac.at co.at or.at com.au net.au org.au edu.au gov.au id.au com.br net.br org.br gov.br com.cn net.cn org.cn edu.cn gov.cn ac.cn com.co com.es org.es nom.es"
    " com.hk org.hk co.id or.id ac.id co.il org.il ac.il co.in net.in org.in ac.in gov.in co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr go.kr ac.kr re.kr com.mx org.mx"
    " gob.mx com.my org.my co.nz net.nz org.nz ac.nz govt.nz com.pe com.ph org.ph com.pl net.pl org.pl com.pt com.ru org.ru com.sg org.sg edu.sg co.th or.th ac.th"
    " com.tr org.tr gov.tr com.tw org.tw edu.tw gov.tw com.ua org.ua co.uk org.uk me.uk ltd.uk plc.uk net.uk ac.uk gov.uk sch.uk nhs.uk com.vn com.ar org.ar gob.ar"
    " co.za org.za ac.za gov.za".split()
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name = F.when(fits, of + start).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _name(host: Column) -> Column:
    """A host without user name, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")


def domain_of(host: Column) -> Column:
    """The registered domain of a host: the public suffix and the label before it."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    """The public suffix of a host; empty for an address."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), "").when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def _strength(rates: DataFrame) -> float:
    """Prior strength from rows (n, bad, mean) of a level, mean being the level above's rate.

    With E[(r - m)^2] = m(1 - m)(1/n + (1 - 1/n) / (k + 1)), solved for k from sums over the level.
    """
    n = F.col("n").cast("double")
    rate = F.try_divide(F.col("bad"), n)
    base = F.col("mean") * (1 - F.col("mean"))
    seen, noise, room = rates.filter("n > 1").agg(F.sum(n * F.pow(rate - F.col("mean"), 2)), F.sum(base), F.sum(base * (n - 1))).first()
    share = (seen - noise) / room if room else 0.0
    low, high = STRENGTH
    return round(min(high, max(low, 1 / share - 1)), 6) if share > 0 else high


def _shrunk(counts: DataFrame) -> DataFrame:
    """Adds (a, b) of the posterior and its mean, ``posterior``, to rows (n, bad, mean)."""
    k = F.lit(_strength(counts))
    a, b = k * F.col("mean") + F.col("bad"), k * (1 - F.col("mean")) + F.col("n") - F.col("bad")
    return counts.select("*", a.alias("a"), b.alias("b"), (a / (a + b)).alias("posterior"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, rate, bound, overall) of every host of ``outcomes`` (host, bad 0/1) and of ``hosts`` (host).

    ``overall`` is the rate of all outcomes, the same on every row, and null where there are none.
    """
    seen = outcomes.select("host", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    if hosts is not None:
        seen = seen.union(hosts.select("host", F.lit(0).cast("long"), F.lit(0).cast("long")))
    counted = seen.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counted = settle(counted.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "host-outcomes")
    overall = counted.agg(F.try_divide(F.sum("bad"), F.sum("n"))).first()[0]
    if overall is None:
        none = F.lit(None).cast("double")
        return counted.select("host", "n", "bad", none.alias("rate"), none.alias("bound"), none.alias("overall"))
    total = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrunk(counted.groupBy("suffix").agg(*total).withColumn("mean", F.lit(overall)))
    domains = counted.groupBy("domain", "suffix").agg(*total)
    domains = _shrunk(domains.join(suffixes.select("suffix", F.col("posterior").alias("mean")), "suffix"))
    found = _shrunk(counted.join(domains.select("domain", "suffix", F.col("posterior").alias("mean")), ["domain", "suffix"]))
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    bound = F.greatest(F.lit(0.0), F.col("posterior") - Z * deviation)
    return found.select("host", "n", "bad", F.col("posterior").alias("rate"), bound.alias("bound"), F.lit(overall).alias("overall"))


def block_limit(overall: Column) -> Column:
    """The rate that a host's bound must pass, given the rate of all outcomes."""
    return F.least(F.lit(SURE), ODDS * overall / (1 + (ODDS - 1) * overall))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the host's shrunk rate and bound."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = host_reputation(outcomes, split.select("host"))
    worse = F.coalesce(F.round("bound", 6) > F.round(block_limit(F.col("overall")), 6), F.lit(False))
    known = known.select("host", F.round("rate", 6).alias("host_rate"), F.round("bound", 6).alias("host_bound"), F.when(worse, "block").otherwise("allow").alias("own"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return split.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "own").alias("verdict"), "host_rate", "host_bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose path names a labelled document: bad is low quality or toxic."""
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.select(F.col("doc_id").alias("number"), F.coalesce(bad, F.lit(0)).alias("bad"))
    return pages.select(host_of(F.col("url")).alias("host"), number.alias("number")).join(known, "number").select("host", "bad")
