"""URL filter: smoothed variable-order Markov models of accepted and rejected URLs, with DataFrame functions only.

Explicit rules come first.  Where none fits, the length-normalised difference of
two character models decides.  Both models share their contexts: all strings of
up to `order` characters that make up at least `least_share` of the accepted or of the
rejected URLs' strings of their length, so that a rare class keeps its own, and no
model has more than 2 * (order + 1) / least_share entries and may be broadcast.  A character's probability is interpolated from the
longest kept context down to the uniform distribution; written in logarithms,
every occurrence of a kept string adds a fixed amount, so that a URL's score is
a sum over its strings.

Training labels are weak: a URL is rejected if one of the names in its host (between
dots, hyphens and underscores) is a seed word, else accepted, so `ads-track` is and
`downloads` is not.  The models see host and path, and
carry the decision over to URLs written otherwise.  Rules do not label.  URLs
are parted by a digest of their host: thirteen in sixteen of the hosts train the
models, and the threshold is the one that parts the URLs of the other hosts best by
balanced accuracy, as the models have not seen them, among those that reject at most
`most_lost` of the accepted ones.

A URL's strings travel with its row number alone; characters are taken from an
array, so that the work grows with the URL's length and not with its square.

Defined results: null URLs and those without :// have empty host and path, fit
no rule and are judged as the empty string, which scores 0; repeated rows have equal
verdicts.  Without rejected or without accepted URLs among the hosts for the
threshold it comes from all URLs; if those are of one class too, all are allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pick
from ..operators.materialize import materialize

#: (verdict, rule): host and path of a rule, which fits the host and all subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words in hosts of unwanted sites.
SEEDS = ("spam", "casino", "pills", "bets", "ads", "adult", "porn", "viagra", "betting", "lottery", "warez")
#: Hosts whose digest begins so serve the threshold, not the models: three in sixteen.
FOLD = ("0", "1", "2")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*+)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def seeded(host: Column, seeds=SEEDS) -> Column:
    """Whether a name in the host is a seed word."""
    return F.arrays_overlap(F.split(host, r"[._-]"), F.array(*map(F.lit, seeds)))


def for_threshold(host: Column) -> Column:
    return F.substring(F.md5(host), 1, 1).isin(*FOLD)


def _strings(rows: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """One row for each string of 1 to order + 1 characters of `u`: s, and whether a character follows."""
    chars = rows.select(*keep, F.when(F.length("u") > 0, F.split("u", "")).otherwise(F.array().cast("array<string>")).alias("c"))
    places = chars.select(*keep, "c", F.posexplode("c").alias("i", "first"))
    one = lambda k: F.get("c", F.col("i") + k)
    # A string that would reach beyond the end is null.
    found = F.array(*(F.struct(F.concat("first", *(one(j) for j in range(1, k))).alias("s"), one(k).isNotNull().cast("int").alias("more")) for k in range(1, order + 2)))
    return places.select(*keep, F.explode(found).alias("x")).select(*keep, "x.s", "x.more").filter("s is not null")


class Model:
    """What each kept string adds to the difference of log-probabilities: always, and if a character follows."""

    def __init__(self, counts: list[tuple[str, int, int]], order: int):
        by = {s: (a, r) for s, a, r in counts}
        alphabet = max(2, sum(len(s) == 1 for s in by))
        self.entries: list[tuple[str, float, float]] = []
        shares: list[dict[str, float]] = [{}, {}]
        after: list[dict[str, tuple[int, int]]] = [{}, {}]
        for c in (0, 1):
            total: dict[str, list[int]] = {}
            for s, n in by.items():
                x = total.setdefault(s[:-1], [0, 0])
                x[0] += n[c]
                x[1] += n[c] > 0
            after[c] = {s: (n, max(1, kinds)) for s, (n, kinds) in total.items()}
        lower = lambda c, s: shares[c].get(s[1:], None)
        back = lambda c, s: math.log(after[c][s][1] / (after[c][s][0] + after[c][s][1])) if s in after[c] else 0.0
        added: dict[str, float] = {}
        for s in sorted(by, key=lambda s: (len(s), s)):
            delta = []
            for c in (0, 1):
                n, kinds = after[c][s[:-1]]
                base = 1 / (alphabet + 1) if len(s) == 1 else lower(c, s)
                shares[c][s] = (by[s][c] + kinds * base) / (n + kinds)
                delta.append(math.log(shares[c][s]) - (math.log(base) if len(s) > 1 else 0.0) - (back(c, s[:-1]) if len(s) > 1 else 0.0))
            added[s] = delta[0] - delta[1]
        for s in by:
            follows = back(0, s) - back(1, s) if len(s) <= order else 0.0
            self.entries.append((s, added[s], follows))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.entries or [("", 0.0, 0.0)], "s string, always double, follows double")


def learn(rows: DataFrame, *, order: int = 4, least_share: float = 1e-5) -> Model:
    """rows: u and rejected (0 or 1).  At most 2 * (order + 1) / least_share counts come to the driver."""
    length = F.length("u")
    totals = rows.agg(F.sum(F.when(F.col("rejected") == 0, length)), F.sum(F.when(F.col("rejected") == 1, length))).first()
    least_a, least_r = (max(2, math.ceil(least_share * (n or 0))) for n in totals)
    counts = _strings(rows, order, ["rejected"]).groupBy("s").agg(F.sum(1 - F.col("rejected")).alias("a"), F.sum("rejected").alias("r")).filter((F.col("a") >= least_a) | (F.col("r") >= least_r))
    # A kept string's starts and ends are at least as frequent in its class, and so are kept.
    return Model([(x["s"], x["a"], x["r"]) for x in counts.orderBy("s").collect()], order)


def _threshold(scored: DataFrame, most_lost: float) -> float:
    """Between accepted and rejected URLs, from counts by score to a hundredth: logarithms, so a few thousand at most."""
    cell = F.floor(F.col("score") * 100).cast("int")
    counts = scored.groupBy(cell.alias("cell"), "apart").agg(F.sum(1 - F.col("rejected")).alias("a"), F.sum("rejected").alias("r")).collect()
    rows = [x for x in counts if x["apart"]]
    if not sum(x["a"] for x in rows) or not sum(x["r"] for x in rows):
        rows = counts
    by: dict[int, list[int]] = {}
    for x in rows:
        own = by.setdefault(x["cell"], [0, 0])
        own[0], own[1] = own[0] + x["a"], own[1] + x["r"]
    accepted, rejected = sum(x[0] for x in by.values()), sum(x[1] for x in by.values())
    if not accepted or not rejected:
        return -math.inf
    best, low, high, a, r = -1.0, -math.inf, -math.inf, 0, 0
    cells = sorted(by)
    for k, at in enumerate(cells):
        a, r = a + by[at][0], r + by[at][1]
        if a <= most_lost * accepted and (value := r / rejected + 1 - a / accepted) > best + 1e-12:
            # Halfway to the next score, as no URL lies between.
            best, low, high = value, (at + 1) / 100, (cells[k + 1] / 100 if k + 1 < len(cells) else (at + 1) / 100)
    return (low + high) / 2


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, seeds=SEEDS, order: int = 4, least_share: float = 1e-5, most_lost: float = 0.01) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (allow or block), and score (positive: more like accepted URLs)."""
    spark = pages.sparkSession
    source = pick(pages, page_id=page_id, url=url)
    host, path = parts(F.col("url"))
    rows = source.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rejected": seeded(F.col("host"), seeds).cast("int"), "apart": for_threshold(F.col("host"))})
    # Written once: a row's number must stay the same.
    rows = materialize(rows, "urls-rows").withColumn("u", F.concat("host", "path"))
    entries = F.broadcast(learn(rows.filter(~F.col("apart")), order=order, least_share=least_share).frame(spark))
    sums = _strings(rows, order, ["rid"]).join(entries, "s").groupBy("rid").agg(F.sum(F.col("always") + F.col("follows") * F.col("more")).alias("sum"))
    scored = rows.join(sums.hint("merge"), "rid", "left").select("page_id", "host", "path", "rejected", "apart", (F.coalesce("sum", F.lit(0.0)) / F.greatest(F.lit(1), F.length("u"))).alias("score"))
    scored = materialize(scored, "urls-scored")
    least = _threshold(scored, most_lost)
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") < (least if math.isfinite(least) else -1e300), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
