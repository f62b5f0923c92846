import collections
import math
import time

from pyspark.sql import functions as F

from millrace.llm import urls

DDL = "page_id BIGINT, url STRING"


def test_parts_and_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net"), (3, "x://example.net/"), (4, None), (5, "no scheme/net/"), (6, "http://notexample.com/de/1"), (7, "http://m.example.com/de/1"), (8, "http://org/fr/"), (9, "http://a.org/frx"), (10, "http://h?a://b/c")]
    df = spark.createDataFrame(rows, DDL).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(df).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("example.net", "", None), 3: ("example.net", "/", "net/"), 4: ("", "", None), 5: ("", "", None), 6: ("notexample.com", "/de/1", None), 7: ("m.example.com", "/de/1", "example.com/de/"), 8: ("org", "/fr/", "org/fr/"), 9: ("a.org", "/frx", None), 10: ("h", "", None)}


def brute(train, urls_to_score, order=4, share=1e-5):
    """Score of each URL from the definition: characters one by one, interpolated from the longest kept context down."""
    counts = [collections.Counter(), collections.Counter()]
    for u, rejected in train:
        for k in range(1, order + 2):
            for i in range(len(u) - k + 1):
                counts[rejected][u[i : i + k]] += 1
    least = [max(2, math.ceil(share * sum(len(u) for u, r in train if r == c))) for c in (0, 1)]
    kept = {s for s in counts[0] | counts[1] if counts[0][s] >= least[0] or counts[1][s] >= least[1]}
    alphabet = max(2, sum(len(s) == 1 for s in kept))

    def p(c, context, x):
        """An unknown character is as likely in both models."""
        after = [s for s in kept if len(s) == len(context) + 1 and s.startswith(context)]
        lower = (1 / (alphabet + 1) if x in kept else 1.0) if not context else p(c, context[1:], x)
        if not after or not context and x not in kept:
            return lower
        n, kinds = sum(counts[c][s] for s in after), max(1, sum(counts[c][s] > 0 for s in after))
        return ((counts[c][context + x] if context + x in kept else 0) + kinds * lower) / (n + kinds)

    return [sum(math.log(p(0, u[max(0, i - order) : i], x)) - math.log(p(1, u[max(0, i - order) : i], x)) for i, x in enumerate(u)) / max(1, len(u)) for u in urls_to_score]


def test_scores_against_brute_force(spark):
    rows = [(i, f"http://{('free-bets', 'news', 'spam.farm')[i % 3]}{i % 5}.example.{('com', 'org')[i % 2]}/en/{i * 37 % 11}") for i in range(40)] + [(50, None), (51, "x://"), (52, "http://né.日/𝒳?q")]
    df = spark.createDataFrame(rows, DDL)
    got = {r["page_id"]: (r["host"], r["path"], r["score"]) for r in urls.judge(df, order=2).collect()}
    labels = {r["host"]: (r["rejected"], r["apart"]) for r in spark.createDataFrame(sorted({(h,) for h, _, _ in got.values()}), "host STRING").select("host", urls.seeded(F.col("host")).cast("int").alias("rejected"), urls.for_threshold(F.col("host")).alias("apart")).collect()}
    assert labels["free-bets1.example.org"][0] == 0 and labels["spam.farm2.example.com"][0] == 1
    train = [(h + p, labels[h][0]) for h, p, _ in got.values() if not labels[h][1]]
    want = brute(train, [h + p for h, p, _ in got.values()], 2)
    assert all(abs(w - s) < 1e-9 for w, (_, _, s) in zip(want, got.values(), strict=True))


def test_labels_are_whole_names(spark):
    hosts = ["ads.example.com", "a.free-bets.org", "downloads.example.com", "alphabets.org", "uploads_x.net", None, ""]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "host STRING").select(F.coalesce(urls.seeded(F.col("host")), F.lit(False))).collect()]
    assert got == [True, True, False, False, False, False, False]


def test_rejected_hosts_that_the_models_did_not_see(spark):
    rows = [(i, f"http://{('www', 'm', 'blog', 'shop')[i // 7 % 4]}{i % 29}.{('cheap-pills', 'daily-news', 'casino-win', 'old-books')[i % 4]}.example.com/en/{i}") for i in range(1200)]
    df = urls.judge(spark.createDataFrame(rows, DDL)).withColumn("apart", urls.for_threshold(F.col("host")))
    got = df.filter("apart").collect()
    right = [(r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in got if r["rule"] is None]
    assert len(right) > 100 and sum(right) >= 0.95 * len(right)


def test_long_urls_take_linear_time(spark):
    began = time.time()
    rows = [(1, "http://casino.example.com/" + "abcdefghij" * 100_000), (2, "http://news.example.org/"), (3, "http://ads.example.com/"), (4, "http://n.example.org/")]
    assert urls.judge(spark.createDataFrame(rows, DDL)).count() == 4
    assert time.time() - began < 90


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], DDL)).count() == 0
    assert urls.judge(spark.createDataFrame([(1, None), (1, None)], DDL)).count() == 2


def test_a_rare_class_keeps_its_own_contexts(spark):
    rows = spark.createDataFrame([("abcdefghij", 0)] * 1000 + [("zzqq", 1)] * 3, "u STRING, rejected INT")
    assert {"zq", "zzqq"} <= {s for s, _, _ in urls.learn(rows, least_share=0.01).entries}
