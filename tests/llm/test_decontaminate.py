import random
import re

import pytest

from millrace.llm import decontaminate

from .cases import TEXTS, documents, empty

ITEMS = "item_id BIGINT, text STRING"


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(str(i if i is not None else ""))
    out = []
    for d, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in wins:
                    hit |= set(range(j, j + n))
                    ids |= wins[x]
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def found(docs, items, **options):
    from pyspark.sql import functions as F

    out = decontaminate.annotate(docs, items, keep=["doc_id"], **options).select("doc_id", F.col("hits.n_words"), decontaminate.n_hit().alias("h"), F.col("hits.items"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("index_bytes", [16 << 20, 300])
def test_against_brute_force(spark, index_bytes):
    rng = random.Random(8)
    word = lambda: rng.choice(("a", "b", "c", "d1", "É"))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 5, 14, 20))))) for i in range(3, 15)] + [(15, None), (16, "..."), (17, "b " * 13)]
    docs = TEXTS + [(100 + i, ", ".join([word() for _ in range(20)] + items[i % 12][1].split(" ") + [word() for _ in range(9)])) for i in range(60)]
    assert found(documents(spark, docs), spark.createDataFrame(items, ITEMS), index_bytes=index_bytes) == brute(docs, items)


def test_only_contaminated_documents_go(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], ITEMS)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = documents(spark, [(1, "x " + text), (2, text + " y" * 400), (3, "one two three"), (4, None)])
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [2, 3, 4]
    assert decontaminate.decontaminate(empty(spark), items).columns == docs.columns
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 4
    # The same by joins of tables.
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items, index_bytes=0).collect()) == [2, 3, 4]
    assert decontaminate.decontaminate(docs, items, index_bytes=0).columns == docs.columns
    assert decontaminate.decontaminate(empty(spark), items, index_bytes=0).count() == 0


def test_both_ways_agree_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/benchmark.parquet")
    assert found(docs, items) == found(docs, items, index_bytes=0)
