import random
import re

import pytest

from millrace.llm import jaccard
from millrace.llm.components import components

from .cases import TEXTS, documents, empty


def brute(rows, k, num, den):
    """[(n, component id, links)] in the order of the rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((own, len(sets[i]), min(ids) if ids else own, links[i]))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in jaccard.join(df, **options).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=repr)


def copies(seed, n=150):
    """Families of near copies of several sizes and strengths, with shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    passage = [word() for _ in range(15)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice((3, 12, 40, 120)))]
        for _ in range(rng.choice((1, 1, 3, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 5)) * len(w) // 40 + rng.randint(0, 1)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at:at] = passage
            out.append((len(out), " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, num):
    rows = copies(k)
    assert found(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), k=k, num=num, den=100) == brute(rows, k, num, 100)


def test_blocks_lose_no_link(spark):
    rows = copies(9, 80)
    assert found(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), k=3, num=80, den=100, block_shingles=200) == brute(rows, 3, 80, 100)


def test_cases(spark):
    assert found(documents(spark), k=3, num=90, den=100) == brute(TEXTS, 3, 90, 100)
    assert found(empty(spark)) == []


def test_keep_one(spark):
    kept = jaccard.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 2, 3, 4, 6, 7, 8]
    assert jaccard.keep_one(empty(spark)).count() == 0


def test_similar_sets_always_share_a_list():
    import numpy as np

    rng = np.random.default_rng(1)
    for num in (80, 90):
        levels = jaccard.Levels(num, 100)
        for _ in range(400):
            n = int(rng.integers(5, 400))
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(rng.integers(0, max(1, n // 6)))
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, gone // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= num * (len(x) + len(y) - both) and both < max(len(x), len(y)):
                for common in (x[:0], x[::7], x[: len(x) // 2], x):
                    (a, p), (b, q) = levels.signatures(x, common), levels.signatures(y, common)
                    _, i, j = np.intersect1d(a, b, return_indices=True)
                    assert (np.bitwise_count(p[i] ^ q[j]) < levels.reach).any()


def test_long_lists_are_closed():
    """Entries of one list: components of the pairs whose parities differ in fewer bits, whatever the length of the list."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (2, 20, 33, 400):
        parity = (rng.integers(0, 6, n).astype(np.uint32) * np.uint32(0x01234567)) ^ (np.uint32(1) << rng.integers(0, 32, n).astype(np.uint32))
        got, want = jaccard._Sets(), jaccard._Sets()
        jaccard._close(np.zeros(n, np.uint64), parity, np.arange(n), 3, got)
        for i in range(n):
            for j in range(i):
                if bin(int(parity[i] ^ parity[j])).count("1") < 3:
                    want.join(i, j)
        assert [got.root(i) for i in range(n)] == [want.root(i) for i in range(n)]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, "a"), (None, "", "b"), (None, " ", "c"), (None, " ", "d"), (3, "", "e"), (3, "", "e"), (4, "some words that are copied", "f"), (4, "some words that are copied", "f")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    assert sorted(r["lang"] for r in jaccard.keep_one(df).collect()) == ["a", "b", "c", "d", "e", "e", "f"]
