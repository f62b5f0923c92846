from pyspark.sql import functions as F

from millrace.llm import toxicity

from .cases import documents, empty


def test_folding():
    assert toxicity.fold("You 1D10T, ѕtuріd! $cum*** 1300") == " you idiot stupid scum 1300 "
    assert toxicity.fold("ｓｔｕｐｉｄ 𝐢𝐝𝐢𝐨𝐭 sc\u200bum s\u0336t\u0336u\u0336p\u0336id été") == " stupid idiot scum stupid été "
    assert toxicity.fold("") == "  "


def test_of_a_repeated_id_one_row_is_learned_from(spark):
    df = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id BIGINT, toxic INT").filter(~toxicity.held_out())
    rows = toxicity.sample(df, labels, doc_id="doc_id", text="text", label="toxic", max_rows=10)
    assert rows.count() == labels.filter("doc_id < 3").count()


def test_exceptions_do_not_count():
    lexicon = toxicity.Lexicon({" clown": 4.0}, frozenset({"clown fish"}), 1.0, 0.0, -2.0)
    matcher = lexicon.matcher()
    assert lexicon.features(matcher, "a clown fish swims")[0] == 0
    assert lexicon.features(matcher, "such a clown")[0] > 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out())
    r = scored.agg(F.sum(((F.col("score") >= 0.7) & (F.col("toxic") == 1)).cast("int")), F.sum(((F.col("score") >= 0.7) & (F.col("toxic") == 0)).cast("int")), F.sum("toxic")).first()
    assert r[0] >= 0.7 * r[2]
    assert r[1] <= 2


def test_cases(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (3, None, None), (None, 1, 1), (6, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    lexicon = toxicity.learn(documents(spark), labels)
    out = toxicity.score(documents(spark), lexicon).collect()
    assert len(out) == 10
    assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.reject(documents(spark), lexicon).columns == documents(spark).columns
    assert toxicity.score(empty(spark), toxicity.learn(empty(spark), labels.limit(0))).count() == 0


def test_copies_of_one_toxic_text_do_not_hide_rare_terms(spark):
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(600)]
    own = lambda i: " ".join(filler[(i * 37 + k * (i % 17 + 1)) % 600] for k in range(30))
    texts = [(f"{own(i)} {'grubnik' if i % 50 == 0 else 'vilesort'} {own(i + 7)}", 1) for i in range(600)]
    texts += [("copied insult everywhere " * 5, 1)] * 3000 + [(own(i + 1000), 0) for i in range(1500)]
    rows = [(i, text, toxic) for i, (text, toxic) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    lexicon = toxicity.learn(df, df.select("doc_id", "toxic"))
    assert any(t.strip() and "grubnik".startswith(t.strip()) for t in lexicon.weights)


def test_families_are_of_near_copies_only():
    words = [f"word{i}" for i in range(300)]
    assert toxicity._family(words) == toxicity._family([*words, "more"]) or toxicity._family(words) == toxicity._family(["more", *words])
    assert len({toxicity._family([*words[i:], "a", *words[:i]]) for i in range(0, 300, 50)}) < 6
    assert len({toxicity._family([words[(i * k) % 300] for k in range(200)]) for i in (1, 7, 11, 13)}) == 4


def test_matching_against_brute_force():
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(200):
        weights = {rng.choice((f" {word()}", f" {word()} ")): rng.uniform(1, 9) for _ in range(8)}
        lexicon = toxicity.Lexicon(weights, frozenset(rng.choice((word(), f"{word()} {word()}")) for _ in range(4)))
        folded = toxicity.fold(" ".join(word() for _ in range(rng.randint(0, 30))))
        words = folded.split()
        want, at = {}, 0
        for i, w in enumerate(words):
            fitting = [v for t, v in weights.items() if (w == t.strip() if t.endswith(" ") else w.startswith(t[1:]))]
            around = {w, " ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}
            if fitting and not around & lexicon.exceptions:
                want[at] = max(fitting)
            at += len(w) + 1
        assert dict(lexicon.hits(lexicon.matcher(), folded)) == want
