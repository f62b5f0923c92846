import random
import re

from pyspark.sql import functions as F

from millrace.llm import pii

from .cases import documents, empty

# The base patterns as they are defined.
DEFINED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(kind, m.start(), m.end()) for kind, p in DEFINED.items() for m in re.finditer(p, text or "") if valid(kind, m[0])]


def test_base_spans_against_the_definition(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "-", "+", "1.2.3.4", "255.0.0.256", "00255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (206) 555-0100", "x", "é", "𝒳", " ", "7", "_", "a.b+c@d-e.f.g", "\n", "(", ")"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    for r in df.select("text", pii.base_spans(F.col("text")).alias("x")).collect():
        assert [tuple(s) for s in r["x"]] == brute(r["text"])


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "a@b" + ".c" * 150_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    assert df.select(F.size(pii.base_spans(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] >= 1


def test_trees_add_secrets_with_a_cue_and_leave_words(spark):
    rng = random.Random(3)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'the token = "{secret()}" here') for i in range(60)] + [(100 + i, "plain " + "wordwordwordwordwordword" + "abc"[i % 3]) for i in range(60)] + [(200, f"lone {secret()} end")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    trees = pii.learn(df)
    got = {r["doc_id"]: r["x"] for r in pii.with_spans(df, trees, spans="found").select("doc_id", pii.written("found").alias("x")).collect()}
    assert got[0] == "secret:13:53"
    assert not any(got[100 + i] for i in range(60))


def test_redaction_and_cases(spark):
    rows = [(1, "mail a@b.c now, call +1 206 555 0100."), (2, None), (3, ""), (4, "no data"), (4, "no data")]
    df = documents(spark, rows)
    out = pii.redact(df, pii.learn(df))
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"] is not None) == [(1, "mail [EMAIL] now, call [PHONE]."), (3, ""), (4, "no data"), (4, "no data")]
    assert pii.redact(empty(spark), pii.learn(empty(spark))).count() == 0
    assert pii.with_spans(documents(spark), pii.learn(documents(spark))).count() == 10


def test_trees_decide_numbers_without_a_cue(spark):
    rng = random.Random(7)

    def grouped(ok):
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if luhn(d) == ok:
                return "-".join(d[i : i + 4] for i in range(0, 16, 4))

    rows = [(i, f"paid with {grouped(True)} today") for i in range(300)] + [(1000, f"paid with {grouped(False)} today")]
    rows += [(2000 + i, f"item {rng.randrange(10**13, 10**14)} in stock") for i in range(300)]
    rows += [(3000 + i, f"reach us at +1 206-555-{i:04d} now") for i in range(300)] + [(4000, "reach us at 206-555-0199 now"), (4001, "tel: 206 555 0199")]
    df = documents(spark, rows)
    trees = pii.learn(df)
    got = {r["doc_id"]: r["x"] for r in pii.with_spans(df, trees, spans="found").select("doc_id", pii.written("found").alias("x")).collect()}
    assert got[1000] == "card_like:10:29"
    assert got[4000] == "phone_like:12:24"
    assert got[4001] == "phone_like:5:17"
    assert not any("card_like" in got[2000 + i] for i in range(300))


def planted(seed=11):
    """(text, kind, value or None): values of added kinds with and without a cue, and what only looks like them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def secret():
        k = rng.randrange(4)
        if k == 0:
            return "".join(rng.choice("0123456789abcdef") for _ in range(40))
        if k == 1:
            return "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))
        if k == 2:
            return ".".join("".join(rng.choice(chars) for _ in range(n)) for n in (12, 20, 16))
        return "sk_" + "".join(rng.choice(chars) for _ in range(32))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        whole = f"DE{check:02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, 22, 4)) if rng.random() < 0.5 else whole

    phone = lambda: rng.choice(("({:03d}) {:03d}-{:04d}", "0{:02d} {:03d} {:05d}", "{:03d}/{:03d}.{:04d}")).format(rng.randrange(10, 99), rng.randrange(100, 999), rng.randrange(1000, 9999))
    out = []
    for _ in range(240):
        for kind, value, cue in (("secret", secret(), rng.choice(("token = ", "api_key: ", ""))), ("phone_like", phone(), rng.choice(("tel: ", "call ", ""))), ("iban", iban(), rng.choice(("IBAN ", "")))):
            before, after = " ".join(word() for _ in range(rng.randint(3, 20))), " ".join(word() for _ in range(rng.randint(3, 20)))
            out.append((f"{before} {cue}{value} {after}", kind, value))
        looks = rng.choice((f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:15", "-".join(word() for _ in range(9)), f"{rng.randint(10, 99)}/{rng.randint(10, 99)}/{rng.randint(1990, 2030)}", "x" * rng.randint(20, 60), "www.example.com.of.the.list", f"{rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)}"))
        out.append((f"{word()} {looks} {word()} {word()}", None, None))
    return out


def test_recall_of_planted_spans(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id BIGINT, text STRING")
    out = pii.with_spans(df, pii.learn(df), spans="found").select("doc_id", "found").collect()
    hit, wrong = {}, 0
    for r in out:
        text, kind, value = rows[r["doc_id"]]
        own = {text[s["start"] : s["end"]] for s in r["found"]}
        hit.setdefault(kind, []).append(value in own)
        wrong += kind is None and bool(own)
    assert {k: sum(x) / len(x) for k, x in hit.items() if k and sum(x) < 0.9 * len(x)} == {}
    assert wrong <= 0.02 * len(hit[None])


def test_check_digits(spark):
    rows = [("DE89 3704 0044 0532 0130 00", True), ("GB82WEST12345698765432", True), ("DE89370400440532013001", False)]
    df = spark.createDataFrame(rows, "s STRING, ok BOOLEAN").select("ok", pii.right_check_digits(F.col("s")).alias("got"))
    assert all(r["ok"] == r["got"] for r in df.collect())
