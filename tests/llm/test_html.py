import time

from millrace.llm import html

FIELD = html.learn()


def test_labels_of_pages_not_trained_on():
    pages = html.training_pages(100, seed=1234)
    right = total = 0
    for page in pages:
        labels = FIELD.viterbi([sum(FIELD.weights.get(f, 0.0) for f in found) for found, _ in page])
        right += sum(a == b for a, (_, b) in zip(labels, page, strict=True))
        total += len(page)
    assert right >= 0.99 * total


def test_a_page():
    page = """<html><head><title>T</title><script>var x = "</p><p>no";</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>
    <div class="cookie">We use cookies.</div><article><h1>Title &amp; more</h1><p>First   line<br>goes on.</p><!-- <p>no</p> --><p><b>Second</b>&nbsp;line &lt;3 &#x41;</p></article>
    <div id="comments"><p>Reader says no.</p></div><footer>&copy; us</footer>"""
    assert FIELD.extract(page) == "Title & more\nFirst line goes on.\nSecond line <3 A"


def test_viterbi_against_all_paths():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(50):
        scores = [rng.uniform(-2, 2) for _ in range(6)]
        field = html.Field({}, [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
        value = lambda path: sum(s for s, y in zip(scores, path, strict=True) if y) + sum(field.pair[a][b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert value(field.viterbi(scores)) >= max(map(value, itertools.product((0, 1), repeat=6))) - 1e-9


def test_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "just text"), (3, "u", "just text"), (None, "u", "<p>unclosed <b>x"), (5, "u", "<article><p>" + "long. " * 30000 + "</p></article>"), (6, "u", "<p>a &am")]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = html.extract(df, FIELD).collect()
    assert len(out) == 7
    assert next(r for r in out if r["page_id"] == 5)["n_chars"] == len(("long. " * 30000).strip())
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.extract(df.limit(0), FIELD).count() == 0


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<" * 100_000, '<p a="' * 30_000, "<!--" * 30_000, "<script>" * 20_000, "</div>" * 50_000, "&amp" * 50_000):
        FIELD.extract(page)
    assert time.time() - began < 60
