"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked at 0.9 on three-word shingles.  Without words: size 0, a class of its own; a null id names no class that has another."""
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", F.col("n_shingles"), "component_id", "n_links")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data.  Null and empty texts have none."""
    from . import pii

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(documents, pii.learn(documents))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts.  Empty texts score as texts without hits; rows without a label are never learned from."""
    from . import toxicity

    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, lexicon).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all texts' ids and of what they decode to.  Null and empty texts are the end alone."""
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents.  Null texts have no words; items of equal text each count."""
    from . import decontaminate as d

    hits = d.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select("doc_id", F.col("hits.n_words").alias("n_words"), d.n_hit().alias("n_hit"), F.size("hits.items").cast("bigint").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), d.contaminated().alias("contaminated"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all URLs.  Null URLs and those without :// have empty host and path."""
    from . import urls

    return urls.judge(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations and what is read back.  Null texts and roles are empty; rows of one turn go by role, then text; rows with a null conv_id are one conversation."""
    from . import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L AS conv_id, t AS turn, IF(t = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L), (1L) AS v(t)")
    out = chat.render(chat.canonical(rows.union(extra), "conv_id"))
    read = out.withColumns({"turns": chat.parse(F.col("formatted")), "learned": chat.masked(F.col("formatted"), F.col("loss"))})
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages.  Null and empty pages have the empty text."""
    from . import html

    return html.extract(table(spark, sf_dir, "pages"), html.learn())


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as 8-bit samples in archives and described from what is read back.  Null and empty texts: one block of zeros; repeated rows are members of their own."""
    from . import media

    return media.round_trip(table(spark, sf_dir, "documents")).withColumn("id", F.col("id").cast("bigint")).withColumnRenamed("id", "doc_id")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts.  Null and empty texts are one end; rows with a null id are training rows."""
    from . import suffix_tree

    return suffix_tree.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media, op2_jaccard, op3_chat, op4_pii, op5_suffix_tree, op6_toxicity, op7_html, op8_sentencepiece, op9_decontamination, op10_urls)}

_ESCAPED = "replace({x}, '␛', '␛0')"
for _i, _control in enumerate(("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"), 1):
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '␛{_i}')"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_BLANK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# The tables' pages mark their main text as the article element; blocks end at h1, p and br.
_ARTICLE = "regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1)"
_BLOCKS = f"list_transform(regexp_split_to_array({_ARTICLE}, '</?(?:h1|p|br)>'), lambda b: trim(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))"
for _name, _character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    # Without its semicolon such a reference is one too.
    _BLOCKS = f"list_transform({_BLOCKS}, lambda b: regexp_replace(b, '&{_name};?', '{_character}', 'g'))"

_REST = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_SEEDS = "['spam', 'casino', 'pills', 'bets', 'ads', 'adult', 'porn', 'viagra', 'betting', 'lottery', 'warez']"
# Shares of strings of k characters in both classes: interpolated with those of the string without its first character.
_SHARES = ", ".join(
    f"""s{k} AS (
        SELECT c.s, c.a, c.r, (c.a + t.ka * {"x.base" if k == 1 else "b.pa"}) / (t.na + t.ka) AS pa, (c.r + t.kr * {"x.base" if k == 1 else "b.pr"}) / (t.nr + t.kr) AS pr,
               t.na, t.nr, t.ka, t.kr{"" if k == 1 else ", b.pa AS ba, b.pr AS br"}
        FROM kept c JOIN after t ON t.s = substr(c.s, 1, {k - 1}) {"CROSS JOIN (SELECT 1.0e0 / (greatest(2, count(*)) + 1) AS base FROM kept WHERE length(s) = 1) x" if k == 1 else f"JOIN s{k - 1} b ON b.s = substr(c.s, 2)"} WHERE length(c.s) = {k})"""
    for k in range(1, 6)
)
_ADDED = " UNION ALL ".join("SELECT s, ln(pa) - ln(pr)" + ("" if k == 1 else " - (ln(ba) - ln(br)) - (ln(ka / (na + ka)) - ln(kr / (nr + kr)))") + f" AS always FROM s{k}" for k in range(1, 6))

SQL: dict[str, str] = {
    "op10_urls": f"""
        WITH p AS (SELECT row_number() OVER () AS rid, page_id, {_REST} AS rest FROM pages),
        h AS (SELECT rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        u AS (SELECT *, host || path AS u, CASE WHEN list_has_any(regexp_split_to_array(host, '[._-]'), {_SEEDS}) THEN 1 ELSE 0 END AS rejected, md5(host)[1] IN ('0', '1', '2') AS apart FROM h),
        places AS (SELECT rid, rejected, apart, substr(u, i, k) AS s, i + k <= length(u) AS more FROM (SELECT *, unnest(range(1, length(u) - k + 2)) AS i FROM u, range(1, 6) AS r(k) WHERE length(u) >= k)),
        size AS (SELECT greatest(2, ceil(1e-5 * coalesce(sum(length(u)) FILTER (WHERE rejected = 0), 0))) AS a, greatest(2, ceil(1e-5 * coalesce(sum(length(u)) FILTER (WHERE rejected = 1), 0))) AS r FROM u WHERE NOT apart),
        kept AS (SELECT s, CAST(sum(1 - rejected) AS DOUBLE) AS a, CAST(sum(rejected) AS DOUBLE) AS r FROM places WHERE NOT apart GROUP BY s HAVING sum(1 - rejected) >= (SELECT a FROM size) OR sum(rejected) >= (SELECT r FROM size)),
        after AS (SELECT substr(s, 1, length(s) - 1) AS s, sum(a) AS na, sum(r) AS nr, greatest(1, count(*) FILTER (WHERE a > 0)) AS ka, greatest(1, count(*) FILTER (WHERE r > 0)) AS kr FROM kept GROUP BY 1),
        {_SHARES},
        added AS ({_ADDED}),
        entries AS (SELECT added.s, always, CASE WHEN length(added.s) <= 4 AND after.s IS NOT NULL THEN ln(ka / (na + ka)) - ln(kr / (nr + kr)) ELSE 0 END AS follows FROM added LEFT JOIN after USING (s)),
        sums AS (SELECT rid, sum(always + CASE WHEN more THEN follows ELSE 0 END) AS x FROM places JOIN entries USING (s) GROUP BY rid),
        scored AS (SELECT u.*, coalesce(x, 0) / greatest(1, length(u)) AS score FROM u LEFT JOIN sums USING (rid)),
        cells AS (SELECT CAST(floor(score * 100) AS INTEGER) AS cell, sum(1 - rejected) AS a, sum(rejected) AS r FROM scored WHERE apart OR (SELECT count(DISTINCT rejected) < 2 FROM u WHERE apart) GROUP BY 1),
        steps AS (SELECT cell, lead(cell) OVER (ORDER BY cell) AS next, (sum(r) OVER (ORDER BY cell)) / (sum(r) OVER ()) + 1 - (sum(a) OVER (ORDER BY cell)) / (sum(a) OVER ()) AS value
                  FROM cells QUALIFY (sum(a) OVER (ORDER BY cell)) <= 0.01 * (sum(a) OVER ())),
        best AS (SELECT ((cell + 1) / 100 + coalesce(next / 100, (cell + 1) / 100)) / 2 AS least FROM steps WHERE value > (SELECT max(value) FROM steps) - 1e-12 ORDER BY cell LIMIT 1),
        rules AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) AS t(own, start, name, verdict)),
        fit AS (SELECT rid, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict FROM u JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY rid)
        SELECT page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN score < (SELECT least FROM best) THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score FROM scored LEFT JOIN fit USING (rid)""",
    "op2_jaccard": f"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_BLANK_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT r, sh FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS sh FROM w)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY 1, 2),
        one AS (SELECT x, y FROM pairs JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        links AS (SELECT x, y FROM one UNION ALL SELECT y, x FROM one),
        reach AS (SELECT r, r AS t FROM w UNION SELECT reach.r, y FROM reach JOIN links ON x = t),
        component AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN w ON w.r = t GROUP BY reach.r)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, (SELECT count(*) FROM links WHERE x = w.r) AS n_links
        FROM w JOIN component USING (r) LEFT JOIN n USING (r)""",
    "op7_html": f"""
        SELECT page_id, url, text, length(text) AS n_chars
        FROM (SELECT page_id, url, array_to_string(list_filter({_BLOCKS}, lambda b: b <> ''), chr(10)) AS text FROM pages)""",
    "op3_chat": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                   string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text) AS learned,
                   CAST(sum(22 + length({_ESCAPED.format(x='role')}) + length({_ESCAPED.format(x='text')})) AS BIGINT) AS formatted_chars
            FROM turns GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM whole""",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        wins AS (
            SELECT DISTINCT item_id, l, array_to_string(w[j + 1 : j + l], ' ') AS win
            FROM (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS j FROM (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0))),
        places AS (
            SELECT doc_id, l, j, array_to_string(w[j + 1 : j + l], ' ') AS win
            FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS j FROM d, (SELECT DISTINCT l FROM wins) WHERE len(w) >= l)),
        hits AS (SELECT doc_id, item_id, l, j FROM places JOIN wins USING (l, win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + l)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
