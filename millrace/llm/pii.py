"""Personal data: candidate gradient boosting, with DataFrame functions only.

Base spans are those of four fixed patterns with a check each.  High-recall
generators propose further spans, which may overlap: long runs of letters and
digits with dots or hyphens (secrets), card-like numbers, groups of digits as in
national phone numbers, and account numbers in the form of an IBAN.
Boosted trees score them by format and context features, all of few values, so
the training data is one table of feature combinations with their counts over
all documents: never more than FEATURE_BOUND rows.  The trees are fitted to that
table on the driver, written as one SQL expression, and applied where the
candidates are.  A kind's threshold is the lowest score from which the
candidates have the wanted precision against their weak labels.

Weak labels, none of which is a feature: a candidate is positive if a cue of its
kind (`token =`, `card`, `tel`, ...) stands just before it, a card-like one also if
it passes Luhn's check, a phone-like one also if it belongs to a number with a
plus, an account number if its check digits are right.  The trees see format and the
kind of character before the candidate, and so carry labels over to candidates
without any.  A card- or phone-like candidate with a cue and an account number with
right check digits are spans by that rule; the trees decide the others, and all
secrets.  A cue shows that a secret or phone number is one, but not every one has a
cue: the share of cues that the trees expect, on the average of the candidates with
one, is what true ones have, and the precision of these two kinds is counted in that
unit, if it is a fifth at least.

Positions are code points, ends exclusive.  Patterns never try a run from
within, so that their time is linear in the text.

Defined results: null and empty texts have no spans; equal rows have equal spans;
other columns do not matter.  Without positive labels no span is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import free, pick

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "card_like", "phone_like", "iban")
#: Kinds whose labels are cues, which true ones may lack.
BY_CUE = ("secret", "phone_like")
LEAST_CUED = 0.2
KINDS = BASE + ADDED
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The patterns of the four kinds, written so that each run of characters is tried from its start or from the end of the match before.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_][A-Za-z0-9_.-]{19,}+",
    "card_like": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone_like": r"(?<![0-9+.,/-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}+(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: A cheap condition that every text with a match fulfils.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_.-]{20}"),
    "card_like": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone_like": lambda t: t.rlike(r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}
_CUES = {
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key)\s*[=:]\s*[\"']?$",
    "card_like": r"(?i)(?:card|visa|karte|carte|tarjeta|iban|account)\W{0,4}$",
    "phone_like": r"(?i)(?:tel|phone|fax|mobile|call|telefon|t[ée]l[ée]phone)\W{0,4}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta)\W{0,4}$",
}
_CONTEXT = 24


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def right_check_digits(s: Column) -> Column:
    """Whether an account number leaves 1 by 97, its first four characters put last and letters read as 10 to 35."""
    plain = F.replace(s, F.lit(" "))
    moved = F.split(F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4)), "")

    def add(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (total * 100 + code - 55) % 97).otherwise((total * 10 + code - 48) % 97)

    return F.aggregate(moved, F.lit(0), add) == 1


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _valid(kind: str, s: Column) -> Column:
    d = _digits(s)
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "card_like":
        return F.length(d).between(13, 19)
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "phone_like":
        return F.length(d).between(8, 12)
    if kind == "secret":
        return F.length(s) >= 20
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "))).between(15, 34)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """array<struct<start,end,s>> of the leftmost matches that do not overlap and pass the kind's check.

    Places come from the pieces between the matches: both functions walk the text in the same way.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda s, gap: F.struct(s.alias("s"), F.length(gap).alias("gap"), F.length(s).alias("n")))
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["s"].alias("s")))).alias("out"))

    placed = F.aggregate(F.filter(pairs, lambda x: x["s"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), place)["out"]
    if kind == "secret":
        # Dots and hyphens at the end are the text's.
        trimmed = lambda m: F.regexp_replace(m["s"], r"[.-]++$", "")
        placed = F.transform(placed, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(trimmed(m))).alias("end"), trimmed(m).alias("s")))
    return F.when(_HINTS[kind](text), F.filter(placed, lambda m: _valid(kind, m["s"]))).otherwise(empty)


# ---- features: each has few values, so that combinations can be counted

FEATURES = {"kind": len(ADDED), "size": 8, "digits": 6, "letters": 3, "turns": 6, "quoted": 2, "marks": 5, "near": 4}
FEATURE_BOUND = math.prod(FEATURES.values()) * 2


def _features(kind: str, m: Column, text: Column) -> Column:
    s = m["s"]
    n = F.length(s)
    before = F.substring(text, F.greatest(F.lit(1), m["start"] - _CONTEXT + 1), F.least(F.lit(_CONTEXT), m["start"]))
    digits = F.length(_digits(s))
    cue = before.rlike(_CUES[kind])
    upper, lower = s.rlike("[A-Z]"), s.rlike("[a-z]")
    label = cue
    if kind == "card_like":
        label = cue | luhn(_digits(s))
    elif kind == "phone_like":
        label = cue | before.rlike(r"\+[0-9][\x20().0-9-]*$")
        # What is before a number with a plus, not the plus, is its context.
        before = F.regexp_replace(before, r"\+[0-9][\x20().0-9-]*$", "")
    elif kind == "iban":
        label = right_check_digits(s)
        cue = label
    # The context is what stands before the cue, so that it does not tell of it.
    before = F.regexp_replace(before, _CUES[kind], "")
    marks = F.array_distinct(F.filter(F.split(F.regexp_replace(s, "[0-9()]", ""), ""), lambda c: c != ""))
    first = F.get(marks, F.lit(0))
    # From digits to letters, or for phone numbers from group to group.
    turns = F.size(F.split(s, r"[^0-9]+" if kind == "phone_like" else "(?<=[0-9])(?=[A-Za-z])")) - 1
    return F.struct(
        F.lit(ADDED.index(kind)).alias("kind"),
        F.least(F.lit(7), digits - 6 if kind == "phone_like" else F.floor(n / 8)).cast("int").alias("size"),
        # Of phone numbers the lengths of the last and of the first group, and whether that is in brackets.
        F.least(F.lit(5), F.length(F.regexp_extract(s, "[0-9]+$", 0)) if kind == "phone_like" else F.floor(5 * digits / n)).cast("int").alias("digits"),
        (F.least(F.lit(4), F.length(F.regexp_extract(s, "[0-9]+", 0))) - 2 if kind == "phone_like" else F.when(upper & lower, 2).when(upper | lower, 1).otherwise(0)).alias("letters"),
        F.least(F.lit(5), turns).alias("turns"),
        (s.startswith("(") if kind == "phone_like" else before.rlike("[\"']$")).cast("int").alias("quoted"),
        (F.lit(0) if kind in ("secret", "iban") else F.when(F.size(marks) > 1, 4).when(first == " ", 1).when(first == "-", 2).when(first == ".", 3).otherwise(0)).alias("marks"),
        (F.lit(0) if kind == "secret" else F.when(before.rlike(r"\p{L}\s*$"), 1).when(before.rlike(r"[:=#]\s*$"), 2).when(before.rlike(r"\S\s*$"), 3).otherwise(0)).alias("near"),
        (F.lit(False) if kind == "secret" else cue).alias("cued"),
        label.cast("int").alias("label"),
        m["start"].alias("start"),
        m["end"].alias("end"),
    )


def candidates(text: Column) -> Column:
    """Proposed spans with their features and weak labels."""
    own = lambda kind: F.transform(matches(text, kind), lambda m: _features(kind, m, text))
    return F.concat(*map(own, ADDED))


class Trees:
    """Boosted regression trees of depth two for the logistic loss, on counted feature combinations."""

    def __init__(self, rounds: int = 30, rate: float = 0.4, precision: float = 0.98, cued_precision: float = 0.98, least: int = 20):
        self.rounds, self.rate, self.precision, self.cued_precision, self.least = rounds, rate, precision, cued_precision, least
        self.start = 0.0
        self.trees: list[tuple] = []
        self.thresholds: dict[int, float] = {}

    def fit(self, rows: list[dict]) -> Trees:
        """rows: feature values, pos and neg."""
        pos, neg = sum(r["pos"] for r in rows), sum(r["neg"] for r in rows)
        if not pos:
            return self
        self.start = math.log((pos + 0.5) / (neg + 0.5))
        score = [self.start] * len(rows)
        for _ in range(self.rounds):
            p = [1 / (1 + math.exp(-s)) for s in score]
            grad = [r["pos"] - (r["pos"] + r["neg"]) * q for r, q in zip(rows, p, strict=True)]
            hess = [(r["pos"] + r["neg"]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
            tree = self._grow(rows, grad, hess, list(range(len(rows))), 2)
            self.trees.append(tree)
            for i, r in enumerate(rows):
                score[i] += self._value(tree, r)
        for kind, name in enumerate(ADDED):
            ranked = sorted(((s, r["pos"], r["pos"] + r["neg"]) for s, r in zip(score, rows, strict=True) if r["kind"] == kind), reverse=True)
            # (score, positive, all) from the highest score down to each.
            steps, n, good = [], 0, 0
            for k, (s, a, b) in enumerate(ranked):
                n, good = n + b, good + a
                if k + 1 == len(ranked) or ranked[k + 1][0] < s:
                    steps.append((s, good, n))
            # What share of cues the trees expect of a candidate with a cue.
            sure = sum(a / (1 + math.exp(-s)) for s, a, _ in ranked) / max(1, good)
            unit = self.precision if name not in BY_CUE else self.cued_precision * sure if sure >= LEAST_CUED else math.inf
            for s, good, n in steps:
                if n >= self.least and good >= unit * n:
                    self.thresholds[kind] = s
        return self

    def _grow(self, rows, grad, hess, at, depth):
        g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
        leaf = ("leaf", self.rate * g / (h + 1))
        if not depth:
            return leaf
        best, choice = 1e-6, None
        for name in FEATURES:
            for cut in sorted({rows[i][name] for i in at})[1:]:
                left = [i for i in at if rows[i][name] < cut]
                gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best:
                    best, choice = gain, (name, cut)
        if choice is None:
            return leaf
        name, cut = choice
        return (name, cut, self._grow(rows, grad, hess, [i for i in at if rows[i][name] < cut], depth - 1), self._grow(rows, grad, hess, [i for i in at if rows[i][name] >= cut], depth - 1))

    def _value(self, tree, row) -> float:
        while tree[0] != "leaf":
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree[1]

    def accept(self, x: Column) -> Column:
        """The trees as one expression over a candidate."""

        def written(tree) -> Column:
            return F.lit(tree[1]) if tree[0] == "leaf" else F.when(x[tree[0]] < tree[1], written(tree[2])).otherwise(written(tree[3]))

        score = F.lit(self.start)
        for tree in self.trees:
            score = score + written(tree)
        out = x["cued"]
        for kind, least in self.thresholds.items():
            out = out | ((x["kind"] == kind) & (score >= least - 1e-9))
        return out


def learn(documents: DataFrame, *, text: str = "text", **options) -> Trees:
    """Trees fitted to the counts of feature combinations over all documents."""
    x = pick(documents, text=text).select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("x"))
    counts = x.groupBy(*(F.col(f"x.{name}").alias(name) for name in FEATURES)).agg(F.sum("x.label").alias("pos"), F.sum(1 - F.col("x.label")).alias("neg"))
    return Trees(**options).fit([r.asDict() for r in counts.orderBy(*FEATURES).collect()])


def base_spans(text: Column) -> Column:
    """Spans of the four kinds: by kind, then start."""
    own = lambda kind: F.transform(matches(text, kind), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return F.concat(*map(own, BASE))


def added_spans(text: Column, base: Column, trees: Trees) -> Column:
    """Accepted candidates that overlap no base span: by kind, then start."""
    kinds = F.array(*map(F.lit, ADDED))
    chosen = F.filter(candidates(text), lambda x: trees.accept(x) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.transform(chosen, lambda x: F.struct(F.element_at(kinds, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def with_spans(documents: DataFrame, trees: Trees, *, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """The documents with two more columns, SPANS each: the base spans, and all of them (the base ones first, by kind and start)."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = documents.withColumn(base, base_spans(value))
    return out.withColumn(spans, F.concat(base, added_spans(value, F.col(base), trees)))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, trees: Trees, *, text: str = "text") -> DataFrame:
    """The documents with all their columns; spans in the text, overlapping ones together, become [KIND] of the first."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base, spans = free(documents, "base", "spans")
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(value, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(value, acc["at"] + 1, F.length(value))))
    out = with_spans(documents, trees, text=text, base=base, spans=spans)
    replaced = F.when(F.size(spans) > 0, done).otherwise(F.col(f"`{text}`"))
    return out.select(*(replaced.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns))
