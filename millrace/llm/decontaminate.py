"""Benchmark decontamination: prefix-filtered set join of documents with benchmark windows.

A window is `window` consecutive words of an item, or the whole of a shorter
item.  A window that occurs in a document has all its shingles there, so one
shingle is a sufficient prefix: the window's rarest one, by counts over all
documents.  Documents look up only those prefix shingles; a hit gives the
window's only possible place, which must lie inside the document (length and
position bounds) and is then compared word by word.

A benchmark of at most `index_bytes` of text is an index in arrays, about eight
bytes for each byte of text, which goes to the executors: both passes over the
documents are then narrow, and nothing of them is shuffled.  A larger benchmark
stays a table.  Bitmaps of fixed size tell which places of the documents may hold
one of its shingles; those are counted, the windows' prefixes are chosen by a
window function over each item's places, and the places with a prefix, each with
the words around it, are joined to the windows by prefix and compared.  Only
hits of distinct texts are joined back to the documents.

Defined results: null texts have no words and no hits; null benchmark texts
have no windows; ties and repeated rows are treated one by one, and items of
equal text each count.  Empty tables give empty results.  Columns of the
documents other than the named ones are carried along, whatever their names;
`annotate` refuses to name its own column like one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.materialize import discard, materialize
from .arrow import ddl, free, frugal, pick, slices
from .words import ALNUM, Words, mix, words

SHINGLE = 3
HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_BITS = 20
#: Bits of a bitmap of shingles, 16 MB.
_MAP_BITS = 27


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k consecutive words of the whole sequence, row bounds ignored."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(k))
        for j in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + (hashes[j : n + j] ^ (hashes[j : n + j] >> np.uint64(31)))
    return mix(total)


class _Lookup:
    """Sorted keys behind a bitmap of their low bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in values, index of the key) of the values that are keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bitmap[(values & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[k] == values[at]
        return at[same], k[same]


class Windows:
    """Distinct windows of some items, as places in one array of word hashes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(ids)}
        flat, start, length, item, at = [np.zeros(0, np.uint64)], [], [], [], 0
        for first, w in words(pa.array([t for _, t in items], pa.large_string()), ALNUM):
            size = np.diff(w.first)
            n = np.where(size >= window, size - window + 1, np.minimum(size, 1))
            row = np.repeat(np.arange(len(w)), n)
            start.append(at + w.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            length.append(np.minimum(size, window)[row])
            item.append(np.array([number[items[first + i][0]] for i in range(len(w))], np.int64)[row])
            flat.append(w.hashes)
            at += len(w.hashes)
        self.ids, self.flat = ids, np.concatenate(flat)
        start, length, item = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (start, length, item))
        key = np.zeros(len(start), np.uint64)
        for n in np.unique(length).tolist():
            own = length == n
            key[own] = _runs(self.flat, n)[start[own]] ^ np.uint64(n)
        _, one, same = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length = start[one], length[one]
        # Which items have window k: item[cut[k]:cut[k + 1]].
        pairs = np.unique(np.stack([same, item], 1), axis=0) if len(same) else np.zeros((0, 2), np.int64)
        self.item, self.cut = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        self.width = np.minimum(self.length, SHINGLE)
        self.widths = np.unique(self.width).tolist()

    def __len__(self) -> int:
        return len(self.start)

    def items_of(self, k: int) -> list[str]:
        return [self.ids[i] for i in self.item[self.cut[k] : self.cut[k + 1]].tolist()]

    def keys(self, width: int) -> np.ndarray:
        """Shingles of that many words of the items, ends and beginnings of neighbours among them."""
        return np.unique(_runs(self.flat, width))

    def prefix_index(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, _Prefixes]:
        """By shingle width: the windows by their rarest shingle; ties go to the smaller hash, then to the first."""
        out = {}
        for width in self.widths:
            tokens = _runs(self.flat, width)
            known, seen = counts.get(width, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            distinct, at = np.unique(tokens, return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            n[np.searchsorted(distinct, known)] = seen
            rank = np.empty(len(distinct), np.int64)
            rank[np.lexsort((distinct, n))] = np.arange(len(distinct))
            rank = rank[at]
            own = np.flatnonzero(self.width == width)
            offset = np.zeros(len(own), np.int64)
            for a in range(0, len(own), 1 << 16):
                part = own[a : a + (1 << 16)]
                steps = np.arange(self.length[part].max() - width + 1)
                inside = steps <= (self.length[part] - width)[:, None]
                places = np.where(inside, self.start[part][:, None] + steps, 0)
                offset[a : a + len(part)] = np.where(inside, rank[places], len(distinct)).argmin(1)
            out[width] = _Prefixes(tokens[self.start[own] + offset], own, offset)
        return out


class _Prefixes:
    """Windows by prefix shingle: those of lookup.keys[i] are window[cut[i]:cut[i + 1]], each with the shingle's place in it."""

    def __init__(self, tokens: np.ndarray, window: np.ndarray, offset: np.ndarray):
        order = np.argsort(tokens, kind="stable")
        self.lookup = _Lookup(tokens)
        self.window, self.offset = window[order].astype(np.int32), offset[order].astype(np.int32)
        self.cut = np.searchsorted(tokens[order], self.lookup.keys)
        self.cut = np.append(self.cut, len(tokens))

    def candidates(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place where the window would begin, window) for each hit."""
        at, key = self.lookup.find(values)
        n = self.cut[key + 1] - self.cut[key]
        entry = np.repeat(self.cut[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n) - self.offset[entry], self.window[entry].astype(np.int64)


def _count(lookups: dict[int, _Lookup]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {width: np.zeros(len(lookup.keys), np.int64) for width, lookup in lookups.items()}
        for b in batches:
            for _, w in words(b.column(0), ALNUM):
                for width, lookup in lookups.items():
                    _, keys = lookup.find(_runs(w.hashes, width))
                    totals[width] += np.bincount(keys, minlength=len(lookup.keys))
        for width, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(lookups[width].keys[seen].view(np.int64)), pa.array(n[seen])], ["token", "n"])

    return run


def shingle_counts(documents: DataFrame, text: str, keys: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(shingle, occurrences over all documents) of the given shingles, by width; no more rows come back than keys are given."""
    lookups = {width: _Lookup(k) for width, k in keys.items()}
    rows = pick(documents, text=text).mapInArrow(frugal(_count(lookups)), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    out = {}
    for width, k in keys.items():
        own = np.isin(token, k)
        order = np.argsort(token[own])
        out[width] = token[own][order], n[own][order]
    return out


def _occurrences(w: Words, windows: Windows, index: dict[int, _Prefixes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the row, window) of every window that occurs inside one row."""
    found = []
    for width, prefixes in index.items():
        at, k = prefixes.candidates(_runs(w.hashes, width))
        good = (at >= 0) & (at + windows.length[k] <= len(w.hashes))
        at, k = at[good], k[good]
        row = np.searchsorted(w.first, at, "right") - 1
        good = at + windows.length[k] <= w.first[row + 1]
        at, k, row = at[good], k[good], row[good]
        for j in range(int(windows.length[k].max(initial=0))):
            good = (j >= windows.length[k]) | (w.hashes[np.minimum(at + j, len(w.hashes) - 1)] == windows.flat[np.minimum(windows.start[k] + j, len(windows.flat) - 1)])
            at, k, row = at[good], k[good], row[good]
        found.append((row, at - w.first[row], k))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _annotate(windows: Windows, index: dict[int, _Prefixes], text: str, names_out: list[str], hits_out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            names = b.schema.names
            hits: list[dict] = []
            for _, w in words(b.column(names.index(text)), ALNUM):
                n = np.diff(w.first).tolist()
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for i, a, k in zip(*(x.tolist() for x in _occurrences(w, windows, index)), strict=True):
                    spans.setdefault(i, []).append((a, a + int(windows.length[k])))
                    items.setdefault(i, set()).update(windows.items_of(k))
                hits += [{"n_words": n[i], "spans": [{"start": s, "end": e} for s, e in _merge(spans.get(i, []))], "items": sorted(items.get(i, set()))} for i in range(len(w))]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(name)) for name in names_out), pa.array(hits, _HITS_TYPE)], [*names_out, hits_out])

    return run


def annotate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, index_bytes: int = 8 << 20, keep: list[str] | None = None, hits: str = "hits") -> DataFrame:
    """The documents' columns, or those to keep, and `hits` (HITS): the number of words, merged spans of hit words, and the items hit, sorted as strings."""
    keep = documents.columns if keep is None else keep
    if hits.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the documents have a column {hits}: name another one for the hits")
    items = pick(benchmark, id=item_id, text=item_text).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > index_bytes:
        return _joined(documents, items, text, window, keep, hits)
    windows = Windows([(r["id"], r["text"]) for r in items.collect()], window)
    counts = shingle_counts(documents, text, {width: windows.keys(width) for width in windows.widths}) if len(windows) else {}
    source = documents.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])))
    return source.mapInArrow(frugal(_annotate(windows, windows.prefix_index(counts), text, keep, hits)), ", ".join(filter(None, [ddl(documents, keep), f"`{hits}` {HITS}"])))


# ---- benchmarks that stay tables

def _item_places(window: int) -> Callable:
    """(item, pos, token, n_words, width, words) of each shingle of an item; `words` are the window that begins there, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            rows: list[tuple] = []
            for first, w in words(b.column(1), ALNUM):
                for i in range(len(w)):
                    own = w.row(i)
                    n, width = min(window, len(own)), min(SHINGLE, len(own))
                    if n:
                        data = own.astype("<u8").tobytes()
                        tokens = _runs(own, width).view(np.int64).tolist()
                        rows += [(b.column(0)[first + i].as_py(), j, token, len(own), width, data[8 * j : 8 * (j + n)] if j + n <= len(own) else None) for j, token in enumerate(tokens)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "pos", "token", "n_words", "width", "words"])

    return run


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """A bit for the low bits of each token: at most 2 ** (_MAP_BITS - 6) numbers come to the driver."""
    bit = F.col("token").bitwiseAND(F.lit((1 << _MAP_BITS) - 1))
    found = tokens.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(token & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _may_hold(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values & np.uint64((1 << _MAP_BITS) - 1)) >> np.uint64(6)
    return np.flatnonzero(bitmap[at.astype(np.int64)] >> (values & np.uint64(63)) & np.uint64(1))


def _count_held(bitmap: np.ndarray, widths: list[int]) -> Callable:
    """(token, n) of the documents' shingles that the bitmap lets through, added up within a task as far as they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

        for b in batches:
            for _, w in words(b.column(0), ALNUM):
                for width in widths:
                    tokens = _runs(w.hashes, width)
                    held.append(tokens[_may_hold(bitmap, tokens)])
                if sum(map(len, held)) > 1 << 20:
                    yield out()
        yield out()

    return run


def _text_places(bitmap: np.ndarray, widths: list[int], window: int) -> Callable:
    """(th, size, token, pos, n_words, start, around) of the places that may hold a prefix: `around` are the words from `start` on that a window there can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            parts: list[tuple] = []
            for first, w in words(b.column(2), ALNUM):
                data = w.hashes.astype("<u8").tobytes()
                for width in widths:
                    tokens = _runs(w.hashes, width)
                    at = _may_hold(bitmap, tokens)
                    row = np.searchsorted(w.first, at, "right") - 1
                    inside = at + width <= w.first[row + 1]
                    at, row = at[inside], row[inside]
                    start = np.maximum(w.first[row], at - (window - width))
                    stop = np.minimum(w.first[row + 1], at + window)
                    parts += zip((first + row).tolist(), tokens[at].view(np.int64).tolist(), (at - w.first[row]).tolist(), (w.first[row + 1] - w.first[row]).tolist(), (start - w.first[row]).tolist(), [data[8 * x : 8 * y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)], strict=True)
            columns = list(zip(*parts, strict=True)) or [()] * 6
            row = pa.array(columns[0], pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["th", "size", "token", "pos", "n_words", "start", "around"])

    return run


def _count_words(text: str, names_out: list[str], n_words: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            names = b.schema.names
            n = [np.diff(w.first) for _, w in words(b.column(names.index(text)), ALNUM)]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(name)) for name in names_out), pa.array(np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64))], [*names_out, n_words])

    return run


def _joined(documents: DataFrame, items: DataFrame, text: str, window: int, keep: list[str], hits: str) -> DataFrame:
    """As `annotate`, by joins of tables; a text's hits are found once and go to all of its copies."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialize(items.select(F.monotonically_increasing_id().alias("item"), "id", "text"), "benchmark-items")
    places = materialize(rows.select("item", "text").mapInArrow(frugal(_item_places(window)), "item bigint, pos bigint, token bigint, n_words bigint, width int, words binary"), "benchmark-places")
    widths = sorted(r["width"] for r in places.select("width").distinct().collect())
    held = pick(documents, text=text).mapInArrow(frugal(_count_held(_bitmap(places.select("token")), widths)), "token bigint, n bigint")
    counts = held.groupBy("token").agg(F.sum("n").alias("n"))
    # A window begins at each place that has `words`; its shingles are this place's and those behind it.
    of_window = Window.partitionBy("item").orderBy("pos").rowsBetween(0, max(0, window - SHINGLE))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"), F.col("pos"))).over(of_window)
    index = places.join(counts, "token", "left").withColumn("best", best).filter("words IS NOT NULL")
    index = index.select("item", "words", F.col("best.token").alias("token"), (F.col("best.pos") - F.col("pos")).alias("offset"))
    index = materialize(index.join(rows.select("item", "id"), "item").select("id", "words", "token", "offset").distinct(), "benchmark-index")
    source = documents.select(F.xxhash64(value).alias("th"), F.octet_length(value).cast("bigint").alias("size"), value.alias("text"))
    found = source.mapInArrow(frugal(_text_places(_bitmap(index.select("token")), widths, window)), "th bigint, size bigint, token bigint, pos bigint, n_words bigint, start bigint, around binary")
    # Copies of a text have the same places.
    found = found.distinct().join(index.hint("merge"), "token").withColumn("begin", F.col("pos") - F.col("offset")).withColumn("stop", F.col("begin") + F.octet_length("words") / 8)
    same = F.expr("substring(around, cast((begin - start) * 8 + 1 AS INT), octet_length(words))") == F.col("words")
    found = found.filter((F.col("begin") >= F.col("start")) & (F.col("stop") <= F.col("n_words")) & same)
    span = F.struct(F.col("begin").alias("start"), F.col("stop").cast("bigint").alias("end"))
    of_text = found.groupBy("th", "size").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("id")).alias("items"))
    [th, own_size, n_words, key, key_size, spans, ids] = free(documents, "th", "size", "n_words", "key", "key_size", "spans", "items")
    of_text = materialize(of_text.select(F.col("th").alias(key), F.col("size").alias(key_size), merged(F.col("spans")).alias(spans), F.col("items").alias(ids)), "benchmark-hits")
    discard(rows, places, index)
    keyed = documents.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])), F.xxhash64(value).alias(th), F.octet_length(value).cast("bigint").alias(own_size))
    names = [*keep, th, own_size]
    counted = keyed.mapInArrow(frugal(_count_words(text, names, n_words)), f"{ddl(keyed, names)}, `{n_words}` bigint")
    out = counted.join(of_text.hint("merge"), (F.col(th) == F.col(key)) & (F.col(own_size) == F.col(key_size)), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(*(F.col(f"`{c}`") for c in keep), F.struct(F.col(n_words).alias("n_words"), F.coalesce(spans, none).alias("spans"), F.coalesce(ids, F.array().cast("array<string>")).alias("items")).alias(hits))


def merged(spans: F.Column) -> F.Column:
    """Sorted spans, those that touch or overlap put together."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, none, step)


def n_hit(hits: str = "hits") -> F.Column:
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(share: int = 20, hits: str = "hits") -> F.Column:
    """At least one word in `share` is hit."""
    return (n_hit(hits) > 0) & (share * n_hit(hits) >= F.col(f"{hits}.n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", share: int = 20, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    [hits] = free(documents, "hits")
    return annotate(documents, benchmark, text=text, hits=hits, **options).filter(~contaminated(share, hits)).select(*(F.col(f"`{c}`") for c in documents.columns))
