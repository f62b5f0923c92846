"""N-gram Jaccard join: which documents' sets of word shingles are similar, exactly.

Documents with equal sets are one class.  Classes meet in index lists, skipped in
blocks by position: sizes form levels, so that similar sets are on one level or
on neighbouring ones, and the range of shingle hashes is cut into segments, one
more than similar sets of a level can differ in, and some to spare.  Similar
sets then agree in a whole segment, so the lists are keyed by (level, segment,
contents of the segment) instead of single shingles: entries at other positions
are never met, and a passage that very many documents share makes no long list,
because its shingles lie in segments with others.

A list is skipped in blocks of entries that cannot be similar where they stand.
Let d(i) be in how many shingles of segment i two similar sets differ, D at most
in all.  Of the D + 1 + spare segments, taken as a ring, at least 1 + spare are
such that every run of r segments that begins there has fewer than r differing
shingles (the cycle lemma on the numbers 1 - d(i)).  So each entry carries, for
the `reach` segments from its position on, the parities of their shingles over
32 bits: those of similar sets differ in fewer than `reach` bits at one of their
common positions.  Entries with equal parities are one block, and blocks that
differ in more bits are skipped; that is exact, and leaves hardly any sets that
meet by chance.  Lists travel as packed runs, one bucket of them is held at once.

Sets connected by such entries form candidate groups, whose texts are fetched.
Inside a group answers are derived from each other: the vector of a leader's
overlaps with all sets is computed from the inverted lists; a similar set's
vector is the leader's, corrected by the lists of the shingles in which the two
differ.  Every pair of a group is thus decided exactly, without listing pairs.  A
group of many sets or shingles is cut into blocks, and each pair of blocks is a
task of its own.

Defined results: a text without words, empty or null, has no shingles, links
with nothing and is its own component; repeated rows link like other equal sets;
a null id never names a component unless all ids of the component are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import free, frugal, pick
from .components import components
from ..operators.materialize import discard, materialize
from .words import BLANKS, mix, shingles, words

_PART = 1 << 16
_BLOCK_SETS, _MOST_BLOCKS = 256, 16
#: An entry of a list: list key (48 bits), parities (32), the set's number in its run (16).
_ENTRY = 12


class Levels:
    """Sizes by level, and the segment bounds of each level, for similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.upper = [1]
        while self.upper[-1] < 1 << 40:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * den // num))
        filled = num * num * (num + den) / (2 * (den - num) * den * den) if den > num else 16
        #: Segments whose parities an entry carries: about 16 shingles, 32 in two sets that meet by chance.
        self.reach = max(3, min(6, round(16 / filled)))
        self._segments: dict[int, tuple[np.ndarray, int]] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.upper, n))

    def differ(self, level: int) -> int:
        """In how many shingles similar sets of a level can differ at most."""
        return (self.den - self.num) * 2 * self.upper[level] // (self.den + self.num)

    def segments(self, level: int) -> tuple[np.ndarray, int]:
        """(inner bounds of the segments, spare ones): a set with at most `spare` empty segments agrees with a similar one in a segment that is not empty.

        What is said of empty segments holds of all that are known to be common: see `signatures`.
        """
        if level not in self._segments:
            least = self.upper[level] * (self.num / self.den) ** 2

            def lacking(spare: int) -> float:
                m = self.differ(level) + 1 + spare
                empty = m * math.exp(-least / m)
                return max(0.0, empty + 3 * math.sqrt(empty) - spare)

            # The fewest that hardly a set of this size exceeds; on the lowest levels, those that come nearest.
            spare = min(range(2, self.differ(level) + 8), key=lambda s: (lacking(s), s))
            m = self.differ(level) + 1 + spare
            bounds = np.array([(j << 64) // m for j in range(1, m)], np.uint64)
            self._segments[level] = bounds, spare
        return self._segments[level]

    def signatures(self, tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List keys of a sorted set, and the parities from each one's position on.

        Segments with common shingles only, or none, give no key, unless the set has
        more of them than are to spare; a similar set then either has a key of another
        segment in which both agree, or gives all of its keys too.
        """
        total = np.zeros(len(tokens) + 1, np.uint64)
        with np.errstate(over="ignore"):
            mixed = mix(tokens)
            np.cumsum(mixed, out=total[1:])
        odd = np.zeros(len(tokens) + 1, np.uint32)
        np.bitwise_xor.accumulate(np.uint32(1) << (mixed >> np.uint64(59)).astype(np.uint32), out=odd[1:])
        rare = np.zeros(len(tokens) + 1, np.int64)
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        np.cumsum(common[at] != tokens if len(common) else np.ones(len(tokens), bool), out=rare[1:])
        out, near = [], []
        own = self.of(len(tokens))
        for level in (own, own + 1):
            if not self.differ(level):
                continue
            bounds, spare = self.segments(level)
            cut = np.empty(len(bounds) + 2, np.int64)
            cut[0], cut[-1] = 0, len(tokens)
            cut[1:-1] = np.searchsorted(tokens, bounds)
            with np.errstate(over="ignore"):
                keys = mix((total[cut[1:]] - total[cut[:-1]]) + np.arange(len(cut) - 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xC2B2AE3D27D4EB4F))
            telling = rare[cut[1:]] > rare[cut[:-1]]
            start, m = np.arange(len(keys)), len(keys)
            stop = start + min(self.reach, m)
            parity = odd[cut[np.minimum(stop, m)]] ^ odd[cut[:-1]] ^ odd[cut[np.maximum(stop - m, 0)]]
            chosen = slice(None) if m - np.count_nonzero(telling) > spare else telling
            out.append(keys[chosen])
            near.append(parity[chosen])
        return (np.concatenate(out), np.concatenate(near)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))


_OUT = pa.schema([("bucket", pa.int32()), ("rid", pa.int64()), ("rep", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("blob", pa.binary())])
_OUT_DDL = "bucket int, rid bigint, rep bigint, doc_id bigint, th bigint, n bigint, s1 bigint, s2 bigint, blob binary"


def _common(k: int, share: float):
    """(shingle, n) of shingles that many of a task's documents hold; rare ones are dropped whenever the table grows large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, docs, new, held, floor = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0, 1

        def fold() -> None:
            nonlocal keys, counts, new, held, floor
            found, at = np.unique(np.concatenate([keys, *new]), return_inverse=True)
            weights = np.concatenate([counts, np.ones(held, np.int64)])
            keys, counts, new, held = found, np.bincount(at, weights, minlength=len(found)).astype(np.int64), [], 0
            while len(keys) > 1 << 20:
                floor += 1
                keys, counts = keys[counts >= floor], counts[counts >= floor]

        for b in batches:
            for _, w in words(b.column(0), BLANKS):
                docs += len(w)
                for i in range(len(w)):
                    new.append(np.unique(shingles(w.row(i), k)))
                    held += len(new[-1])
                if held > 1 << 19:
                    fold()
        if held:
            fold()
        seen = counts >= max(2, share * docs)
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(counts[seen])], ["shingle", "n"])

    return run


def common_shingles(texts: DataFrame, k: int, share: float) -> tuple[np.ndarray, int]:
    """Sorted shingles that at least about `share` of all documents hold, at most a document's mean number of shingles / share; and the bytes of all texts.

    They only steer which lists are made; answers do not depend on them.
    """
    counts = texts.mapInArrow(frugal(_common(k, share)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    docs, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return np.sort(counts.filter(F.col("n") >= max(4.0, share * docs)).select("shingle").toArrow().column(0).to_numpy().view(np.uint64)), size


def _sketch(k: int, num: int, den: int, buckets: int, common: np.ndarray):
    """Rows for documents, and packed lists by bucket (a range of list keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den)
        base = TaskContext.get().partitionId() << 36
        flushes = 0
        first: dict[tuple[int, int, int], int] = {}
        keys: list[np.ndarray] = []
        near: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        used = held = 0

        def blobs() -> pa.RecordBatch:
            nonlocal keys, near, owners, held
            sig, parity = np.concatenate(keys), np.concatenate(near)
            owner = np.repeat(np.array([o for o, _ in owners], np.uint16), [n for _, n in owners])
            bucket = (sig >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)
            order = np.argsort(bucket, kind="stable")
            sig, parity, owner, bucket = sig[order], parity[order].astype("<u4"), owner[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - np.uint64(1), append=bucket[-1:] + np.uint64(1)))
            low, mid = (sig & np.uint64(0xFFFFFFFF)).astype("<u4"), (sig >> np.uint64(32)).astype("<u2")
            packed = [b"".join((low[a:b].tobytes(), parity[a:b].tobytes(), mid[a:b].tobytes(), owner[a:b].tobytes())) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            none = pa.nulls(len(packed), pa.int64())
            keys, near, owners, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array([base + flushes * _PART] * len(packed), pa.int64()), *[none] * 6, pa.array(packed, pa.binary())], schema=_OUT)

        for b in batches:
            rows: list[tuple] = []
            for at, w in words(b.column(2), BLANKS):
                for i in range(len(w)):
                    tokens = np.unique(shingles(w.row(i), k))
                    n = len(tokens)
                    with np.errstate(over="ignore"):
                        s1 = int(np.add.reduce(mix(tokens), dtype=np.uint64).view(np.int64)) if n else 0
                        s2 = int(np.add.reduce(mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64).view(np.int64)) if n else 0
                    rid = base + flushes * _PART + used
                    rep = first.setdefault((n, s1, s2), rid) if n else rid
                    rows.append((rid % buckets, rid, rep, n, s1, s2))
                    if rep == rid and n:
                        own, parity = levels.signatures(tokens, common)
                        if len(own):
                            keys.append(own)
                            near.append(parity)
                            owners.append((used, len(own)))
                            held += len(own)
                    used += 1
                    if used == _PART or held > 1 << 22:
                        if keys:
                            yield blobs()
                        used, flushes = 0, flushes + 1
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 6
            bucket, rid, rep, n, s1, s2 = columns
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(rid), pa.array(rep), b.column(0), b.column(1), pa.array(n), pa.array(s1), pa.array(s2), pa.nulls(len(rid), pa.binary())], schema=_OUT)
        if keys:
            yield blobs()

    return run


class _Sets:
    """Union-find."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = up.setdefault(x, x)
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        a = [x for x in self.up if self.root(x) != x]
        return np.array(a, np.int64), np.array([self.up[x] for x in a], np.int64)


def _close(sig: np.ndarray, parity: np.ndarray, rid: np.ndarray, reach: int, sets: _Sets) -> None:
    """Joins the sets of entries with one list key whose parities differ in fewer than `reach` bits."""
    order = np.lexsort((rid, parity, sig))
    sig, parity, rid = sig[order], parity[order], rid[order]
    same = sig[1:] == sig[:-1]
    block = np.concatenate([[True], ~same | (parity[1:] != parity[:-1])])
    inner = np.flatnonzero(~block)
    pairs = [np.stack([rid[inner - 1], rid[inner]], 1)]
    sig, parity, rid = sig[block], parity[block], rid[block]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(start, append=len(sig))
    at = np.repeat(size, size)
    short, rank = np.flatnonzero((at > 1) & (at <= 32)), np.arange(len(sig)) - np.repeat(start, size)
    for step in range(1, 32):
        short = short[rank[short] + step < at[short]]
        if not len(short):
            break
        good = short[np.bitwise_count(parity[short] ^ parity[short + step]) < reach]
        pairs.append(np.stack([rid[good], rid[good + step]], 1))
    for a, b in np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0).tolist():
        if a != b:
            sets.join(a, b)
    for k in np.flatnonzero(size > 32).tolist():
        # Blocks outside of the first one's component are compared with all others, so every pair has one side that is.
        own, ids = parity[start[k] : start[k] + size[k]], rid[start[k] : start[k] + size[k]].tolist()
        for i in range(len(ids)):
            if i and sets.root(ids[i]) == sets.root(ids[0]):
                continue
            for j in np.flatnonzero(np.bitwise_count(own ^ own[i]) < reach).tolist():
                sets.join(ids[i], ids[j])


def _meet(reach: int):
    """Passes the documents' rows on, and adds rows (rid, rep) for sets that meet in a list; rows come in order of buckets."""
    schema = pa.schema(list(_OUT)[1:8])

    def links(sets: _Sets) -> pa.RecordBatch:
        a, b = sets.links()
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[none] * 5], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, now, runs = _Sets(), None, []

        def close() -> None:
            parts = [[], [], []]
            for base, blob in runs:
                n = len(blob) // _ENTRY
                low, parity, mid, owner = np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<u4", n, 4 * n), np.frombuffer(blob, "<u2", n, 8 * n), np.frombuffer(blob, "<u2", n, 10 * n)
                for part, x in zip(parts, (mid.astype(np.uint64) << np.uint64(32) | low, parity, owner.astype(np.int64) + base), strict=True):
                    part.append(x)
            runs.clear()
            sig, parity, rid = map(np.concatenate, parts)
            order = np.argsort(sig, kind="stable")
            sig = sig[order]
            twin = sig[1:] == sig[:-1]
            met = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
            if met.any():
                _close(sig[met], parity[order[met]], rid[order[met]], reach, sets)

        for b in batches:
            packed = pc.is_valid(b.column(8))
            blobs = b.filter(packed)
            for bucket, base, blob in zip(blobs.column(0).to_pylist(), blobs.column(1).to_pylist(), blobs.column(8).to_pylist(), strict=True):
                if bucket != now and runs:
                    close()
                    if len(sets.up) > 1 << 20:
                        yield links(sets)
                        sets = _Sets()
                now = bucket
                runs.append((base, blob))
            rest = b.filter(pc.invert(packed))
            yield pa.RecordBatch.from_arrays(rest.columns[1:8], schema=schema)
        if runs:
            close()
        yield links(sets)

    return run


class _Group:
    """Exact links among the sets of one task."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.flat, kind="stable")
        self.posting = owner[order]
        self.at = np.searchsorted(self.flat[order], np.arange(len(tokens) + 1))
        self.cut = np.concatenate([[0], np.cumsum(self.sizes)])

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.cut[i] : self.cut[i + 1]]

    def _lists(self, tokens: np.ndarray) -> np.ndarray:
        """How often each set has one of the tokens."""
        if not len(tokens):
            return np.zeros(len(self.sizes), np.int64)
        return np.bincount(np.concatenate([self.posting[self.at[t] : self.at[t + 1]] for t in tokens.tolist()]), minlength=len(self.sizes))

    def overlaps(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each set, its overlap with every set; sets that share their smallest shingle come one after another."""
        order = np.lexsort((self.sizes, self.flat[self.cut[:-1]]))
        lead = None
        for y in order.tolist():
            own = self.row(y)
            if lead is not None:
                x, found = lead
                less, more = np.setdiff1d(self.row(x), own, assume_unique=True), np.setdiff1d(own, self.row(x), assume_unique=True)
                if 2 * (len(less) + len(more)) < len(own):
                    yield y, found - self._lists(less) + self._lists(more)
                    continue
            found = self._lists(own)
            lead = y, found
            yield y, found


def _verify(k: int, num: int, den: int):
    """(a, b, links): forest of the links of each task, and for each class (a = b) the number of documents it links with."""

    def decide(task: pa.Table) -> pa.RecordBatch:
        low, high = task.column("low")[0].as_py(), task.column("high")[0].as_py()
        ids, at = np.unique(task.column("cid").to_numpy(), return_index=True)
        task = task.take(at)
        block, weight = task.column("block").to_numpy(), task.column("copies").to_numpy()
        sets = [np.unique(shingles(w.row(i), k)) for _, w in words(task.column("text"), BLANKS) for i in range(len(w))]
        links = np.zeros(len(ids), np.int64)
        forest = _Sets()
        group = _Group(sets)
        del sets
        for y, overlap in group.overlaps() if len(ids) > 1 else ():
            near = den * overlap >= num * (group.sizes + group.sizes[y] - overlap)
            near[y] = False
            if low != high:
                near &= block != block[y]
            z = np.flatnonzero(near)
            links[y] += weight[z].sum()
            for other in z[z > y].tolist():
                forest.join(int(ids[y]), int(ids[other]))
        a, b = forest.links()
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ids[linked]])), pa.array(np.concatenate([b, ids[linked]])), pa.array(np.concatenate([np.zeros(len(a), np.int64), links[linked]]))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).to_numpy() for i in range(3)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for x, y in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                key = tuple(int(c[x]) for c in keys)
                if key != now and parts:
                    yield decide(pa.Table.from_batches(parts))
                    parts = []
                now = key
                parts.append(b.slice(x, y - x))
        if parts:
            yield decide(pa.Table.from_batches(parts))

    return run


def _found(documents: DataFrame, doc_id: str, text: str, k: int, num: int, den: int, block_shingles: int, common_share: float) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The rows of `join`, and the tables they are read from."""
    spark = documents.sparkSession
    source = pick(documents, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    common, size = common_shingles(source.select("text"), k, common_share)
    # A bucket holds the lists of about 8 MB of text, a partition those of 64 MB: similar sets
    # meet once in each partition, so more partitions than needed would only repeat their links.
    lists = max(8, size >> 26)
    buckets = max(8 * lists, size >> 23)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 27)
    sketched = source.mapInArrow(frugal(_sketch(k, num, den, buckets, common)), _OUT_DDL).repartition(lists, "bucket").sortWithinPartitions("bucket")
    met = materialize(sketched.mapInArrow(frugal(_meet(Levels(num, den).reach)), _OUT_DDL.split("int, ", 1)[1].rsplit(",", 1)[0]), "jaccard-sets")
    rows = met.filter("n is not null")
    of_set = rows.filter("n > 0 and rid = rep").groupBy("n", "s1", "s2").agg(F.min("rid").alias("cid"))
    reps = materialize(rows.filter("n > 0 and rid = rep").join(of_set, ["n", "s1", "s2"]).select("rid", "cid", "n", "doc_id", "th"), "jaccard-reps")
    copies = rows.filter("n > 0").groupBy("rep").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    classes = materialize(reps.join(copies, reps["rid"] == copies["rep"]).groupBy("cid").agg(F.sum("copies").alias("copies"), F.min("least").alias("least"), F.max(F.when(F.col("rid") == F.col("cid"), F.struct("doc_id", "th", "n"))).alias("at")), "jaccard-classes")
    labels = components(met.filter("n is null").select(F.col("rid").alias("a"), F.col("rep").alias("b")).union(reps.filter("rid <> cid").select("rid", "cid")))
    member = materialize(classes.join(labels, classes["cid"] == labels["node"]).select(F.col("label").alias("g"), "cid", "copies", "at.*"), "jaccard-members")
    large = member.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("total")).filter("size > 1")
    # Large groups also of short texts go to many tasks: blocks of _BLOCK_SETS sets, as far as that makes _MOST_BLOCKS; beyond, by shingles.
    by_sets = F.least(F.lit(_MOST_BLOCKS), F.ceil(F.col("size") / _BLOCK_SETS))
    large = large.select("g", F.greatest(F.ceil(F.col("total") / block_shingles), by_sets).cast("int").alias("q"))
    tasks = member.join(large, "g").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("q")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    tasks = tasks.select("g", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "cid", "block", "copies", "doc_id", "th")
    # Merged at every size: the members grow with the documents, so they are never broadcast.
    texts = source.alias("s").join(tasks.hint("merge").alias("t"), F.expr("s.th = t.th and s.doc_id <=> t.doc_id")).select("t.g", "t.low", "t.high", "t.cid", "t.block", "t.copies", "s.text")
    texts = texts.repartition(partitions, "g", "low", "high").sortWithinPartitions("g", "low", "high", "cid")
    links = materialize(texts.mapInArrow(frugal(_verify(k, num, den)), "a bigint, b bigint, links bigint"), "jaccard-links")
    joined = components(links.filter("a <> b").select("a", "b"))
    counts = links.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    named = classes.join(joined, classes["cid"] == joined["node"], "left").select("cid", "copies", "least", F.coalesce("label", "cid").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").join(counts, "cid", "left").select("cid", "component", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_rep = materialize(reps.select("rid", "cid").join(named, "cid").select(F.col("rid").alias("rep"), "component", "component_id", "n_links"), "jaccard-named")
    discard(reps, classes, labels, member, links, joined)
    out = rows.select("rid", "rep", "doc_id", "th", F.col("n").alias("n_shingles")).join(of_rep, "rep", "left")
    out = out.select("rid", "doc_id", "th", "n_shingles", F.coalesce("component", "rid").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out, (met, of_rep)


def join(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, block_shingles: int = 500_000, common_share: float = 1 / 2000) -> DataFrame:
    """rid (a row's own number), doc_id, th (hash of the text), n_shingles, component (a number), component_id (its smallest doc_id) and n_links (documents that the row links with) of every row.

    Sets link when den * intersection >= num * union.  Ids are cast to bigint.
    """
    return _found(documents, doc_id, text, k, num, den, block_shingles, common_share)[0]


def keep_one(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, block_shingles: int = 500_000, common_share: float = 1 / 2000) -> DataFrame:
    """The documents with all their columns, one of each component: that with the smallest id, null ids last.

    Documents without words are components of their own and all stay, also repeated
    ones.  Other columns, whatever their names, stay as they are.
    """
    found, tables = _found(documents, doc_id, text, k, num, den, block_shingles, common_share)
    rows = found.groupBy("component", "doc_id", "th").agg(F.min("rid").alias("rid"), F.when(F.max("n_shingles") > 0, F.count("*")).otherwise(0).alias("n"))
    one = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "th", "n")).alias("x"))
    key, hashed, its_key, its_hash, many = free(documents, "key", "hash", "kept_key", "kept_hash", "many")
    kept = materialize(one.groupBy(F.col("x.doc_id").alias(its_key), F.col("x.th").alias(its_hash)).agg((F.sum("x.n") > 1).alias(many)), "jaccard-kept")
    discard(*tables)
    keyed = documents.withColumns({key: F.col(f"`{doc_id}`").cast("bigint"), hashed: F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    joined = keyed.join(kept.hint("merge"), (F.col(hashed) == F.col(its_hash)) & F.col(key).eqNullSafe(F.col(its_key)))
    # Only fully repeated rows need a second look; the others are not shuffled again.
    names = [F.col(f"`{c}`") for c in documents.columns]
    return joined.filter(~F.col(many)).select(*names).unionAll(joined.filter(many).dropDuplicates([key, hashed]).select(*names))
