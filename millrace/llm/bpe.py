"""SentencePiece encoding and decoding of merge-type models, by backtracking.

The pieces that occur at a position come from an Aho-Corasick automaton.  The
encoder takes the longest one, and accepts it if the pair with the piece
before it is compatible: merging the pair's text anew must give just these two
pieces.  Otherwise it tries shorter ones, then steps back; a bitfield keeps the
positions from which no encoding goes on.  A sequence whose neighbours are all
compatible is the one that merging by score gives.  Re-merging a pair only
has to replay the merges at the place where its pieces touch (`compatible`).

Two cases lie outside that theorem and are merged directly: chunks with a run
of two or more spaces (the pieces of such runs tie in score), and characters
without a piece (bytes).  Texts are cut before each space that follows another
character, where the vocabulary has no piece across such a place, and the
pieces of a chunk are kept in a table of bounded size.

Defined results: a null or empty text has the end id alone; ids do not depend
on other rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ddl, frugal, pick, slices, small_batches, strings

SPACE = "▁"
CACHE_ENTRIES = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Bpe:
    def __init__(self, model_path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        parts = {f: dict(_fields(v)) for f, v in _fields(library.serialized_model_proto()) if f in (2, 3)}
        trainer, normalizer = parts.get(2, {}), parts.get(3, {})
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models that do not normalise the text are supported")
        self.dummy = " " if normalizer.get(3, 1) else ""
        size = library.get_piece_size()
        self.end = library.eos_id()
        self.unknown = library.unk_id()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.scores = [library.get_score(i) for i in range(size)]
        special = {i for i in range(size) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if library.is_byte(i)}
        self.byte_ids = {value: i for i, value in self.byte_of.items()}
        self.control = {i for i in range(size) if library.is_control(i)}
        tied = {p for p in self.ids if len(p) > 1 and not p.strip(SPACE)}
        # Merging must give a piece for its own text, else it is in no encoding; the last merge gives its halves.
        self.halves: dict[int, tuple[int, int]] = {}
        usable = {}
        for p, i in self.ids.items():
            if p not in tied and self.merge(p) == [i]:
                usable[p] = i
                if len(p) > 1:
                    self.halves[i] = self.ids[self._last[0]], self.ids[self._last[1]]
        order = {i: k for k, i in enumerate(sorted(self.halves, key=lambda i: -self.scores[i]))}
        self.rank = {i: order.get(i, -1) for i in usable.values()}
        if any(self.rank.get(h, len(order)) >= self.rank[i] for i, pair in self.halves.items() for h in pair):
            raise ValueError("a piece has a better score than its halves")
        self.joined = {(usable[p[:n]], usable[p[n:]]): self.rank[i] for p, i in usable.items() for n in range(1, len(p)) if p[:n] in usable and p[n:] in usable}
        self.automaton = ahocorasick.Automaton()
        for p, i in usable.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.shorter = {i: next((usable[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in usable), None) for p, i in usable.items()}
        self.length = {i: len(p) for p, i in usable.items()}
        self.characters = {p for p in usable if len(p) == 1}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[str, int, str]] = {}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        newline = not any("\n" in p for p in self.ids)
        self._cut = None if crossing else re.compile(" +[^ \n]*|[^ \n]+|\n" if newline else " +[^ ]*|[^ ]+")

    def merge(self, text: str) -> list[int]:
        """Merges neighbours, best score first and leftmost of ties, as the model's definition says."""
        n = len(text)
        if n == 1:
            return self._symbol(text)
        part: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if (b := after[a]) < n and (i := self.ids.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, both))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            if part[a] is None or (b := after[a]) >= n or part[a] + part[b] != both:
                continue
            self._last = part[a], part[b]
            part[a], part[b] = both, None
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [i for p in part if p is not None for i in self._symbol(p)]

    def _symbol(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives a and b: no two parts that touch while both are there would merge with each other first."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            found = self._pairs[a, b] = self._remerge(a, b)
        return found

    def _remerge(self, x: int, y: int) -> bool:
        rank, halves, joined = self.rank, self.halves, self.joined
        into_x = into_y = len(rank)  # when x and y are merged into what holds them
        while True:
            when = joined.get((x, y))
            # Of equal merges the leftmost comes first: that into x stands left of x + y, that into y right of it.
            if when is not None and when < into_x and when <= into_y:
                return False
            if rank[x] > rank[y]:
                into_x, x = rank[x], halves[x][1]
            elif rank[y] >= 0:
                into_y, y = rank[y], halves[y][0]
            else:
                return True

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n = len(text)
        longest: list[int | None] = [None] * n
        reach = [0] * n
        for end, (size, i) in self.automaton.iter(text):
            if size > reach[end - size + 1]:
                reach[end - size + 1], longest[end - size + 1] = size, i
        failed = b""  # a bit for each position, once there is a failed one
        out: list[int] = []
        at = 0
        token = longest[0]
        while at < n:
            while True:
                end = at + self.length[token]
                if not (failed and failed[end >> 3] >> (end & 7) & 1) and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[end] if end < n else None
                    break
                if (less := self.shorter[token]) is not None:
                    token = less
                    continue
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= self.length[token]
        return out

    def _chunk(self, text: str) -> list[int]:
        text = text.replace(" ", SPACE)
        if SPACE * 2 in text:
            return self.merge(text)
        if self.characters.issuperset(text):
            return self._backtrack(text)
        out: list[int] = []
        a = 0
        for b, c in enumerate(text):
            if c not in self.characters:
                if a < b:
                    out += self._backtrack(text[a:b])
                out += self._symbol(c)
                a = b + 1
        if a < len(text):
            out += self._backtrack(text[a:])
        return out

    def decode_part(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front goes, control ids have no text."""
        text = self.decode_part(ids)
        return text[1:] if self.dummy and text[:1] == " " else text

    def _learn(self, chunk: str) -> tuple[str, int, str]:
        ids = self._chunk(chunk)
        text = self.decode_part(ids)
        found = (" ".join(map(str, ids)), len(ids), chunk if text == chunk else text)
        if len(chunk) < 48:
            if len(self._known) >= CACHE_ENTRIES:
                self._known.clear()
            self._known[chunk] = found
        return found

    def parts(self, text: str) -> list[tuple[str, int, str]]:
        """(ids in decimal, their number, decoded text) of each chunk."""
        if not text:
            return []
        text = self.dummy + text.replace(SPACE, " ")
        known, learn = self._known.get, self._learn
        return [known(c) or learn(c) for c in (self._cut.findall(text) if self._cut else [text])]

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        return [int(i) for ids, _, _ in self.parts(text) for i in ids.split()] + [self.end]

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal joined by one space, decoded text)."""
        parts = self.parts(text)
        decoded = "".join([p[2] for p in parts])
        if self.dummy and decoded[:1] == " ":
            decoded = decoded[1:]
        return sum([p[1] for p in parts]) + 1, " ".join([*[p[0] for p in parts], str(self.end)]), decoded


def _utf8(raw: bytes) -> str:
    """Bytes that are no UTF-8 become U+FFFD, one each."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at : at + n]).decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_models: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(documents: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>, the end id last) and decoded (the text that decode gives for them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for part in slices(batches):
            ids = [bpe.encode(t) for t in strings(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    source = pick(documents, doc_id=doc_id, text=text)
    return source.mapInArrow(frugal(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(documents: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the same encoding, where the ids themselves are not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for b in slices(batches):
            rows = [(n, _sha(ids), _sha(decoded)) for n, ids, decoded in map(bpe.digest, strings(b.column(1)))]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = pick(documents, doc_id=doc_id, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(frugal(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def add_counts(documents: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """The documents with all their columns, the ids and their number; a column that already has such a name is replaced."""
    small_batches(documents.sparkSession)
    names = [c for c in documents.columns if c not in (ids, n_tokens)]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for b in slices(batches):
            found = [bpe.encode(t) for t in strings(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32())), pa.array([len(i) for i in found], pa.int64())], [*names, ids, n_tokens])

    source = documents.select(*(F.col(f"`{c}`") for c in names))
    return source.mapInArrow(frugal(run), f"{ddl(source, names)}, `{ids}` array<int>, `{n_tokens}` bigint")
