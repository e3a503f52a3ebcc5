"""Near-duplicate texts: MinHash LSH forest with exact verification.

Each text becomes the set of its k-character pieces over letters and digits (or
of its k-word shingles). Each of TREES tries holds the signatures of all texts in
sorted order: a key is made of minima, the first `floor` of them name a node of
the least depth, and two more follow. A text starts with the full prefix in every
trie and shortens it to the node of least depth in one trie after another, the
least crowded first, until the chance that a pair at the threshold shares one of
its prefixes, 1 - prod(1 - t**depth), reaches the target recall. So a text leaves
its most crowded nodes deep, and how many these are depends on the text. Nodes of
up to CROWD classes cost little and count as equally empty: otherwise those that
a text shares with what it resembles would be the first to be left out. A pair
are candidates if the prefix of either of them holds both. A sketch of two
bits of each of 96 further minima drops candidates that are far below the
threshold (3.4 standard deviations), and the rest are verified on the exact sets,
so no pair that is returned is below the threshold.

Scale. A text is normalised once: its prefixes, its letters and its id leave in
packed messages of one shuffle, prefixes to the partition of their node, letters
and id to that of the text's class. Exact copies are one class (a key of their
letters and digits) before anything is paired; classes and members meet only at
the end. A node with more than NODE classes is not paired in the task that finds
it but cut into cells of two groups of classes, which are spread again, so that
what is sent grows with the node times the number of its groups. Nothing is
capped or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowkit import MESSAGE, PACKED, Windows, batch, bucket_ids, by_part, chunks, code_points, cut, letters_and_digits, meet, message_batch, mix, pack, part_of, partitions, ranges, text_key, unpack

TREES, DEEPEST, BEYOND, RECALL = 24, 6, 2, 0.995
SKETCH = 96
NODE, CROWD = 16384, 1024
_SPREAD = 3.4


def forest_floor(threshold: float, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix that reaches the target recall at the threshold if all tries have it."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shortened(threshold: float, floor: int, trees: int = TREES, recall: float = RECALL) -> int:
    """In how many tries a text must shorten its prefix to the floor, with the full prefix in the others."""
    short, full = (np.log1p(-(threshold**d)) for d in (floor, floor + BEYOND))
    return int(np.clip(np.ceil((np.log1p(-recall) - trees * full) / (short - full) - 1e-9), 1, trees)) if short < full else trees


def least_matches(threshold: float) -> int:
    """Fewest equal two-bit sketch values of a pair at the threshold, at _SPREAD deviations."""
    p = threshold + (1 - threshold) / 4
    return int(np.floor(SKETCH * p - _SPREAD * np.sqrt(SKETCH * p * (1 - p))))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    state = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return state[:n] | np.uint32(1), state[n:]


class Pieces:
    """What counts as the set of a text: k characters, or k words."""

    def __init__(self, unit: str, width: int, least: int):
        self.unit, self.width, self.least = unit, width, least

    def prepare(self, text: str | None) -> str | None:
        """The canonical text, or None where the text takes no part."""
        if text is None:
            return None
        if self.unit == "char":
            text = letters_and_digits(text)
            return text if len(text) >= max(self.least, self.width) else None
        words = [w for w in map(letters_and_digits, text.split()) if w]
        return " ".join(words) if len(words) >= max(self.least, self.width) else None

    def exact(self, text: str) -> set[str]:
        k = self.width
        if self.unit == "char":
            return {text[i : i + k] for i in range(len(text) - k + 1)}
        words = text.split(" ")
        return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}

    def hashed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of all pieces of all texts, and where each text's begin."""
        points, lens = code_points(texts)
        ends = np.cumsum(lens)
        if self.unit == "char":
            h = Windows(points).hashes(None, self.width)
            keep = np.ones(len(points), bool)
            for back in range(1, self.width):
                keep[ends - back] = False
            count = lens - self.width + 1
            return (h[keep[: len(h)]] >> np.uint64(32)).astype(np.uint32), np.cumsum(count) - count
        win = Windows(points)
        space = points == 32
        first = np.zeros(len(points), bool)
        first[ends - lens] = True
        first[1:] |= space[:-1]
        word_at = np.flatnonzero(first)
        text_of = np.searchsorted(ends, word_at, side="right")
        per = np.bincount(text_of, minlength=len(texts))
        stop = np.append(word_at[1:], len(points))
        stop = np.where(np.isin(stop, ends), stop, stop - 1)
        last = np.cumsum(per)
        ok = np.arange(len(word_at)) + self.width <= last[text_of]
        at = np.flatnonzero(ok)
        begin, end = word_at[at], stop[at + self.width - 1]
        h = mix((win.sums[end] - win.sums[begin]) * win.inverse[begin])
        count = per - self.width + 1
        return (h >> np.uint64(32)).astype(np.uint32), np.cumsum(count) - count


def _signatures(pieces: Pieces, texts: list[str], n: int) -> np.ndarray:
    a, b = _constants(n)
    out = np.empty((len(texts), n), np.uint32)
    for lo, hi in chunks(texts):
        h, starts = pieces.hashed(texts[lo:hi])
        step = max(1, int(65536 * (hi - lo) / max(1, len(h))))
        bounds = np.append(starts, len(h))
        for i in range(0, hi - lo, step):
            j = min(i + step, hi - lo)
            part, at = h[bounds[i] : bounds[j]], starts[i:j] - bounds[i]
            buf = np.empty_like(part)
            for k in range(n):
                np.multiply(part, a[k], out=buf)
                np.add(buf, b[k], out=buf)
                out[lo + i : lo + j, k] = np.minimum.reduceat(buf, at)
    return out


#: Kinds of messages: prefixes, letters and ids.
_PREFIX, _LETTERS, _IDS = 0, 1, 2


def _kind(kind: int, *arrays: np.ndarray) -> bytes:
    return bytes((kind,)) + pack(*arrays)


def _of_kind(blobs, kind: int) -> list[list[np.ndarray]]:
    return [unpack(b[1:]) for b in blobs if b[0] == kind]


def _strings(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in bytes, and all strings compressed."""
    raw = [v.encode("utf-8", "surrogatepass") for v in values]
    return np.array([len(v) for v in raw], np.uint32), np.frombuffer(zstandard.ZstdCompressor(3).compress(b"".join(raw)), np.uint8)


def _back(lens: np.ndarray, squeezed: np.ndarray, at=None) -> list[str]:
    raw, ends = zstandard.ZstdDecompressor().decompress(squeezed.tobytes()), np.cumsum(lens.astype(np.int64))
    return [raw[ends[i] - int(lens[i]) : ends[i]].decode("utf-8", "surrogatepass") for i in (range(len(lens)) if at is None else at)]


def _plant(pieces: Pieces, trees: int, floor: int, numbers: list[int], text_ids: bool):
    """Batches of ids and texts into packed messages of prefixes, letters and ids."""
    many, depth = len(numbers), floor + BEYOND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            by_key, keyed = {}, []
            for text in rows.column(1).to_pylist():
                p = pieces.prepare(text)
                keyed.append(None if p is None else text_key(p))
                if p is not None:
                    by_key[keyed[-1]] = p
            out = []
            ids, who = rows.column(0).to_pylist(), {}
            for i, c in zip(ids, keyed):
                who[(i, c)] = None
            # an id without a class goes where a hash of nothing does; a null id has no name
            named = [(i, c) for i, c in who if i is not None]
            of = np.array([c or 0 for _, c in named], np.int64)
            lone = np.array([c is None for _, c in named], bool)
            for b, at in by_part(part_of(np.where(lone, np.arange(len(named)), of).view(np.uint64), many), many):
                values = [named[i][0] for i in at]
                stored = _strings(values) if text_ids else (np.array(values, np.int64), np.zeros(0, np.uint8))
                out.append((numbers[b], _kind(_IDS, of[at], lone[at].astype(np.uint8), *stored)))
            if by_key:
                cls, texts = np.fromiter(by_key, np.int64, len(by_key)), list(by_key.values())
                for b, at in by_part(part_of(cls.view(np.uint64), many), many):
                    out.append((numbers[b], _kind(_LETTERS, cls[at], *_strings([texts[i] for i in at]))))
                sig = _signatures(pieces, texts, trees * depth + SKETCH)
                sketch = np.zeros((len(cls), SKETCH // 32), np.uint64)
                for j in range(SKETCH):
                    sketch[:, j // 32] |= (sig[:, trees * depth + j] & np.uint32(3)).astype(np.uint64) << np.uint64(2 * (j % 32))
                node, deep = np.empty((len(cls), trees), np.uint64), np.empty((len(cls), trees), np.uint16)
                for t in range(trees):
                    h = np.full(len(cls), t + 1, np.uint64)
                    for d in range(floor):
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, t * depth + d])
                    node[:, t] = h
                    further = mix(sig[:, t * depth + floor : (t + 1) * depth].astype(np.uint64)) & np.uint64(255)
                    deep[:, t] = (further[:, 0] << np.uint64(8)) | further[:, 1]
                node, deep = node.ravel(), deep.ravel()
                owner = np.repeat(np.arange(len(cls), dtype=np.int64), trees)
                for b, at in by_part(((node >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32), many):
                    mine, count = np.unique(owner[at], return_counts=True)
                    out.append((numbers[b], _kind(_PREFIX, cls[mine], count.astype(np.uint8), sketch[mine].ravel(), node[at].astype(np.uint32), deep[at])))
            yield message_batch(out)

    return run


class _Trie:
    """The prefixes of one partition in sorted order: nodes, and the classes in them."""

    def __init__(self, blobs):
        parts = _of_kind(blobs, _PREFIX)
        cls = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
        self.cls, first, inverse = np.unique(cls, return_index=True, return_inverse=True)
        words = SKETCH // 32
        self.sketch = np.concatenate([p[2].reshape(-1, words) for p in parts] or [np.zeros((0, words), np.uint64)])[first]
        at = inverse[np.repeat(np.arange(len(cls)), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint8)]))]
        key = np.concatenate([p[3] for p in parts] or [np.zeros(0, np.uint32)])
        deep = np.concatenate([p[4] for p in parts] or [np.zeros(0, np.uint16)])
        order = np.lexsort((at, deep, key))
        key, deep, at = key[order], deep[order], at[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))[: len(at)]
        self.key, self.deep, self.at = key[fresh], deep[fresh], at[fresh]
        #: where each node begins, and how many classes it has
        self.begin = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1]))[: len(self.at)]
        self.size = np.diff(np.append(self.begin, len(self.at)))


def _grade(size: np.ndarray, crowd: int) -> np.ndarray:
    """Sizes in a byte, in order: none up to ``crowd``, then eight grades for each doubling."""
    return np.where(size <= crowd, 0, np.minimum(254, 1 + 8 * np.log2(np.maximum(size, crowd) / crowd))).astype(np.uint8)


def _crowds(numbers: list[int], crowd: int = CROWD):
    """How crowded the nodes of each class are, to the partition of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for rows in batches:
            for bucket, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if blob[0] == _PREFIX:
                    blobs.setdefault(bucket, []).append(blob)
        for bucket in list(blobs):
            trie = _Trie(blobs.pop(bucket))
            grade = np.repeat(_grade(trie.size, crowd), trie.size)
            order = np.argsort(trie.at, kind="stable")
            grade, count = grade[order], np.bincount(trie.at, minlength=len(trie.cls))
            start = np.cumsum(count) - count
            for b, who in by_part(part_of(trie.cls.view(np.uint64), len(numbers)), len(numbers)):
                yield message_batch([(numbers[b], pack(np.array([bucket], np.int32), trie.cls[who], count[who].astype(np.uint8), grade[ranges(start[who], count[who])]))])

    return run


def _depths(needed: int):
    """The grade up to which each class shortens its prefixes, to the partitions where it has prefixes that stay long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for rows in batches for x in rows.column(1).to_pylist()]
        if not parts:
            return
        cls, count = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
        grade = np.concatenate([p[3] for p in parts])
        most = np.maximum.reduceat(grade, np.cumsum(count) - count)
        classes, which = np.unique(cls, return_inverse=True)
        order = np.argsort((np.repeat(which, count) << 8) | grade)
        owner = np.repeat(which, count)[order]
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        stop = np.append(begin[1:], len(owner))
        bound = grade[order][np.minimum(begin + needed, stop) - 1]
        edge = np.cumsum([0] + [len(p[1]) for p in parts])
        for p, a, b in zip(parts, edge[:-1], edge[1:]):
            at = a + np.flatnonzero(most[a:b] > bound[which[a:b]])
            yield batch(MESSAGE, p[0], [pack(cls[at], bound[which[at]])])

    return run


_LOW = np.uint64(0x5555555555555555)


def _alike(left: np.ndarray, right: np.ndarray, most_different: int) -> np.ndarray:
    different = np.zeros(len(left), np.uint16)
    for w in range(left.shape[1]):
        x = left[:, w] ^ right[:, w]
        different += np.bitwise_count((x | (x >> np.uint64(1))) & _LOW)
    return different <= most_different


def _emit(numbers: list[int], a: np.ndarray, b: np.ndarray) -> list[tuple[int, bytes]]:
    """Candidate pairs, each once, to the partition of the first."""
    if not len(a):
        return []
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    a, b = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
    return [(numbers[x], _kind(0, a[at], b[at])) for x, at in by_part(part_of(a.view(np.uint64), len(numbers)), len(numbers))]


def _climb(numbers: list[int], most_different: int, node: int = NODE, crowd: int = CROWD):
    """Candidates of each node: pairs of which either has the node as its prefix, or which share the full prefix."""

    def run(messages: pa.Table, depths: pa.Table) -> pa.Table:
        trie = _Trie(messages.column("blob").to_pylist())
        out: list[tuple[int, bytes]] = []
        kept = [unpack(b) for b in depths.column("blob").to_pylist()]
        bound = np.full(len(trie.cls), 255, np.uint8)
        if kept:
            bound[np.searchsorted(trie.cls, np.concatenate([p[0] for p in kept]))] = np.concatenate([p[1] for p in kept])
        at, cls, sketch = trie.at, trie.cls, trie.sketch
        open_ = np.repeat(_grade(trie.size, crowd), trie.size) <= bound[at]
        # a node where no prefix is short falls apart into its full prefixes
        some = np.repeat(np.logical_or.reduceat(open_, trie.begin), trie.size) if len(at) else open_
        part = np.append(True, (trie.key[1:] != trie.key[:-1]) | ~some[1:] & (trie.deep[1:] != trie.deep[:-1]))[: len(at)]
        begin = np.flatnonzero(part)
        size = np.diff(np.append(begin, len(at)))
        group = np.repeat(np.arange(len(begin)), size)
        meets = lambda i, j: open_[i] | open_[j] | (trie.deep[i] == trie.deep[j])
        a, b, held, offset = [], [], 0, 1
        live = np.flatnonzero(np.repeat(size <= node, size)[:-1] & (group[1:] == group[:-1])) if len(at) else at
        while len(live):
            i = live[meets(live, live + offset)]
            x, y = at[i], at[i + offset]
            ok = _alike(sketch[x], sketch[y], most_different)
            a.append(cls[x[ok]])
            b.append(cls[y[ok]])
            held += int(ok.sum())
            if held > 2_000_000:
                out += _emit(numbers, np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
            offset += 1
            live = live[live + offset < len(at)]
            live = live[group[live] == group[live + offset]]
        if a:
            out += _emit(numbers, np.concatenate(a), np.concatenate(b))
        for r in np.flatnonzero(size > node):
            groups = np.array_split(np.arange(begin[r], begin[r] + size[r]), -(-size[r] // node))
            side = [(cls[at[g]], open_[g].astype(np.uint8), trie.deep[g], sketch[at[g]].ravel()) for g in groups]
            for x in range(len(groups)):
                for y in range(x, len(groups)):
                    cell = mix(np.array([int(trie.key[begin[r]]) << 32 | x * len(groups) + y], np.uint64))
                    out.append((numbers[int(part_of(cell, len(numbers))[0])], _kind(1, *side[x], *side[y])))
        return pa.Table.from_batches([message_batch(out)])

    return run


def _cells(numbers: list[int], most_different: int):
    """Cells of large nodes into candidates; candidates pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            blobs = rows.column(1).to_pylist()
            pairs = _of_kind(blobs, 0)
            if pairs:
                yield message_batch(_emit(numbers, *(np.concatenate([p[i] for p in pairs]) for i in range(2))))
            for ca, oa, da, sa, cb, ob, db, sb in _of_kind(blobs, 1):
                sa, sb = sa.reshape(len(ca), -1), sb.reshape(len(cb), -1)
                a, b = [], []
                for i in range(len(ca)):
                    at = np.flatnonzero((oa[i] | ob).astype(bool) | (db == da[i]))
                    ok = _alike(np.broadcast_to(sa[i], (len(at), sa.shape[1])), sb[at], most_different) & (cb[at] != ca[i])
                    a.append(np.full(int(ok.sum()), ca[i]))
                    b.append(cb[at[ok]])
                    if sum(map(len, a[-256:])) > 1_000_000:
                        yield message_batch(_emit(numbers, np.concatenate(a), np.concatenate(b)))
                        a, b = [], []
                if a:
                    yield message_batch(_emit(numbers, np.concatenate(a), np.concatenate(b)))

    return run


def _wanted(messages: pa.Table, keys: np.ndarray) -> dict[int, str]:
    """The letters of the classes with the keys."""
    out: dict[int, str] = {}
    for own, lens, squeezed in _of_kind(messages.column("blob").to_pylist(), _LETTERS):
        at = np.flatnonzero(np.isin(own, keys))
        if len(at):
            out.update(zip(own[at].tolist(), _back(lens, squeezed, at)))
    return out


def _with_first(numbers: list[int]):
    """Candidates, each once, with the letters of the first to the partition of the second."""

    def run(candidates: pa.Table, messages: pa.Table) -> pa.Table:
        out = []
        pairs = _of_kind(candidates.column("blob").to_pylist(), 0)
        if pairs:
            both = np.unique(np.stack([np.concatenate([p[i] for p in pairs]) for i in range(2)], 1), axis=0)
            a, b = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            body = _wanted(messages, a)
            for x, at in by_part(part_of(b.view(np.uint64), len(numbers)), len(numbers)):
                first, local = np.unique(a[at], return_inverse=True)
                out.append((numbers[x], pack(b[at], local.astype(np.uint32), first, *_strings([body[k] for k in first.tolist()]))))
        return pa.Table.from_batches([message_batch(out)])

    return run


_VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _verify(pieces: Pieces, threshold: float):
    """The exact similarity of each candidate, where it is large enough."""

    def run(candidates: pa.Table, messages: pa.Table) -> pa.Table:
        rows: tuple[list, ...] = ([], [], [])
        parts = [unpack(x) for x in candidates.column("blob").to_pylist()]
        body = _wanted(messages, np.unique(np.concatenate([p[0] for p in parts]))) if parts else {}
        for b, local, first, lens, squeezed in parts:
            texts = _back(lens, squeezed)
            last, mine = None, set()
            for i in np.argsort(local, kind="stable"):
                if local[i] != last:
                    last, mine = local[i], pieces.exact(texts[local[i]])
                other = pieces.exact(body[int(b[i])])
                shared = len(mine & other)
                similarity = shared / (len(mine) + len(other) - shared)
                if similarity >= threshold:
                    for column, x in zip(rows, (int(first[local[i]]), int(b[i]), similarity)):
                        column.append(x)
        return pa.Table.from_batches([batch(_VERIFIED, *rows)])

    return run


def _named(text_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string() if text_ids else pa.int64()), ("cls", pa.int64())])
        for rows in batches:
            for cls, lone, values, squeezed in _of_kind(rows.column(1).to_pylist(), _IDS):
                yield batch(schema, _back(values, squeezed) if text_ids else values, pa.array(cls, mask=lone.astype(bool)))

    return run


class Forest:
    """The forest of a table's texts; ``key`` may be of a string or whole-number type."""

    def __init__(self, df: DataFrame, key: Column, text: Column, *, unit: str = "word", width: int = 5, threshold: float = 0.8, least: int = 0, trees: int = TREES, recall: float = RECALL):
        self.pieces, self.threshold, self.trees, self.recall = Pieces(unit, width, least), threshold, trees, recall
        self.floor = forest_floor(threshold, trees, recall)
        self.numbers = bucket_ids(df.sparkSession, partitions(df.sparkSession))
        rows = df.select(key.alias("id"), text.alias("body"))
        kind = rows.schema["id"].dataType.simpleString()
        self.text_ids = kind == "string"
        rows = rows if self.text_ids else rows.select(F.col("id").cast("long").alias("id"), "body")
        self.id_type = kind if self.text_ids else "bigint"
        self.planted = rows.mapInArrow(_plant(self.pieces, trees, self.floor, self.numbers, self.text_ids), PACKED).repartition(len(self.numbers), "bucket")

    def classes(self) -> DataFrame:
        """Pairs ``a < b, similarity`` of class keys whose sets have at least the similarity.

        Null texts and texts with fewer than ``least`` units (or than one shingle)
        take no part. Equal canonical texts are one class and no pair here. An
        empty table gives no row.
        """
        n, different = len(self.numbers), SKETCH - least_matches(self.threshold)
        crowds = self.planted.mapInArrow(_crowds(self.numbers), PACKED).repartition(n, "bucket")
        depths = crowds.mapInArrow(_depths(shortened(self.threshold, self.floor, self.trees, self.recall)), PACKED).repartition(n, "bucket")
        found = meet(self.planted, depths, _climb(self.numbers, different)).repartition(n, "bucket")
        candidates = found.mapInArrow(_cells(self.numbers, different), PACKED).repartition(n, "bucket")
        first = meet(candidates, self.planted, _with_first(self.numbers)).repartition(n, "bucket")
        return meet(first, self.planted, _verify(self.pieces, self.threshold), "a long, b long, similarity double")

    def members(self) -> DataFrame:
        """``id, cls``: one row for each key, ``cls`` null where the text takes no part.

        Rows that repeat a key count once. A key with several texts has a row for
        each class that it has. A null key has none.
        """
        rows = self.planted.mapInArrow(_named(self.text_ids), f"id {self.id_type}, cls long")
        return rows.repartition(len(self.numbers), "cls", "id").distinct()


def near_duplicate_pairs(df: DataFrame, key: Column, text: Column, **how) -> DataFrame:
    """``id_a < id_b`` of all records whose texts are equal or near duplicates.

    The result names every pair of records, so it grows with the square of a
    group of copies; `near_duplicate_groups` doesn't.
    """
    forest = Forest(df, key, text, **how)
    pairs = forest.classes()
    members = forest.members().where("cls is not null")
    left = members.select(F.col("id").alias("x"), F.col("cls").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    apart = pairs.join(left, "a").join(right, "b").select("x", "y")
    same = left.join(right, left.a == right.b).where("x < y").select("x", "y")
    every = apart.where("x <> y").unionByName(same)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: Column, text: Column, **how) -> DataFrame:
    """One row for each key: ``id, group_key, links``.

    ``group_key`` is the smallest class key that is reached over links; null for
    texts that take no part. ``links`` counts the other classes that the
    record's class is linked with. Copies are never paired.
    """
    forest = Forest(df, key, text, **how)
    pairs = cut(forest.classes().select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count("*").alias("links")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        up = label.select(F.col("a").alias("root"), F.col("root").alias("above"))
        after = cut(label.join(near, "a").join(up, "root", "left").select("a", F.least("root", "other", "above").alias("root"), "links", (F.least("root", "other", "above") < F.col("root")).alias("moved")))
        label = after.select("a", "root", "links")
        if not after.where("moved").head(1):
            break
    members = forest.members()
    return members.join(label, members.cls == label.a, "left").select("id", F.coalesce("root", "cls").alias("group_key"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
