"""The k most similar vectors of every vector: multi-index hashing.

A rotation is learned (iterative quantisation over the principal directions) on
a bounded sample and turns each vector into sign bits: an index code of BITS bits
and a check code of as many. The index code is split into m substrings, as many
as make probing cheapest, and each substring is an index of its own. Two codes within
the Hamming radius r agree in some substring up to floor(r / m) bits
(pigeonhole), so probing every value within that distance of a substring
retrieves every code within the radius, and many a bit farther, which count up
to KEPT. A pair is reported by the first substring that retrieves it, so it comes
once, and only if its check codes are also near. Vectors of retrieved pairs are then brought together and ranked by
the cosine in double precision.

Codes retrieve near vectors only: a pair of cosine 0.9 passes both with a chance
of 0.95 if its sign bits are independent, one of 0.8 with half. And codes don't
tell apart the vectors of a dense cluster: a class with more than DENSE partners
under one value of a substring is not paired with others of that kind. So a
vector that has fewer than k neighbours then, or whose k-th is less similar than
FLOOR, or that is dense, is compared with all vectors. That is exact: ASKED such
vectors at a time go to every task that reads the table, which returns what is
at least as similar as the k-th neighbour known so far. The cost is the number of
such vectors times that of all, in time; nothing but the result is shuffled.

The sample is the only bounded thing: about SAMPLE vectors with the smallest hash
of their key. Every vector is indexed and is a query.

Scale. Equal vectors are one class, of which the k + 1 smallest keys can be
neighbours; more can't matter, and a batch sends no more of them. Substring
indexes are spread by the leading bits of the substring, a code goes to the
partitions within the probing distance. For the ranking each class takes the
smallest class among itself and its retrieved neighbours as its home; a vector
goes to its home and to the homes of its neighbours, so that similar vectors meet
while a vector travels a few times. Vectors travel in packed messages.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowkit import PACKED, batch, bucket_ids, by_part, cut, meet, message_batch, mix, pack, part_of, partitions, ranges, unpack

BITS, RADIUS, KEPT, CHECK_RADIUS, SAMPLE, ROUNDS = 64, 11, 15, 14, 8192, 25
DECIMALS = 6
FLOOR, DENSE, SEEN, ASKED = 0.9, 2048, 4096, 16384
ALONE = 2


def learn_rotation(sample: np.ndarray, bits: int = 2 * BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation that make sign bits of centred vectors (iterative quantisation)."""
    dim = sample.shape[1]
    bits = min(bits, dim)
    mean = sample.mean(0)
    _, axes = np.linalg.eigh(np.cov((sample - mean).T) + 1e-12 * np.eye(dim))
    basis = axes[:, ::-1][:, :bits]
    projected = (sample - mean) @ basis
    turn = np.linalg.qr(np.random.default_rng(bits).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (left @ right).T
    return mean, basis @ turn


def substrings(n: int, bits: int = BITS, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Shift and width of each substring: as many as make probing n codes cheapest.

    Probing a substring takes, for each flip of up to floor(radius / m) of its
    bits, a look-up of each value that occurs and a comparison of each pair that
    meets; a look-up takes about six times as long.
    """
    best: tuple[float, int] | None = None
    for m in range(max(1, math.ceil(bits / 30)), max(2, bits // 8) + 1):
        width = bits / m
        flips = sum(math.comb(math.ceil(width), k) for k in range(radius // m + 1))
        cost = m * flips * (6 * min(n, 2**width) + n * n / 2 ** (width + 1))
        if best is None or cost < best[0]:
            best = cost, m
    m = best[1]
    edges = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float32 matrix of the vectors that take part."""
    import pyarrow.compute as pc

    lens = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lens == dim)
    flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def _class_keys(x: np.ndarray) -> np.ndarray:
    """Equal vectors have equal keys (minus zero counts as zero)."""
    bits = (x + 0.0).view(np.uint64)
    key = np.full(len(x), 0x51ED270B, np.uint64)
    for j in range(bits.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, j])
    return key.view(np.int64)


def _classes(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class keys, a place of each class, how many of its smallest keys follow (k + 1 at most), and these."""
    cls = _class_keys(x)
    order = np.lexsort((ids, cls))
    cls, ids = cls[order], ids[order]
    begin = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))[: len(cls)]
    count = np.minimum(np.diff(np.append(begin, len(cls))), k + 1)
    return cls[begin], order[begin], count, ids[ranges(begin, count)]


def _vectors(numbers: list[int], dim: int, k: int):
    """Vectors into packed messages, one for each partition of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, x = _usable(rows.column(1), dim)
            if not len(x):
                continue
            cls, place, count, keys = _classes(x, rows.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64), k)
            x, start = _small(x[place]), np.cumsum(count) - count
            yield message_batch([(numbers[b], pack(cls[i], count[i].astype(np.uint8), keys[ranges(start[i], count[i])], x[i].ravel())) for b, i in by_part(part_of(cls.view(np.uint64), len(numbers)), len(numbers))])

    return run


def _small(x: np.ndarray) -> np.ndarray:
    """In single precision where that loses nothing."""
    single = x.astype(np.float32)
    return single if (single == x).all() else x


def _members(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, x = _usable(rows.column(1), dim)
            yield batch(_MEMBER, rows.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64), _class_keys(x))

    return run


_MEMBER = pa.schema([("vec_id", pa.int64()), ("cls", pa.int64())])
_INDEX = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def _layout(parts: list[tuple[int, int]], spread: int) -> int:
    return len(parts) << spread


def _packed(signs: np.ndarray) -> np.ndarray:
    code = np.zeros(len(signs), np.uint64)
    for j in range(signs.shape[1]):
        code |= signs[:, j].astype(np.uint64) << np.uint64(j)
    return code


def _index(dim: int, bits: int, mean: np.ndarray, rotation: np.ndarray, parts: list[tuple[int, int]], spread: int, near: int):
    """Codes, sent to every partition of each substring that probes them."""
    flips = [f for f in range(1 << spread) if f.bit_count() <= near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            _, x = _usable(rows.column(0), dim)
            if not len(x):
                continue
            cls, first = np.unique(_class_keys(x), return_index=True)
            x = x[first] / np.linalg.norm(x[first], axis=1, keepdims=True)
            signs = (x - mean) @ rotation > 0
            code, check = _packed(signs[:, :bits]), _packed(signs[:, bits:])
            ids, blobs = [], []
            for j, (shift, width) in enumerate(parts):
                lead = (code >> np.uint64(shift + width - spread)) & np.uint64((1 << spread) - 1)
                for p in range(1 << spread):
                    at = np.flatnonzero(lead == p)
                    if len(at):
                        blob = np.int64(len(at)).tobytes() + cls[at].tobytes() + code[at].tobytes() + check[at].tobytes()
                        for f in flips:
                            ids.append((j << spread) | (p ^ f))
                            blobs.append(blob)
            yield batch(_INDEX, np.array(ids, np.int32), blobs)

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _probe(parts: list[tuple[int, int]], spread: int, radius: int, kept: int, check_radius: int, dense: int):
    """Every pair of codes within the radius that this substring is the first to retrieve."""
    near = radius // len(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[bytes]] = {}
        for rows in batches:
            for part, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                by_part.setdefault(part, []).append(blob)
        for part, blobs in by_part.items():
            j, home = part >> spread, part & ((1 << spread) - 1)
            shift, width = parts[j]
            sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
            cls = np.concatenate([np.frombuffer(b, np.int64, n, 8) for b, n in zip(blobs, sizes)])
            code, check = (np.concatenate([np.frombuffer(b, np.uint64, n, 8 + k * n) for b, n in zip(blobs, sizes)]) for k in (8, 16))
            cls, first = np.unique(cls, return_index=True)
            code, check = code[first], check[first]
            sub = (code >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(sub, kind="stable")
            cls, code, check, sub = cls[order], code[order], check[order], sub[order]
            value, begin, count = np.unique(sub, return_index=True, return_counts=True)
            mine = np.flatnonzero((value >> np.uint64(width - spread)) == home)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            near_by = lambda i, k: (np.bitwise_count(code[i] ^ code[k]) <= kept) & (np.bitwise_count(check[i] ^ check[k]) <= check_radius)
            crowded = np.zeros(len(cls), bool)
            for g in np.flatnonzero(count > dense):
                # counted on members at even steps; which way a class goes doesn't change its result
                span = np.arange(begin[g], begin[g] + count[g])
                some = span[:: max(1, len(span) // SEEN)]
                for lo in range(0, len(span), 256):
                    i = span[lo : lo + 256]
                    crowded[i] = near_by(i[:, None], some[None, :]).sum(1) * len(span) > dense * len(some)
            if crowded.any():
                # a pair with itself names a crowded class
                yield batch(_PAIR, cls[crowded], cls[crowded])
            for mask in itertools.chain.from_iterable(itertools.combinations(range(width), k) for k in range(near + 1)):
                flip = np.uint64(sum(1 << b for b in mask))
                other = value[mine] ^ flip
                at = np.minimum(np.searchsorted(value, other), len(value) - 1)
                hit = value[at] == other
                for i, k in _meetings(begin, count, mine[hit], at[hit], crowded):
                    ok = (cls[i] < cls[k]) & ~(crowded[i] & crowded[k])
                    i, k = i[ok], k[ok]
                    ok = near_by(i, k)
                    i, k = i[ok], k[ok]
                    x = code[i] ^ code[k]
                    for s, w in parts[:j]:
                        ok = np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)) > near
                        i, k, x = i[ok], k[ok], x[ok]
                    found.append((cls[i], cls[k]))
                    held += len(i)
                    if held > 1_000_000:
                        yield batch(_PAIR, *(np.concatenate(c) for c in zip(*found)))
                        found, held = [], 0
            if found:
                yield batch(_PAIR, *(np.concatenate(c) for c in zip(*found)))

    return run


def _meetings(begin: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray, crowded: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places of the left values with all of the right ones, about ``most`` at a time; of large values no two crowded ones."""
    work = count[left] * count[right]
    large = work > most
    for l, r in zip(left[large], right[large]):
        lefts, rights = np.arange(begin[l], begin[l] + count[l]), np.arange(begin[r], begin[r] + count[r])
        for some, others in ((lefts[~crowded[lefts]], rights), (lefts[crowded[lefts]], rights[~crowded[rights]])):
            step = max(1, most // max(1, len(others)))
            for lo in range(0, len(some) if len(others) else 0, step):
                i = some[lo : lo + step]
                yield np.repeat(i, len(others)), np.tile(others, len(i))
    left, right, work = left[~large], right[~large], work[~large]
    if len(work):
        group = np.cumsum(work) // most
        edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(work))
        for lo, hi in zip(edges[:-1], edges[1:]):
            l, r = left[lo:hi], right[lo:hi]
            yield np.repeat(ranges(begin[l], count[l]), np.repeat(count[r], count[l])), ranges(np.repeat(begin[r], count[l]), np.repeat(count[r], count[l]))


_RANKED = pa.schema([("cls", pa.int64()), ("near", pa.list_(pa.int64())), ("last", pa.float64()), ("vector", pa.binary())])


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(s: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k + 1 most similar keys, best first."""
    if len(s) > 8 * (k + 1):
        cut_at = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
        near = np.flatnonzero(s >= cut_at)
    else:
        near = np.arange(len(s))
    return near[np.lexsort((key[near], -s[near]))[: k + 1]]


def _seats(numbers: list[int]):
    """``cls, home, own`` into packed messages, one for each partition of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            cls, home, own = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield message_batch([(numbers[b], pack(cls[at], home[at], own[at].astype(np.uint8))) for b, at in by_part(part_of(cls.view(np.uint64), len(numbers)), len(numbers))])

    return run


class _Held:
    """Packed vectors of one partition: each class once, with its k + 1 smallest keys."""

    def __init__(self, blobs: list[bytes], dim: int, k: int):
        parts = [unpack(b) for b in blobs]
        owner = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        keys = np.concatenate([p[2] for p in parts])
        order = np.lexsort((keys, owner))
        owner, keys = owner[order], keys[order]
        fresh = np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))
        owner, keys = owner[fresh], keys[fresh]
        self.cls, begin = np.unique(owner, return_index=True)
        self.count = np.minimum(np.diff(np.append(begin, len(owner))), k + 1)
        self.keys = keys[ranges(begin, self.count)]
        self.start = np.cumsum(self.count) - self.count
        _, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        self.x = np.concatenate([p[3].reshape(-1, dim) for p in parts])[first]

    def packed(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.cls[at], self.count[at].astype(np.uint8), self.keys[ranges(self.start[at], self.count[at])], self.x[at].ravel()]


def _seated(numbers: list[int], dim: int, k: int):
    """Vectors to the partitions of the homes where they have a seat; those without one are alone."""

    def run(vectors: pa.Table, seats: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows:
            held = _Held(vectors.column("blob").to_pylist(), dim, k)
            parts = [unpack(b) for b in seats.column("blob").to_pylist()]
            cls, home, own = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(3))
            # own seats first, so that they stay
            order = np.lexsort((1 - own.astype(np.int8), home, cls))
            cls, home, own = cls[order], home[order], own[order]
            fresh = np.append(True, (cls[1:] != cls[:-1]) | (home[1:] != home[:-1]))[: len(cls)]
            cls, home, own = cls[fresh], home[fresh], own[fresh]
            alone = np.setdiff1d(held.cls, cls[own == 1])
            at = np.searchsorted(held.cls, np.concatenate([cls, alone]))
            # a home that no class names
            home = np.concatenate([home, mix(alone.view(np.uint64)).view(np.int64)])
            own = np.concatenate([own, np.full(len(alone), ALONE)]).astype(np.uint8)
            for b, i in by_part(part_of(home.view(np.uint64), len(numbers)), len(numbers)):
                out.append((numbers[b], pack(home[i], own[i], *held.packed(at[i]))))
        return pa.Table.from_batches([message_batch(out)])

    return run


def _rank(dim: int, k: int, floor: float):
    """Rank the vectors that met in one home; for its own classes the best k + 1 keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for rows in batches for x in rows.column(1).to_pylist()]
        if not parts:
            return
        home, own, cls, count, keys = (np.concatenate([p[i] for p in parts]) for i in range(5))
        raw = np.concatenate([p[5].reshape(-1, dim) for p in parts])
        del parts
        count = count.astype(np.int64)
        start = np.cumsum(count) - count
        order = np.argsort(home, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, home[order][1:] != home[order][:-1])), len(order))
        out: tuple[list, ...] = ([], [], [], [])
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            x, key = _units(raw[at]), keys[ranges(start[at], count[at])]
            holder = np.repeat(np.arange(len(at)), count[at])
            queries = np.flatnonzero(own[at])
            for lo in range(0, len(queries), 512):
                q = queries[lo : lo + 512]
                for row, c in zip(np.round(x[q] @ x.T, DECIMALS) + 0.0, q):
                    s = row[holder]
                    best = _best(s, key, k)
                    last = float(s[best[-1]]) if len(best) > k and own[at[c]] != ALONE else -2.0
                    for column, value in zip(out, (int(cls[at[c]]), key[best].tolist(), last, raw[at[c]].tobytes() if last < floor else None)):
                        column.append(value)
            if len(out[0]) > 4096:
                yield batch(_RANKED, *out)
                out = ([], [], [], [])
        yield batch(_RANKED, *out)

    return run


_SCANNED = pa.schema([("cls", pa.int64()), ("key", pa.int64()), ("sim", pa.float64())])


def _scan(asked, dim: int, k: int):
    """Of the rows of one task the k + 1 most similar to each asked vector that may count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, x, last = asked.value
        x = _units(x)
        least = last.copy()
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for rows in batches:
            at, y = _usable(rows.column(1), dim)
            if not len(y):
                continue
            y, ids = _units(y), rows.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            found = [held]
            for lo in range(0, len(cls), 512):
                sims = x[lo : lo + 512] @ y.T
                bound = least[lo : lo + 512]
                open_ = np.flatnonzero(bound < -1)
                if len(open_) and len(ids) > k:
                    bound = bound.copy()
                    bound[open_] = np.round(np.partition(sims[open_], len(ids) - k - 1, axis=1)[:, len(ids) - k - 1], DECIMALS)
                i, j = np.nonzero(sims >= bound[:, None] - 10.0**-DECIMALS)
                found.append([i + lo, ids[j], np.round(sims[i, j], DECIMALS) + 0.0])
            q, key, sim = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((key, -sim, q))
            q, key, sim = q[order], key[order], sim[order]
            begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))[: len(q)]
            size = np.diff(np.append(begin, len(q)))
            full = size > k
            least[q[begin[full]]] = np.maximum(least[q[begin[full]]], sim[begin[full] + k])
            keep = np.arange(len(q)) - np.repeat(begin, size) <= k
            held = [q[keep], key[keep], sim[keep]]
        q, key, sim = held
        good = sim >= last[q]
        yield batch(_SCANNED, cls[q[good]], key[good], sim[good])

    return run


def _completed(ranked: DataFrame, rows: DataFrame, dim: int, k: int) -> DataFrame:
    """``cls, near``: classes whose last neighbour lies below the floor, of which ``ranked`` has the vectors, are compared with all."""
    spark = ranked.sparkSession
    short = ranked.where("vector is not null").select("cls", "last", "vector")
    passes = math.ceil(short.count() / (0.9 * ASKED))
    if not passes:
        return ranked.select("cls", "near")
    best = None
    for turn in range(passes):
        # a pass has at most about ASKED vectors; no more are ever on the driver
        part = short.where(F.pmod(F.xxhash64("cls"), F.lit(passes)) == turn).toArrow()
        raw = [np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in part.column("vector").to_pylist()]
        asked = spark.sparkContext.broadcast((part.column("cls").to_numpy(), np.stack(raw) if raw else np.zeros((0, dim)), part.column("last").to_numpy()))
        found = rows.mapInArrow(_scan(asked, dim, k), "cls long, key long, sim double")
        place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("sim"), "key"))
        top = cut(found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("best")).select("cls", F.col("best.key").alias("near")))
        asked.unpersist()
        best = top if best is None else best.unionByName(top)
    return ranked.where("vector is null").select("cls", "near").unionByName(best)


def _sample(vectors: DataFrame, dim: int, size: int, n: int) -> np.ndarray:
    # twice as many as wanted pass the hash, so that few rows are sorted
    of = max(1, n // (2 * size))
    rows = vectors.where((F.pmod(F.xxhash64("key"), F.lit(of)) == 0) & (F.size("vector") == dim)).orderBy(F.xxhash64("key"), "key").limit(size).select("vector").toArrow()
    if not rows.num_rows:
        return np.zeros((0, dim))
    _, x = _usable(rows.column(0).combine_chunks(), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def nearest_vectors(df: DataFrame, key: Column, vector: Column, *, k: int = 5, dim: int = 128, bits: int = BITS, radius: int = RADIUS, kept: int = KEPT, check_radius: int = CHECK_RADIUS, sample: int = SAMPLE, count: int | None = None, floor: float = FLOOR, dense: int = DENSE) -> DataFrame:
    """``vec_id, near``: for each usable vector the k most similar others, best first.

    Similarity is the cosine rounded to DECIMALS; among equals the smaller key
    comes first. Null, wrongly long, non-finite and all-zero vectors take no
    part, and no row has them. Keys are unique longs. Fewer than k are given
    only where the table has fewer others. ``sample`` bounds the vectors that the
    rotation is learned on, and nothing else. Vectors whose k-th neighbour has a
    similarity below ``floor``, and those with more than ``dense`` partners under
    one value of a substring, are compared with all.
    """
    spark = df.sparkSession
    rows = df.select(key.cast("long").alias("key"), vector.alias("vector")).where("key is not null and vector is not null")
    n = rows.count() if count is None else count
    train = _sample(rows, dim, sample, n)
    if len(train) < 2:
        train = np.eye(dim)
    mean, rotation = learn_rotation(train, 2 * bits)
    bits = min(bits, rotation.shape[1])
    parts = substrings(n, bits, radius)
    near = radius // len(parts)
    # a partition of a substring is home to about two million codes; at least two partitions each
    spread = min(min(w for _, w in parts), max(1, math.ceil(math.log2(max(1, n / 2_000_000)))))
    codes = rows.select("vector").mapInArrow(_index(dim, bits, mean, rotation, parts, spread, near), "part int, blob binary").repartitionById(_layout(parts, spread), "part")
    every = cut(codes.mapInArrow(_probe(parts, spread, radius, kept, check_radius, dense), "a long, b long"))
    pairs, crowded = every.where("a <> b"), every.where("a = b").select(F.col("a").alias("cls")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    homes = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("cls"), F.least("a", "least").alias("home")).join(crowded, "cls", "left_anti")
    visits = both.join(homes.withColumnRenamed("cls", "a"), "a").select(F.col("b").alias("cls"), "home", F.lit(False).alias("own"))
    # a crowded class has not met all its neighbours: it sits alone, and is compared with all
    stays = homes.select("cls", "home", F.lit(True).alias("own"))
    numbers = bucket_ids(spark, partitions(spark))
    size = len(numbers)
    held = rows.mapInArrow(_vectors(numbers, dim, k), PACKED).repartition(size, "bucket")
    seats = visits.unionByName(stays).mapInArrow(_seats(numbers), PACKED).repartition(size, "bucket")
    seated = meet(held, seats, _seated(numbers, dim, k)).repartition(size, "bucket")
    ranked = cut(seated.mapInArrow(_rank(dim, k, floor), "cls long, near array<long>, last double, vector binary"))
    done = _completed(ranked, rows, dim, k)
    members = rows.mapInArrow(_members(dim), "vec_id long, cls long")
    return members.join(done, "cls").select("vec_id", F.slice(F.array_remove("near", F.col("vec_id")), 1, k).alias("near"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """``vec_id_a < vec_id_b``: one is among the nearest of the other."""
    pairs = near.select("vec_id", F.explode("near").alias("other"))
    return pairs.select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
