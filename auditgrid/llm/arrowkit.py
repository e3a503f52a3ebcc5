"""Vectorised text helpers shared by the operators of this folder.

Texts of an Arrow batch are handled as one flat array of code points with
offsets, so that hashing and scanning run in numpy over the whole batch.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Code points that are handled at a time; bounds the memory of one step.
CHUNK_POINTS = 1_000_000


def partitions(spark: SparkSession) -> int:
    """Reduce partitions as the cluster has them set."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only where no such folder is set on one machine (tests), one in the warehouse
    folder is used and set; on a cluster that is an error, as its executors share
    no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(root or shared_dir(spark, "cut"))
    return df.checkpoint(eager=True)


_DROP_ASCII = {i: None for i in range(128) if not chr(i).isalnum()}


def letters_and_digits(text: str) -> str:
    """NFKC, case-folded, only characters that are letters or digits."""
    if text.isascii():
        return text.lower().translate(_DROP_ASCII)
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


def text_key(text: str) -> int:
    """A signed 64-bit key of a text; every use verifies the texts behind it."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the length of each text."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.fromiter(map(len, texts), np.int64, len(texts))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_POINTS characters each; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_POINTS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Windows:
    """Hashes of all windows of any width over a flat code point array.

    A window's hash depends on its characters only. Prefix sums of
    c[i] * m**i modulo 2**64 give each width in one subtraction.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.inverse = np.full(n + 1, _MULT_INV, np.uint64)
        self.inverse[:1] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        powers = np.full(n, _MULT, np.uint64)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers, out=self.sums[1:])

    def hashes(self, starts: np.ndarray | None, width: int) -> np.ndarray:
        """Hash of [start, start + width) for each start; None: for all starts."""
        if starts is None:
            n = max(0, len(self.sums) - width)
            return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])
        return mix((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    out = np.ones(int(ends[-1]), np.int64)
    live = counts > 0
    s, c, e = starts[live], counts[live], ends[live]
    if not len(s):
        return np.zeros(0, np.int64)
    out[0] = s[0]
    out[e[:-1]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each 64-bit key."""
    return ((mix(keys.astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each partition that has any."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), order[bounds[b] : bounds[b + 1]]


#: What a batch has for a partition: the partition's number and packed arrays.
MESSAGE = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
PACKED = "bucket int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays)] + [len(a) for a in arrays] + [ord(a.dtype.char) for a in arrays], np.int64)
    return b"".join([head.tobytes()] + [a.tobytes() for a in arrays])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for size, kind in zip(head[:n], head[n:]):
        out.append(np.frombuffer(blob, np.dtype(chr(kind)), int(size), at))
        at += out[-1].nbytes
    return out


def message_batch(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return batch(MESSAGE, np.array([b for b, _ in out], np.int32), [x for _, x in out])


def bucket_ids(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n hash partitions that is put there."""
    found = spark.range(0, 64 * n + 64, 1, 1).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).orderBy("p").collect()
    return [r.i for r in found]


def meet(left: DataFrame, right: DataFrame, function, schema: str = PACKED) -> DataFrame:
    """Messages of two kinds that have one bucket, through a function of two Arrow tables."""
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(function, schema)
