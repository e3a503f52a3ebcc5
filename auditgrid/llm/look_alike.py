"""One form for texts that look the same.

Arrow text becomes numpy code points; lookup tables give each code point its
replacement (none, one or several code points), which expansion offsets lay out;
marks are put into canonical order and composed with their base vectorially. No
string call is made for a row.

The form drops what is not drawn (zero-width and direction signs, soft hyphens,
variation selectors, tags, control characters other than tab and line breaks),
turns spaces of any width into a space and hyphens into a hyphen-minus, wide,
narrow and joined signs into plain ones, look-alike Cyrillic, Greek and Armenian
letters into the Latin ones, and composes accents. It keeps letter case, accents,
digits, line breaks and the number of spaces. Superscript, circled and squared
signs are drawn otherwise and stay. Hangul is kept as conjoining letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrowkit import CHUNK_POINTS, Windows, batch, mix, partitions, ranges

# Letters that are drawn like a basic Latin letter in common sans-serif type, of Cyrillic, Greek, Armenian,
# Cherokee and Lisu, and phonetic signs, in the order of their Latin letters. A letter that lacks a part (a dotless i) is another.
LOOK_ALIKE = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "ԀᎠꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻҺꓧ",
    "I": "ІΙӀꓲ", "J": "ЈᎫͿꓙ", "K": "КΚᏦKꓗ", "L": "Ꮮꓡ", "M": "МΜᎷϺꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ",
    "Q": "Ԛ", "R": "ᎡꓣᏒ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ",
    "Y": "ΥУҮꓬ", "Z": "ΖᏃꓜ", "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ցɡ", "h": "һհᏂ",
    "i": "іᎥ", "j": "јϳյ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ",
    "u": "ս", "v": "ѵν", "w": "ԝѡ", "x": "х", "y": "уү",
}
# Hyphens and signs of the same shape.
HYPHENS = "‐‑‒–⁃−˗﹣－"
# Marks and fillers without a shape that are not in the category of format characters.
UNDRAWN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Format characters that are drawn.
DRAWN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"
_KEPT_CONTROL = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x85"
_OPENED = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")


class Tables:
    """count and start of each code point's replacement in flat; marks; compositions."""

    def __init__(self) -> None:
        latin = {ord(c): ord(k) for k, v in LOOK_ALIKE.items() for c in v}
        top = 0x110000
        self.count = np.ones(top, np.uint8)
        self.start = np.arange(top, dtype=np.int32)
        self.order = np.zeros(top, np.uint8)
        self.alnum = np.zeros(top, bool)
        extra: list[int] = []
        pairs: dict[int, int] = {}

        def opened(c: int) -> list[int]:
            ch = chr(c)
            if c in latin:
                return [latin[c]]
            if ch in HYPHENS:
                return [0x2D]
            kind = unicodedata.category(ch)
            if ch in UNDRAWN or kind == "Cf" and ch not in DRAWN_FORMAT or kind == "Cc" and ch not in _KEPT_CONTROL or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
                return []
            if kind == "Zs" and c != 0x1680:
                return [0x20]
            if 0xAC00 <= c < 0xD7A4:
                s = c - 0xAC00
                return [0x1100 + s // 588, 0x1161 + s % 588 // 28] + ([0x11A7 + s % 28] if s % 28 else [])
            parts = unicodedata.decomposition(ch).split()
            if not parts:
                return [c]
            if parts[0][0] == "<":
                inner = [int(p, 16) for p in parts[1:]]
                letters = all(unicodedata.category(chr(i))[0] in "LN" for i in inner)
                if parts[0] not in _OPENED or parts[0] == "<compat>" and not letters:
                    return [c]
            else:
                inner = [int(p, 16) for p in parts]
            return [y for x in inner for y in opened(x)]

        for c in range(top):
            if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0x20000 <= c < 0xE0000 and not 0x2F800 <= c < 0x2FA20 or c >= 0xF0000:
                if c < 0x40000 and 0x20000 <= c:
                    self.alnum[c] = chr(c).isalnum()
                continue
            ch = chr(c)
            self.order[c] = unicodedata.combining(ch)
            self.alnum[c] = ch.isalnum()
            new = opened(c)
            if new != [c]:
                self.count[c], self.start[c] = len(new), top + len(extra)
                extra += new
            pair = unicodedata.decomposition(ch).split()
            if len(pair) == 2 and pair[0][0] != "<":
                a, b = (int(p, 16) for p in pair)
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    a, b = latin.get(a, a), latin.get(b, b)
                    # a look-alike base composes to what the Latin base composes to
                    whole = unicodedata.normalize("NFC", chr(a) + chr(b))
                    pairs[a << 21 | b] = ord(whole) if len(whole) == 1 else c
        self.flat = np.concatenate([np.arange(top, dtype=np.uint32), np.array(extra, np.uint32)])
        keys = sorted(pairs)
        self.pair = np.array(keys, np.int64)
        self.whole = np.array([pairs[k] for k in keys], np.uint32)
        self.plain = (self.count == 1) & (self.start == np.arange(top)) & (self.order == 0)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _sort_marks(points: np.ndarray, order: np.ndarray, first: np.ndarray) -> None:
    """Marks after one base into canonical order, in place; equal classes keep theirs."""
    wrong = (order[:-1] > order[1:]) & (order[1:] > 0) & ~first[1:]
    if not wrong.any():
        return
    run = np.cumsum((order == 0) | first)
    touched = np.zeros(int(run[-1]) + 1, bool)
    touched[run[1:][wrong]] = True
    at = np.flatnonzero((order > 0) & touched[run])
    new = at[np.lexsort((order[at], run[at]))]
    points[at], order[at] = points[new], order[new]


def _compose(points: np.ndarray, order: np.ndarray, first: np.ndarray, t: Tables) -> np.ndarray:
    """Compose bases with their marks, in place; returns which points remain.

    ``first`` marks where a text begins, before which nothing is a base.
    """
    remain = np.ones(len(points), bool)
    marks = np.flatnonzero(order > 0)
    if not len(marks):
        return remain
    text = np.cumsum(first)
    starters = np.flatnonzero(order == 0)
    slot = np.searchsorted(starters, marks) - 1
    marks, slot = marks[slot >= 0], slot[slot >= 0]
    base = starters[slot]
    same = text[base] == text[marks]
    marks, base = marks[same], base[same]
    while len(marks):
        before = np.zeros(len(marks), np.int64)
        follows = np.append(False, base[1:] == base[:-1])
        before[1:] = np.where(follows[1:], order[marks[:-1]], 0)
        key = (points[base].astype(np.int64) << 21) | points[marks]
        at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        ok = (t.pair[at] == key) & (before < order[marks])
        hit = np.flatnonzero(ok)
        if not len(hit):
            break
        hit = hit[np.append(True, base[hit][1:] != base[hit][:-1])]
        points[base[hit]] = t.whole[at[hit]]
        remain[marks[hit]] = False
        left = np.ones(len(marks), bool)
        left[hit] = False
        marks, base = marks[left], base[left]
    return remain


def fold(points: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form of texts that are given and returned as code points and lengths."""
    t = tables()
    if t.plain[points].all():
        return points, lens
    n = t.count[points].astype(np.int64)
    out = t.flat[ranges(t.start[points].astype(np.int64), n)]
    edge = np.append(0, np.cumsum(n))
    ends = np.cumsum(lens)
    new = edge[ends] - edge[ends - lens]
    order = t.order[out]
    first = np.zeros(len(out) + 1, np.int64)
    np.add.at(first, np.cumsum(new) - new, 1)
    begins = first[:-1] > 0
    if order.any():
        _sort_marks(out, order, begins)
        remain = _compose(out, np.where(begins, 0, order), begins, t)
        gone = np.append(0, np.cumsum(~remain))
        stop = np.cumsum(new)
        new = new - (gone[stop] - gone[stop - new])
        out = out[remain]
    return out, new


def to_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and their lengths; null is empty."""
    column = column.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
    raw = column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    data = np.frombuffer(raw, np.uint8)
    points = np.frombuffer(raw.to_pybytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    edge = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    at = offsets.astype(np.int64) - int(offsets[0])
    return points, edge[at[1:]] - edge[at[:-1]]


def from_points(points: np.ndarray, lens: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    edge = np.append(0, np.cumsum(width))
    offsets = edge[np.append(0, np.cumsum(lens))].astype(np.int32)
    column = pa.StringArray.from_buffers(len(lens), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
    return column if null is None or not null.any() else pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), column)


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ranges of rows with at most about CHUNK_POINTS bytes each."""
    import pyarrow.compute as pc

    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // CHUNK_POINTS
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(size)) if len(size) else [0]
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(lo), *to_points(column.slice(int(lo), int(hi - lo)))


def row_keys(points: np.ndarray, lens: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit key of each text, from its code points only."""
    ends = np.cumsum(lens)
    win = Windows(points ^ np.uint32(salt)) if salt else Windows(points)
    starts = ends - lens
    inverse = win.inverse[starts]
    return mix((win.sums[ends] - win.sums[starts]) * inverse + lens.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _forms(id_type: pa.DataType, schema: pa.Schema, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for rows in batches:
            text = rows.column(1).cast(pa.string())
            for lo, points, lens in _pieces(text):
                out, new = fold(points, lens)
                ids = rows.column(0).slice(lo, len(lens))
                null = text.slice(lo, len(lens)).is_null().to_numpy(zero_copy_only=False)
                seen = np.append(0, np.cumsum(t.alnum[out]))
                ends = np.cumsum(new)
                shown = (seen[ends] > seen[ends - new]) & ~null
                a, b = row_keys(out, new), row_keys(out, new, 0x155555)
                if with_text:
                    yield batch(schema, ids, from_points(out, new, null), pa.array(shown), pa.array(a.view(np.int64), mask=null), pa.array(b.view(np.int64), mask=null))
                else:
                    yield batch(schema, ids.filter(pa.array(shown)), a[shown].view(np.int64), b[shown].view(np.int64), row_keys(points, lens)[shown].view(np.int64))

    return run


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def look_alike_forms(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """One row for each row: ``id, form, shown, form_a, form_b``.

    ``form`` is null for a null text and empty for one of which nothing is
    drawn; ``shown`` tells whether it has a letter or digit; two forms are equal
    if their two 64-bit keys are.
    """
    rows = df.select(key.alias("id"), text.alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", _arrow(kind)), ("form", pa.string()), ("shown", pa.bool_()), ("form_a", pa.int64()), ("form_b", pa.int64())])
    return rows.mapInArrow(_forms(_arrow(kind), schema, True), f"id {kind}, form string, shown boolean, form_a long, form_b long")


def look_alike_classes(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``id, form_a, form_b, body_key``: each record with a key and a letter or digit, once for each of its texts."""
    rows = df.select(key.alias("id"), text.alias("body")).where("id is not null and body is not null")
    kind = rows.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", _arrow(kind)), ("form_a", pa.int64()), ("form_b", pa.int64()), ("body_key", pa.int64())])
    # declared without nulls: otherwise each reader puts its own filter below the shuffle, which is then another one
    declared = StructType([StructField("id", rows.schema["id"].dataType, False), *(StructField(c, LongType(), False) for c in ("form_a", "form_b", "body_key"))])
    folded = rows.mapInArrow(_forms(_arrow(kind), schema, False), declared)
    # one shuffle, by what no group is large in; whoever reads this again reads that shuffle, and no text is folded twice
    return folded.repartition(partitions(df.sparkSession), "id").distinct()


def look_alike_pairs(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``id_a < id_b`` whose texts differ in characters and have one form.

    Null texts and texts without a letter or digit give no row. Records with
    equal texts are no pair. Variants of a form are paired by class, and members
    join them afterwards, so copies never meet each other.
    """
    members = look_alike_classes(df, key, text)
    mixed = members.groupBy("form_a", "form_b").agg(F.min("body_key").alias("low"), F.max("body_key").alias("high")).where("low <> high").select("form_a", "form_b")
    members = members.join(mixed, ["form_a", "form_b"])
    variants = members.select("form_a", "form_b", "body_key").distinct()
    left = variants.withColumnRenamed("body_key", "x")
    right = variants.withColumnRenamed("body_key", "y")
    pairs = left.join(right, ["form_a", "form_b"]).where("x < y")
    a = members.select("form_a", "form_b", F.col("body_key").alias("x"), F.col("id").alias("p"))
    b = members.select("form_a", "form_b", F.col("body_key").alias("y"), F.col("id").alias("q"))
    every = pairs.join(a, ["form_a", "form_b", "x"]).join(b, ["form_a", "form_b", "y"]).where("p <> q")
    return every.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()
