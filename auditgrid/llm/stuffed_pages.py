"""Pages that are mostly repeated keywords, links or product tags.

The pages of a batch are handled as one array of characters. For each page the
suffixes of its words' letters (links and tags are counted apart) are sorted by
their first letters, which is what a suffix automaton of the page would tell:
neighbours with a common prefix of SHORT letters or more that occurs REPEATS
times are substrings that the page repeats, and their union is what repeated
maximal substrings cover. A word is covered if all its letters are, or if it is
none of those that sentences need and is said OFTEN times, in whatever order.

Clause structure is measured by segment (line or sentence): a segment has it if
it has words that only sentences need (articles, pronouns, auxiliaries,
conjunctions of six languages). A run of RUN covered words or more is a segment
of its own, with clause structure only if CLAUSE of its words are such; segments
that are mostly links and tags, REPEATS or more, have none. Stuffed are, in
segments without clause structure: links with their labels, tags, and segments
of which at least half is covered.

A word of them doesn't save text that is said over and over: substrings of LONG
letters that occur OFTEN times, outside whole sentences of which CLAUSE or more
is such words, make a page stuffed with its links and tags if they are more than
REFRAIN of it; a refrain in prose stays below.

Signs such as ``[a-b]``, ``{a_b}``, ``tag:a`` and ``a-b;`` may be tags or not; they
count as tags if the suffixes of their letters show that the page repeats the
same stems in them. A page is found if more than half of its drawn characters is
stuffed.

The decision on a page needs that page only; there is no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .arrowkit import Windows, batch, chunks, mix, ranges

REPEATS, HALF = 4, 0.5
#: Letters, with the spaces between words, of a substring that counts if repeated, and if said OFTEN times.
SHORT, LONG = 12, 16
#: Times that a single word is said to be a keyword, and words of a run that is a segment of its own.
OFTEN, RUN = 8, 12
#: Share of such words that makes a clause of a run, and share of a page that is more than a refrain.
CLAUSE, REFRAIN = 0.3, 2 / 3
#: Letters of a repeated stem of tags, and the share of their letters that stems must cover.
STEM, STEM_SHARE = 6, 0.3

# Words that sentences need and lists of keywords don't, by language.
CLAUSE_WORDS = {
    "en": "the this that these those is are was were be been has have had does did do will would should could can may must not no nothing it its he she they them their we our us you your i who which what why when where whether if than then there because since until while from by of to on at an a into about after before as so every each any how said says means mentions",
    "de": "der die das den dem des ein eine einen einem einer ist sind war waren wird wurde hat haben nicht kein keine keinen noch nur auf aus bei durch gegen nach seit vom von zu zum zur und oder aber wenn weil dass daß sie er es wir ihr ich unser unsere wer was warum wie darf muss soll bitte heute gestern",
    "fr": "le la les un une des du est sont était a ont au aux que qui quoi dont où il elle ils elles nous vous je ne n'est n'a pas? et ou mais par sur sous dans avant après chez encore tant sans avec entre ce cette ces son sa ses leur merci",
    "es": "el la los las un una unos unas es son fue era está han ha hay que quien se su sus le lo les nos no ni y o pero por sin sobre en con del al desde hasta entre este esta eso nadie según ayer mañana más favor",
    "ru": "и а но или не ни на в во с со к ко по за из от до у о об для через при без над под что кто как где когда почему если уже ещё это он она они мы вы я его её их был была было были всё только пожалуйста",
    "el": "ο η το οι τα του της των τον την τη ένα μια μία ένας και ή αλλά δεν μην να θα που πως ότι για από με σε στο στη στην στον στα είναι ήταν έχει αν όταν γιατί πριν μετά χωρίς χθες παρακαλώ",
}



_SLOTS = 22


@lru_cache(8)
def _special(slash: bool, semicolon: bool, other: bool):
    """Links, tags, and signs that may be tags, as far as a page with these characters can have them."""
    import regex

    link = []
    if other:
        link += [r"\[[^\[\]\n]*+\]\(\s*+[^()\s]++\s*+\)", r"(?i:<a\s[^>]*+>.*?</a>)", r"(?i:www\.)\S++"]
    if slash:
        link += [r"(?i:https?://|ftp://)\S++", r"\b(?:[\p{L}\p{N}-]++\.)++[\p{L}]{2,}+/\S*+"]
    token = r"[\p{L}\p{M}\p{N}]++(?:[_-][\p{L}\p{M}\p{N}]++)*+"
    maybe = [rf"(?<![\p{{L}}\p{{M}}\p{{N}}_'’-]){token};"] if semicolon else []
    kinds = [("link", link)]
    if other:
        kinds.append(("tag", [r"(?<!&)#[\p{L}\p{N}_][\p{L}\p{N}_-]*+"]))
        maybe += [rf"\[{token}\]", rf"\{{{token}\}}", rf"\b(?i:tag):{token}(?::{token})*+"]
    kinds.append(("maybe", maybe))
    return regex.compile("|".join(f"(?P<{k}>{'|'.join(v)})" for k, v in kinds if v), regex.S)


WORD, SPACE, STOP, CLOSER, OPENER, APOSTROPHE = 1, 2, 4, 8, 16, 32


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kinds and lower case of each character."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0x40000 <= c < 0xE0000 or c >= 0xF0000:
            continue
        ch = chr(c)
        category = unicodedata.category(ch)
        kind[c] = WORD * (category[0] in "LMN") | SPACE * ch.isspace() | OPENER * (category in ("Lu", "Lt") or category[0] == "N")
        small = ch.lower()
        if len(small) == 1:
            lower[c] = ord(small)
    for flag, signs in ((STOP, ".!?;…"), (CLOSER, "\"'»”)"), (OPENER, "[\"«“(¿¡"), (APOSTROPHE, "'’")):
        for ch in signs:
            kind[ord(ch)] |= flag
    return kind, lower


@lru_cache(1)
def _clause_hashes() -> np.ndarray:
    words = sorted({w.strip("?") for words in CLAUSE_WORDS.values() for w in words.split() if not w.endswith("?")})
    points, lens = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]), np.array([len(w) for w in words])
    ends = np.cumsum(lens)
    return np.sort(_hashes(Windows(points), ends - lens, ends))


def _hashes(win: Windows, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((win.sums[stop] - win.sums[start]) * win.inverse[start] + (stop - start).astype(np.uint64))


def repeated_starts(points: np.ndarray, page: np.ndarray, width: int, times: int, among: np.ndarray | None = None) -> np.ndarray:
    """Places where a substring of ``width`` letters begins that its page has ``times`` or more.

    ``page`` has the page of each letter, in order. Places whose hashes rule out
    enough repeats are left out; the suffixes of the others are sorted by page and
    their first ``width`` letters, and neighbours that agree in these are a run.
    """
    n = len(points) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n) if among is None else among[among < n]
    at = at[page[at] == page[at + width - 1]]
    win = Windows(points)
    h = mix((win.sums[at + width] - win.sums[at]) * win.inverse[at] + page[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
    at = at[np.bincount(slot, minlength=1 << _SLOTS)[slot] >= times]
    if not len(at):
        return at
    letters, code = np.unique(points, return_inverse=True)
    bits = max(1, int(len(letters) - 1).bit_length())
    per = 64 // bits
    keys = []
    for k in range(0, width, per):
        key = np.zeros(len(at), np.uint64)
        for d in range(k, min(k + per, width)):
            key = (key << np.uint64(bits)) | code[at + d].astype(np.uint64)
        keys.append(key)
    order = np.lexsort((*reversed(keys), page[at]))
    at = at[order]
    differs = np.append(True, page[at[1:]] != page[at[:-1]])
    for key in keys:
        differs[1:] |= key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(differs)
    size = np.diff(np.append(begin, len(at)))
    return np.sort(at[np.repeat(size >= times, size)])


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0


def _sums(n: int, at: np.ndarray, weight) -> np.ndarray:
    """Sums of weights before each place."""
    out = np.zeros(n + 1, np.int64)
    np.add.at(out[1:], at, weight)
    return np.cumsum(out)


def _signs(texts: list[str], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, kind (0 link, 1 tag, 2 maybe a tag) and page of all signs."""
    names = {"link": 0, "tag": 1, "maybe": 2}
    rows = []
    for i, (t, b) in enumerate(zip(texts, begins.tolist())):
        slash, semicolon = "/" in t, ";" in t
        other = "[" in t or "#" in t or "{" in t or "<a" in t or "<A" in t or "www." in (low := t.lower()) or "tag:" in low
        if slash or semicolon or other:
            rows += [(m.start() + b, m.end() + b, names[m.lastgroup], i) for m in _special(slash, semicolon, other).finditer(t)]
    return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def _stemmed(points: np.ndarray, start: np.ndarray, stop: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """Pages whose signs that may be tags repeat stems."""
    letters, owner = [], []
    for a, b, p in zip(start, stop, page):
        text = points[a:b].tobytes().decode("utf-32-le").casefold().removeprefix("tag:")
        letters.append("".join(filter(str.isalpha, text)))
        owner.append(p)
    # each sign ends in a letter of its own, so that no stem crosses two
    size = np.array([len(x) + 1 for x in letters], np.int64)
    flat = np.frombuffer("\n".join([*letters, ""]).encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum(size) - 1
    flat[ends] = 0x200000 + np.arange(len(ends))
    of = np.repeat(np.array(owner, np.int64), size)
    covered = _covered(len(flat), repeated_starts(flat, of, STEM, REPEATS), STEM)
    real = flat < 0x200000
    have, all_ = np.bincount(of[covered & real], minlength=pages), np.bincount(of[real], minlength=pages)
    return have >= STEM_SHARE * np.maximum(1, all_)


def measure_pages(texts: list[str], repeats: int = REPEATS) -> np.ndarray:
    """Drawn characters of each page: all, and stuffed ones as links, tags and keywords; in clauses."""
    kind, lower = _tables()
    pages = len(texts)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    begins, n = np.cumsum(lens) - lens, len(points)
    page = np.repeat(np.arange(pages), lens)
    k = kind[points]
    space = (k & SPACE) > 0
    drawn = np.append(0, np.cumsum(~space))
    sign_start, sign_stop, sign_kind, sign_page = _signs(texts, begins)
    # words, outside of signs
    is_word = (k & WORD) > 0
    joined = (k & APOSTROPHE) > 0
    joined[1:] &= is_word[:-1]
    joined[:-1] &= is_word[1:]
    is_word |= joined
    if len(sign_start):
        is_word[ranges(sign_start, sign_stop - sign_start)] = False
    edge = np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size, of = stop - start, page[start]
    small = lower[points]
    h = _hashes(Windows(small), start, stop)
    clause = np.isin(h, _clause_hashes())
    _, which, said = np.unique(h ^ mix(of.astype(np.uint64)), return_inverse=True, return_counts=True)
    often = (said[which] >= OFTEN) & ~clause
    # the letters of the words, a space before each word and after each page's last
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    last = np.append(first[1:], True)[: len(of)]
    width = size + 1 + last
    to = np.cumsum(width) - width + 1
    stream = np.full(int(width.sum()), 32, np.uint32)
    stream[ranges(to, size)] = small[ranges(start, size)]
    stream_page = np.repeat(of, width)
    # a word doesn't repeat itself: substrings have a space
    gaps = np.append(0, np.cumsum(stream == 32))
    spaced = np.flatnonzero(gaps[SHORT:] > gaps[: max(0, len(gaps) - SHORT)])
    short = repeated_starts(stream, stream_page, SHORT, repeats, spaced)
    inside = lambda cover: np.add.reduceat(np.append(cover, False), np.ravel((to, to + size), "F"), dtype=np.int64)[::2] == size if len(to) else np.zeros(0, bool)
    covered = inside(_covered(len(stream), short, SHORT)) | often
    over = inside(_covered(len(stream), repeated_starts(stream, stream_page, LONG, OFTEN, short), LONG))
    # segments: lines, and sentences
    run_edge = np.diff(np.concatenate(([False], space, [False])).astype(np.int8))
    gap, after = np.flatnonzero(run_edge == 1), np.flatnonzero(run_edge == -1)
    lines = np.append(0, np.cumsum(points == 10))
    before = np.maximum.accumulate(np.where((k & CLOSER) == 0, np.arange(n), -1))
    ends = (k[before[np.maximum(gap - 1, 0)]] & STOP) > 0
    opens = (k[np.minimum(after, n - 1)] & OPENER) > 0
    cuts = after[(lines[after] > lines[gap]) | (ends & opens & (gap > 0))]
    cuts = np.unique(np.concatenate((begins, cuts[cuts < n])))
    # whole sentences, of which a full share is such words
    bounds, segment = cuts, np.searchsorted(cuts, start, side="right") - 1
    said_in, such = np.bincount(segment, minlength=len(cuts)), np.bincount(segment[clause], minlength=len(cuts))
    full = np.maximum.accumulate(np.where((k & (CLOSER | SPACE)) == 0, np.arange(n), 0))[np.append(cuts[1:], n) - 1]
    sentence = ((k[full] & STOP) > 0) & (such >= CLAUSE * said_in)
    # long covered runs in segments with clause words
    has = such > 0
    at = np.flatnonzero(covered & has[segment])
    new = np.append(True, (np.diff(at) > 2) | (segment[at[1:]] != segment[at[:-1]]))[: len(at)]
    a = at[new]
    b = at[np.append(new[1:], True)[: len(at)]]
    long_ = b - a + 1 >= RUN
    a, b = a[long_], b[long_]
    so_far = np.append(0, np.cumsum(clause))
    listed = start[a[so_far[b + 1] - so_far[a] < CLAUSE * (b - a + 1)]]
    cuts = np.unique(np.concatenate((cuts, start[a], stop[b])))
    cuts = cuts[cuts < n]
    # sums by segment
    each = lambda sums: np.diff(sums[np.append(cuts, n)])
    sign_size = drawn[sign_stop] - drawn[sign_start]
    maybe = sign_kind == 2
    tagged = np.zeros(pages, bool)
    if maybe.any():
        tagged = _stemmed(points, sign_start[maybe], sign_stop[maybe], sign_page[maybe], pages)
    is_link, is_tag = sign_kind == 0, (sign_kind == 1) | maybe & tagged[sign_page]
    link, tag = (each(_sums(n, sign_start[x], sign_size[x])) for x in (is_link, is_tag))
    signs = each(_sums(n, sign_start[is_link | is_tag], 1))
    letters, cover, again = (each(_sums(n, start[x], size[x])) for x in (np.ones(len(start), bool), covered, over))
    count = each(drawn)
    where = page[cuts]
    has_clause = (each(_sums(n, start[clause], 1)) > 0) & ~np.isin(cuts, listed) & ~((signs >= repeats) & (2 * (link + tag) >= count))
    rest = count - link - tag
    labels = (link > 0) & (2 * link >= count - tag)
    keys = np.where(~labels & (letters > 0) & (2 * cover >= letters), rest, 0)
    per = lambda x: np.bincount(where, x, minlength=pages).astype(np.int64)
    total = per(count)
    free = ~has_clause
    links, tags, keywords, clauses = per(free * (link + labels * rest)), per(free * tag), per(free * keys), per(has_clause * count)
    # said over and over, whatever its structure, but for whole sentences with a full share of such words
    again = again * ~sentence[np.searchsorted(bounds, cuts, side="right") - 1]
    everywhere = per(link + tag + np.where(free & (keys > 0), keys, again)) > REFRAIN * total
    everywhere &= (per(signs) >= repeats) | (per(again) > 0)
    links += everywhere * per(has_clause * link)
    tags += everywhere * per(has_clause * tag)
    keywords += everywhere * per(has_clause * again)
    clauses -= everywhere * per(has_clause * (link + tag + again))
    return np.stack((total, links, tags, keywords, clauses), 1)


def page_measures(text: str | None, repeats: int = REPEATS) -> tuple[int, int, int, int, int]:
    """The measures of one page; zeros for null and blank ones."""
    return tuple(measure_pages([text], repeats)[0].tolist()) if text else (0, 0, 0, 0, 0)


_FOUND = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("link_chars", pa.int64()), ("tag_chars", pa.int64()), ("keyword_chars", pa.int64()), ("clause_chars", pa.int64()), ("stuffed", pa.bool_())])


def _measure(repeats: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            out = [np.zeros((0, 5), np.int64)] + [measure_pages(texts[lo:hi], repeats) for lo, hi in chunks(texts)]
            m = np.concatenate(out)
            yield batch(_FOUND, rows.column(0), *m.T.copy(), m[:, 1:4].sum(1) > share * m[:, 0])

    return run


def page_stuffing(df: DataFrame, key: Column, text: Column, *, repeats: int = REPEATS, share: float = HALF) -> DataFrame:
    """One row for each row: characters by kind, and ``stuffed``.

    Null, empty and blank texts have no characters and are not stuffed.
    """
    rows = df.select(key.cast("long").alias("doc_id"), text.alias("body"))
    return rows.mapInArrow(_measure(repeats, share), "doc_id long, chars long, link_chars long, tag_chars long, keyword_chars long, clause_chars long, stuffed boolean")
