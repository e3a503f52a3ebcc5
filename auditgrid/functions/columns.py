"""Column builders: labels, structural predicates, text steps and hashes.

Only built-in expressions, so all of them stay in whole-stage code and run
unchanged on streams. A null flag counts as false unless a name says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def true(flag: str | Column) -> Column:
    """The flag is true; null is false."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


# labels and maps
def label(attack_class: str = "attack_class") -> Column:
    return F.when(F.col(attack_class) == "benign", "benign").otherwise("attack")


def is_attack(name: str = "label") -> Column:
    return (F.col(name) == "attack").cast("int")


def coarse_source(strict: bool = False) -> Column:
    """Three kinds of source; a tool outweighs a user. ``strict`` raises on an unknown value."""
    source, trust = F.col("source_type"), F.col("trust_level")
    kind = F.when(true((source == "tool_result") | (trust == "tool_output")), "tool_result").when(true((source == "user") | (trust == "authenticated_user")), "user").otherwise("other")
    if not strict:
        return kind
    unknown = true(~source.isin(*fixed.SOURCES)) | true(~trust.isin(*fixed.TRUST_LEVELS))
    return F.when(unknown, F.raise_error(F.concat(F.lit("unknown source or trust: "), F.coalesce(source, F.lit("")), F.lit("/"), F.coalesce(trust, F.lit(""))))).otherwise(kind)


def native_decision(action: str = "expected_action") -> Column:
    a = F.col(action)
    return F.when(a.isin("block", "quarantine"), "deny").when(a == "require_approval", "requires_approval").when(a.isin("allow", "log_only"), "allow").otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce(a, F.lit("null")))))


def containment(attack_class: str = "attack_class", action: str = "expected_action") -> Column:
    a = F.col(action)
    return F.when(F.col(attack_class) == "benign", "benign_control").when(a == "require_approval", "workflow_review").when(a.isin("block", "quarantine"), "structural").otherwise("evidence")


def hard_benign() -> Column:
    return (F.col("label") == "benign") & (F.coalesce("expected_action", F.lit("allow")) == "allow")


def stratum() -> Column:
    return F.when(F.col("label") == "benign", F.col("benign_subclass")).otherwise(F.col("bypass_class"))


# structural rules
def r1() -> Column:
    return true(F.col("trust_level") == "untrusted") & true("requires_tool_call")


def r2() -> Column:
    return true("contains_sensitive_sink") & (coarse_source() != "user")


def r3() -> Column:
    return r1() & true("contains_sensitive_sink")


def r4() -> Column:
    return r1() | r2()


def any_handle() -> Column:
    return true(F.col("trust_level") == "untrusted") | true("requires_tool_call") | true("contains_sensitive_sink") | true(F.col("source_type") == "tool_result")


def distrusted() -> Column:
    return true(F.col("trust_level").isin("untrusted", "tool_output"))


def static_flag() -> Column:
    near = true(F.col("source_type").isin("rag_chunk", "tool_result", "memory"))
    return distrusted() & (near | true("requires_tool_call")) & (true("requires_tool_call") | true("contains_sensitive_sink"))


def r1_prime(with_user: bool = False) -> Column:
    sources = ["rag_chunk", "tool_result", "memory", *(["user"] if with_user else [])]
    return distrusted() & true(F.col("source_type").isin(*sources)) & (true("requires_tool_call") | true("contains_sensitive_sink"))


def sink_required() -> Column:
    return distrusted() & true("requires_tool_call") & true("contains_sensitive_sink")


def risky_transform(tags: str = "tags") -> Column:
    return true(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, fixed.RISKY_TAGS))))


RULES = {"r1_untrusted_tool": r1, "r2_sink_not_user": r2, "r3_untrusted_tool_sink": r3, "r4_union": r4, "any_handle": any_handle}


# terms
def has_term(text: Column, terms: Iterable[str]) -> Column:
    """Some term is in the lower-cased text, anywhere."""
    low = F.lower(text)
    return true(any_of(low.contains(t) for t in terms))


def has_word(text: Column, terms: Iterable[str]) -> Column:
    """Some term is in the lower-cased text as whole words."""
    return true(F.lower(text).rlike(r"\b(" + "|".join(map(re.escape, terms)) + r")\b"))


def risky_intent(text: Column) -> Column:
    return true("contains_sensitive_sink") | has_term(text, fixed.PLACEHOLDERS) | has_word(text, fixed.RISK_TERMS)


def framed(text: Column) -> Column:
    return has_term(text, fixed.FRAMING_TERMS)


def searched(text: Column, plain: Column) -> Column:
    """A text and its normalized form, in which terms are looked for."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(plain, F.lit("")))


def term_flags(text: Column, tags: Column | None = None) -> dict[str, Column]:
    """Decision flags of one row, by name; ``tags`` are the transforms of the text, if known."""
    escaped = has_term(text, ["terminal controls", "escape-coded"])
    if tags is not None:
        escaped = escaped | true(F.array_contains(tags, "AnsiEscape"))
    free = ~framed(text)
    return {
        "risky_intent": risky_intent(text),
        "framed": framed(text),
        "gated_r1": r1_prime(True) & risky_intent(text) & free,
        "tool_authority": true(F.col("source_type") == "tool_result") & has_term(text, fixed.AUTHORITY_TERMS) & free,
        "leaking_output": has_term(text, fixed.LEAK_TERMS) & free,
        "package_claim": has_term(text, fixed.PACKAGE_TERMS) & ~has_term(text, ["public package index"]),
        "terminal_escape": escaped & has_term(text, fixed.TERMINAL_TERMS),
    }


def view_has(views: Column, terms: Iterable[str]) -> Column:
    """Some term is in one of the readings, as it is or with nothing but its letters; those in brackets only as they are."""
    terms = [t.lower() for t in terms]
    plain = sorted({c for t in terms if "[" not in t and "]" not in t and (c := "".join(filter(str.isalnum, t)))})
    bare = F.transform(views, lambda v: F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))
    return true(F.exists(views, lambda v: any_of(v.contains(t) for t in terms))) | true(F.exists(bare, lambda v: any_of(v.contains(t) for t in plain)))


def view_flags(views: Column, tags: Column) -> dict[str, Column]:
    """Decision flags of one row by all readings of its text, by name."""
    has = lambda terms: view_has(views, terms)
    sink, source = true("contains_sensitive_sink"), F.col("source_type")
    calm = ~sink & has(fixed.CALM_PHRASES) & ~has(fixed.UNEXCUSED_PHRASES)
    risky = sink | has(fixed.PLACEHOLDERS) | has(fixed.RISK_TERMS)
    surface = has(fixed.TERMINAL_SURFACE) | true(F.arrays_overlap(tags, F.array(*map(F.lit, fixed.SURFACE_TAGS))))
    return {
        "hard_benign_allow": calm,
        "risky_intent": risky,
        "gated_r1": r1_prime(True) & risky & ~calm,
        "terminal_escape": true(source == "tool_result") & surface & has(fixed.TERMINAL_INTENT) & ~calm,
        "memory_taint": true(source == "memory") & has(fixed.MEMORY_TERMS) & ~calm,
        "retrieval_taint": true(source == "rag_chunk") & true("requires_tool_call") & (has(fixed.RETRIEVAL_TERMS) | risky) & ~calm,
    }


def metadata_score(plain: Column, tags: Column | None = None) -> Column:
    """Cues for and against an attack in a normalized text, its metadata and transforms, as one number."""
    low = F.concat(F.lit(" "), F.lower(plain), F.lit(" "))
    hits = lambda terms: reduce(lambda a, b: a + b, (low.contains(t).cast("int") for t in terms))
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    near = true(F.col("source_type").isin("rag_chunk", "tool_result", "memory"))
    score = hits(fixed.ATTACK_CUES) * 0.25 - hits(fixed.CALM_CUES) * 0.35 + part(distrusted(), 0.2) + part(true("requires_tool_call"), 0.2) + part(true("contains_sensitive_sink"), 0.25) + part(near, 0.1)
    if tags is not None:
        weights = F.create_map(*(F.lit(x) for kv in fixed.TAG_WEIGHTS.items() for x in kv))
        score = score + F.aggregate(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(weights, t), F.lit(fixed.OTHER_TAG_WEIGHT)))
    return F.round(score, 8)


def class_action(reviewed: Iterable[str], quarantined: Iterable[str], attack_class: str = "attack_class") -> Column:
    """The action that is expected for a class; null for null."""
    c = F.col(attack_class)
    return F.when(c == "benign", "allow").when(c.isin(*reviewed), "require_approval").when(c.isin(*quarantined), "quarantine").when(c.isNotNull(), "block")


def placeholders_in(text: Column) -> Column:
    """Sorted placeholders of a text."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.lower(text).contains(p), F.lit(p)) for p in fixed.PLACEHOLDERS))))


def english_score(text: Column, padded: bool = True) -> Column:
    """Occurrences of English markers, each counted without overlap."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" ")) if padded else F.lower(text)
    return reduce(lambda a, b: a + b, ((F.length(low) - F.length(F.replace(low, F.lit(m)))) / F.lit(len(m)) for m in fixed.ENGLISH_MARKERS)).cast("int")


# text steps
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rot13(text: Column) -> Column:
    return F.translate(text, _LOW + _UP, _LOW[13:] + _LOW[:13] + _UP[13:] + _UP[:13])


def atbash(text: Column) -> Column:
    return F.translate(text, _LOW + _UP, _LOW[::-1] + _UP[::-1])


def braille(text: Column) -> Column:
    return F.translate(F.lower(text), fixed.BRAILLE_LETTERS, fixed.BRAILLE_CELLS)


def unbraille(text: Column) -> Column:
    return F.translate(text, fixed.BRAILLE_CELLS, fixed.BRAILLE_LETTERS)


def zero_width_free(text: Column) -> Column:
    return F.translate(text, fixed.ZERO_WIDTH, "")


def control_free(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")


def folded_letters(text: Column) -> Column:
    return F.translate(text, "".join(fixed.FOLDED_LETTERS), "".join(fixed.FOLDED_LETTERS.values()))


def wide_folded(text: Column) -> Column:
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def tidy(text: Column) -> Column:
    """Runs of blanks to one, at most one empty line, no blanks at line ends or text ends."""
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\u00a0]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r" +(?=\n)", ""), r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_leet(text: Column) -> Column:
    """Words with letters written as digits or signs, by word between single blanks."""
    token = F.transform(F.split(text, " "), lambda t: F.when(_leet_word(t), F.translate(t, "".join(fixed.LEET), "".join(fixed.LEET.values()))).otherwise(t))
    return F.array_join(token, " ")


def _leet_word(t: Column) -> Column:
    plain = F.translate(t, "".join(fixed.LEET), "".join(fixed.LEET.values()))
    return (plain != t) & plain.rlike(r"^\p{L}{3,}$") & (F.length(F.regexp_replace(t, r"\P{L}", "")) >= 2)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def grams(compact: Column, n: int = 7) -> Column:
    """Distinct n-grams of characters; a shorter text is its own gram, an empty one has none."""
    some = F.transform(F.sequence(F.lit(1), F.length(compact) - (n - 1)), lambda i: F.substring(compact, i, F.lit(n)))
    return F.when(F.length(compact) >= n, F.array_distinct(some)).when(F.length(compact) > 0, F.array(compact)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def band(signature: Column, i: int) -> Column:
    return F.shiftrightunsigned(signature, 16 * i).bitwiseAND(65535)


def sha_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_fifth(key: Column, salt: str, digits: int = 16) -> Column:
    """Hash of a salted key modulo five, from its first hex digits (eight for each step)."""
    hex_ = F.sha2(F.concat(F.lit(salt), key), 256)
    # 16 is 1 modulo 5, so parts of a number may be added instead of shifted
    parts = (F.conv(F.substring(hex_, i, 8), 16, 10).cast("bigint") for i in range(1, digits, 8))
    return F.pmod(reduce(lambda a, b: a + b, parts), F.lit(5)).cast("int")


def hash_split(key: Column, salt: str = "1337:") -> Column:
    part = hash_fifth(key, salt)
    return F.when(part < 3, "exemplar_bank").when(part == 3, "validation").otherwise("test")


def family_split(family: Column, salt: str = "1337:") -> Column:
    """Split of a whole family: the number after its last colon, or else a hash, shifted by a hash of what stands before."""
    prefix = F.coalesce(F.regexp_extract(family, r"(?s)^(.*):[^:]*$", 1), F.lit(""))
    tail = F.regexp_extract(family, r"(?s)([^:]*)$", 1)
    number = F.when(tail.rlike(r"^\s*[+-]?\d{1,36}\s*$"), F.pmod(F.trim(tail).cast("decimal(38,0)"), F.lit(5)).cast("int"))
    part = F.pmod(F.coalesce(number, hash_fifth(family, salt, 64)) + hash_fifth(prefix, salt, 64), F.lit(5))
    return F.when(part < 3, "exemplar_bank").when(part == 3, "validation").when(part == 4, "test")


def hash_half(key: Column, salt: str = "1337:") -> Column:
    """Zero or one: parity of the last hex digit."""
    return F.pmod(F.conv(F.right(F.sha2(F.concat(F.lit(salt), key), 256), F.lit(1)), 16, 10).cast("int"), F.lit(2))


def line_secrets(text: Column) -> Column:
    """``array<struct<line_no, kind>>`` of the secrets in a text, by line."""
    lines = F.split(text, r"\r\n|\r|\n")
    numbered = F.transform(lines, lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("line")))
    hit = lambda x: F.array_compact(F.array(*(F.when(x.line.rlike(p), F.struct(x.line_no.alias("line_no"), F.lit(k).alias("kind"))) for k, p in fixed.SECRETS.items())))
    return F.flatten(F.transform(numbered, hit))


def has_url(text: Column) -> Column:
    return true(text.rlike(r"https?://|www\."))


def has_mail(text: Column) -> Column:
    return true(text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))


_COMMENT = r"(?s)<!--.*?-->"
_UNSEEN = r"(?is)<(script|style)\b.*?</\1>"
_HIDDEN = r"(?is)<([a-z0-9]+)\b[^>]*display\s*:\s*none[^>]*>.*?</\1>"
_TAG = r"(?s)<[^>]+>"


def human_view(markup: Column) -> Column:
    """What a reader of a page sees."""
    for pattern in (_COMMENT, _UNSEEN, _HIDDEN, _TAG):
        markup = F.regexp_replace(markup, pattern, " ")
    return collapsed(markup)


def agent_view(markup: Column) -> Column:
    """What an agent reads: text, comments, labels and link targets."""
    found = [F.regexp_extract_all(markup, F.lit(p), F.lit(1)) for p in (r"(?s)<!--(.*?)-->", r'(?i)aria-label="([^"]*)"', r'(?i)href="([^"]*)"')]
    text = F.regexp_replace(F.regexp_replace(markup, _COMMENT, " "), _TAG, " ")
    return collapsed(F.concat_ws(" ", text, *found))


def flat_turns(turns: str = "turns") -> Column:
    """A conversation as marked lines, in the order of its turns."""
    line = lambda t, i: F.concat(F.lit("[R7-TURN "), (i + 1).cast("string"), F.lit(" role="), t.role, F.lit(" source="), t.source_type, F.lit("]\n"), t.text)
    return F.array_join(F.transform(turns, line), "\n")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
