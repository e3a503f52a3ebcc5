"""SQL that states the problems where it can: brute force over whole tables.

Texts are brought to letters and digits by translation of the code points that
NFKC changes in these tables, so the SQL holds for the synthetic tables, not for
all of Unicode.
"""

from __future__ import annotations

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_THIN = "".join(map(chr, range(0x21, 0x7F)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NARROW = f"translate(text, {_quoted(_WIDE)}, {_quoted(_THIN)})"
_OPEN = f"replace(replace(replace({_NARROW}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
#: NFKC, case-folded, letters and digits.
_LETTERS = f"regexp_replace(replace(translate(lower(nfc_normalize({_OPEN})), 'ςϲ', 'σσ'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_BASE = f"base AS (SELECT DISTINCT id, split, {_LETTERS} AS c FROM corpus_v4 WHERE text IS NOT NULL), long AS (SELECT * FROM base WHERE length(c) >= 80), g AS (SELECT DISTINCT id, split, unnest(list_transform(range(1, length(c) - 5), lambda i: substr(c, i, 7))) AS p FROM long), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1)"

_P1 = f"""WITH {_BASE}, s AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS k FROM g x JOIN g y ON x.p = y.p AND x.id < y.id GROUP BY 1, 2)
SELECT id_a, id_b FROM s JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE k >= 0.6::double * (a.n + b.n - k)"""

_P2 = """WITH v AS (SELECT vec_id, embedding::double[] AS e FROM row_vectors WHERE embedding IS NOT NULL AND len(embedding) = 128),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS q, b.vec_id AS o, round(list_cosine_similarity(a.e, b.e), 6) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, o) AS rn FROM s)
SELECT DISTINCT least(q, o) AS vec_id_a, greatest(q, o) AS vec_id_b FROM r WHERE rn <= 5"""

_P3 = f"""WITH {_BASE}, s AS (SELECT x.id AS v, y.id AS e, count(*) AS k FROM g x JOIN g y ON x.p = y.p AND x.split IN ('validation', 'test') AND y.split = 'exemplar_bank' AND x.id <> y.id GROUP BY 1, 2)
SELECT DISTINCT least(v, e) AS id_a, greatest(v, e) AS id_b FROM s JOIN n ON n.id = v WHERE k >= 0.8::double * n"""

# Look-alike letters of the tables, after the code points above; letters that hold an accent map to the accented Latin letter.
_ALIKE = "ЅІЈАВЕКМНОРСТХѴҺԀԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹаеорсухѕіјѵһԁԛԝοϲνρЁёΆΈΉΊΌό"
_LATIN = "SIJABEKMHOPCTXVHDQWABEZHIKMNOPTYXCaeopcyxsijvhdqwocvpËëÁÉHÍÓó"
_SHOWN = f"nfc_normalize(translate(translate(regexp_replace({_OPEN}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f]', '', 'g'), '    ', '    '), '‐‑', '--'))"
_FORM = f"nfc_normalize(translate({_SHOWN}, {_quoted(_ALIKE.replace('Ή', ''))}, {_quoted(_LATIN.replace('ÉHÍ', 'ÉÍ'))}))"
_P5 = f"""WITH f AS (SELECT DISTINCT id, text, {_FORM} AS form FROM corpus_v4 WHERE text IS NOT NULL)
SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.id <> b.id WHERE regexp_matches(a.form, '[\\p{{L}}\\p{{N}}]')"""

SQL = {"p1_found": _P1, "p2_found": _P2, "p3_found": _P3, "p5_found": _P5}


def _letters(expression: str) -> str:
    return _LETTERS.replace("(text,", f"({expression},")


_NAME = "[\\p{L}\\p{N}][\\w .\\-]{0,60}"
_PARTS = "list_filter(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), ';'), lambda p: regexp_matches(p, '\\S'))"
_LINES = "list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda p: regexp_matches(p, '\\S'))"


def _fields(parts: str, sign: str) -> str:
    pattern = f"'(?s)^\\s*({_NAME}?)\\s*{sign}\\s*(.*?)\\s*$'"
    return f"list_transform({parts}, lambda p: {_letters(f'regexp_extract(p, {pattern}, 1)')} || chr(31) || {_letters(f'regexp_extract(p, {pattern}, 2)')})"


def _all_match(parts: str, sign: str) -> str:
    return f"len({parts}) > 1 AND len(list_filter({parts}, lambda p: NOT regexp_full_match(p, '(?s)\\s*{_NAME}\\s*{sign}.*'))) = 0"


_JSON = f"list_transform(json_keys(text), lambda k: {_letters('k')} || chr(31) || {_letters('''json_extract_string(text, '$.\"' || k || '\"')''')})"
_P4 = f"""WITH t AS (SELECT DISTINCT id, text FROM corpus_v7 WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
k AS (SELECT id, {_LETTERS} AS words, CASE WHEN regexp_matches(text, '^\\s*\\{{') AND json_valid(text) THEN list_sort({_JSON})
 WHEN contains(text, '=') AND {_all_match(_PARTS, '=')} THEN list_sort({_fields(_PARTS, '=')}) WHEN {_all_match(_LINES, ':')} THEN list_sort({_fields(_LINES, ':')}) END AS fields FROM t),
f AS (SELECT id, coalesce(fields::varchar, min(fields::varchar) OVER (PARTITION BY words), words) AS file FROM k), g AS (SELECT id, min(id) OVER (PARTITION BY file) AS keep_id FROM f)
SELECT DISTINCT keep_id, id AS copy_id FROM g WHERE id <> keep_id"""
SQL["p4_found"] = _P4

SQL["p3_report"] = f"""WITH {_BASE}, s AS (SELECT x.id AS v, y.id AS e, count(*) AS k FROM g x JOIN g y ON x.p = y.p AND x.split IN ('validation', 'test') AND y.split = 'exemplar_bank' GROUP BY 1, 2),
m AS (SELECT v, max(k::double / n) AS c FROM s JOIN n ON n.id = v WHERE k >= 0.8::double * n GROUP BY 1), once AS (SELECT DISTINCT id, split, family_id FROM corpus_v4 WHERE split IN ('validation', 'test'))
SELECT split, family_id, count(*) AS records, count(c) AS overlapped, count(*) FILTER (c = 1) AS wholly_found, round(max(c), 6) AS most_contained FROM once LEFT JOIN m ON m.v = once.id GROUP BY 1, 2"""
SQL["p4_counts"] = (
    _P4.split("g AS (")[0].rstrip(", \n")
    + ", a AS (SELECT id, min(loaded_at) AS loaded FROM corpus_v7 GROUP BY 1), g AS (SELECT id, loaded, min(id) OVER (PARTITION BY file) AS keep_id FROM f JOIN a USING (id)) SELECT keep_id, arg_min(id, (loaded, id)) AS first_id, count(*) AS copies FROM g GROUP BY 1"
)
SQL["p5_forms"] = f"SELECT id, {_FORM} AS form, coalesce(regexp_matches({_FORM}, '[\\p{{L}}\\p{{N}}]'), false) AS shown FROM corpus_v4"
