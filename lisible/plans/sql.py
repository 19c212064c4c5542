"""DuckDB SQL fragments mirroring the Spark expressions.

The oracle is written independently in plain SQL (CTEs, unnest, window
functions, list lambdas) but shares the regular expressions and fixed
values, so any difference points at an operator, not at a constant.
"""

from __future__ import annotations

from lisible.constants import (CLIP_SUFFIX, FLOAT_DECIMALS, LEVELS, LIX_CENTRES,
                               LIX_LONG_WORD, LIX_SPREAD, READING_BAND_LIMITS)
from lisible.functions.levels import TIE_DECIMALS
from lisible.functions.text import (LONG_WORD_TEMPLATE, SENT_END, SPECIAL_TOKENS, TOKEN,
                                    TRIM, WORD, protect_pattern)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ESCAPE_SQL = "chr(57344)"
ESCAPED_SQL = "chr(57344) || chr(57345)"
PROTECT_SQL = "chr(57344) || chr(57346)"
MARK_SQL = "chr(57344) || chr(57347)"


def clip(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || {lit(CLIP_SUFFIX)} ELSE {c} END"


def strip_ws(c: str) -> str:
    return f"regexp_replace({c}, {lit(TRIM)}, '', 'g')"


def sentence_list(text: str, abbreviations: list[str] | None = None) -> str:
    escaped = f"replace({text}, {ESCAPE_SQL}, {ESCAPED_SQL})"
    protected = f"regexp_replace({escaped}, {lit(protect_pattern(abbreviations))}, '\\1\\2' || {PROTECT_SQL}, 'g')"
    marked = f"regexp_replace({protected}, {lit(SENT_END)}, '\\1' || {MARK_SQL}, 'g')"
    cleaned = f"list_transform(string_split({marked}, {MARK_SQL}), lambda s: replace({strip_ws(f'replace(s, {PROTECT_SQL}, {lit(chr(46))})')}, {ESCAPED_SQL}, {ESCAPE_SQL}))"
    return f"list_filter({cleaned}, lambda s: s <> '')"


def regexp_count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {lit(pattern)}))"


def token_count(c: str) -> str:
    return f"({regexp_count(c, TOKEN)} + {SPECIAL_TOKENS})"


def sentences_cte(source: str, key: str = "doc_id", text: str = "text") -> str:
    """SELECT producing (key, pos, sentence) with 0-based positions."""
    return (f"SELECT {key}, pos - 1 AS pos, sents[pos] AS sentence FROM ("
            f"SELECT {key}, sents, generate_subscripts(sents, 1) AS pos FROM ("
            f"SELECT {key}, {sentence_list(text)} AS sents FROM {source}) a) b")


def lix_probability_ctes(source: str, sentence: str = "sentence", name: str = "p") -> list[tuple[str, str]]:
    """CTE chain adding A1..C2 to every column of ``source``."""
    lg = [f"-((ix - CAST({c} AS DOUBLE)) * (ix - CAST({c} AS DOUBLE))) / CAST({LIX_SPREAD} AS DOUBLE)" for c in LIX_CENTRES]
    return [
        (f"{name}_cnt", f"SELECT *, {regexp_count(sentence, WORD)} AS _w, "
                        f"{regexp_count(sentence, LONG_WORD_TEMPLATE % LIX_LONG_WORD)} AS _lw FROM {source}"),
        (f"{name}_ix", f"SELECT *, CAST(_w AS DOUBLE) + CAST(100.0 AS DOUBLE) * _lw / greatest(_w, 1) AS ix FROM {name}_cnt"),
        (f"{name}_lg", "SELECT *, " + ", ".join(f"{e} AS _lg{i}" for i, e in enumerate(lg)) + f" FROM {name}_ix"),
        (f"{name}_top", "SELECT *, greatest(" + ", ".join(f"_lg{i}" for i in range(6)) + f") AS _top FROM {name}_lg"),
        (f"{name}_ex", "SELECT *, " + ", ".join(f"exp(_lg{i} - _top) AS _e{i}" for i in range(6)) + f" FROM {name}_top"),
        (f"{name}_tot", "SELECT *, " + " + ".join(f"_e{i}" for i in range(6)) + f" AS _tot FROM {name}_ex"),
        (name, "SELECT * EXCLUDE (_w, _lw, ix, _top, _tot, " + ", ".join(f"_lg{i}, _e{i}" for i in range(6)) + "), "
               + ", ".join(f"_e{i} / _tot AS {lv}" for i, lv in enumerate(LEVELS)) + f" FROM {name}_tot"),
    ]


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + final


def rounded_levels(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{lv}, {FLOAT_DECIMALS}) AS {lv}" for lv in LEVELS)


def dominant_level(prefix: str = "") -> str:
    r = [f"round({prefix}{lv}, {TIE_DECIMALS})" for lv in LEVELS]
    top = "greatest(" + ", ".join(r) + ")"
    return "CASE " + " ".join(f"WHEN {c} = {top} THEN '{lv}'" for c, lv in zip(r, LEVELS)) + " END"


def reading_minutes(text: str) -> str:
    return f"CAST(length({text}) // 1000 AS BIGINT)"


def reading_band(minutes: str) -> str:
    return ("CAST(CASE " + " ".join(f"WHEN {minutes} < {lim} THEN {i}" for i, lim in enumerate(READING_BAND_LIMITS))
            + f" ELSE {len(READING_BAND_LIMITS)} END AS INTEGER)")


# ----------------------------------------------------------------------------
# HTML, URLs, Markdown
# ----------------------------------------------------------------------------

def unescape(c: str) -> str:
    from lisible.functions.html import ENTITIES
    for k, v in ENTITIES:
        c = f"replace({c}, {lit(k)}, {lit(v)})"
    return c


def clean_text(c: str) -> str:
    from lisible.functions import html as H
    c = f"regexp_replace({c}, {lit(H.TAG)}, ' ', 'g')"
    c = unescape(c)
    c = f"regexp_replace({c}, {lit(H.WS_RUN)}, ' ', 'g')"
    return f"regexp_replace({c}, {lit(H.TRIM)}, '', 'g')"


def attr_value(tag: str, attr: str) -> str:
    from lisible.functions import html as H
    raw = f"regexp_extract({tag}, {lit(H.attr_pattern(attr))}, 1)"
    val = f"(CASE WHEN {raw} LIKE '\"%' OR {raw} LIKE '''%' THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END)"
    return f"(CASE WHEN regexp_matches({tag}, {lit(H.has_attr_pattern(attr))}) THEN {unescape(val)} END)"


def host(url: str) -> str:
    from lisible.functions import html as H
    return f"lower(regexp_extract({url}, {lit(H.HOST)}, 1))"


def nullif_empty(c: str) -> str:
    return f"nullif({c}, '')"


def remove_dot_segments(path: str) -> str:
    from lisible.functions import urls as U
    tailed = f"(CASE WHEN regexp_matches({path}, {lit(U.DOT_TAIL)}) THEN {path} || '/' ELSE {path} END)"
    segs = f"string_split({tailed}, '/')"
    folded = (f"list_reduce(list_slice({segs}, 2, len({segs})), lambda acc, s: CASE WHEN s = '..' THEN "
              f"regexp_replace(acc, {lit(U.LAST_SEGMENT)}, '') WHEN s = '.' THEN acc ELSE acc || '/' || s END, '')")
    return f"(CASE WHEN {folded} = '' THEN '/' ELSE {folded} END)"


def _url_tail(query: str, fragment: str) -> str:
    return (f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END || "
            f"CASE WHEN {fragment} <> '' THEN '#' || {fragment} ELSE '' END)")


def resolve(base: str, ref: str) -> str:
    from lisible.functions import urls as U
    b_scheme = f"regexp_extract({base}, {lit(U.BASE_SCHEME)}, 1)"
    b_auth = f"regexp_extract({base}, {lit(U.BASE_AUTHORITY)}, 1)"
    b_path = f"regexp_extract({base}, {lit(U.BASE_PATH)}, 1)"
    b_query = f"regexp_extract({base}, {lit(U.BASE_QUERY)}, 1)"
    prefix = f"({b_scheme} || '://' || {b_auth})"
    r_path = f"regexp_extract({ref}, {lit(U.REF_PATH)}, 1)"
    r_query = f"regexp_extract({ref}, {lit(U.REF_QUERY)}, 1)"
    r_frag = f"regexp_extract({ref}, {lit(U.REF_FRAGMENT)}, 1)"
    r_rest = _url_tail(r_query, r_frag)
    base_dir = f"regexp_replace(CASE WHEN {b_path} = '' THEN '/' ELSE {b_path} END, '[^/]*$', '')"
    merged = f"regexp_replace({base_dir} || {r_path}, {lit(U.SLASH_RUN)}, '/', 'g')"
    q = f"(CASE WHEN {r_query} <> '' THEN {r_query} ELSE {b_query} END)"
    return (f"(CASE WHEN {ref} IS NULL OR {base} IS NULL THEN NULL "
            f"WHEN {ref} = '' THEN {base} "
            f"WHEN regexp_matches({base}, {lit(U.BASE_AUTHORITY)}) AND regexp_matches({b_auth}, {lit(U.BAD_AUTHORITY)}) THEN NULL "
            f"WHEN regexp_matches({ref}, {lit(U.SCHEME_PREFIX)}) THEN {ref} "
            f"WHEN NOT regexp_matches({base}, {lit(U.BASE_AUTHORITY)}) THEN {ref} "
            f"WHEN starts_with({ref}, '//') THEN {b_scheme} || ':' || {ref} "
            f"WHEN starts_with({ref}, '/') THEN {prefix} || {remove_dot_segments(r_path)} || {r_rest} "
            f"WHEN {r_path} = '' THEN {prefix} || {b_path} || {_url_tail(q, r_frag)} "
            f"ELSE {prefix} || {remove_dot_segments(merged)} || {r_rest} END)")


def relocate_images(text: str) -> str:
    from lisible.functions import markdown as M
    mark = "chr(57344) || chr(57348)"
    marked = f"regexp_replace(replace({text}, {ESCAPE_SQL}, {ESCAPED_SQL}), {lit(M.BLANK_RUN)}, {mark}, 'g')"
    marked = f"regexp_replace({marked}, '(\\n|' || {mark} || ')#+', '\\1' || {mark}, 'g')"
    nn = "chr(10) || chr(10)"
    one = (f"regexp_replace(p, {lit(M.IMAGE)}, '', 'g') || {nn} || "
           f"array_to_string(regexp_extract_all(p, {lit(M.IMAGE)}), {nn})")
    return f"replace(array_to_string(list_transform(string_split({marked}, {mark}), lambda p: {one}), {nn}), {ESCAPED_SQL}, {ESCAPE_SQL})"


def scored_text_ctes(source: str, key: str, prefix: str) -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}_means(key, n_sentences, A1..C2)`` for texts in ``source(key, text)``."""
    from lisible.constants import SCORER_MAX_TOKENS
    return [
        (f"{prefix}_s", sentences_cte(source, key=key)),
        (f"{prefix}_t", f"SELECT *, {token_count('sentence')} AS n_tokens FROM {prefix}_s"),
        (f"{prefix}_k", f"SELECT * FROM {prefix}_t WHERE n_tokens <= {SCORER_MAX_TOKENS}"),
        *lix_probability_ctes(f"{prefix}_k", name=f"{prefix}_p"),
        (f"{prefix}_means", f"SELECT {key}, count(*) AS n_sentences, " + ", ".join(f"avg({lv}) AS {lv}" for lv in LEVELS)
                            + f" FROM {prefix}_p GROUP BY {key}"),
    ]


def rule_rewrite(s: str, keep_clauses: bool = False) -> str:
    from lisible.operators.simplify import CLAUSE_SPLIT, PARENS
    first = s if keep_clauses else f"regexp_split_to_array({s}, {lit(CLAUSE_SPLIT)})[1]"
    out = f"regexp_replace({first}, {lit(PARENS)}, '', 'g')"
    out = f"regexp_replace({out}, '[ \\t\\n\\r]+', ' ', 'g')"
    out = f"regexp_replace({out}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
    return out


def ids_text(list_expr: str) -> str:
    return f"array_to_string(list_transform({list_expr}, lambda x: CAST(x AS VARCHAR)), ' ')"
