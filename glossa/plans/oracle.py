"""SQL for the registered queries, written the other way round.

Where the engine scans for known surfaces and folds arrays, this tokenises everything,
sums lengths over windows, stems forward by CASE and joins twice; DuckDB runs it.
"""

from __future__ import annotations

import re
from pathlib import Path

from ..functions.patterns import ABBREVIATIONS
from ..operators import review
from ..operators.apply import OUT_OF_ORDER, OVERLAP
from .queries import PARAGRAPHS, corpus_lexicon, prose_sql

_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_C, _V = "bcdfghjklmnpqrstvwxyz", "aeiou"


def _lexicon_cte() -> str:
    rows = ", ".join(f"('{b}', {i}, '{a}')" for b, alts in corpus_lexicon().entries.items() for i, a in enumerate(alts))
    return f"lex(base, pos, raw) AS (VALUES {rows}), bases AS (SELECT DISTINCT base FROM lex)"


_PROSE = f"prose AS (SELECT doc_id, {prose_sql()} AS text FROM documents)"
_WORDS = r"""
pieces AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p FROM prose)),
placed AS (SELECT doc_id, s, CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM pieces),
words AS MATERIALIZED (SELECT doc_id, e - length(s) AS st, e AS en, s FROM placed WHERE regexp_matches(s, '^[\p{L}\p{N}_]'))"""


def _spans(kind: str, pattern: str) -> str:
    """Matches of a pattern with offsets: gaps and matches alternate."""
    return f"""SELECT doc_id, '{kind}' AS kind, CAST(e - length(m) AS BIGINT) AS st, CAST(e AS BIGINT) AS en, g FROM (
        SELECT doc_id, g, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
            SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
                SELECT doc_id, string_split_regex(text, '{pattern}') AS gs, regexp_extract_all(text, '{pattern}') AS ms FROM prose)))"""


PROTECTED = "raw AS MATERIALIZED (" + " UNION ALL ".join(_spans(k, p) for k, p in (
    ("fenced", "(?s)```.*?```"), ("indented", r"(?m)^(?: {4}|\t).+$"), ("inline", r"`[^`\n]+`"), ("url", f"https?://[^{_SPACES}]+"),
)) + ")"
_MERGED = """
reach AS (SELECT doc_id, st, en, max(en) OVER (PARTITION BY doc_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM raw),
islands AS (SELECT *, sum(CASE WHEN upto IS NULL OR st > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY st, en) AS isle FROM reach),
prot AS (SELECT doc_id, min(st) AS st, max(en) AS en FROM islands GROUP BY doc_id, isle)"""
_FREE = """
kept_out AS (SELECT DISTINCT w.doc_id, w.st FROM words w JOIN raw r ON r.doc_id = w.doc_id AND r.st < w.en AND r.en > w.st),
free AS MATERIALIZED (SELECT w.* FROM words w ANTI JOIN kept_out USING (doc_id, st))"""


def _stem(k: str) -> str:
    """struct of stem and suffix by the first rule that fits."""
    undo = lambda p: (
        f"CASE WHEN regexp_matches({p}, '[{_C}]$') AND length({p}) >= 2 AND right({p}, 1) = left(right({p}, 2), 1) THEN left({p}, length({p}) - 1) "
        f"WHEN regexp_matches({p}, '[{_V}][{_C}]$') THEN {p} || 'e' ELSE {p} END"
    )
    cut = lambda n: f"left({k}, length({k}) - {n})"
    one = lambda s, f: f"{{'stem': {s}, 'suffix': '{f}'}}"
    return f"""CASE WHEN suffix({k}, 'ies') AND length({k}) >= 4 THEN {one(cut(3) + " || 'y'", "-ies")}
        WHEN suffix({k}, 'ied') AND length({k}) >= 4 THEN {one(cut(3) + " || 'y'", "-ied")}
        WHEN suffix({k}, 'ing') AND length({undo(cut(3))}) >= 3 THEN {one(undo(cut(3)), "-ing")}
        WHEN suffix({k}, 'ed') AND length({undo(cut(2))}) >= 2 THEN {one(undo(cut(2)), "-ed")}
        WHEN regexp_matches({k}, '(s|x|z|ch|sh)es$') AND length({k}) >= 4 THEN {one(cut(2), "-es")}
        WHEN suffix({k}, 's') AND length({k}) >= 3 THEN {one(cut(1), "-s")}
        WHEN suffix({k}, 'ly') AND length({k}) >= 4 THEN {one(cut(2), "-ly")}
        ELSE {one(k, "")} END"""


def _inflect(w: str, s: str) -> str:
    cy, vc, body = f"regexp_matches({w}, '[{_C}]y$')", f"regexp_matches({w}, '[{_V}][{_C}]$')", f"left({w}, length({w}) - 1)"
    return f"""CASE WHEN {s} = '' THEN {w} WHEN contains({w}, ' ') OR contains({w}, '-') THEN NULL
        WHEN {s} IN ('-s', '-es', '-ies') THEN CASE WHEN {cy} THEN {body} || 'ies' WHEN regexp_matches({w}, '([sxz]|[cs]h)$') THEN {w} || 'es' ELSE {w} || 's' END
        WHEN {s} IN ('-ed', '-ied') THEN CASE WHEN suffix({w}, 'e') THEN {w} || 'd' WHEN {cy} THEN {body} || 'ied' WHEN {vc} THEN NULL ELSE {w} || 'ed' END
        WHEN {s} = '-ing' THEN CASE WHEN suffix({w}, 'e') THEN {body} || 'ing' WHEN {vc} THEN NULL ELSE {w} || 'ing' END
        WHEN {s} = '-ly' THEN {w} || 'ly' END"""


_FOUND = f"""
keyed AS (SELECT doc_id, st, en, s, lower(s) AS k, {_stem("lower(s)")} AS f FROM free),
hits AS MATERIALIZED (SELECT doc_id, st, en, s, b.base, CASE WHEN k = b.base THEN '' ELSE f.suffix END AS suf
    FROM keyed JOIN bases b ON b.base = CASE WHEN k IN (SELECT base FROM bases) THEN k ELSE f.stem END),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS ord FROM hits),
opts AS (SELECT doc_id, ord, pos, raw, m, row_number() OVER (PARTITION BY doc_id, ord ORDER BY pos) AS no FROM (
    SELECT o.doc_id, o.ord, l.pos, l.raw, {_inflect("l.raw", "o.suf")} AS m FROM ordered o JOIN lex l USING (base)) WHERE m IS NOT NULL),
menus AS (SELECT doc_id, ord, string_agg(m, '|' ORDER BY no) AS alts, max(no) AS n FROM opts GROUP BY doc_id, ord),
sug AS (SELECT o.*, coalesce(alts, '') AS alts, coalesce(n, 0) AS n FROM ordered o LEFT JOIN menus USING (doc_id, ord))"""
BASE = f"WITH {_PROSE}, {_WORDS}, {PROTECTED}, {_FREE}, {_lexicon_cte()}, {_FOUND}"
BOUNDS = f"""bounds AS (SELECT doc_id, en - 1 AS b FROM ({_spans("end", f"[.!?][{_SPACES}]+[A-Z]")}) x JOIN prose USING (doc_id)
    WHERE NOT (substr(text, CAST(st + 1 AS BIGINT), 1) = '.' AND lower(regexp_extract(left(text, st), '([\\p{{L}}.]*)$', 1)) IN ({", ".join(f"'{a}'" for a in ABBREVIATIONS)})))"""
_BLANKS = f"blanks AS (SELECT doc_id, en AS b FROM ({_spans('blank', '\\n[ \\t]*\\n')}))"
_WINDOWS = """
cuts AS (SELECT * FROM bounds UNION ALL SELECT * FROM blanks WHERE doc_id NOT IN (SELECT doc_id FROM bounds)),
ends AS (SELECT s.doc_id, s.ord, s.st, s.en, any_value(s.alts) AS alts, coalesce(max(CASE WHEN b <= s.st THEN b END), 0) AS ws, min(CASE WHEN b > s.st THEN b END) AS nx FROM sug s LEFT JOIN cuts USING (doc_id) GROUP BY s.doc_id, s.ord, s.st, s.en),
wins AS (SELECT e.*, coalesce(nx, length(text)) AS we, text FROM ends e JOIN prose USING (doc_id))"""
_DECIDED = f"""
lines AS (SELECT doc_id, ord, base, suf, st, en, s, n, doc_id * 31 + ord * 7 AS k FROM sug),
typed AS (SELECT *, trim(CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN ' x ' WHEN k % 17 = 0 THEN '99' WHEN doc_id % 97 = 0 AND ord = 5 THEN '{review.INTERRUPT}' ELSE CAST(k % 4 AS VARCHAR) END) AS line FROM lines),
nums AS (SELECT *, TRY_CAST(line AS BIGINT) AS num FROM typed),
ok AS (SELECT *, line = '' OR coalesce(num BETWEEN 0 AND n, false) AS valid FROM nums),
picks AS (SELECT ok.*, o.raw AS picked FROM ok LEFT JOIN opts o ON o.doc_id = ok.doc_id AND o.ord = ok.ord AND o.no = ok.num AND ok.valid AND ok.num > 0),
mem AS (SELECT *, last_value(picked IGNORE NULLS) OVER (PARTITION BY doc_id, base ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM picks),
defs AS (SELECT m.*, o.no AS def FROM mem m LEFT JOIN opts o ON o.doc_id = m.doc_id AND o.ord = m.ord AND o.raw = m.kept),
fin AS (SELECT *, CASE WHEN line = '' THEN coalesce(def, 0) WHEN valid THEN num ELSE 0 END AS choice FROM defs)"""


_LINES = """
lines AS (SELECT doc_id, ord, base, suf, st, en, s, n, doc_id * 31 + ord * 7 AS k FROM sug),
typed AS (SELECT *, CASE WHEN k % 11 = 0 THEN '' ELSE CAST(k % (n + 1) AS VARCHAR) END AS line, CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS wrong FROM lines),
picks AS (SELECT t.*, o.raw AS picked FROM typed t LEFT JOIN opts o ON o.doc_id = t.doc_id AND o.ord = t.ord AND t.line <> '' AND o.no = k % (n + 1)),
mem AS (SELECT *, last_value(picked IGNORE NULLS) OVER (PARTITION BY doc_id, base ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM picks),
defs AS (SELECT m.*, o.no AS def FROM mem m LEFT JOIN opts o ON o.doc_id = m.doc_id AND o.ord = m.ord AND o.raw = m.kept),
fin AS (SELECT *, CASE WHEN line = '' THEN coalesce(def, 0) ELSE k % (n + 1) END AS choice FROM defs)"""


def _cased(s: str, r: str) -> str:
    capital = f"upper(left({r}, 1)) || substr({r}, 2)"
    first = f"left({s}, 1)"
    return f"CASE WHEN upper({s}) = {s} AND lower({s}) <> {s} THEN upper({r}) WHEN upper({first}) = {first} AND lower({first}) <> {first} THEN {capital} WHEN lower({s}) = {s} AND upper({s}) <> {s} THEN lower({r}) ELSE {r} END"


def _applied(made: str) -> str:
    """Texts with the choices of a (doc_id, st, en, s, m) relation put in."""
    return f"""cho AS ({made}),
    nxt AS (SELECT c.*, p.text, lead(st) OVER (PARTITION BY doc_id ORDER BY st) AS nst, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS rn FROM cho c JOIN prose p USING (doc_id)),
    spl AS (SELECT doc_id, string_agg(CASE WHEN rn = 1 THEN left(text, st) ELSE '' END || {_cased("s", "m")} || CASE WHEN nst IS NULL THEN substr(text, CAST(en + 1 AS BIGINT)) ELSE substr(text, CAST(en + 1 AS BIGINT), CAST(nst - en AS BIGINT)) END, '' ORDER BY st) AS r FROM nxt GROUP BY doc_id),
    rev AS (SELECT p.doc_id, coalesce(r, p.text) AS revised FROM prose p LEFT JOIN spl USING (doc_id))"""


def _violations() -> str:
    return f"""WITH {_PROSE}, l AS (SELECT doc_id AS lexicon, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS a FROM prose),
    t AS (SELECT lexicon, a, unnest(range(0, len(a) // 3)) AS p FROM l),
    e AS MATERIALIZED (SELECT lexicon, p, a[3 * p + 1] AS base, CASE WHEN p % 50 = 49 THEN NULL WHEN p % 70 = 69 THEN [] ELSE [a[3 * p + 2], a[3 * p + 3]] END AS alts FROM t),
    w AS MATERIALIZED (SELECT lexicon, p, base, unnest(alts) AS word, generate_subscripts(alts, 1) AS i FROM e),
    bad AS (
        SELECT e.lexicon, e.p, 0 AS ph, 0 AS i, 1 AS c, e.base AS entry, 'duplicate_base' AS rule, e.base AS word FROM e WHERE EXISTS (SELECT 1 FROM e o WHERE o.lexicon = e.lexicon AND o.base = e.base AND o.p < e.p)
        UNION ALL SELECT e.lexicon, e.p, 0, 0, 2, e.base, 'base_is_alternative', e.base FROM e WHERE EXISTS (SELECT 1 FROM w WHERE w.lexicon = e.lexicon AND w.word = e.base AND w.p < e.p)
        UNION ALL SELECT lexicon, p, 0, 0, 3, base, 'not_a_list', base FROM e WHERE alts IS NULL
        UNION ALL SELECT lexicon, p, 0, 0, 4, base, 'empty', base FROM e WHERE len(alts) = 0
        UNION ALL SELECT lexicon, p, 0, 0, 5, base, 'own_base', base FROM e WHERE list_contains(alts, base)
        UNION ALL SELECT w.lexicon, w.p, 1, w.i, 6, w.base, 'alternative_is_base', w.word FROM w WHERE EXISTS (SELECT 1 FROM e o WHERE o.lexicon = w.lexicon AND o.base = w.word AND o.p < w.p)
        UNION ALL SELECT w.lexicon, w.p, 1, w.i, 7, w.base, 'duplicate_alternative', w.word FROM w WHERE EXISTS (SELECT 1 FROM w o WHERE o.lexicon = w.lexicon AND o.word = w.word AND (o.p, o.i) < (w.p, w.i)))
    SELECT CAST(lexicon AS BIGINT) AS lexicon, entry, rule, word FROM bad QUALIFY row_number() OVER (PARTITION BY lexicon ORDER BY p, ph, i, c) = 1"""


_MATRIX = "(VALUES ('-ies'), ('-ied'), ('-ing'), ('-ed'), ('-es'), ('-s'), ('-ly'), (''), ('-xyz')) AS x(suffix)"
HEAD = f"WITH {_PROSE}, {_WORDS}"
_PROMPT = """array_to_string([regexp_replace(sen, '\\n+$', ''), repeat(' ', CAST(st - ws AS BIGINT)) || repeat('^', CAST(en - st AS BIGINT)), '  0) NO CHANGE'], chr(10)) || chr(10)
    || CASE WHEN alts = '' THEN '' ELSE array_to_string(list_transform(range(1, len(a) + 1), lambda i: '  ' || i || ') ' || a[i]), chr(10)) || chr(10) END"""



def _packaged_rows() -> str:
    """The packaged lexicon read line by line, without what is under test: word = [words]."""
    out = []
    for line in (Path(__file__).parents[1] / "data" / "lexicon.toml").read_text(encoding="utf-8").splitlines():
        base, _, alts = line.partition("=")
        out += [(base.strip().strip('"'), i, a) for i, a in enumerate(re.findall('"([^"]*)"', alts))]
    return ", ".join(f"('{b}', {i}, '{a.replace(chr(39), chr(39) * 2)}')" for b, i, a in out)


ORACLE_SQL: dict[str, str] = {
    "tokenize_offsets": f'{HEAD} SELECT doc_id, st AS start, en AS "end", s AS surface FROM words',
    "protected_spans_raw": f'WITH {_PROSE}, {PROTECTED} SELECT doc_id, kind, st AS start, en AS "end" FROM raw',
    "protected_spans_merged": f'WITH {_PROSE}, {PROTECTED}, {_MERGED} SELECT doc_id, st AS start, en AS "end" FROM prot',
    "tokens_unprotected": f'{HEAD}, {PROTECTED}, {_FREE} SELECT doc_id, st AS start, en AS "end" FROM free',
    "tokens_protected_semi": f'{HEAD}, {PROTECTED}, {_MERGED} SELECT doc_id, w.st AS start, w.en AS "end" FROM words w SEMI JOIN prot p ON p.doc_id = w.doc_id AND p.st < w.en AND p.en > w.st',
    "stem_vocabulary": f"{HEAD}, v AS (SELECT DISTINCT lower(s) AS key FROM words), f AS (SELECT key, {_stem('key')} AS x FROM v) SELECT key, x.stem AS stem, x.suffix AS suffix FROM f",
    "lexicon_lookup": f"{BASE} SELECT doc_id, st AS start, base, suf AS suffix FROM hits",
    "reinflect_matrix": f"{HEAD}, v AS (SELECT DISTINCT lower(s) AS raw FROM words) SELECT raw AS alternative, suffix, {_inflect('raw', 'suffix')} AS inflected FROM v, {_MATRIX}",
    "suggest_exact": f"""{BASE} SELECT doc_id, st AS start, en AS "end", s AS surface, base, suf AS suffix, alts AS alternatives FROM sug WHERE suf = ''""",
    "suggest": f'{BASE} SELECT doc_id, ord AS match_ord, st AS start, en AS "end", s AS surface, base, suf AS suffix, alts AS alternatives FROM sug',
    "suggest_offers": f"{BASE} SELECT doc_id, ord AS match_ord, no AS option_no, m AS alternative FROM opts",
    "sentence_boundaries": f"WITH {_PROSE}, {BOUNDS} SELECT doc_id, CAST(b AS BIGINT) AS boundary FROM bounds",
    "sentence_windows": f"{BASE}, {BOUNDS}, {_BLANKS}, {_WINDOWS} SELECT doc_id, st AS start, CAST(ws AS BIGINT) AS win_start, CAST(we AS BIGINT) AS win_end, substr(text, CAST(ws + 1 AS BIGINT), CAST(we - ws AS BIGINT)) AS sentence FROM wins",
    "block_windows": f"{BASE}, {_BLANKS} SELECT s.doc_id, s.st AS start, CAST(coalesce(max(CASE WHEN b <= s.st THEN b END), 0) AS BIGINT) AS win_start, CAST(coalesce(min(CASE WHEN b > s.st THEN b END), any_value(length(text))) AS BIGINT) AS win_end FROM sug s JOIN prose USING (doc_id) LEFT JOIN blanks USING (doc_id) GROUP BY s.doc_id, s.st",
    "prompts": f"{BASE}, {BOUNDS}, {_BLANKS}, {_WINDOWS}, w2 AS (SELECT *, substr(text, CAST(ws + 1 AS BIGINT), CAST(we - ws AS BIGINT)) AS sen, string_split(alts, '|') AS a FROM wins) SELECT doc_id, ord AS match_ord, {_PROMPT} AS prompt FROM w2",
    "decisions_parsed": f"{BASE}, {_DECIDED} SELECT doc_id, ord AS match_ord, CAST(choice AS BIGINT) AS choice_no, valid FROM fin",
    "remembered_defaults": f"{BASE}, {_DECIDED} SELECT doc_id, ord AS match_ord, CAST(def AS BIGINT) AS default_no FROM fin",
    "case_transfer": f"{BASE}, pairs AS (SELECT DISTINCT s, m FROM opts JOIN sug USING (doc_id, ord)) SELECT s AS surface, m AS replacement, {_cased('s', 'm')} AS result FROM pairs",
    "apply_first_choice": f"{BASE}, {_applied('SELECT doc_id, st, en, s, m FROM sug JOIN opts USING (doc_id, ord) WHERE ord % 2 = 0 AND no = 1')} SELECT doc_id, revised FROM rev",
    "session_replay": f"""{BASE}, {_DECIDED}, stops AS (SELECT doc_id, min(CASE WHEN line = '{review.INTERRUPT}' THEN ord END) AS stop FROM fin GROUP BY doc_id),
        {_applied("SELECT f.doc_id, f.st, f.en, f.s, o.m FROM fin f JOIN stops USING (doc_id) JOIN opts o ON o.doc_id = f.doc_id AND o.ord = f.ord AND o.no = f.choice WHERE f.choice > 0 AND (stop IS NULL OR f.ord < stop)")}
        SELECT rev.doc_id, revised, CAST(CASE WHEN stop IS NULL THEN {review.DONE} ELSE {review.INTERRUPTED} END AS BIGINT) AS exit_code FROM rev LEFT JOIN stops USING (doc_id)""",
    "lexicon_violations": _violations(),
    "replay_lines": f"""{BASE}, {_LINES}, {_applied("SELECT f.doc_id, f.st, f.en, f.s, o.m FROM fin f JOIN opts o ON o.doc_id = f.doc_id AND o.ord = f.ord AND o.no = f.choice WHERE f.choice > 0")},
        told AS (SELECT doc_id, sum(wrong) AS w FROM typed GROUP BY doc_id)
        SELECT rev.doc_id, revised, CAST({review.DONE} AS BIGINT) AS exit_code, CAST(coalesce(w, 0) AS BIGINT) AS invalid FROM rev LEFT JOIN told USING (doc_id)""",
    "prompts_marked": f"""{BASE}, {BOUNDS}, {_BLANKS}, {_WINDOWS}, w2 AS (SELECT *, regexp_replace(substr(text, CAST(ws + 1 AS BIGINT), CAST(we - ws AS BIGINT)), '\\n+$', '') AS sen, string_split(alts, '|') AS a, CAST(st - ws AS BIGINT) AS i, CAST(en - st AS BIGINT) AS l, ord % 3 AS d FROM wins)
        SELECT doc_id, ord AS match_ord, left(sen, i) || chr(27) || '[1m' || substr(sen, i + 1, l) || chr(27) || '[0m' || substr(sen, i + l + 1) || chr(10) || repeat(' ', i) || repeat('^', l) || chr(10)
            || '  0) {review.NO_CHANGE}' || CASE WHEN d = 0 THEN ' [default]' ELSE '' END || chr(10)
            || CASE WHEN alts = '' THEN '' ELSE array_to_string(list_transform(range(1, len(a) + 1), lambda j: '  ' || j || ') ' || a[j] || CASE WHEN d = j THEN ' [default]' ELSE '' END), chr(10)) || chr(10) END AS prompt FROM w2""",
    "choice_errors": f"""{BASE}, made AS (SELECT doc_id, ord, st, CASE WHEN doc_id % 5 = 0 AND ord % 4 = 1 THEN en + 40 ELSE en END AS en, CASE WHEN doc_id % 7 = 0 AND ord > 2 THEN -ord ELSE ord END AS pos FROM sug),
        pairs AS (SELECT doc_id, pos, st, en, lead(st) OVER w AS nst FROM made WINDOW w AS (PARTITION BY doc_id ORDER BY pos, st, en)),
        bad AS (SELECT doc_id, CASE WHEN st > nst THEN '{OUT_OF_ORDER}' ELSE '{OVERLAP}' END AS error, pos, st FROM pairs WHERE st > nst OR en > nst)
        SELECT doc_id, error FROM bad QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, st) = 1""",
    "text_source": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, text FROM benchmark",
    "file_source": f"WITH {_PROSE} SELECT doc_id % 8 AS part, true AS valid, string_agg(text || chr(10), '' ORDER BY doc_id) AS text FROM prose GROUP BY 1 UNION ALL SELECT 8, false, NULL",
    "file_sink": f"WITH {_PROSE} SELECT doc_id, text FROM prose",
    "rewritten_in_place": f"{BASE}, {_applied('SELECT doc_id, st, en, s, m FROM sug JOIN opts USING (doc_id, ord) WHERE ord % 2 = 0 AND no = 1')} SELECT doc_id, revised FROM rev",
    "lexicon_file": """WITH i AS (SELECT DISTINCT item_id, kind, brand FROM items WHERE item_id IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(kind, 'None'), coalesce(brand, 'None')) - 1 AS pos FROM i)
        SELECT 'item' || item_id AS base, pos AS alt_pos, coalesce(kind, 'None') || ' no. ' || item_id || ' "' || coalesce(brand, 'None') || '" ' || pos AS raw FROM n""",
    "lexicon_packaged": f"""{HEAD}, lex(base, pos, raw) AS (VALUES {_packaged_rows()}), c AS (SELECT lower(s) AS base, count(*) AS n FROM words GROUP BY 1)
        SELECT lex.base, CAST(pos AS BIGINT) AS alt_pos, raw, coalesce(n, 0) AS times FROM lex LEFT JOIN c USING (base)""",
}
