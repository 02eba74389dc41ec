"""The lexers of all families as DuckDB SQL, to check the scan's own: one expression a family, from the same fixed values.

A line feed is put before each text, so that a line dropped as a whole begins
with one; what a lexeme is can then be told from its first characters.
"""

from __future__ import annotations

import re

from kinprint.functions.artifacts import FLAG_NAMES, MAX_COMMENT_HASHES, MAX_IDENTS, STRUCT_PUNCT, STRUCT_WORDS
from kinprint.functions.lexer import C_KEYWORDS, C_OPERATORS, PASCAL_KEYWORDS, PASCAL_OPERATORS, PLAIN_OPERATORS, PYTHON_KEYWORDS, PYTHON_OPERATORS, family_regex

_REST = r"(?:\\[\s\S]?|[^\n\\])*"
_START = r"\n[ \t\r]*"
_C_COMMENT = rf"//{_REST}|/\*[\s\S]*?(?:\*/|\z)"


def _quoted(q: str) -> str:
    return rf"{q}(?:\\[\s\S]?|[^{q}\\\n])*{q}?"


def _lexemes(special: list[str], operators: list[str]) -> str:
    tail = [r"[0-9][A-Za-z0-9_$.]*", r"[A-Za-z_$][A-Za-z0-9_$]*", *("".join(f"\\{c}" for c in o) for o in operators), r"[^ \t\r\n\f\x0B]"]
    return "|".join([*special, *tail]).replace("'", "''")


LEXEMES = {
    "c": _lexemes([rf"{_START}(?:import|package)\b{_REST}", rf"{_START}using\b[^;\n]*;?", _C_COMMENT, rf"#{_REST}", _quoted('"'), _quoted("'")], C_OPERATORS),
    "python": _lexemes([rf"{_START}(?:import|from)\b{_REST}", rf"#{_REST}", r'"{3}[\s\S]*?(?:"{3}|\z)', r"'{3}[\s\S]*?(?:'{3}|\z)", _quoted('"'), _quoted("'")], PYTHON_OPERATORS),
    # A brace right after a string opens no comment, so it is taken along with the string.
    "pascal": _lexemes([rf"{_START}(?i:uses|program)\b[^;\n]*;?", r"\(\*[\s\S]*?(?:\*\)|\z)", r"\{[\s\S]*?(?:\}|\z)", r"'(?:''|[^'\n])*'\{", r"'(?:''|[^'\n])*['\n]?"], PASCAL_OPERATORS),
    "plain": _lexemes([_C_COMMENT], PLAIN_OPERATORS),
}
_COMMENTS = {"c": ("//", "/*"), "python": ("#",), "pascal": ("{", "(*"), "plain": ("//", "/*")}
_DROPPED = {"c": ("#", "\n"), "python": ("\n",), "pascal": ("\n",), "plain": ()}
_STRINGS = {"c": {'"': "S", "'": "C"}, "python": {'"': "S", "'": "S"}, "pascal": {"'": "S"}, "plain": {}}
_KEYWORDS = {"c": C_KEYWORDS, "python": PYTHON_KEYWORDS, "pascal": PASCAL_KEYWORDS, "plain": []}


def _text(x: str) -> str:
    return "chr(10)" if x == "\n" else "'" + x.replace("'", "''") + "'"


def _starts(marks) -> str:
    return " or ".join(f"starts_with(t, {_text(m)})" for m in marks) or "false"


def _cases(make) -> str:
    return "case family " + " ".join(f"when '{f}' then {make(f)}" for f in LEXEMES) + " end"


def _token(f: str) -> str:
    word = "lower(t)" if f == "pascal" else "t"
    known = "[" + ", ".join(map(_text, _KEYWORDS[f])) + "]::varchar[]"
    quotes = " ".join(f"when t[1] = {_text(q)} then {{'k': 'v', 'v': '{s}', 'x': '{s}'}}" for q, s in _STRINGS[f].items())
    return f"""list_transform(list_filter(l, lambda t: not ({_starts([*_COMMENTS[f], *_DROPPED[f]])})), lambda t: case
      when regexp_matches(t, '^[0-9]') then {{'k': 'v', 'v': 'N', 'x': 'N'}} {quotes}
      when regexp_matches(t, '^[A-Za-z_$]') then case when list_contains({known}, {word}) then {{'k': 'w', 'v': {word}, 'x': {word}}} else {{'k': 'n', 'v': 'V', 'x': {word}}} end
      else {{'k': 'p', 'v': t, 'x': t}} end)"""


#: One row a text given by `texts` (rid, lang, source): its tokens as structs of kind (w keyword, n name, v literal, p punctuation), value and lexical value.
_SPLIT = r"""flatten(list_transform(r, lambda t: case when family = 'pascal' and t[1] = '''' and ends_with(t, '''{') then [t[:-2], '{'] else [t] end))"""
_FAMILY = "case " + " ".join(f"when regexp_matches(lower(coalesce(lang, '')), '{family_regex(f)}') then '{f}'" for f in ("c", "python", "pascal")) + " else 'plain' end"
# Such a brace then counts as a comment here, unlike in the scanner; the tables have none, and a test compares both without it.
TOKENS = f"""fam as (select rid, source, {_FAMILY} as family from texts),
raw as (select rid, family, source, {_cases(lambda f: f"regexp_extract_all(chr(10) || source, '{LEXEMES[f]}')")} r from fam),
lexemes as (select rid, family, source, {_SPLIT} l from raw),
toks as (select rid, family, source, l, {_cases(_token)} t from lexemes)"""

#: All submissions with a text of their own, each rid once.
TEXTS = "texts as (select rid, any_value(lang) lang, any_value(code) source from submissions where coalesce(files_code, '') = '' and coalesce(code, '') <> '' and rid is not null group by rid)"

FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
_GRAMS = "case when len({0}) < 8 then [] else list_transform(range(1, len({0}) - 6), lambda j: list_reduce(list_prepend(0::bigint, {0}[j:j+7]), lambda h, x: (h * 16777619 + x) & 4294967295)) end"
_VALUES, _LEXICAL = "list_transform(t, lambda x: x.v)", "list_transform(t, lambda x: x.x)"

#: Every different token is hashed once.
HASHED = f"""{TOKENS},
lexwords as (select distinct x from (select unnest({_VALUES}) x from toks union all select unnest({_LEXICAL}) from toks)),
dict as (select map_from_entries(list((x, {FNV.format('x')}))) m from lexwords),
based as (select rid, family, source, l, t, list_transform({_VALUES}, lambda x: dict.m[x]) b, list_transform({_LEXICAL}, lambda x: dict.m[x]) lb from toks, dict),
made as (select rid, family, source, l, t, b, lb, sha1(array_to_string({_VALUES}, chr(10))) code_hash, list_sort(list_distinct({_GRAMS.format('b')})) hashes, list_sort(list_distinct({_GRAMS.format('lb')})) lex_hashes from based)"""

_BLANKS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]+"
_MARKS = r"//|/\*|\*/|^\{|\}$|^\(\*|\*\)$|^#"
COMMENT_LINES = f"""flatten(list_transform(list_filter(l, lambda t: {_cases(lambda f: '(' + _starts(_COMMENTS[f]) + ')')}), lambda c: list_filter(list_transform(string_split(c, chr(10)),
  lambda y: trim(regexp_replace(regexp_replace(regexp_replace(y, '^[\t ]*', ''), '{_MARKS}', ' '), '{_BLANKS}', ' ', 'g'))), lambda y: length(y) >= 4)[1:64]))"""
IDENTS = f"list_sort(list_distinct(list_transform(list_filter(t, lambda x: x.k = 'n'), lambda x: x.x)))[1:{MAX_IDENTS}]"
FLAGS = rf"list_sort(list_distinct(regexp_extract_all(source, '\b({'|'.join(FLAG_NAMES)})\b', 1)))"
COMMENT_HASHES = f"list_sort(list_distinct(list_transform({{0}}, lambda y: {FNV.format('y')})))[1:{MAX_COMMENT_HASHES}]"

_OPEN = "(k = 'p' and v in ('{', '(', '[') or k = 'w' and v = 'begin')"
_CLOSE = "(k = 'p' and v in ('}', ')', ']') or k = 'w' and v = 'end')"
#: Nesting never falls below 0: the depth is the running sum less its least value so far.
DEPTHS = f"""flat as (select rid, i, x.k k, x.v v from (select rid, unnest(t) x, generate_subscripts(t, 1) i from toks)),
steps as (select rid, i, k, v, sum(case when {_OPEN} then 1 when {_CLOSE} then -1 else 0 end) over (partition by rid order by i) s from flat),
depths as (select rid, k, v, s - least(0, min(s) over (partition by rid order by i)) d from steps)"""
_COUNTED = [*(f"count_if(k = 'w' and v = '{w}')" for w in STRUCT_WORDS), *(f"count_if(k = 'p' and v = '{p}')" for p in STRUCT_PUNCT), "0", "0", "0", f"coalesce(max(d) filter ({_OPEN}), 0)", *(f"count_if({_OPEN} and least(d, 8) = {n})" for n in range(1, 9))]
PROFILE = f"select rid, [{', '.join(_COUNTED)}]::bigint[] counts from depths group by rid"


_U32 = "list_transform(coalesce({0}, []), lambda x: x & 4294967295)"
#: The features of a scan: cached ones where current, else those of the inline text (named files are not among the tables, so they read as empty).
FEATURES = f"""{TEXTS}, {HASHED}, {DEPTHS}, profiles as ({PROFILE}),
term_maps as (select rid, map_from_entries(list((v, n))) tf from (select rid, v, count(*)::int n from flat where k = 'w' group by all) group by rid),
cached as (select * from (select *, row_number() over (partition by rid order by rid) i from features where k = 8 and schema_version = 3 and rid is not null) where i = 1),
lexed as (select rid, code_hash, len(t)::int token_count, hashes, b base_hashes, lex_hashes, coalesce(tf, map([]::varchar[], []::int[])) tf,
  list_transform(coalesce(counts, list_resize([]::bigint[], 37, 0)), lambda x: ln(1 + x)) struct_vec, {IDENTS} idents, {COMMENT_HASHES.format(COMMENT_LINES)} comment_hashes, {FLAGS} flags
  from made left join term_maps using (rid) left join profiles using (rid)),
feats as (select rid, true hit, code_hash, token_count, list_sort(list_distinct({_U32.format('hashes')})) hashes, {_U32.format('base_hashes')} base_hashes,
  list_sort(list_distinct({_GRAMS.format('(' + _U32.format('lex_base_hashes') + ')')})) lex_hashes, tf, list_transform(struct_vec, lambda x: x::double) struct_vec, idents, list_sort(list_distinct({_U32.format('comment_hashes')})) comment_hashes, flags from cached
  union all select rid, false, * exclude (rid) from lexed where rid not in (select rid from cached))"""


def _equal_head(a: str, b: str) -> str:
    return f"coalesce(nullif(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]), false), 0) - 1, least(len({a}), len({b})))"


#: Lengths of longest common subsequences of the list pairs `both_` (id, a, b), as lcs (id, n): equal heads and tails count as
#: they are, the rest by the table of the recurrence, diagonal by diagonal, whose cells do not depend on each other.
LCS = f"""heads as (select id, a, b, {_equal_head('a', 'b')} h from both_),
rests as (select id, h, list_reverse(a[h + 1:]) a, list_reverse(b[h + 1:]) b from heads),
tails as (select id, h, a, b, {_equal_head('a', 'b')} e from rests),
middles as materialized (select id, h + e equal_, case when len(a) <= len(b) then a[e + 1:] else b[e + 1:] end a, case when len(a) <= len(b) then b[e + 1:] else a[e + 1:] end b from tails),
dp(id, d, p1, p2) using key (id) as (
  select id, 1, list_resize([]::int[], len(a) + 1, 0), list_resize([]::int[], len(a) + 1, 0) from middles where len(a) > 0
  union select id, d + 1, list_transform(range(0, len(a) + 1), lambda i: case when i = 0 or i >= d or d - i > len(b) then 0 else greatest(p1[i], p1[i + 1], p2[i] + (a[i] = b[d - i])::int) end), p1 from dp join middles using (id) where d <= len(a) + len(b)),
lcs as (select id, equal_ + coalesce(p1[len(a) + 1], 0) n from middles left join dp using (id))"""


_BLANK_SET = _BLANKS[:-1]
#: Functions of all texts in order, as funcs (rid, i, name, body): brackets meet their partners by their depth, and a
#: function begins after the one before it has ended.
FUNCTIONS = rf"""tk as (select rid, family, i, x.k k, x.v v, x.x x from (select rid, family, unnest(t) x, generate_subscripts(t, 1) i from toks)),
marks as (select rid, i, '(' kind, case v when '(' then 1 else -1 end s from tk where k = 'p' and v in ('(', ')') union all select rid, i, '{{', case v when '{{' then 1 else -1 end from tk where k = 'p' and v in ('{{', '}}')
  union all select rid, i, 'begin', case v when 'begin' then 1 else -1 end from tk where k = 'w' and v in ('begin', 'end')),
sums as (select *, sum(s) over (partition by rid, kind order by i) r from marks),
levels_ as (select *, r - least(0, min(r) over (partition by rid, kind order by i)) + case when s < 0 then 1 else 0 end level from sums),
nexts as (select rid, kind, i, s, lead(i) over w j, lead(s) over w sj from levels_ window w as (partition by rid, kind, level order by i)),
partner as (select rid, kind, i, j from nexts where s = 1 and sj = -1),
heads_ as (select a.rid, a.i, case when a.k = 'n' then a.x else '' end as name, r.j + 1 + (case when n1.k = 'p' then 0 when n2.k = 'p' then 1 when n3.k = 'p' then 2 else 3 end) brace
  from tk a join partner r on r.rid = a.rid and r.kind = '(' and r.i = a.i + 1 left join tk n1 on n1.rid = a.rid and n1.i = r.j + 1 left join tk n2 on n2.rid = a.rid and n2.i = r.j + 2 left join tk n3 on n3.rid = a.rid and n3.i = r.j + 3
  where a.k in ('n', 'v') and a.family in ('c', 'plain')),
braced as (select h.rid, h.i, h.name, h.brace first_, p.j last_ from heads_ h join partner p on p.rid = h.rid and p.kind = '{{' and p.i = h.brace),
starts_ as (select a.rid, a.i, min(b.i) b from tk a join tk b on b.rid = a.rid and b.i > a.i and b.k = 'w' and b.v = 'begin' where a.family = 'pascal' and a.k = 'w' and a.v in ('procedure', 'function') group by all),
begins as (select s.rid, s.i, s.b first_, p.j last_, coalesce((select arg_min(case when k = 'n' then x else '' end, i) from tk where tk.rid = s.rid and tk.i > s.i and tk.i < s.b and k in ('n', 'v')), '') as name from starts_ s left join partner p on p.rid = s.rid and p.kind = 'begin' and p.i = s.b),
ln_ as (select rid, unnest(y) line, generate_subscripts(y, 1) i from (select rid, string_split(source, chr(10)) y from toks where family = 'python')),
widths as (select *, length(regexp_extract(line, '^[ 	]*')) w, regexp_full_match(line, '{_BLANKS[:-1]}*') empty_, regexp_extract(line, '^({_BLANK_SET}*)(?:async{_BLANKS})?def{_BLANKS}([A-Za-z0-9_]+){_BLANK_SET}*\(', ['lead', 'name']) d from ln_),
defs as (select a.rid, a.i, a.d.name as name, a.i first_, coalesce((select min(b.i) from widths b where b.rid = a.rid and b.i > a.i and not b.empty_ and b.w <= length(a.d.lead)), (select max(i) + 1 from ln_ c where c.rid = a.rid)) - 1 last_ from widths a where a.d.name <> ''),
every_ as (select rid, i, name, first_, last_ from braced union all select rid, i, name, first_, last_ from begins union all select rid, i, name, first_, last_ from defs),
acc(rid, i, name, first_, last_) as (select rid, min(i), arg_min(name, i), arg_min(first_, i), arg_min_null(last_, i) from every_ group by rid
  union all select e.rid, min(e.i), arg_min(e.name, e.i), arg_min(e.first_, e.i), arg_min_null(e.last_, e.i) from acc join every_ e on e.rid = acc.rid and e.i > acc.last_ group by e.rid),
bodies as (select acc.rid, acc.i, name, family, first_, last_ from acc join toks using (rid) where last_ is not null),
pytexts as (select rid * 100000 + b.i rid, (select string_agg(line, chr(10) order by l.i) from ln_ l where l.rid = b.rid and l.i between b.first_ and b.last_) source from bodies b where family = 'python'),
pylex as (select rid, regexp_extract_all(chr(10) || source, '{LEXEMES['python']}') l, 'python' family from pytexts),
pytoks as (select rid, {_token('python')} t from pylex),
funcs as (select b.rid, b.i, name, case when b.family = 'python' then (select {_VALUES} from pytoks p where p.rid = b.rid * 100000 + b.i) else (select {_VALUES} from toks where toks.rid = b.rid)[first_ + 1:last_ - 1] end body from bodies b)"""


def pattern_of(family: str) -> re.Pattern:
    """The expression of a family for Python, to compare with the scanner's in tests."""
    return re.compile(LEXEMES[family].replace("''", "'").replace(r"\z", r"\Z"))
