"""Queries on text: lexing, hashing, flags, comments, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import hashing
from kinprint.functions.artifacts import FLAG_NAMES, STRUCT_PUNCT, with_artifacts
from kinprint.functions.lexer import PLAIN_OPERATORS, family_regex
from kinprint.operators import latest
from kinprint.plans import sql_lexer as sql
from kinprint.plans.registry import query
from kinprint.session import spread
from kinprint.sources.tables import table

# The same lexemes for DuckDB, whose regex engine has no possessive quantifiers and needs none.
_LEXEMES = "|".join([r"//(?:\\[\s\S]|[^\n\\])*", r"/\*[\s\S]*?(?:\*/|\z)", r"[0-9][A-Za-z0-9_$.]*", r"[A-Za-z_$][A-Za-z0-9_$]*", *("".join(f"\\{c}" for c in o) for o in PLAIN_OPERATORS), r"[^ \t\r\n\f\x0B]"])
_RAW = f"raw as (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{_LEXEMES}'), lambda t: not (starts_with(t, '//') or starts_with(t, '/*'))) r from documents)"
_TOKENS = f"""{_RAW}, tokens as (select doc_id, r,
  list_transform(r, lambda t: case when regexp_matches(t, '^[0-9]') then 'N' when regexp_matches(t, '^[A-Za-z_$]') then 'V' else t end) v from raw)"""
_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
_BASE = f"{_TOKENS}, base as (select doc_id, list_transform(v, lambda t: {_FNV.format('t')}) b from tokens)"
_GRAMS = f"""{_BASE}, grams as (select doc_id, case when len(b) < 8 then [] else list_transform(range(1, len(b) - 6), lambda j:
  list_reduce(list_prepend(0::bigint, b[j:j+7]), lambda h, x: (h * 16777619 + x) & 4294967295)) end g from base)"""
_JOINED = "md5(array_to_string(list_transform({0}, lambda x: x::varchar), ','))"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", hashing.plain_lexemes(F.col("text")).alias("r"))


def _joined(values):
    return F.md5(F.array_join(values.cast("array<string>"), ","))


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", hashing.fnv_all(hashing.plain_tokens(F.col("r"))).alias("b"))


@query("select lang, case " + " ".join(f"when regexp_matches(lower(coalesce(lang, '')), '{family_regex(f)}') then '{f}'" for f in ("c", "python", "pascal")) + " else 'plain' end family, count(*) n from (select lang from submissions union all select lang from documents) group by lang")
def lang_family(spark: SparkSession, folder: str) -> DataFrame:
    """Lexer family of every language key."""
    rows = table(spark, folder, "submissions").select("lang").unionAll(table(spark, folder, "documents").select("lang"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", hashing.family(F.col("lang")).alias("family"), "n")


@query(f"with {_TOKENS} select doc_id, len(v) n_tokens, md5(array_to_string(v, chr(10))) tokens from tokens")
def tokenize_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised tokens of every document."""
    v = hashing.plain_tokens(F.col("r"))
    return _documents(spark, folder).select("doc_id", F.size(v).alias("n_tokens"), F.md5(F.array_join(v, "\n")).alias("tokens"))


@query(f"with {_RAW} select doc_id, md5(array_to_string(list_transform(r, lambda t: case when regexp_matches(t, '^[0-9]') then 'N' else t end), chr(10))) lexical from raw")
def lex_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The lexical channel of every document."""
    return _documents(spark, folder).select("doc_id", F.md5(F.array_join(hashing.plain_lexical(F.col("r")), "\n")).alias("lexical"))


@query(f"with {_BASE} select doc_id, len(b) n, {_JOINED.format('b')} hashes from base")
def fnv_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token hashes of every document."""
    return _base(spark, folder).select("doc_id", F.size("b").alias("n"), _joined(F.col("b")).alias("hashes"))


@query(f"with {_GRAMS} select doc_id, len(g) n, {_JOINED.format('g')} grams from grams")
def kgram_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """k-gram hashes of every document in order (k = 8)."""
    g = hashing.kgrams(F.col("b"), 8)
    return _base(spark, folder).select("doc_id", g.alias("g")).select("doc_id", F.size("g").alias("n"), _joined(F.col("g")).alias("grams"))


@query(f"with {_GRAMS} select doc_id, len(list_distinct(g)) n, {_JOINED.format('list_sort(list_distinct(g))')} fingerprint from grams")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint sets of every document."""
    rows = _base(spark, folder).select("doc_id", hashing.as_set(hashing.kgrams(F.col("b"), 8)).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), _joined(F.col("s")).alias("fingerprint"))


@query(f"with {_TOKENS} select doc_id, sha1(array_to_string(v, chr(10))) code_hash from tokens")
def code_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Identity of the normalised text of every document."""
    return _documents(spark, folder).select("doc_id", hashing.code_hash(hashing.plain_tokens(F.col("r"))).alias("code_hash"))


@query(rf"""select rid, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(code, ''), '\b({"|".join(FLAG_NAMES)})\b', 1))), ',') flags from submissions""")
def keyword_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged names in the inline code of every submission (the two regex engines differ in what \\b means, hence two patterns)."""
    return table(spark, folder, "submissions").select("rid", F.array_join(hashing.keyword_flags(F.col("code")), ",").alias("flags"))


_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_BLANKS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]+"
_LINES = rf"""lines as (select rid, flatten(list_transform(regexp_extract_all(coalesce(code, ''), '{_COMMENT}'), lambda c: list_filter(list_transform(string_split(c, chr(10)),
  lambda l: trim(regexp_replace(regexp_replace(regexp_replace(l, '^[\t ]*', ''), '//|/\*|\*/|^\{{|\}}$|^\(\*|\*\)$|^#', ' '), '{_BLANKS}', ' ', 'g'))), lambda l: length(l) >= 4)[1:64])) l from submissions)"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    blocks = F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(_COMMENT), F.lit(0))
    return table(spark, folder, "submissions").select("rid", F.flatten(F.transform(blocks, hashing.comment_lines)).alias("l"))


@query(f"with {_LINES} select rid, len(l) n, array_to_string(l, chr(10)) lines from lines")
def comment_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Comparable comment lines of every submission's inline code."""
    return _lines(spark, folder).select("rid", F.size("l").alias("n"), F.array_join("l", "\n").alias("lines"))


@query(f"with {_LINES} select rid, len(l) comment_count, array_to_string(list_transform(list_sort(list_distinct(list_transform(l, lambda t: {_FNV.format('t')})))[1:256], lambda x: x::varchar), ',') hashes from lines")
def comment_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of the comment lines, ascending, at most 256."""
    hashed = F.slice(hashing.as_set(hashing.fnv_all(F.col("l"))), 1, 256)
    return _lines(spark, folder).select("rid", F.size("l").alias("comment_count"), F.array_join(hashed.cast("array<string>"), ",").alias("hashes"))


@query(f"with {_RAW} select doc_id, array_to_string(list_sort(list_distinct(list_filter(r, lambda t: regexp_matches(t, '^[A-Za-z_$]'))))[1:512], ',') idents from raw")
def idents(spark: SparkSession, folder: str) -> DataFrame:
    """Names in every document, ascending, at most 512."""
    names = F.slice(hashing.as_set(F.filter("r", lambda t: t.rlike("^[A-Za-z_$]"))), 1, 512)
    return _documents(spark, folder).select("doc_id", F.array_join(names, ",").alias("idents"))


@query(f"""with {_RAW} select doc_id, {", ".join(f"list_count(list_filter(r, lambda t: t = '{p}')) n{i}" for i, p in enumerate(STRUCT_PUNCT))} from raw""")
def struct_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The punctuation counts of the structure profile of every document."""
    count = lambda mark: F.size(F.filter("r", lambda t: t == mark)).cast("bigint")
    return _documents(spark, folder).select("doc_id", *[count(p).alias(f"n{i}") for i, p in enumerate(STRUCT_PUNCT)])


# --- the scan's own lexer and artifacts, over the inline text of every submission ---


def _computed(spark: SparkSession, folder: str) -> DataFrame:
    """All artifacts of every submission's inline text, each rid once."""
    rows = latest.source_text(table(spark, folder, "submissions")).where((F.col("source") != "") & F.col("rid").isNotNull())
    return with_artifacts(rows.groupBy("rid").agg(F.min("lang").alias("lang"), F.min("source").alias("source")), "source", "lang")


@query(f"with {sql.TEXTS}, {sql.HASHED} select rid, code_hash, len(t) token_count, {_JOINED.format('b')} base, {_JOINED.format('lb')} lexical, len(hashes) n_hashes, {_JOINED.format('hashes')} hashes from made")
def code_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token stream, lexical stream and fingerprint of every submission, in all families."""
    return _computed(spark, folder).select("rid", "code_hash", "token_count", _joined(F.col("base_hashes")).alias("base"), _joined(F.col("lex_base_hashes")).alias("lexical"), F.size("hashes").alias("n_hashes"), _joined(F.col("hashes")).alias("hashes"))


@query(f"with {sql.TEXTS}, {sql.TOKENS} select rid, x.v term, count(*) n from (select rid, unnest(t) x from toks) where x.k = 'w' group by all")
def term_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword counts of every submission."""
    return _computed(spark, folder).select("rid", F.explode("tf").alias("term", "n")).withColumn("n", F.col("n").cast("bigint"))


@query(f"with {sql.TEXTS}, {sql.TOKENS}, {sql.DEPTHS}, p as ({sql.PROFILE}) select rid, array_to_string(coalesce(counts, list_resize([]::bigint[], 37, 0)), ',') counts from texts left join p using (rid)")
def struct_vec(spark: SparkSession, folder: str) -> DataFrame:
    """The structure profile of every submission, undamped: words, punctuation, deepest nesting and openings by depth."""
    counts = F.transform("struct_vec", lambda a: F.floor(F.exp(a) - 1 + 0.5).cast("string"))
    return _computed(spark, folder).select("rid", F.array_join(counts, ",").alias("counts"))


@query(f"""with {sql.TEXTS}, {sql.TOKENS}, c as (select rid, {sql.IDENTS} idents, {sql.COMMENT_LINES} lines, {sql.FLAGS} flags from toks)
select rid, md5(array_to_string(idents, chr(10))) idents, len(lines) comment_count, array_to_string({sql.COMMENT_HASHES.format('lines')}, ',') comment_hashes, array_to_string(flags, ',') flags from c""")
def code_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Names, comment lines and flags of every submission."""
    return _computed(spark, folder).select("rid", F.md5(F.array_join("idents", "\n")).alias("idents"), "comment_count", F.array_join(F.col("comment_hashes").cast("array<string>"), ",").alias("comment_hashes"), F.array_join("flags", ",").alias("flags"))


@query(f"""with recursive {sql.TEXTS}, {sql.TOKENS}, {sql.FUNCTIONS}
select rid, array_to_string(list(name || ' ' || len(body) || ' ' || {sql.FNV.format("array_to_string(body, chr(10))")} order by i), ',') funcs from funcs where len(body) between 1 and 20000 group by rid""")
def code_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Name, length and hash of every function of every submission that has any."""
    rows = _computed(spark, folder).where(F.size("funcs") > 0)
    return rows.select("rid", F.array_join(F.transform("funcs", lambda f: F.concat_ws(" ", f["name"], f["len"], f["hash"])), ",").alias("funcs"))


@query(f"select (select count(*) from documents) + (select count(distinct rid) from submissions where coalesce(files_code, '') = '' and coalesce(code, '') <> '' and {sql._FAMILY} = 'plain') texts, 0 other")
def plain_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the plain family, and how many of them the scan's lexer and the Catalyst one read differently."""
    subs = latest.source_text(table(spark, folder, "submissions")).where((F.col("source") != "") & F.col("rid").isNotNull() & (hashing.family(F.col("lang")) == "plain"))
    rows = subs.groupBy("rid").agg(F.min("source").alias("text")).unionAll(table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit(""))))
    lexemes = hashing.plain_lexemes(F.col("text"))
    both = with_artifacts(rows.select(hashing.code_hash(hashing.plain_tokens(lexemes)).alias("catalyst"), F.lit(None).cast("string").alias("lang"), "text"), "text", "lang")
    return both.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("catalyst") != F.col("code_hash")).alias("other"))


@query("""
with l as (select doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) x from documents)
select doc_id, len(x) n_lines, list_max(list_transform(x, lambda a: length(a))) longest, length(array_to_string(x, '')) n_chars from l""")
def split_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document."""
    rows = table(spark, folder, "documents").select("doc_id", hashing.split_lines(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("bigint").alias("n_lines"), F.array_max(F.transform("x", F.length)).cast("bigint").alias("longest"), F.length(F.array_join("x", "")).cast("bigint").alias("n_chars"))


@query()
def features(spark: SparkSession, folder: str) -> DataFrame:
    """All derived columns of every submission's inline code."""
    rows = latest.source_text(table(spark, folder, "submissions")).select("rid", "lang", "source")
    return with_artifacts(spread(rows.where(F.col("source") != "")), "source", "lang")
