"""Token hashes, k-grams and the plain lexer as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinprint.functions.artifacts import FLAG_NAMES, OFFSET, PRIME
from kinprint.functions.lexer import PLAIN_OPERATORS, family_regex

MASK = 4294967295


def _escaped(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


#: Lexemes of the plain family in the order they are tried; possessive, so long inputs need no stack.
PLAIN_LEXEMES = "|".join([r"//(?:\\[\s\S]|[^\n\\])*+", r"/\*[\s\S]*?(?:\*/|\z)", r"[0-9][A-Za-z0-9_$.]*", r"[A-Za-z_$][A-Za-z0-9_$]*", *map(_escaped, PLAIN_OPERATORS), r"[^ \t\r\n\f\x0B]"])


def family(lang: Column) -> Column:
    """Lexer family of a language key: c, python, pascal, or plain for all others and null."""
    key = F.lower(F.coalesce(lang, F.lit("")))
    out = F.lit("plain")
    for name in ("pascal", "python", "c"):
        out = F.when(key.rlike("(?s)" + family_regex(name)), name).otherwise(out)
    return out


def plain_lexemes(text: Column) -> Column:
    """Lexemes of a text in the plain family without comments; a null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLAIN_LEXEMES), F.lit(0))
    return F.filter(found, lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))


def plain_tokens(lexemes: Column) -> Column:
    """Numbers as N, words as V, the rest as it is."""
    return F.transform(lexemes, lambda t: F.when(t.rlike("^[0-9]"), "N").when(t.rlike("^[A-Za-z_$]"), "V").otherwise(t))


def plain_lexical(lexemes: Column) -> Column:
    """Numbers as N, all else as written."""
    return F.transform(lexemes, lambda t: F.when(t.rlike("^[0-9]"), "N").otherwise(t))


def fnv32a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 code units, as a bigint."""
    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * F.lit(PRIME).cast("bigint")).bitwiseAND(F.lit(MASK))

    def char(h: Column, c: Column) -> Column:
        point = F.ascii(c).cast("bigint")
        high = F.lit(0xD800).cast("bigint") + F.shiftright(point - 0x10000, 10)
        low = F.lit(0xDC00).cast("bigint") + (point - 0x10000).bitwiseAND(F.lit(0x3FF).cast("bigint"))
        return F.when(point < 0x10000, step(h, point)).otherwise(step(step(h, high), low))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(OFFSET).cast("bigint"), char)


def fnv_all(tokens: Column) -> Column:
    return F.transform(tokens, fnv32a)


def kgrams(base: Column, k: int) -> Column:
    """Polynomial hashes of all runs of k values modulo 2**32; empty if there are fewer than k."""
    if k <= 0:
        return F.array().cast("array<bigint>")
    n = F.size(base)
    def one(j: Column) -> Column:
        return F.aggregate(F.slice(base, j, k), F.lit(0).cast("bigint"), lambda h, v: (h * F.lit(PRIME).cast("bigint") + v).bitwiseAND(F.lit(MASK)))

    return F.when(n < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), one))


def as_set(values: Column) -> Column:
    """Distinct values in ascending order."""
    return F.array_sort(F.array_distinct(values))


def unsigned_set(values: Column) -> Column:
    """Hash values modulo 2**32, distinct and ascending; nulls are dropped, a null list is empty."""
    return as_set(F.transform(F.filter(F.coalesce(values, F.array().cast("array<bigint>")), lambda x: x.isNotNull()), lambda x: x.bitwiseAND(F.lit(MASK))))


def unsigned(values: Column) -> Column:
    """Hash values modulo 2**32 in their order."""
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<bigint>")), lambda x: x.isNotNull()), lambda x: x.bitwiseAND(F.lit(MASK)))


def code_hash(tokens: Column) -> Column:
    """SHA-1 of the tokens joined by line feeds."""
    return F.sha1(F.array_join(tokens, "\n"))


def keyword_flags(code: Column) -> Column:
    """Flagged names that stand as whole ASCII words anywhere in the raw text, sorted."""
    pattern = rf"(?<![A-Za-z0-9_])({'|'.join(FLAG_NAMES)})(?![A-Za-z0-9_])"
    return as_set(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(pattern), F.lit(1)))


def round4(x: Column) -> Column:
    """Half-up rounding to four decimals, as floor(x * 10000 + 0.5) / 10000."""
    return F.floor(x * 10000 + 0.5) / 10000


def split_lines(text: Column) -> Column:
    """Lines of a text with CRLF as LF."""
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)


_BLANK = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def comment_lines(comment: Column) -> Column:
    """Comparable lines of one comment: first mark blanked, blanks collapsed and trimmed, at least 4 long, the first 64."""
    def tidy(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^[\t ]*", "")
        once = F.regexp_replace(bare, r"(?s)^(.*?)(?://|/\*|\*/|(?<![\s\S])\{|\}(?![\s\S])|(?<![\s\S])\(\*|\*\)(?![\s\S])|(?<![\s\S])#)", "$1 ")
        return F.regexp_replace(F.regexp_replace(once, f"[{_BLANK}]+", " "), "^ | $", "")

    lines = F.transform(F.split(F.coalesce(comment, F.lit("")), "\n", -1), tidy)
    return F.slice(F.filter(lines, lambda x: F.length(x) >= 4), 1, 64)
