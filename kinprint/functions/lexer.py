"""Language-aware lexing of source text into normalised tokens.

One compiled pattern per family recognises the next lexeme; what is kept of it
depends only on its kind.  Token streams ignore comments, layout, literals and
names, so they stay the same when a program is renamed or reformatted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# --- fixed values: language keys, keywords and operators that decide the token stream ---
C_LANGS = "c cc cc.cc98 cc.cc11 cc.cc11o2 cc.cc14 cc.cc17 cc.cc17o2 cc.cc20 cc.cc20o2 cpp cxx gcc g++ java kt kotlin rs rust go golang cs csharp swift d zig nim".split()
PYTHON_LANGS = "py py2 py3 pypy pypy3 python python2 python3 rb ruby pl perl php lua js javascript ts typescript sh bash zsh r".split()
PASCAL_LANGS = "pas pascal fpc fp".split()

C_KEYWORDS = """alignas alignof and asm auto bool break case catch char class const const_cast constexpr continue decltype
default delete do double dynamic_cast else enum explicit export extern false final float for friend goto if inline int long
mutable namespace new noexcept not nullptr operator or override private protected public register reinterpret_cast return
short signed sizeof static static_cast struct switch template this throw throws true try typedef typeid typename union
unsigned using virtual void volatile wchar_t while xor abstract extends implements import instanceof interface native
package strictfp super synchronized transient""".split()
PYTHON_KEYWORDS = """False None True and as assert async await break class continue def del elif else except finally for
from global if import in is lambda nonlocal not or pass raise return try while with yield match case""".split()
PASCAL_KEYWORDS = """and array begin case const div do downto else end file for function goto if in label mod nil not of or
packed procedure program record repeat set then to type until uses var while with out string integer longint int64 qword
cardinal ansistring boolean char real byte word""".split()

C_OPERATORS = "<<= >>= <=> ... ->* << >> <= >= == != && || += -= *= /= %= &= |= ^= -> ++ -- :: .*".split()
PYTHON_OPERATORS = "**= //= <<= >>= ** // -> <= >= == != += -= *= /= %= &= |= ^=".split()
PASCAL_OPERATORS = ":= <= >= <> ..".split()
PLAIN_OPERATORS = "<= >= == != && || += -= *= /= %= -> ++ -- ::".split()
# --- end of fixed values ---

FAMILIES = {"c": C_LANGS, "python": PYTHON_LANGS, "pascal": PASCAL_LANGS}


#: Characters that count as blank when text is trimmed or collapsed.
BLANK = " \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def family_regex(family: str) -> str:
    """A pattern for lower-cased language keys of a family: the key alone or followed by '.' or '-' and anything."""
    return "^(" + "|".join(re.escape(x) for x in FAMILIES[family]) + r")([.-].*)?$"


_FAMILY = {f: re.compile(family_regex(f), re.S) for f in FAMILIES}


def language_family(lang: str | None) -> str:
    """c, python, pascal or plain (also for null)."""
    key = (lang or "").lower()
    return next((f for f, rx in _FAMILY.items() if rx.match(key)), "plain")


@dataclass(frozen=True)
class _Family:
    """How a family's lexemes look; the alternatives are tried in order."""

    operators: list[str]
    keywords: frozenset
    comments: str = r"(?!)"
    dropped: str = r"(?!)"
    strings: dict[str, str] = field(default_factory=dict)
    to_line_end: frozenset = frozenset()
    to_semicolon: frozenset = frozenset()
    fold_case: bool = False

    def pattern(self) -> re.Pattern:
        strings = "|".join(f"(?P<{name}>{rx})" for name, rx in self.strings.items()) or r"(?!)"
        operators = "|".join(re.escape(o) for o in self.operators) or r"(?!)"
        return re.compile(
            rf"[ \t\r\n\f\v]*+(?:(?P<comment>{self.comments})|(?P<dropped>{self.dropped})|{strings}"
            rf"|(?P<number>[0-9][A-Za-z0-9_$.]*)|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<punct>{operators}|[\s\S]))"
        )


_REST_OF_LINE = r"(?:\\[\s\S]?|[^\n\\])*"  # a backslash takes the next character along, a line end included


def _quoted(q: str) -> str:
    return rf"{q}(?:\\[\s\S]?|[^{q}\\\n])*{q}?"


_C_COMMENTS = rf"//{_REST_OF_LINE}|/\*[\s\S]*?(?:\*/|\Z)"
_FAMILIES = {
    "c": _Family(
        C_OPERATORS, frozenset(C_KEYWORDS), _C_COMMENTS, rf"\#{_REST_OF_LINE}", {"S": _quoted('"'), "C": _quoted("'")},
        frozenset({"import", "package"}), frozenset({"using"}),
    ),
    "python": _Family(
        PYTHON_OPERATORS, frozenset(PYTHON_KEYWORDS), rf"\#{_REST_OF_LINE}", strings={"S": r"\"{3}[\s\S]*?(?:\"{3}|\Z)|'{3}[\s\S]*?(?:'{3}|\Z)|" + _quoted('"') + "|" + _quoted("'")},
        to_line_end=frozenset({"import", "from"}),
    ),
    "pascal": _Family(
        PASCAL_OPERATORS, frozenset(PASCAL_KEYWORDS), r"(?<!')\{[\s\S]*?(?:\}|\Z)|\(\*[\s\S]*?(?:\*\)|\Z)", strings={"S": r"'(?:''|[^'\n])*['\n]?"},
        to_semicolon=frozenset({"uses", "program"}), fold_case=True,
    ),
    "plain": _Family(PLAIN_OPERATORS, frozenset(), _C_COMMENTS),
}
_PATTERNS = {name: f.pattern() for name, f in _FAMILIES.items()}
_LINE_REST, _STATEMENT = re.compile(_REST_OF_LINE), re.compile(r"[^;\n]*;?")


def code_units(text: str) -> str:
    """The text as UTF-16 code units, one character each: lengths and hashes count these."""
    if not text or max(text) <= "\uffff":
        return text
    return "".join(map(chr, memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H")))


@dataclass
class Lexed:
    """kinds: w keyword, p punctuation, v placeholder; lexical keeps names as written; names: (token index, name)."""

    kinds: list[str]
    values: list[str]
    lexical: list[str]
    names: list[tuple[int, str]]
    comments: list[str]


def lex(units: str, family: str) -> Lexed:
    """Tokens of a text in code units (see code_units)."""
    how, match = _FAMILIES[family], _PATTERNS[family].match
    out = Lexed([], [], [], [], [])
    kinds, values, lexical = out.kinds.append, out.values.append, out.lexical.append
    at, end = 0, len(units)
    while at < end:
        m = match(units, at)
        if m is None:  # blanks to the end
            break
        kind = m.lastgroup
        if kind == "dropped":
            at = m.end()
            continue
        text, at = m[kind], m.end()
        if kind == "comment":
            out.comments.append(text)
            continue
        if kind == "word":
            word = text.lower() if how.fold_case else text
            start = at - len(text)
            if (word in how.to_line_end or word in how.to_semicolon) and not units[units.rfind("\n", 0, start) + 1 : start].strip(" \t\r"):
                at = (_LINE_REST if word in how.to_line_end else _STATEMENT).match(units, start).end()
                continue
            if word in how.keywords:
                kinds("w")
                values(word)
            else:
                out.names.append((len(out.values), word))
                kinds("v")
                values("V")
            lexical(word)
            continue
        value = text if kind == "punct" else "N" if kind == "number" else kind
        kinds("p" if kind == "punct" else "v")
        values(value)
        lexical(value)
    return out
