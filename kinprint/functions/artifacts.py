"""Everything one scan derives from one source text, as an Arrow function."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinprint.functions.lexer import BLANK, Lexed, code_units, language_family, lex

SCHEMA_VERSION = 3
MAX_IDENTS, MAX_COMMENT_HASHES, MAX_FUNCS, MAX_BODY, MAX_BLOCK_LINES = 512, 256, 128, 20_000, 64

# --- fixed values: flagged names and the words counted by the structure profile ---
FLAG_NAMES = "freopen fopen fclose fread fwrite ifstream ofstream fstream system popen execl execlp execv execvp fork remove unlink".split()
STRUCT_WORDS = "for while if else do switch case break continue return try catch def class struct enum union template".split()
STRUCT_PUNCT = "; { } ( ) [ ]".split()
# --- end of fixed values ---

#: The profile: word counts, punctuation counts, three unused places, deepest nesting, openings at depth 1 to 8.
STRUCT_DIMS = len(STRUCT_WORDS) + len(STRUCT_PUNCT) + 3 + 1 + 8
_SLOT = {("w", x): i for i, x in enumerate(STRUCT_WORDS)} | {("p", x): len(STRUCT_WORDS) + i for i, x in enumerate(STRUCT_PUNCT)}
_DEEPEST = STRUCT_DIMS - 9
_OPEN = {("p", "{"), ("p", "("), ("p", "["), ("w", "begin")}
_CLOSE = {("p", "}"), ("p", ")"), ("p", "]"), ("w", "end")}

_FLAG = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(FLAG_NAMES)})(?![A-Za-z0-9_])")
_BLANKS = re.compile(f"[{BLANK}]+")
_MARK = re.compile(r"//|/\*|\*/|^\{|\}$|^\(\*|\*\)$|^#")
_DEF = re.compile(rf"^([{BLANK}]*)(?:async[{BLANK}]+)?def[{BLANK}]+([A-Za-z0-9_]+)[{BLANK}]*\(")

OFFSET, PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF
_HASHED: dict[str, int] = {}


def fnv32a(units: str) -> int:
    """FNV-1a of 32 bits over code units."""
    found = _HASHED.get(units)
    if found is None:
        found = OFFSET
        for c in units:
            found = ((found ^ ord(c)) * PRIME) & MASK
        if len(units) < 64:
            if len(_HASHED) > 200_000:
                _HASHED.clear()
            _HASHED[units] = found
    return found


def fnv_all(values: list[str]) -> list[int]:
    """fnv32a of all values; those seen before cost no call."""
    known = _HASHED.get
    return [fnv32a(x) if (h := known(x)) is None else h for x in values]


def kgrams(base: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k values, modulo 2**32; none if there are fewer than k or k <= 0."""
    n = len(base) - k + 1
    if k <= 0 or n <= 0:
        return np.zeros(0, dtype=np.uint32)
    b, h = base.astype(np.uint32), np.zeros(n, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint32(PRIME) + b[j : j + n]
    return h


def well_formed(units: str) -> str:
    """Code units as text that can be encoded: halves of a pair become U+FFFD."""
    return re.sub("[\ud800-\udfff]", "\ufffd", units)


def token_text(values: list[str]) -> str:
    return "\n".join(values)


def keyword_flags(text: str) -> list[str]:
    return sorted(set(_FLAG.findall(text)))


def comment_lines(raw: str) -> list[str]:
    """Comparable lines of a comment: first mark blanked, blanks collapsed, at least 4 long, 64 a comment at most."""
    lines = (_BLANKS.sub(" ", _MARK.sub(" ", line.lstrip("\t "), count=1)).strip(" ") for line in raw.split("\n"))
    kept = [x for x in lines if len(x) >= 4]
    return kept[:MAX_BLOCK_LINES]


def struct_vector(kinds: list[str], values: list[str]) -> list[float]:
    """Damped counts of structure words, punctuation and nesting: ln(1 + count)."""
    v = [0] * STRUCT_DIMS
    depth = 0
    for token in zip(kinds, values):
        slot = _SLOT.get(token)
        if slot is not None:
            v[slot] += 1
        if token in _OPEN:
            depth += 1
            v[_DEEPEST] = max(v[_DEEPEST], depth)
            v[_DEEPEST + min(depth, 8)] += 1
        elif token in _CLOSE:
            depth = max(0, depth - 1)
    return [math.log1p(x) for x in v]


def _partners(tokens: list[tuple[str, str]], opening: tuple[str, str], closing: tuple[str, str]) -> dict[int, int]:
    """Index of the closing token of each opening one, if it has one."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for i, t in enumerate(tokens):
        if t == opening:
            stack.append(i)
        elif t == closing and stack:
            out[stack.pop()] = i
    return out


def _braced_functions(t: Lexed) -> Iterator[tuple[str, list[str]]]:
    """name ( ... ) up to three words { body }: declarations without a body are passed over, bodies are not searched."""
    tokens, names = list(zip(t.kinds, t.values)), dict(t.names)
    round_, curly = _partners(tokens, ("p", "("), ("p", ")")), _partners(tokens, ("p", "{"), ("p", "}"))
    i = 0
    while i + 1 < len(tokens):
        if t.kinds[i] == "v" and i + 1 in round_:
            brace = round_[i + 1] + 1
            last = brace + 3
            while brace < min(last, len(tokens)) and t.kinds[brace] != "p":
                brace += 1
            if brace in curly:
                yield names.get(i, ""), t.values[brace + 1 : curly[brace]]
                i = curly[brace] + 1
                continue
        i += 1


def _indented_functions(units: str) -> Iterator[tuple[str, list[str]]]:
    """def lines with all lines after them that are blank or indented deeper."""
    lines = units.split("\n")
    i = 0
    while i < len(lines):
        m = _DEF.match(lines[i])
        if not m:
            i += 1
            continue
        j = i + 1
        while j < len(lines) and (not lines[j].strip(BLANK) or len(lines[j]) - len(lines[j].lstrip(" \t")) > len(m[1])):
            j += 1
        yield m[2], lex("\n".join(lines[i:j]), "python").values
        i = j


def _begin_end_functions(t: Lexed) -> Iterator[tuple[str, list[str]]]:
    """procedure or function with its first begin ... end; the search stops at one without."""
    tokens, names = list(zip(t.kinds, t.values)), dict(t.names)
    pairs = _partners(tokens, ("w", "begin"), ("w", "end"))
    i = 0
    while i < len(tokens):
        if tokens[i] not in (("w", "procedure"), ("w", "function")):
            i += 1
            continue
        begin = next((j for j in range(i + 1, len(tokens)) if tokens[j] == ("w", "begin")), None)
        if begin not in pairs:
            return
        first = next((j for j in range(i + 1, begin) if t.kinds[j] == "v"), None)
        yield names.get(first, "") if first is not None else "", t.values[begin + 1 : pairs[begin]]
        i = pairs[begin] + 1


def functions(t: Lexed, units: str, family: str) -> list[dict]:
    """Signatures of the first 128 functions: name, tokens of the body, hash of its normalised text."""
    found = _indented_functions(units) if family == "python" else _begin_end_functions(t) if family == "pascal" else _braced_functions(t)
    out = []
    for n, (name, body) in enumerate(found):
        if n >= MAX_FUNCS:
            break
        if 0 < len(body) <= MAX_BODY:
            out.append({"name": well_formed(name), "len": len(body), "hash": fnv32a(token_text(body))})
    return out


def artifacts(code: str, lang: str | None, k: int) -> dict:
    """All derived columns of one text."""
    units = code_units(code)
    family = language_family(lang)
    t = lex(units, family)
    hashes = fnv_all(t.values)
    base = np.array(hashes, dtype=np.uint32)
    lines = [x for raw in t.comments for x in comment_lines(raw)]
    return {
        "code_hash": hashlib.sha1(well_formed(token_text(t.values)).encode()).hexdigest(),
        "k": k,
        "token_count": len(t.values),
        "hashes": np.unique(kgrams(base, k)).astype(np.int64).tolist(),
        "schema_version": SCHEMA_VERSION,
        "base_hashes": hashes,
        "lex_base_hashes": fnv_all(t.lexical),
        "tf": list(Counter(v for kind, v in zip(t.kinds, t.values) if kind == "w").items()),
        "struct_vec": struct_vector(t.kinds, t.values),
        "funcs": functions(t, units, family),
        "idents": sorted({name for _, name in t.names})[:MAX_IDENTS],
        "comment_hashes": sorted({fnv32a(x) for x in lines})[:MAX_COMMENT_HASHES],
        "comment_count": len(lines),
        "flags": keyword_flags(code),
    }


_LONGS = pa.list_(pa.int64())
ARTIFACT_FIELDS = [
    ("code_hash", pa.string(), "string"), ("k", pa.int32(), "int"), ("token_count", pa.int32(), "int"), ("hashes", _LONGS, "array<bigint>"),
    ("schema_version", pa.int32(), "int"), ("base_hashes", _LONGS, "array<bigint>"), ("lex_base_hashes", _LONGS, "array<bigint>"),
    ("tf", pa.map_(pa.string(), pa.int32()), "map<string,int>"), ("struct_vec", pa.list_(pa.float64()), "array<double>"),
    ("funcs", pa.list_(pa.struct([("name", pa.string()), ("len", pa.int32()), ("hash", pa.int64())])), "array<struct<name:string,len:int,hash:bigint>>"),
    ("idents", pa.list_(pa.string()), "array<string>"), ("comment_hashes", _LONGS, "array<bigint>"), ("comment_count", pa.int32(), "int"), ("flags", pa.list_(pa.string()), "array<string>"),
]


def with_artifacts(df: DataFrame, code: str = "code", lang: str = "lang", k: int = 8) -> DataFrame:
    """df without the code column, with the derived columns; a null code counts as empty."""
    keep = [c for c in df.columns if c != code]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f[0] for f in ARTIFACT_FIELDS]
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows = [artifacts(c or "", x, k) for c, x in zip(batch.column(len(keep)).to_pylist(), batch.column(keep.index(lang)).to_pylist())]
            made = [pa.array([r[name] for r in rows], kind) for name, kind, _ in ARTIFACT_FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=keep + names)

    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{name} {kind}" for name, _, kind in ARTIFACT_FIELDS)])
    return df.select(*keep, code).mapInArrow(run, ddl)
