import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinprint.functions import artifacts as art
from kinprint.functions.lexer import code_units, language_family, lex


@pytest.mark.parametrize("lang,family", [("cc.cc17o2", "c"), ("java", "c"), ("g++", "c"), ("python3.11", "python"), ("py.py3", "python"), ("PAS", "pascal"), ("brainfk", "plain"), ("cpp17", "plain"), (None, "plain"), ("", "plain")])
def test_family(lang, family):
    assert language_family(lang) == family


def values(text, family):
    return lex(code_units(text), family).values


def test_c_stream_is_blind_to_names_layout_and_comments():
    a = values("#include <x>\nusing namespace std;\nint main() { int x = 3; // note\n return x; }", "c")
    b = values("int  main ( )\n{ int  other=42 ;/* long\n */ return other; }", "c")
    assert a == b == ["int", "V", "(", ")", "{", "int", "V", "=", "N", ";", "return", "V", ";", "}"]


def test_python_stream():
    a = values('import os\nfrom a import b\ndef f(x):\n    """doc"""\n    return x ** 2  # c\n', "python")
    b = values("def g(y):\n  'doc'\n  return y ** 7", "python")
    assert a == b


def test_pascal_folds_case_and_drops_uses():
    a = values("program p;\nuses crt;\nBEGIN { note } x := 'it''s'; (* more *) END.", "pascal")
    assert a == values("begin y := 'a'; end.", "pascal") == ["begin", "V", ":=", "S", ";", "end", "."]


@pytest.mark.parametrize(
    "text,family,expected",
    [
        ("1e+5", "c", ["N", "+", "N"]),
        ("'ab\nx", "c", ["C", "V"]),
        ('"a\\"b" y', "c", ["S", "V"]),
        ("/* open", "c", []),
        ("// a \\\n still\nz", "c", ["V"]),
        ("x #define y\nz", "c", ["V", "V"]),
        ('"""open', "python", ["S"]),
        ("a // b", "python", ["V", "//", "V"]),
        ("a // b", "pascal", ["V", "/", "/", "V"]),
        ("a b", "plain", ["V", " ", "V"]),
        ("say 'hi'", "plain", ["V", "'", "V", "'"]),
        ("x <<= y->*z", "c", ["V", "<<=", "V", "->*", "V"]),
        ("int using;", "c", ["int", "using", ";"]),
        ("", "c", []),
    ],
)
def test_lexer_rules(text, family, expected):
    assert values(text, family) == expected


def test_lexical_channel_keeps_names():
    t = lex("Foo bar = 1", "c")
    assert t.lexical == ["Foo", "bar", "=", "N"] and t.names == [(0, "Foo"), (1, "bar")]
    assert lex("Foo", "pascal").lexical == ["foo"]


def test_long_inputs_need_no_stack():
    assert values('"' + "\\a" * 200_000 + '"', "c") == ["S"]
    assert values("// " + "\\\n" * 200_000 + "x", "plain") == []


@given(st.text(max_size=200), st.sampled_from(["c", "python", "pascal", "plain"]))
@settings(max_examples=200, deadline=None)
def test_lexer_takes_any_text(text, family):
    t = lex(code_units(text), family)
    assert len(t.kinds) == len(t.values) == len(t.lexical)


@pytest.mark.parametrize("text,value", [("", 2166136261), ("int", 2515107422), ("main", 3935363592), ("(", 755801111), (")", 739023492), ("{", 4262220314), ("a", 3826002220), ("é", 1812687940), ("日本", 1610399396)])
def test_fnv_golden_values(text, value):
    assert art.fnv32a(text) == value


def test_fnv_counts_code_units(spark):
    from pyspark.sql import functions as F

    from kinprint.functions import hashing

    h = 2166136261
    for unit in (0xD83D, 0xDE00):
        h = ((h ^ unit) * 16777619) % 2**32
    assert art.fnv32a(code_units("😀")) == h == spark.range(1).select(hashing.fnv32a(F.lit("😀"))).first()[0]


def test_kgrams():
    import numpy as np

    tokens = [art.fnv32a(f"tok_{i % 37}") for i in range(200)]
    naive = []
    for j in range(193):
        h = 0
        for v in tokens[j : j + 8]:
            h = (h * 16777619 + v) % 2**32
        naive.append(h)
    assert art.kgrams(np.array(tokens), 8).tolist() == naive
    assert len(art.kgrams(np.array([1, 2, 3]), 5)) == 0 and len(art.kgrams(np.array([1]), 0)) == 0


def test_flags_and_comments():
    assert art.keyword_flags("freopenx") == []
    assert art.keyword_flags("fopen(); fopen(); system(); éfork()") == ["fopen", "fork", "system"]
    assert art.comment_lines("// foo    bar\t\tbaz") == ["foo bar baz"]
    assert art.comment_lines("/* cache lookup */") == ["cache lookup */"]
    assert art.comment_lines("// ab") == [] and len(art.comment_lines("\n".join(["// line x"] * 100))) == 64


def test_functions():
    code = "int add(int a, int b) const { if (a) { return a; } return b; }\nint decl(int);\nvoid run() { add(1, 2); }"
    found = art.functions(lex(code, "c"), code, "c")
    assert [f["name"] for f in found] == ["add", "run"]
    renamed = code.replace("add", "plus")
    assert [(f["len"], f["hash"]) for f in art.functions(lex(renamed, "c"), renamed, "c")] == [(f["len"], f["hash"]) for f in found]
    py = "def f(x):\n    y = 1\n\n    return y\nz = 2\nasync def g():\n  pass\n"
    assert [f["name"] for f in art.functions(lex(py, "python"), py, "python")] == ["f", "g"]
    pas = "procedure go(x: integer); begin if x then begin end; end; begin end."
    assert [f["name"] for f in art.functions(lex(pas, "pascal"), pas, "pascal")] == ["go"]


def test_struct_vector():
    t = lex("for (;;) { if (x) { } }", "c")
    v = [round(2.718281828459045**x - 1) for x in art.struct_vector(t.kinds, t.values)]
    assert len(v) == 37 and v[0] == 1 and v[2] == 1 and v[18:25] == [2, 2, 2, 2, 2, 0, 0] and v[28] == 2 and v[29:31] == [2, 2]


def test_artifacts_of_odd_texts():
    for code in ("", "   ", "// only a note", "﻿x", "😀 = 1", "a\r\nb", "x" * 100_000):
        a = art.artifacts(code, None, 8)
        assert a["token_count"] == len(a["base_hashes"]) == len(a["lex_base_hashes"])
    assert art.artifacts("// only a note", "c", 8)["code_hash"] == art.artifacts("", "c", 8)["code_hash"]


def test_catalyst_and_scanner_agree(spark):
    from pyspark.sql import functions as F

    from kinprint.functions import hashing

    texts = ["a b 1.5 // c\n d", "x<=y /* z */ 😀 é", "", None, "1 2 3 4 5 6 7 8 9 10 abc $q _r ->", "/* open"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    base = hashing.fnv_all(hashing.plain_tokens(hashing.plain_lexemes(F.col("text"))))
    got = {r["i"]: r for r in df.select("i", base.alias("b"), hashing.kgrams(base, 8).alias("g")).collect()}
    for i, t in enumerate(texts):
        if t and "😀" in t:  # one lexeme to Catalyst, two code units to the scanner
            continue
        a = art.artifacts(t or "", None, 8)
        assert got[i]["b"] == a["base_hashes"] and sorted(set(got[i]["g"])) == a["hashes"]


@given(st.text(alphabet="ab1.\"'\\\\\n #/*{}()<>=+-:;import using def", max_size=80))
@settings(max_examples=300, deadline=None)
def test_sql_expressions_cut_like_the_scanner(text):
    """The expressions that check the lexers find the same tokens as the scanner."""
    from kinprint.plans.sql_lexer import _COMMENTS, _DROPPED, pattern_of

    for family in ("c", "python", "pascal", "plain"):
        found = [m.group() for m in pattern_of(family).finditer("\n" + text)]
        if family == "pascal":
            found = [y for x in found for y in ([x[:-1], "{"] if x.startswith("'") and x.endswith("'{") else [x])]
        kept = [x for x in found if x != "{" and not x.startswith((*_COMMENTS[family], *_DROPPED[family]))] if family == "pascal" else [x for x in found if not x.startswith((*_COMMENTS[family], *_DROPPED[family]))]
        got = [v for v in lex(text, family).values if not (family == "pascal" and v == "{")]
        assert len(kept) == len(got), (family, text)


@pytest.mark.parametrize("family", ["c", "python", "pascal", "plain"])
def test_blanks_between_lexemes(family):
    assert lex(" \t\r\n\f\v", family).values == [] and lex("", family).values == []
    assert lex("  a \f\v 1\t", family).values == lex("a 1", family).values == ["V", "N"]
    assert lex(" \n  import b\n a", family).values == (["V"] if family in ("c", "python") else ["V", "V", "V"])
