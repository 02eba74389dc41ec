"""Statistics that tell running prose from lists, tables, code and junk, for one text or a stretch of it."""

from __future__ import annotations

import math
import re

#: Statistics of a text, in order.
STATISTICS = [
    "common_share",  # words that are among the language's common words
    "symbol_share",  # characters that are neither letters, digits nor usual punctuation
    "digit_share",
    "plain_share",  # space-separated pieces that are a word, with usual punctuation at most (in Chinese: characters that are Han)
    "odd_share",  # pieces that look like identifiers: mixed letters and digits, underscores, inner capitals
    "word_length",  # mean letters a word
    "line_words",  # ln(1 + mean words a line)
    "variety",  # different words of all words
    "end_share",  # lines that end in closing punctuation
    "bullet_share",  # lines that begin with a list mark, a number, a table bar or a label of a word or two
]
LANGUAGES = ("en", "de", "fr", "es", "zh")

# Frequent Chinese function characters, for which the common-word table has no rows.
ZH_COMMON = "的一是了在有我你他们这那不和就也都而及与或个中为以到要会可能对从后前上下里吗什么没很但所被把给"
_ZH = set(ZH_COMMON)

_CJK = r"㐀-䶿一-鿿"
_WORD = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*")
_HAN = re.compile(rf"[{_CJK}]")
_USUAL = set(".,;:!?'\"’‘“”„«»‹›¿¡()-–—…。，、？！；：（）《》「」%/")
_PLAIN = re.compile(rf"[\"'“”„«»‹›¿¡(‘’（《「]*(?:(?:[^\W\d_]+(?:['’\-][^\W\d_]+)*['’]?)|\d+(?:[.,]\d+)?%?)[\"'“”»«.,;:!?…)’。，、？！；：）》」]*")
_ODD = re.compile(r"\w*(?:_\w|[^\W\d_]\d|\d[^\W\d_]|[a-zà-ÿ][A-Z])\w*")
_BULLET = re.compile(r"\s*(?:[-–—•*·+|▪◦‣○●]\s|\[[ xX]?\]\s|\(?\d+[.)]\s|[|+#=~]|[^\W\d_]+(?: [^\W\d_]+)?: \S.{0,30}$)")
_DIGIT = re.compile(r"\d")
_SYMBOL = re.compile("[^\\w\\s" + re.escape("".join(sorted(_USUAL))) + "]|_")
_ENDS = tuple(".!?…。！？:;：；\"”»'’)）")


def clean(text: str) -> str:
    """One kind of line end; no byte order mark; no-break spaces are spaces."""
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "").replace("\u00a0", " ").replace("\u202f", " ")


def stretches(text: str, least: int = 80, most: int = 240) -> tuple[list[str], bool]:
    """The text cut into stretches of whole lines of about `least` characters; longer lines are cut evenly, at spaces if there are any.

    Together they hold every non-blank character of the text once.  A blank line ends a stretch.
    Also whether all cuts are at blanks.
    """
    at_blanks = True
    out: list[str] = []
    held: list[str] = []
    size = 0
    for line in clean(text).split("\n"):
        line = line.strip()
        if held and (not line or size >= least or len(line) > most):
            out.append("\n".join(held))
            held, size = [], 0
        if not line:
            continue
        if len(line) > most:
            part = len(line) / math.ceil(len(line) / most)
            at = 0
            while len(line) - at > part * 1.3:
                cut = line.find(" ", at + int(part * 0.9), at + int(part * 1.2))
                if cut < 0:
                    cut, at_blanks = at + int(part), False
                out.append(line[at:cut].strip())
                at = cut
            out.append(line[at:].strip())
            continue
        held.append(line)
        size += len(line)
    if held:
        out.append("\n".join(held))
    return [x for x in out if x], at_blanks


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


class Common:
    """The common words of all languages, looked up at once: of each known word the languages that have it."""

    def __init__(self, common: dict[str, frozenset]):
        self.languages = sorted(common)
        self._of: dict[str, tuple[int, ...]] = {}
        for i, lang in enumerate(self.languages):
            for w in common[lang]:
                self._of[w] = (*self._of.get(w, ()), i)

    def hits(self, words: list[str]) -> list[int]:
        """How many of the words are common in each language, and, last, in any."""
        out = [0] * (len(self.languages) + 1)
        for found in filter(None, map(self._of.get, words)):
            out[-1] += 1
            for i in found:
                out[i] += 1
        return out


class _Kinds(dict):
    """Pieces seen before: 1 for a plain word, 2 for an odd one, 3 for both, else 0.  Emptied when full."""

    def __missing__(self, piece: str) -> int:
        found = bool(_PLAIN.fullmatch(piece)) + 2 * bool(_ODD.fullmatch(piece.strip("\"'.,;:!?()[]{}")))
        if len(piece) < 40:
            if len(self) >= 100_000:
                self.clear()
            self[piece] = found
        return found


_KINDS = _Kinds()


class Counts:
    """What is counted in a text: additive over parts that are cut at blanks, but for the lines and the different words."""

    __slots__ = ("chars", "words", "hits", "han", "han_known", "letters", "symbols", "digits", "pieces", "plain", "odd", "lines", "ends", "bullets", "different")

    def __init__(self, text: str, common: Common):
        pieces = text.split()
        bare = "".join(pieces)
        words = words_of(text)
        kinds = list(map(_KINDS.__getitem__, pieces))
        self.chars, self.words, self.letters = len(bare), len(words), sum(map(len, words))
        self.hits = common.hits(words)
        self.han = 0 if text.isascii() else len(_HAN.findall(text))
        self.han_known = sum(w in _ZH for w in words) if self.han else 0
        self.symbols, self.digits = len(_SYMBOL.findall(bare)), len(_DIGIT.findall(bare))
        both = kinds.count(3)
        self.pieces, self.plain, self.odd = len(pieces), kinds.count(1) + both, kinds.count(2) + both
        self.different = set(words)
        self.count_lines(text)

    def count_lines(self, text: str) -> None:
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        self.lines = len(lines)
        self.ends = sum(x.rstrip().endswith(_ENDS) for x in lines)
        self.bullets = sum(bool(_BULLET.match(x)) for x in lines)

    def add(self, other: Counts) -> None:
        """The counts of both parts; lines are left as they are."""
        self.chars += other.chars
        self.words += other.words
        self.han += other.han
        self.han_known += other.han_known
        self.letters += other.letters
        self.symbols += other.symbols
        self.digits += other.digits
        self.pieces += other.pieces
        self.plain += other.plain
        self.odd += other.odd
        self.hits = [a + b for a, b in zip(self.hits, other.hits)]
        self.different.update(other.different)

    def language(self, common: Common, declared: str | None) -> str:
        """The language with the most common words in the text, if it has enough of them; else the declared one, else 'und'."""
        if self.words and self.han * 2 > self.words:
            return "zh"
        best = max(zip(self.hits, common.languages), default=None)
        if best and best[0] >= max(2, 0.1 * self.words):
            return best[1]
        declared = (declared or "").strip().lower()
        return declared if declared in LANGUAGES else "und"

    def statistics(self, lang: str, common: Common) -> list[float]:
        """STATISTICS in order; all 0 for a blank text.  word_length is in letters, in Chinese, too."""
        if not self.chars:
            return [0.0] * len(STATISTICS)
        n = self.words
        if lang == "zh":
            hits, plain = self.han_known, self.han / self.chars
        else:
            hits = self.hits[common.languages.index(lang) if lang in common.languages else -1]
            plain = self.plain / self.pieces
        return [
            hits / n if n else 0.0,
            self.symbols / self.chars,
            self.digits / self.chars,
            plain,
            self.odd / self.pieces,
            self.letters / n if n else 0.0,
            math.log1p(n / self.lines),
            len(self.different) / n if n else 0.0,
            self.ends / self.lines,
            self.bullets / self.lines,
        ]


#: Counts of a whole text besides STATISTICS.
COUNTS = ("n_words", "n_lines")


def measured(text: str | None, declared: str | None, common: Common) -> tuple[list[Counts], Counts | None, str]:
    """The counts of every stretch of a text and of the whole of it, and its language; nothing for a blank text."""
    cut, at_blanks = stretches(text or "")
    parts = [Counts(x, common) for x in cut]
    if not parts:
        return [], None, "und"
    tidy = clean(text)
    if at_blanks:
        whole = Counts("", common)
        for p in parts:
            whole.add(p)
        whole.count_lines(tidy)
    else:  # a stretch ends within a word
        whole = Counts(tidy, common)
    return parts, whole, whole.language(common, declared)
