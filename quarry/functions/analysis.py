"""Text analysis: an analyzer turns a text into tokens, in a column or in one Python string.

Tokens are an array in text order; the index is the position. A null entry is a position
without a token (a stop word, an overlong word): it keeps phrases apart and has no length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, functions as F, types as T

from quarry.functions.stemmer import porter2

_SPACE, _NOT_WORD = r"\p{IsWhite_Space}+", r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]"


@dataclass(frozen=True)
class Analyzer:
    """column: a text column -> array<string>; local: one text -> list, the same tokens."""

    column: Callable[[Column], Column]
    local: Callable[[str], list[str | None]]


def _simple(text: Column) -> Column:
    """Split at white space, drop what is not alphanumeric, lower-case; empty tokens take no position."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, _NOT_WORD, "")), _SPACE), lambda t: t != "")


def _simple_local(text: str) -> list[str | None]:
    words = ("".join(c for c in w if c.isalnum() or unicodedata.category(c) in ("Mn", "Mc") and _alphabetic_mark(c)) for w in text.split())
    return [w.lower() for w in words if w]


def _alphabetic_mark(c: str) -> bool:
    """Marks that count as alphabetic: vowel signs and the like, but not accents."""
    return unicodedata.combining(c) == 0


def _raw(fold: bool) -> Analyzer:
    def column(text: Column) -> Column:
        whole = F.trim(text)
        return F.filter(F.array(F.lower(whole) if fold else whole), lambda t: t != "")

    def local(text: str) -> list[str | None]:
        whole = text.strip(" ")
        return [whole.lower() if fold else whole] if whole else []

    return Analyzer(column, local)


def from_function(tokens: Callable[[str], list[str | None]]) -> Analyzer:
    """An analyzer from a Python function; columns go through Arrow in batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def column(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else tokens(x))

    return Analyzer(column, tokens)


def stemmed(base: Analyzer, stem: Callable[[str], str]) -> Analyzer:
    """The base's tokens, stemmed: the column's in Arrow batches, each distinct token of a batch once."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def column(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        stems = pa.array([None if t is None else stem(t) for t in coded.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.compute.subtract(lists.offsets, lists.offsets[0]), stems.take(coded.indices), mask=lists.is_null() if lists.null_count else None)

    return Analyzer(lambda text: column(base.column(text)), lambda text: [t if t is None else stem(t) for t in base.local(text)])


_WORDS = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ]|[.,'’:](?=[^\W_]))*")


def unicode_words(text: str, longest: int = 255) -> list[str | None]:
    """Words by Unicode boundaries, lower-case; longer ones leave a gap.

    Letters, digits and marks stay together, and so do parts around a single dot, comma or
    apostrophe inside a word or number.
    """
    out: list[str | None] = []
    for w in _WORDS.findall(text):
        parts = re.split(r"(?<=[^\W\d])[,:](?=.)|(?<=\d)[:](?=.)|(?<=[^\W\d])[.,](?=\d)|(?<=\d)[.,'’](?=[^\W\d])", w)
        out += [p.lower() if len(p) <= longest else None for p in parts]
    return out


# What is dropped after and before an apostrophe, beside heads of one or two letters.
_CLITICS = {"s", "t", "re", "ve", "ll", "d", "m"}
_ELIDED = {"qu", "lorsqu", "jusqu", "puisqu", "quoiqu", "dell", "nell", "sull", "dall", "all", "coll", "degl", "dagl", "negl", "sugl", "quest", "quell", "sant", "anch"}
_LEX = re.compile(r"(?:[^\W_]\.){2,}(?:[^\W_]\b)?|\d+(?:[.,]\d+)*|[^\W_](?:[^\W_]|[̀-ͯ]|['](?=[^\W_]))*")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def lex_words(text: str, fold: bool = False, longest: int = 64, stem: Callable[[str], str] | None = None, stop: frozenset[str] = frozenset()) -> list[str | None]:
    """Search words of mixed text: compatibility forms unified, lower case.

    Anything but letters, digits and marks ends a word. Dotted acronyms are joined, a dot
    between digits stays and a comma there goes. Parts around apostrophes are words of their
    own, without an English clitic at the end and elided articles at the start. Stop words and
    words longer than ``longest`` leave a gap.
    """
    plain = unicodedata.normalize("NFKC", text).translate(_INVISIBLE).replace("’", "'").lower()
    out: list[str | None] = []
    for m in _LEX.finditer(plain):
        w = m.group()
        if w[0].isdigit() and set(w) <= set("0123456789.,"):
            w = w.replace(",", "")
        elif "." in w:
            w = w.replace(".", "")
        parts = w.split("'")
        if len(parts) > 1 and parts[-1] in _CLITICS:
            parts.pop()
        while len(parts) > 1 and (len(parts[0]) <= 2 or parts[0] in _ELIDED):
            parts.pop(0)
        for w in parts:
            if fold:
                w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
            if w in stop or len(w) > longest:
                out.append(None)
            elif w:
                out.append(stem(w) if stem else w)
    return out


_REGISTRY: dict[str, Analyzer] = {}


def register(name: str, analyzer: Analyzer) -> None:
    """Make an analyzer known by name, for schemas; a later one of the name replaces it."""
    _REGISTRY[name] = analyzer


def with_stop_words(base: Analyzer, words: Iterable[str]) -> Analyzer:
    """The base's tokens, in which stop words leave a gap."""
    stop = sorted(set(words))
    gap = lambda t: F.when(~t.isin(stop), t)
    return Analyzer(lambda text: F.transform(base.column(text), gap) if stop else base.column(text), lambda text: [None if t in stop else t for t in base.local(text)])


def analyzer(spec: str) -> Analyzer:
    """By name; ``lex(fold: true, stop_words: a b)`` has parameters."""
    name, _, inside = spec.partition("(")
    name = name.strip()
    if name == "lex":
        options = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in inside.rstrip(") ").split(",")) if k.strip()}
        known = {"fold", "max_token_length", "stem", "stop_words", "segmenter", "variants"}
        if set(options) - known or options.get("segmenter", "simple") != "simple" or options.get("variants", "false") != "false":
            raise ValueError(f"lex takes {', '.join(sorted(known))}, with segmenter simple and variants false; not {inside.rstrip(') ')}")
        fold, longest = options.get("fold") == "true", int(options.get("max_token_length", 64))
        stem, stop = porter2 if options.get("stem") in ("snowball", "en") else None, frozenset(options.get("stop_words", "").split())
        return from_function(lambda text: lex_words(text, fold, longest, stem, stop))
    if name not in _REGISTRY:
        raise ValueError(f"unknown tokenizer {spec!r}")
    return _REGISTRY[name]


SIMPLE = Analyzer(_simple, _simple_local)
register("simple", SIMPLE)
register("default", SIMPLE)
register("raw", _raw(False))
register("raw_ci", _raw(True))
register("unicode_word", from_function(unicode_words))
register("en_stem", stemmed(SIMPLE, porter2))
