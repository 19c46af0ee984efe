"""Text normalisation as native Spark column expressions.

Each normaliser is an ordered list of steps.  ``to_column`` turns the steps
into a Spark expression (JVM-side, inside whole-stage codegen); ``to_sql``
turns the same steps into DuckDB SQL for the correctness oracle.  Unicode
folding uses translate tables generated from ``unicodedata`` by rule: one letter
for one over all code points, several letters for one inside Latin.  What tables
cannot do (composed Hangul, stacked marks, ligatures) ``fold_ascii`` leaves to an
Arrow function, to which only such rows send their text.

The chains over whole texts (F1, F5, F6, F7) are Arrow functions: a chain of
expressions builds the text anew in every step and runs each pattern over all of
it, here a pattern only sees texts that hold what it looks for.  They do what
the step lists say, which stay the form for short columns and for SQL.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from . import fixed

# Characters for which Python's str.isspace() is true; strip() and the ``\s``
# class of the reference use this set, Java's ``\s`` lacks some of them.
_WS_CODES = [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def _class_body(codes):
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        a, b = codes[i], codes[j]
        parts.append(f"\\x{{{a:02X}}}" if a == b else f"\\x{{{a:02X}}}-\\x{{{b:02X}}}")
        i = j + 1
    return "".join(parts)


WS = "[" + _class_body(_WS_CODES) + "]"          # whitespace class, Java + RE2 syntax
WS_CHARS = "".join(chr(c) for c in _WS_CODES)


LATIN_END = 0x250


def _fold_table():
    """NFKD + drop non-ASCII, by rule, for every code point above ASCII.

    Returns (one-to-one from, to) strings, the multi-character replacements of
    Latin, and the other code points that fold to several characters.  Those
    that fold to nothing are dropped afterwards by removing every remaining
    non-ASCII character.
    """
    src, dst, multi, rare = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if not unicodedata.decomposition(ch):
            continue
        out = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        elif len(out) > 1 and code < LATIN_END:
            multi.append((ch, out))
        elif len(out) > 1:
            rare.append(code)
    return "".join(src), "".join(dst), multi, rare


def _nfkc_table(lo: int = 0x80, hi: int = 0x100):
    """NFKC changes inside Latin-1, by rule (NBSP, superscripts, fractions, ...)."""
    return [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(lo, hi)
            if unicodedata.normalize("NFKC", chr(c)) != chr(c)]


FOLD_FROM, FOLD_TO, FOLD_MULTI, _RARE = _fold_table()
#: Code points outside Latin that fold to several characters (ligatures, enclosed numbers, units).
FOLD_RARE = "[" + _class_body(_RARE) + "]"
NFKC_PAIRS = _nfkc_table()


# ----------------------------------------------------------------------------
# Step language shared by the Spark and SQL renderings.

@dataclass(frozen=True)
class Step:
    kind: str            # 'lower' | 'fold' | 'nfkc' | 'regex' | 'strip' | 'replace' | 'nullto'
    a: str = ""
    b: str = ""


def lower():
    return Step("lower")


def fold():
    return Step("fold")


def nfkc():
    return Step("nfkc")


def rx(pattern: str, repl: str = " "):
    return Step("regex", pattern, repl)


def strip():
    return Step("strip")


def rep(a: str, b: str):
    return Step("replace", a, b)


def collapse():
    return [rx(WS + "+", " "), strip()]


def _java_repl(r: str) -> str:
    return r.replace("\\1", "$1")


def to_column(c: Column, steps) -> Column:
    for s in steps:
        if s.kind == "lower":
            c = F.lower(c)
        elif s.kind == "fold":
            for a, b in FOLD_MULTI:
                c = F.replace(c, F.lit(a), F.lit(b))
            c = F.translate(c, FOLD_FROM, FOLD_TO)
            c = F.regexp_replace(c, r"[^\x{00}-\x{7F}]", "")
        elif s.kind == "nfkc":
            for a, b in NFKC_PAIRS:
                c = F.replace(c, F.lit(a), F.lit(b))
        elif s.kind == "regex":
            c = F.regexp_replace(c, s.a, _java_repl(s.b))
        elif s.kind == "strip":
            c = F.btrim(c, F.lit(WS_CHARS))
        elif s.kind == "replace":
            c = F.replace(c, F.lit(s.a), F.lit(s.b))
        else:
            raise ValueError(s.kind)
    return c


def sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def to_sql(e: str, steps) -> str:
    """DuckDB rendering of the same steps (RE2 regexes, global replace)."""
    for s in steps:
        if s.kind == "lower":
            e = f"lower({e})"
        elif s.kind == "fold":
            for a, b in FOLD_MULTI:
                e = f"replace({e}, {sql_str(a)}, {sql_str(b)})"
            e = f"translate({e}, {sql_str(FOLD_FROM)}, {sql_str(FOLD_TO)})"
            e = f"regexp_replace({e}, '[^\\x{{00}}-\\x{{7F}}]', '', 'g')"
        elif s.kind == "nfkc":
            for a, b in NFKC_PAIRS:
                e = f"replace({e}, {sql_str(a)}, {sql_str(b)})"
        elif s.kind == "regex":
            e = f"regexp_replace({e}, {sql_str(s.a)}, {sql_str(s.b)}, 'g')"
        elif s.kind == "strip":
            e = f"regexp_replace({e}, {sql_str('^' + WS + '+|' + WS + '+$')}, '', 'g')"
        elif s.kind == "replace":
            e = f"replace({e}, {sql_str(s.a)}, {sql_str(s.b)})"
    return e


# ----------------------------------------------------------------------------
# Normalisers (step lists).  Null handling is applied by the wrappers below.

# strip, lower, NFKC, collapse blanks.
NFKC_STEPS = [strip(), lower(), nfkc(), *collapse()]
# NFKD, keep ASCII.
FOLD_STEPS = [fold()]
# fold, lower, drop '.', '/' -> blank, collapse.
GROUP_KEY_STEPS = [fold(), lower(), rep(".", ""), rep("/", " "), *collapse()]
# strip, lower, fold, collapse, drop '.', '/' -> '-', strip.
CLASS_STEPS = [strip(), lower(), fold(), rx(WS + "+", " "), rep(".", ""), rep("/", "-"), strip()]
# lower, fold, keep alnum, drop numbers, letter-digit codes and tokens of <= 2 chars.
CLEAN_STEPS = [
    lower(), fold(),
    rx(r"[^a-zA-Z0-9" + WS[1:-1] + "]", " "),
    rx(r"\b\d+\b", " "),
    rx(r"\b[a-z]*\d+[a-z0-9]*\b", " "),
    rx(r"\b[a-zA-Z0-9_]{1,2}\b", " "),
    *collapse(),
]
# mask URLs, e-mails, dates, long numbers, numbers; punctuation out; runs of 4+ out.
_RUN4_RE2 = "|".join(f"{ch}{{4,}}" for ch in "abcdefghijklmnopqrstuvwxyz0123456789")
MASK_STEPS_HEAD = [
    strip(), lower(), fold(),
    rx(r"(https?://[^" + WS[1:-1] + r"]+|www\.[^" + WS[1:-1] + "]+)", " url "),
    rx(r"\b[a-zA-Z0-9_\.-]+@[a-zA-Z0-9_\.-]+\.[a-zA-Z0-9_]+\b", " email "),
    rx(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", " fecha "),
    rx(r"\b\d{7,}\b", " num_largo "),
    rx(r"\b\d+\b", " num "),
    rx(r"[_\-=/\\|()\[\]{},;:]+", " "),
    rx(r"[^a-zA-Z0-9_" + WS[1:-1] + "]", " "),
    *collapse(),
]
MASK_STEPS_TAIL = [rx(r"[^a-z0-9" + WS[1:-1] + "]", " "), *collapse()]

# boilerplate alternation, applied to a fixpoint (unrolled), then leading prepositions.
BOILERPLATE_RE = "|".join(fixed.BOILERPLATE_PATTERNS)
PREFIX_RE = "^(" + "|".join(fixed.LEADING_PREPOSITIONS) + r")\s+"
BOILER_STEPS = ([s for _ in range(fixed.BOILERPLATE_PASSES)
                 for s in [rx(BOILERPLATE_RE, " "), *collapse()]]
                + [s for _ in range(fixed.PREPOSITION_PASSES) for s in [rx(PREFIX_RE, ""), strip()]]
                + collapse())


def _null_to(c: Column, default: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


_FOLD = {**{ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO)}, **{ord(a): b for a, b in FOLD_MULTI}}


def _fold_steps(s: str) -> str:
    """As :func:`fold`'s step: the tables, then ASCII only."""
    if s.isascii():
        return s
    try:
        s.encode("latin-1")
    except UnicodeEncodeError:
        return s.translate(_FOLD).encode("ascii", "ignore").decode("ascii")
    return fold_py(s)


def _each(text: pd.Series, f) -> pd.Series:
    """``f`` of every text, null as ''."""
    return pd.Series([f(x) if x is not None else f("") for x in text], dtype=object)


@F.pandas_udf(StringType())
def _nfkc_text(text: pd.Series) -> pd.Series:
    return _each(text, lambda x: " ".join(unicodedata.normalize("NFKC", x.strip().lower()).split()))


@F.pandas_udf(StringType())
def _fold_any(text: pd.Series) -> pd.Series:
    return text.map(fold_py, na_action="ignore")


def normalize_nfkc(c: Column) -> Column:
    """non-string/null -> ''."""
    return _nfkc_text(c.cast("string"))


def fold_ascii(c: Column) -> Column:
    """NFKD and drop non-ASCII, for every code point; rows with ``FOLD_RARE`` characters are folded in Arrow batches."""
    return F.coalesce(_fold_any(F.when(c.rlike(FOLD_RARE), c)), to_column(c, FOLD_STEPS))


def normalize_group_key(c: Column) -> Column:
    """null -> ''."""
    return to_column(_null_to(c, ""), GROUP_KEY_STEPS)


def normalize_class(c: Column, unclassified: str = fixed.UNCLASSIFIED) -> Column:
    """null -> ``sin_clasificar``."""
    return F.when(c.isNull(), F.lit(unclassified)).otherwise(to_column(c, CLASS_STEPS))


def remove_stopwords(c: Column, stopwords=fixed.SPANISH_STOPWORDS, fold_words: bool = False) -> Column:
    """drop tokens found in ``stopwords``; optional folding of the list (Q1).

    ``isin`` over a literal list becomes a hash ``InSet`` inside the lambda.
    """
    words = sorted({fold_py(w) for w in stopwords} if fold_words else set(stopwords))
    toks = F.split(c, " ")
    kept = F.filter(toks, lambda t: (t != "") & ~t.isin(words))
    return F.array_join(kept, " ")


#: ASCII characters that are neither blank, letter nor digit.
_ALNUM = {c: " " for c in range(128) if not chr(c).isspace() and not chr(c).isalnum()}
_UPPER = {c: " " for c in range(ord("A"), ord("Z") + 1)}
_CODE = re.compile("[a-z]*[0-9]+[a-z0-9]*")


def clean_text(c: Column, stopwords=fixed.SPANISH_STOPWORDS, fold_words: bool = False) -> Column:
    """null -> ''; then the cleaning chain and the stopword filter."""
    words = frozenset(fold_py(w) for w in stopwords) if fold_words else frozenset(stopwords)

    def clean(x: str) -> str:
        tokens = _fold_steps(x.lower()).translate(_ALNUM).split()
        return " ".join([t for t in tokens if len(t) > 2 and t not in words and (t.isalpha() or not _CODE.fullmatch(t))])

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return _each(text, clean)

    return run(c.cast("string"))


_URL = re.compile(r"https?://\S+|www\.\S+")
_EMAIL = re.compile(r"\b[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+\.[a-zA-Z0-9_]+\b")
_DATE = re.compile(r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b")
_NUMBER = re.compile(r"\b[0-9]+\b")
_DIGIT = re.compile("[0-9]")
_RUN4 = re.compile(r"(.)\1\1\1\1*")


def _mask(x: str) -> str:
    x = _fold_steps(x.strip().lower())
    if "http" in x or "www." in x:
        x = _URL.sub(" url ", x)
    if "@" in x:
        x = _EMAIL.sub(" email ", x)
    if _DIGIT.search(x):
        x = _DATE.sub(" fecha ", x)
        x = _NUMBER.sub(lambda m: " num_largo " if m.end() - m.start() >= 7 else " num ", x)
    x = " ".join(x.translate(_ALNUM).split())
    x = _RUN4.sub(" ", x)
    return " ".join(x.translate(_UPPER).split())


@F.pandas_udf(StringType())
def _mask_text(text: pd.Series) -> pd.Series:
    return _each(text, _mask)


def mask_entities(c: Column) -> Column:
    """null -> ''."""
    return _mask_text(c.cast("string"))


#: Java's blanks; the patterns are written for them.
_JAVA_BLANK = r"[ \t\n\x0b\f\r]"
def _boilerplate_parts() -> list[tuple[str, str]]:
    """(a word that every match holds, pattern) of the alternatives, in order."""
    parts = []
    for p in fixed.BOILERPLATE_PATTERNS:
        certain = re.sub(r"\\[a-z]|\(\?:[^)]*\)\??|\[[^\]]*\]\??|[a-z]\?", " ", p)      # without classes, groups and optional letters
        parts.append((max(re.findall("[a-z]+", certain), key=len), p.replace(r"\s", _JAVA_BLANK)))
    return parts


_BOILERPLATE = _boilerplate_parts()
_BOILERPLATE_STEMS = sorted({stem for stem, _ in _BOILERPLATE})
_PREFIX = re.compile(PREFIX_RE.replace(r"\s", _JAVA_BLANK))
_COMPILED: dict[frozenset, re.Pattern] = {}


def _boilerplate_of(x: str) -> re.Pattern | None:
    """The alternatives that can match in ``x``, in their order."""
    held = frozenset([stem for stem in _BOILERPLATE_STEMS if stem in x])
    if held and held not in _COMPILED:
        if len(_COMPILED) > 1000:
            _COMPILED.clear()
        _COMPILED[held] = re.compile("|".join(p for stem, p in _BOILERPLATE if stem in held))
    return _COMPILED.get(held)


def _core(x: str) -> str:
    for _ in range(fixed.BOILERPLATE_PASSES):
        pattern = _boilerplate_of(x)
        new = " ".join((pattern.sub(" ", x) if pattern else x).split())
        if new == x:
            break
        x = new
    for _ in range(fixed.PREPOSITION_PASSES):
        new = _PREFIX.sub("", x).strip()
        if new == x:
            break
        x = new
    return " ".join(x.split())


@F.pandas_udf(StringType())
def _core_text(text: pd.Series) -> pd.Series:
    return _each(text, _core)


def strip_boilerplate(c: Column) -> Column:
    """null -> ''; boilerplate to a fixpoint (<= 6), then leading prepositions (<= 4)."""
    return _core_text(c.cast("string"))


@F.pandas_udf(IntegerType())
def _tokens_of(text: pd.Series) -> pd.Series:
    return pd.Series([len(x.split()) if x is not None else 0 for x in text], dtype="int32")


def tokens_count(c: Column) -> Column:
    """number of whitespace-separated tokens."""
    return _tokens_of(c.cast("string"))


def choose_text(desc: Column, short: Column, min_tokens: int = 4) -> Column:
    """F8: description and/or short text, each only if it has >= min_tokens tokens."""
    d = F.coalesce(desc, F.lit(""))
    s = F.coalesce(short, F.lit(""))
    d_ok = tokens_count(d) >= min_tokens
    s_ok = tokens_count(s) >= min_tokens
    both = to_column(F.concat(d, F.lit(" "), s), [strip()])
    return (F.when(d_ok & s_ok, both)
             .when(d_ok, to_column(d, [strip()]))
             .when(s_ok, to_column(s, [strip()]))
             .otherwise(F.lit("")))


def singularize_phrase(c: Column) -> Column:
    """drop one trailing 's' of every blank-separated token."""
    return F.regexp_replace(c, "s( |$)", "$1")


def name_token_key(c: Column) -> Column:
    """order-free key of a person name: sorted tokens of F3, upper case."""
    toks = F.filter(F.split(F.upper(normalize_group_key(c)), " "), lambda t: t != "")
    return F.array_join(F.array_sort(toks), " ")


def requirement_stopwords():
    """F11 requirement list: Spanish list plus the domain words, all folded."""
    return sorted({fold_py(w.lower().strip()) for w in
                   list(fixed.SPANISH_STOPWORDS) + list(fixed.REQUIREMENT_EXTRA_STOPWORDS)})


def fold_py(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


# ----------------------------------------------------------------------------
# SQL renderings for the oracle.

def sql_null_to(e: str, default: str) -> str:
    return f"coalesce(cast({e} AS varchar), {sql_str(default)})"


def sql_clean_text(e: str, stopwords=fixed.SPANISH_STOPWORDS, fold_words=False) -> str:
    x = to_sql(sql_null_to(e, ""), CLEAN_STEPS)
    return sql_remove_stopwords(x, stopwords, fold_words)


def sql_remove_stopwords(x: str, stopwords=fixed.SPANISH_STOPWORDS, fold_words=False) -> str:
    words = sorted({fold_py(w) for w in stopwords} if fold_words else set(stopwords))
    lst = ", ".join(sql_str(w) for w in words)
    return (f"array_to_string(list_filter(string_split({x}, ' '), "
            f"lambda t: t <> '' AND NOT list_contains([{lst}], t)), ' ')")


def sql_mask_entities(e: str) -> str:
    x = to_sql(sql_null_to(e, ""), MASK_STEPS_HEAD)
    x = f"regexp_replace({x}, {sql_str(_RUN4_RE2)}, ' ', 'g')"
    return to_sql(x, MASK_STEPS_TAIL)


def sql_tokens_count(e: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({e}, ''), {sql_str(WS + '+')}), lambda t: t <> ''))"


def sql_choose_text(d: str, s: str, min_tokens: int = 4) -> str:
    d = f"coalesce({d}, '')"
    s = f"coalesce({s}, '')"
    both = to_sql(f"concat({d}, ' ', {s})", [strip()])
    return (f"CASE WHEN {sql_tokens_count(d)} >= {min_tokens} AND {sql_tokens_count(s)} >= {min_tokens} THEN {both} "
            f"WHEN {sql_tokens_count(d)} >= {min_tokens} THEN {to_sql(d, [strip()])} "
            f"WHEN {sql_tokens_count(s)} >= {min_tokens} THEN {to_sql(s, [strip()])} ELSE '' END")


def sql_name_token_key(e: str) -> str:
    k = f"upper({to_sql(sql_null_to(e, ''), GROUP_KEY_STEPS)})"
    return f"array_to_string(list_sort(list_filter(string_split({k}, ' '), lambda t: t <> '')), ' ')"


def sql_normalize_class(e: str) -> str:
    return f"CASE WHEN {e} IS NULL THEN {sql_str(fixed.UNCLASSIFIED)} ELSE {to_sql(e, CLASS_STEPS)} END"
