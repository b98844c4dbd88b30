"""Text normalisation as native column expressions.

Matching has to agree character for character with Unicode-aware string rules
(case folding, HTML character references, white space that includes the ASCII
separators U+001C..U+001F).  Spark's own functions cover all but two things: HTML
references and the full case-folding table.  Rows that need either are sent to one
Arrow UDF; every other row hands it a null and stays on the native path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import fixed

WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
"""Every character that counts as white space."""


def py_regex(pattern: str, ignore_case: bool = False) -> str:
    r"""Give a pattern Unicode classes, ``\n``-only line ends and full white space."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == "[" and not in_class:
            in_class = True
        elif token == "]" and in_class:
            in_class = False
        elif token == r"\s":
            token = r"\s\x1c-\x1f" if in_class else r"[\s\x1c-\x1f]"
        elif token == r"\S" and not in_class:
            token = r"[^\s\x1c-\x1f]"
        out.append(token)
    return ("(?diU)" if ignore_case else "(?dU)") + "".join(out)


def found(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(py_regex(pattern, ignore_case))


def any_of(phrases) -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)


def present(text: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column, chars: str = WHITE) -> Column:
    return F.btrim(text, F.lit(chars))


def rstrip(text: Column, chars: str = WHITE) -> Column:
    return F.rtrim(text, F.lit(chars))


# One character class of all white space; characters of one byte come first, which the
# regular expression engine keeps in one bit table.  The others are looked at one by one
# only within their range, so that a letter costs two tests and not one for each of them.
_WIDE = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE if c > "\xff")
_BLANKS = "[" + "".join(
    f"\\x{{{ord(c):x}}}" for c in WHITE if c <= "\xff"
) + f"[\\x{{1680}}-\\x{{3000}}&&[{_WIDE}]]]+"


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, _BLANKS, " "))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extract_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null (not '') when the pattern is absent."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


# Folds that lower() does not make, cheap enough to do natively on every row.
_NATIVE_FOLDS = {"ß": "ss", "ς": "σ", "µ": "μ", "ſ": "s", "ŉ": "ʼn"}


def fold(text: Column) -> Column:
    return reduce(
        lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])),
        _NATIVE_FOLDS.items(),
        F.lower(text),
    )


@lru_cache(maxsize=1)
def _rare_folds() -> str:
    """Character class around the folds that ``fold`` does not make.

    Nearby characters share a range: the class may hold harmless ones, which then
    take the slow path as well.
    """
    def native(c: str) -> str:
        return reduce(lambda t, pair: t.replace(*pair), _NATIVE_FOLDS.items(), c.lower())

    ranges: list[list[int]] = []
    for code in range(0x20000):
        if chr(code).casefold() != native(chr(code)):
            if ranges and code - ranges[-1][1] <= 0x60:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


def needs_slow_path(text: Column) -> Column:
    """Texts with a character reference or a rare fold; cheap tests come first."""
    reference = F.contains(text, F.lit("&")) & text.rlike("&[#a-zA-Z]")
    return reference | (~is_ascii(text) & text.rlike(_rare_folds()))


def normalize_native(text: Column) -> Column:
    """Match form of a text without character references or rare folds."""
    # each step once: a branch would have the steps before it evaluated again
    urls = F.regexp_replace(fold(text), py_regex(fixed.URL_TEXT), " <url> ")
    return collapse(F.regexp_replace(urls, py_regex(fixed.UUID_TEXT), " <uuid> "))


_URL = re.compile(fixed.URL_TEXT, re.I)
_UUID = re.compile(fixed.UUID_TEXT, re.I)


def normalize_value(value: str) -> str:
    """Match form of one value; the reference meaning for both paths."""
    text = _URL.sub(" <url> ", html.unescape(value).casefold())
    return " ".join(_UUID.sub(" <uuid> ", text).split())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normalize_slow(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda row: None if row is None else [normalize_value(v or "") for v in row],
        na_action=None,
    )


def _segments_native(path: Column) -> Column:
    """Normalised parts of a '>' path.

    Without an address (which may contain '>') the path is normalised once as a whole.
    """
    whole = F.transform(F.split(normalize_native(path), ">", -1), lambda s: F.trim(s))
    apart = F.transform(F.split(path, ">", -1), normalize_native)
    return F.when(F.contains(path, F.lit("://")), apart).otherwise(whole)


def normalize_all(texts: list[Column], path: Column) -> tuple[list[Column], Column]:
    """Normalise several texts and the parts of a '>' path with a single UDF call."""
    texts, path = [present(t) for t in texts], present(path)
    everything = F.concat(F.array(*texts), F.split(path, ">", -1))
    slow = _normalize_slow(F.when(
        needs_slow_path(F.concat_ws("\u0000", *texts, path)), everything
    ))
    done = [
        F.coalesce(F.element_at(slow, i + 1), normalize_native(t))
        for i, t in enumerate(texts)
    ]
    rest = F.slice(slow, len(texts) + 1, F.greatest(F.size(slow), F.lit(0)))
    return done, F.coalesce(rest, _segments_native(path))


def normalize_match_text(text: Column) -> Column:
    """Match form of one column."""
    return normalize_all([text], F.lit(""))[0][0]


def breadcrumb_path(segments: Column) -> Column:
    """Portable location from normalised breadcrumb segments.

    Leading course names are cut before the first unit-like segment and the last
    four levels are kept.
    """
    kept = F.filter(segments, lambda s: s != "")
    place = F.array_position(
        # the first letters are looked at before the costlier word boundary
        F.transform(kept, lambda s: found(s, "(?=[uslcam])" + fixed.LOCATION_WORD)), F.lit(True)
    )
    start = F.greatest(place, F.lit(1))
    # from the unit-like segment on, at most the last four
    first = F.greatest(start, F.size(kept) - 3).cast("int")
    return F.when(
        F.size(kept) > 0, F.array_join(F.slice(kept, first, F.lit(4)), " > ")
    ).otherwise("")


def normalize_breadcrumb(text: Column) -> Column:
    _, segments = normalize_all([F.lit("")], text)
    return breadcrumb_path(segments)


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def is_one_edit(left: Column, right: Column) -> Column:
    """Whether two texts are one insert, delete, change or adjacent swap apart."""
    left, right = F.lower(left), F.lower(right)
    # equal lengths, differing first at i: a swap makes the rest agree
    places = F.sequence(F.lit(1), F.greatest(F.length(left) - 1, F.lit(1)))
    swapped = F.exists(
        places,
        lambda i: F.concat(
            F.substring(left, F.lit(1), i - 1), F.substring(left, i + 1, F.lit(1)),
            F.substring(left, i, F.lit(1)), F.substring(left, i + 2, F.length(left)),
        ) == right,
    )
    is_swap = (
        (F.length(left) >= 2) & (F.length(left) == F.length(right))
        & (left != right) & swapped
    )
    return (F.levenshtein(left, right, 1) == 1) | is_swap


def osa_value(left: str, right: str) -> int:
    """Edit distance with adjacent swaps, each character moved at most once."""
    left, right = left.lower(), right.lower()
    before_last, last = [], list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        row = [i]
        for j, b in enumerate(right, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
            if i > 1 and j > 1 and a == right[j - 2] and left[i - 2] == b:
                best = min(best, before_last[j - 2] + (a != b))
            row.append(best)
        before_last, last = last, row
    return last[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([osa_value(a or "", b or "") for a, b in zip(left, right)])


SCORE = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("rounded", T.DoubleType()),
])


def similarities(pairs: Iterable[tuple[str, str]], threshold: float,
                 autojunk: bool = True) -> Iterator[tuple[float | None, float | None]]:
    """Similarity, plain and rounded, of (new text, stored text) pairs; none below the threshold.

    The matcher's popularity heuristic looks at the stored text only, so the
    argument order matters.  Its cheap upper bound runs first.  Pairs of one stored
    text should come together.
    """
    matcher, last = SequenceMatcher(autojunk=autojunk), None
    for a, b in pairs:
        if (not autojunk or len(b) < 200) and (a in b or b in a):
            # no character of the stored text is popular: the shorter text is the longest match
            both = len(a) + len(b)
            ratio = 2.0 * min(len(a), len(b)) / both if both else 1.0
        else:
            if b != last:
                matcher.set_seq2(b)
                last = b
            matcher.set_seq1(a)
            ratio = matcher.ratio() if matcher.quick_ratio() >= threshold else 0.0
        yield (ratio, round(ratio, 4)) if ratio >= threshold else (None, None)


def similarity_udf(threshold: float, autojunk: bool = True):
    """Similarity of (new text, stored text); null below the threshold."""

    @F.pandas_udf(SCORE)
    def similarity(new: pd.Series, stored: pd.Series) -> pd.DataFrame:
        scores = list(similarities(zip(new, stored), threshold, autojunk))
        return pd.DataFrame(scores, columns=["score", "rounded"], dtype="float64")

    return similarity
