"""Text cleaning and sentence splitting as column expressions.

All functions take and return ``Column``; they run inside the JVM, need no shuffle and work on
batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fidelscope.functions import script
from fidelscope.functions.once import let

_MAP = script.character_map()
_MAP_FROM, _MAP_TO = "".join(_MAP), "".join(_MAP.values())


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nfkc(col: Column | str) -> Column:
    """Unicode compatibility composition (NFKC).

    Spark has no function for it, but ships the Unicode library behind its collations, which
    ``reflect`` reaches without leaving the JVM.  ASCII and U+1200..U+137F are stable under
    NFKC, so rows of those characters only skip the call.
    """
    text = _col(col)
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )
    return F.when(text.rlike(r"[^\x00-\x7F\x{1200}-\x{137F}]"), composed).otherwise(text)


def normalize_chars(col: Column | str) -> Column:
    """Fold letter variants, Ethiopic punctuation and foreign digits to their standard form.

    ``translate`` looks every character up as a string of its own, which costs several times this.
    """
    text = _col(col)
    folded = F.reflect(
        F.lit("org.apache.commons.lang3.StringUtils"), F.lit("replaceChars"), text, F.lit(_MAP_FROM), F.lit(_MAP_TO)
    )
    return F.when(text.isNotNull(), folded)


def strip_urls(col: Column | str) -> Column:
    """Delete ``http…`` and ``www…`` up to the next white space."""
    return F.regexp_replace(_col(col), script.URL, "")


def strip_mentions(col: Column | str) -> Column:
    """Delete ``@word`` and ``#word``; the neighbours close up."""
    return F.regexp_replace(_col(col), script.MENTION, "")


def strip_symbols(col: Column | str) -> Column:
    """Turn runs of emoji, symbols and ASCII punctuation into one space.

    Inside :func:`clean_text` this is implied by :func:`keep_script`.
    """
    return F.regexp_replace(_col(col), f"[{script.SYMBOLS}]+", " ")


def keep_script(col: Column | str, profile: str = "ethiopic") -> Column:
    """Replace every character outside the profile's script, digits and white space by a space."""
    kept = script.SCRIPT_PROFILES[profile]
    return F.regexp_replace(_col(col), f"[^{kept}{script.WHITE_SPACE}]", " ")


def tokens(col: Column | str) -> Column:
    """Split at white space, without empty tokens."""
    spaced = F.regexp_replace(_col(col), f"[{script.WHITE_SPACE}]+", " ")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def stopword_list(words: Sequence[str] = script.STOPWORDS, normalize: bool = False) -> list[str]:
    """The stopwords to match; ``normalize`` also folds their letters as in the cleaned text.

    Cleaning folds letters *before* it looks for stopwords, so a stopword written with a folded
    letter never matches unless ``normalize`` is set.
    """
    table = str.maketrans(_MAP)
    return sorted({w.translate(table) if normalize else w for w in words})


def drop_stopwords(
    col: Column | str, words: Sequence[str] = script.STOPWORDS, normalize: bool = False
) -> Column:
    """Remove exact matches of ``words`` from an array of tokens."""
    listed = stopword_list(words, normalize)
    return F.filter(_col(col), lambda t: ~t.isin(listed))


def clean_text(
    col: Column | str,
    *,
    compose: bool = True,
    profile: str = "ethiopic",
    stopwords: Sequence[str] = script.STOPWORDS,
    normalize_stopwords: bool = False,
) -> Column:
    """Full cleaning: compose, fold, delete links and mentions, keep the script, drop stopwords.

    ``compose=False`` skips NFKC for data known to be composed.  A null text becomes ``''``.
    """
    text = F.coalesce(_col(col), F.lit(""))
    if compose:
        text = nfkc(text)
    listed = ["", *stopword_list(stopwords, normalize_stopwords)]

    # Finding a plain string costs a fraction of a search by pattern, and most texts hold none.
    def without_urls(text: Column) -> Column:
        return F.when(text.contains("http") | text.contains("www"), strip_urls(text)).otherwise(text)

    def without_mentions(text: Column) -> Column:
        return F.when(text.contains("@") | text.contains("#"), strip_mentions(text)).otherwise(text)

    def words(text: Column) -> Column:
        # One pass stands for: symbols to space, other scripts to space, collapse the spaces, split.
        parts = F.split(text, f"[^{script.SCRIPT_PROFILES[profile]}]+")
        return F.array_join(F.filter(parts, lambda t: ~t.isin(listed)), " ")

    return let(normalize_chars(text), lambda a: let(without_urls(a), lambda b: let(without_mentions(b), words)))


def trim_white_space(col: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(_col(col), F.lit(script.WHITE_SPACE_CHARS))


def split_sentences(col: Column | str) -> Column:
    """Sentences of a raw text: cut after an end mark that white space or the end follows.

    The mark stays with its sentence.  A null or blank text gives an empty array.
    """
    cut = rf"(?<=[{script.SENTENCE_END}])(?=[{script.WHITE_SPACE}]|$)"
    parts = F.transform(F.split(_col(col), cut), trim_white_space)
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def feature_tokens(col: Column | str) -> Column:
    """Vectoriser tokens of a cleaned text: lower-cased runs of two or more word characters."""
    words = F.split(F.lower(_col(col)), f"[^{script.WORD}]+")
    return F.filter(words, lambda t: F.char_length(t) >= 2)
