"""Text columns: normalisation profiles and robustness perturbations.

All are column expressions but NFKC and emoji names, which Spark has no function for;
those two are Arrow-batched functions of pandas series.  A null text is empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: the patterns that define addresses, users and hashtags
URL = r'(?iU)\b(?:https?://|www\.)[^\s<>"]+'
USER = r"(?U)(?<!\w)@[A-Za-z0-9_]+"
HASHTAG = r"(?U)(?<!\w)#([\p{L}\p{N}_]+)"
TOKEN = r"[\p{L}\p{N}_]{2,}"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _emoji_name(c: str) -> str:
    """An emoji's lower-case Unicode name between spaces; other characters as they are."""
    if ord(c) >= 0x2190 and unicodedata.category(c) == "So":
        return f" {unicodedata.name(c, 'symbol').lower().replace(' ', '_').replace('-', '_')} "
    return c


@F.pandas_udf(StringType())
def emoji_names(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else "".join(map(_emoji_name, t)))


def coerce_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column, unicode: bool = True) -> Column:
    """NFKC, white space squeezed; unicode=False leaves the NFKC step out."""
    c = coerce_text(c)
    return squeeze(nfkc(c) if unicode else c)


def profile_p0(c: Column, unicode: bool = True) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(normalize(c, unicode), URL, " <URL> "), USER, " <USER> "))


def _lowered(c: Column, unicode: bool, url: str, user: str, hashtag: str) -> Column:
    c = F.regexp_replace(F.lower(normalize(c, unicode)), URL, url)
    return F.regexp_replace(F.regexp_replace(c, USER, user), HASHTAG, hashtag)


def profile_p1(c: Column, unicode: bool = True) -> Column:
    c = _lowered(c, unicode, " <url> ", " <user> ", " hashtag_$1 ")
    return squeeze(emoji_names(c) if unicode else c)


def profile_p2(c: Column, unicode: bool = True, stop_words: list[str] | None = None) -> Column:
    """stop_words: by default Spark's English list."""
    stop = F.array(*map(F.lit, stop_words if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")))
    words = F.split(squeeze(F.regexp_replace(_lowered(c, unicode, " ", " ", " $1 "), r"(?U)[^\p{L}\p{N}\s]", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w)), " ")


PROFILES: dict[str, Callable[..., Column]] = {"p0": profile_p0, "p1": profile_p1, "p2": profile_p2}


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(coerce_text(c), r"[\p{P}\p{S}]", " ")


def normalize_repeats(c: Column) -> Column:
    return F.regexp_replace(coerce_text(c), r"([^\n])\1{2,}", "$1")


def leetspeak(c: Column) -> Column:
    return F.translate(coerce_text(c), "aeios", "43105")


def partial_masking(c: Column) -> Column:
    """Of words of five letters or more the first two and the last stay."""
    return F.regexp_replace(coerce_text(c), r"(?<=\p{L}{2})\p{L}(?=\p{L}{2})|(?<=\p{L}{3})\p{L}(?=\p{L})", "*")


PERTURBATIONS: dict[str, Callable[[Column], Column]] = {"clean": coerce_text, "remove_punctuation": remove_punctuation, "normalize_repeats": normalize_repeats, "leetspeak": leetspeak, "partial_masking": partial_masking}


def mask_feature(c: Column) -> Column:
    """A feature's name after its block prefix: first character, then stars."""
    name = F.element_at(F.split(c, "__", 2), -1)
    return F.concat(F.substring(name, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(2), F.length(name) - 1)))


def prettify(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def title_case(c: Column) -> Column:
    """Words parted by underscores or spaces, each with a capital."""
    return F.initcap(prettify(c))


def percent(c: Column, places: int = 1) -> Column:
    """A share as it is shown."""
    return F.format_string(f"%.{places}f%%", 100.0 * c)


def utc_stamp(c: Column) -> Column:
    """An instant as ISO text in UTC, to the microsecond, whatever the session's zone."""
    utc = F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def looked_up(c: Column, names: dict[str, str]) -> Column:
    """The value of a name; null for one that is not there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def with_pairs(w: Column) -> Column:
    """Words and pairs of neighbours, of a column that holds the words: the column is named several times."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w)


def word_ngrams(c: Column) -> Column:
    """Words and pairs of neighbours of a text; where the words stand in a column already, with_pairs is cheaper."""
    return with_pairs(tokens(c))


def char_wb_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with a space at either end; a shorter padded word stands once."""

    def of_word(w: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (F.length(w) + 2 > n - 1))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1))), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, n))))

    return F.flatten(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), of_word))


def char_shingles(c: Column, n: int = 5) -> Column:
    """Distinct character n-grams; the whole text where it is shorter.  One walk over the text: cutting at each place anew would walk from its start."""
    return F.when(F.length(c) > n, F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))).otherwise(F.array(c))


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
