"""Text cleaning as column expressions, plus the one Python step: stemming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import porter
from tidewire.functions.stopwords import ENGLISH, VECTORISER
from tidewire.functions.timefn import as_column
from tidewire.session import give_back, short_batches

# Letters of the basic Russian alphabet; the two letters outside the range stay.
RUSSIAN = "[а-яА-Я]"


def normalise(c: Column | str) -> Column:
    """Lower-case, write digit runs as ``num``, delete all but a-z and white space."""
    c = F.regexp_replace(F.lower(as_column(c)), r"\p{Nd}+", "num")
    return F.regexp_replace(c, r"(?U)[^a-z\s]", "")


def sql_list(values: Sequence[str]) -> str:
    """Text values as the inside of an SQL ``IN`` list."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _without(found: Column, stop: Sequence[str]) -> Column:
    """Drop the listed words; written as SQL text, since a long list is slow to pass word by word."""
    if not stop:
        return found
    return F.call_function("filter", found, F.expr(f"w -> w NOT IN ({sql_list(stop)})"))


def words(c: Column | str, stop: Sequence[str] = ENGLISH) -> Column:
    """Words of a normalised text in order, repeats kept, stop words removed."""
    return _without(F.regexp_extract_all(as_column(c), F.lit("[a-z]+"), F.lit(0)), stop)


def tokens(c: Column | str, stop: Sequence[str] = VECTORISER) -> Column:
    """Terms of two or more word characters, lower-cased, stop words removed."""
    found = F.regexp_extract_all(F.lower(as_column(c)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return _without(found, stop)


def clean(c: Column | str, stop: Sequence[str] = ENGLISH) -> Column:
    """Normalised text without stop words; null or empty text gives ``''``."""
    return F.coalesce(F.array_join(words(normalise(c), stop), " "), F.lit(""))


def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(porter.stem, na_action="ignore")
    give_back()


#: Stem a column that holds one word per row.  Marked as not deterministic, though it is, so that a filter on the stems is
#: not moved below it, which would stem every word twice.
stem_words = F.pandas_udf(_stems, T.StringType()).asNondeterministic()


@F.pandas_udf(T.StringType())
def stem_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stem every word of a blank-separated text.

    The text stays whole in its row: no explode, no shuffle, so a word that makes
    up a third of the corpus costs nothing extra.
    """
    for batch in batches:
        yield batch.map(lambda text: " ".join(porter.stem(w) for w in text.split()), na_action="ignore")
    give_back()


def clean_and_stem(c: Column | str, stop: Sequence[str] = ENGLISH) -> Column:
    """The full cleaning chain; texts go to the workers in short batches."""
    short_batches(SparkSession.active())
    return stem_text(clean(c, stop))


def stem_vocabulary(df: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words with their stems: each word is stemmed once in the whole job."""
    return df.select(word).where(F.col(word).isNotNull()).distinct().withColumn("stem", stem_words(word))


def without_script(df: DataFrame, column: str, pattern: str = RUSSIAN) -> DataFrame:
    """Drop rows whose text contains the pattern, and rows without text."""
    return df.where(~F.col(column).rlike(pattern))
