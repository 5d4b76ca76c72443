"""Pages of repeated keywords, links or tags, told from prose by how their terms recur.

Function words come from the corpus: those that a fifth of the documents of a language hold. A page is then a sequence of
words in which every link, hashtag and key:value tag is one marker, so a list of links is a run of one term, and its
content terms are the words and markers that are neither function words nor numbers.

* ``recurrence``: share of the page's places that hold a content term which came up at most GAP places before. It is the
  sum of the positional autocorrelation over LAG_WINDOWS: of the content terms' gaps, the share in each window.
* ``lag_peak``: the largest of these windows, a beat.
* ``regularity``: share of places that hold content terms which come back at all but equal gaps beyond GAP.
* ``function_share``, ``number_share``, ``unit_share`` (markers), ``distinct_share`` of content terms, ``n_words``.

Prose names things again too, but far between, and its places are mostly function words. The verdict is a rule on these
measures (:func:`stuffed`), the same for every language and size of corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 40
#: Lags of the positional autocorrelation, up to GAP.
LAG_WINDOWS = ((1, 1), (2, 2), (3, 4), (5, 8), (9, 16), (17, 40))
MEASURES = ("recurrence", "lag_peak", "regularity", "function_share", "number_share", "unit_share", "distinct_share", "n_words")
#: Share of a language's documents that hold a function word, by the lower end of its interval (two standard errors).
FUNCTION_DF = 0.2
#: A word that makes more of a page than this is none of its function words, whatever it is elsewhere.
FUNCTION_TOP = 0.3

_LINK, _TAG, _KEY = "\ue000", "\ue001", "\ue002"
_MARKUP = re.compile(r"<a\s[^<>]*>[^<>]*</a\s*>|\[[^\[\]\n]*\]\([^()\s]*\)|(?:https?://|www\.)\S+")
#: Addresses without a scheme, the dot disguised or not; of up to ten labels, and begun at a word, so that a text costs its length.
_DOT = r"(?:\s?(?:\(\.\)|\[\.\]|\[dot\]|\(dot\))\s?|\s\.\s|\.)"
_HOST = re.compile(rf"(?<![\w-])[\w-]++(?:{_DOT}[\w-]++){{0,8}}?{_DOT}[a-z]{{2,12}}(?:/\S*|(?![\w.]))")
_HOST_SIGN = re.compile(r"\.[a-z]|[(\[](?:\.|dot)[)\]]|\w \. [a-z]")
_HASH = re.compile(r"#[^\s#]+")
_PAIR = re.compile(r"(?<![^\W\d_])[^\W\d_]++:[\w-]*\w")
_ASCII_WORD = re.compile(r"[a-z0-9]+")  # what _WORD finds in such a text
_WORD = re.compile(r"[㐀-䶿一-鿿\ue000-\ue002]|[^\W_㐀-䶿一-鿿]+")
_JVM_HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
_JVM_WORD = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]]+"


def page_words(text: str) -> list[str]:
    """The words of a text in lower case, Chinese by character, with one marker for each link, hashtag and key:value tag."""
    low = text.lower()
    if not low.isascii():
        low = low.translate({0xE000: " ", 0xE001: " ", 0xE002: " "})
    if "http" in low or "www." in low or "<a" in low or "](" in low:
        low = _MARKUP.sub(f" {_LINK} ", low)
    if _HOST_SIGN.search(low):
        low = _HOST.sub(f" {_LINK} ", low)
    if "#" in low:
        low = _HASH.sub(f" {_TAG} ", low)
    if ":" in low:
        low = _PAIR.sub(f" {_KEY} ", low)
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def measure(text: str | None, function_words: Collection[str]) -> tuple[float, ...]:
    """The measures of one text, in the order of MEASURES; all 0 for a null, empty or blank one."""
    words = page_words(text) if text else []
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    code: defaultdict[str, int] = defaultdict()
    code.default_factory = code.__len__  # the next free number
    terms = np.fromiter(map(code.__getitem__, words), np.int64, n)
    m = len(code)
    often = np.bincount(terms, minlength=m)
    function = np.fromiter(map(function_words.__contains__, code), bool, m) & (often <= max(3, FUNCTION_TOP * n))
    number = np.fromiter(map(str.isdigit, code), bool, m)
    marker = np.fromiter(("\ue000" <= w <= "\ue002" for w in code), bool, m)
    plain = ~(function | number)
    shares = (float(often[function].sum()) / n, float(often[number].sum()) / n, float(often[marker].sum()) / n)
    n_content = int(often[plain].sum())
    if not n_content:
        return (0.0, 0.0, 0.0, *shares, 0.0, float(n))
    places = np.flatnonzero(plain[terms])
    order = places[np.argsort(terms[places], kind="stable")]
    held = terms[order]
    again = held[1:] == held[:-1]
    gaps, owner = (order[1:] - order[:-1])[again], held[1:][again]
    profile = np.bincount(gaps[gaps <= GAP], minlength=GAP + 1)
    windows = [profile[low : high + 1].sum() / n for low, high in LAG_WINDOWS]
    regular = 0.0
    far = gaps > GAP
    if far.any():
        count = np.bincount(owner, minlength=m)
        mean = np.bincount(owner, gaps, m) / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(np.bincount(owner, gaps.astype(float) ** 2, m) / np.maximum(count, 1) - mean**2, 0))
        beat = (count >= 4) & (spread <= 0.1 * mean)
        regular = float((far & beat[owner]).sum()) / n
    return (float(sum(windows)), float(max(windows)), regular, *shares, float(plain.sum()) / n_content, float(n))


def function_words(df: DataFrame, text_col: str = "text", lang_col: str | None = None, share: float = FUNCTION_DF) -> DataFrame:
    """(word) that at least ``share`` of the documents of some language hold, by the lower end of two standard errors.

    Documents are counted whole and all of them, per value of ``lang_col`` (null is a value; without it there is one
    language). Counts combine before the shuffle. A document has a bounded number of words above the share on average, so
    the result has at most (mean number of different words of a document) / ``share`` rows a language.
    """
    lang = F.coalesce(F.lower(F.trim(F.col(lang_col).cast("string"))), F.lit("")) if lang_col else F.lit("")
    low = F.lower(F.col(text_col).cast("string"))
    # without a Chinese character the short pattern finds the same words
    found = F.when(low.rlike(_JVM_HAN), F.regexp_extract_all(low, F.lit(_JVM_WORD), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    docs = df.where(F.trim(F.col(text_col)) != "").select(lang.alias("l"), found.alias("w"))
    counted = docs.select("l", F.explode(F.array_distinct("w")).alias("word")).groupBy("l", "word").agg(F.count("*").alias("k"))
    total = df.where(F.trim(F.col(text_col)) != "").groupBy(lang.alias("l")).agg(F.count("*").alias("n"))  # a row a language
    known = counted.where("not word rlike '^[0-9]+$'").join(F.broadcast(total), "l")
    return known.where(F.col("k") / F.col("n") - 2 * F.sqrt(share * (1 - share) / F.col("n")) >= share).select("word").distinct()


def page_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, words: Collection[str] | None = None) -> DataFrame:
    """(id_col, the MEASURES as double) of every row; a null, empty or blank text measures 0 throughout.

    ``words`` are the function words; without them they are taken from the corpus by :func:`function_words`, which is one
    more pass over it. Repeated rows come out as often as they come in, an empty table gives an empty result, and other
    columns, of whatever name, are left out first.
    """
    known = frozenset(r["word"] for r in function_words(df, text_col, lang_col).collect()) if words is None else frozenset(words)  # a few hundred, see there
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([measure(t, known) for t in batch.column(1).to_pylist()], float).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in values.T.copy())], ["k", *MEASURES])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, " + ", ".join(f"{m} double" for m in MEASURES)).withColumnRenamed("k", id_col)


def stuffed() -> Column:
    """The rule over the measures: a fifth of the page is content that recurs, or a list of terms without any function word.

    Two recurrences are free, as a short text has them by chance.
    """
    c = F.col
    recurring = (c("n_words") >= 8) & (c("recurrence") + c("regularity") - 2 / F.greatest(c("n_words"), F.lit(1.0)) >= 0.2)
    bare_list = (c("n_words") >= 15) & (c("number_share") < 0.03) & (c("function_share") < 0.03)
    return recurring | bare_list


def stuffed_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, words: Collection[str] | None = None) -> DataFrame:
    """(id_col) of the pages :func:`stuffed` flags, each id once; null, empty and blank texts are never flagged."""
    return page_measures(df, id_col, text_col, lang_col, words).where(stuffed()).select(id_col).distinct()
