"""Evaluation records that occur, exactly or nearly, among training records.

Texts become sets of n-gram codes, of characters or of words. With n-grams ordered by how few evaluation records hold them,
two sets with an overlap of o share at least l of the first |x| - o + l of each. Only these are looked up, so n-grams that
most records share are hardly touched, and no pair above the threshold is missed.

* The posting lists of about INDEX_GRAMS evaluation n-grams at a time are broadcast, and training texts are scanned where
  they are, a batch at a time. Hits are counted sparsely, so a training text costs what it hits. Of several such blocks
  each is written and its broadcast dropped before the next is collected, so the driver holds one.
* Beyond INDEX_BLOCKS blocks both sides are partitioned by their rare n-grams: a join on the n-gram counts the hits of a
  pair, and pairs with enough of them are verified by a join with the sets.

Texts are made different and numbered first; only numbers travel until a pair is found. Both ways give the same rows: for each pair the size of the overlap, the containment of the evaluation record in the
training record, and the Jaccard similarity.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.workspace import checkpointed

#: N-grams of all evaluation texts that are broadcast at most (some 40 bytes each in a worker).
INDEX_GRAMS = 2_000_000
#: Broadcasts of that size, one after the other, before both sides are joined instead.
INDEX_BLOCKS = 16
#: Training texts of a task.
TRAIN_PART = 20_000
#: Shared rare n-grams asked of a pair before its whole sets are compared.
RARE_HITS = 16
#: Hits held at once by a task.
_HITS = 2_000_000
MEASURES = ("jaccard", "containment")


def clean_split(split: Column) -> Column:
    """Trimmed, in lower case, ``dev`` as development; null stays null."""
    tidy = F.lower(F.trim(split))
    return F.when(tidy == "dev", "development").otherwise(tidy)


def normal_text(text: str, unit: str = "chars") -> str:
    """NFKC, lower case, letters and digits only; with ``unit`` words the runs of them, one blank apart."""
    low = unicodedata.normalize("NFKC", text).lower()
    return "".join(filter(str.isalnum, low)) if unit == "chars" else " ".join(re.findall(r"[^\W_]+", low))


def gram_codes(text: str, unit: str = "chars", n: int = 3) -> np.ndarray:
    """The distinct runs of ``n`` characters or words of a normal text, ascending; up to three characters as exact codes, others hashed."""
    if unit == "words":
        words = text.split()
        return np.unique(np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + n])) >> 1 for i in range(len(words) - n + 1)], np.int64))
    if n > 3:
        return np.unique(np.array([xxhash.xxh64_intdigest(text[i : i + n]) >> 1 for i in range(len(text) - n + 1)], np.int64))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = max(len(points) - n + 1, 0)
    code = np.zeros(size, np.int64)
    for i in range(n):
        code = (code << 21) | points[i : i + size]
    return np.unique(code)


def _lists(codes: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(codes) if codes else np.empty(0, np.int64)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list of each entry, and its place there."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(offsets[:-1], sizes)


def _expand(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start to before its end, one run after the other."""
    sizes = ends - starts
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and how often each occurs; by counters where they would be hardly more than the keys, else by sorting."""
    if not len(keys):
        return keys, keys
    if keys.max() < 4 * len(keys):
        count = np.bincount(keys)
        found = np.flatnonzero(count)
        return found, count[found]
    return np.unique(keys, return_counts=True)


class _Index:
    """Posting lists of the evaluation sets."""

    def __init__(self, grams: np.ndarray, offsets: np.ndarray, threshold: float, measure: str):
        self.threshold, self.measure = threshold, measure
        self.sizes = np.diff(offsets)
        self.need = np.ceil(threshold * self.sizes - 1e-9).astype(np.int64)
        self.vocabulary, inverse, df = np.unique(grams, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(df), np.int64)
        self.rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        owner, _ = _places(offsets)
        code = self.rank[inverse.reshape(-1)]
        order = np.lexsort((code, owner))
        self.code, self.starts = code[order], offsets[:-1]
        _, place = _places(offsets)
        prefix = place < (self.sizes - self.need + RARE_HITS)[owner]
        by_code = np.argsort(self.code[prefix], kind="stable")
        self.postings = owner[prefix][by_code]
        self.ends = np.searchsorted(self.code[prefix][by_code], np.arange(len(df) + 1))
        self.keyed = owner * len(df) + self.code  # ascending: whether a set has a code is one search

    def scan(self, grams: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(training set, evaluation set, overlap) of all pairs that reach the threshold."""
        if not len(grams) or not len(self.vocabulary):
            return
        sizes = np.diff(offsets)
        need = np.ceil(self.threshold * sizes - 1e-9).astype(np.int64) if self.measure == "jaccard" else np.zeros(len(sizes), np.int64)
        owner, _ = _places(offsets)
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        present = self.vocabulary[at] == grams
        owner, code = owner[present], self.rank[at[present]]
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        held = np.bincount(owner, minlength=len(sizes))
        starts = np.cumsum(held) - held
        place = np.arange(len(owner)) - starts[owner] + (sizes - held)[owner]  # n-grams that no evaluation record has come first
        looked = (place < (sizes - need + RARE_HITS)[owner]) & (held >= need)[owner]
        owner_looked, code_looked = owner[looked], code[looked]
        lengths = self.ends[code_looked + 1] - self.ends[code_looked]
        total = np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            past = int(np.searchsorted(total, (total[first - 1] if first else 0) + _HITS, side="right"))
            past = max(past, first + 1)
            past = int(np.searchsorted(owner_looked, owner_looked[past - 1], side="right"))  # a training set is counted as a whole
            part = slice(first, past)
            hits = self.postings[_expand(self.ends[code_looked[part]], self.ends[code_looked[part] + 1])]
            low = owner_looked[first]
            pair, count = _counted(np.repeat(owner_looked[part] - low, lengths[part]) * len(self.sizes) + hits)
            pair = pair + low * len(self.sizes)
            t, e = pair // len(self.sizes), pair % len(self.sizes)
            most = np.maximum(np.maximum(need[t], self.need[e]), 1)  # no pair of sets of too different sizes can share that many
            good = (count >= np.minimum(RARE_HITS, most)) & (np.minimum(held[t], self.sizes[e]) >= most)
            t, e = t[good], e[good]
            for at_pair in range(0, len(t), 20_000):
                yield self._verified(t[at_pair : at_pair + 20_000], e[at_pair : at_pair + 20_000], code, starts, held, sizes)
            first = past

    def _verified(self, t: np.ndarray, e: np.ndarray, code: np.ndarray, starts: np.ndarray, held: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidate pairs those that reach the threshold: the codes of each training set are searched in its evaluation set."""
        mine = code[_expand(starts[t], starts[t] + held[t])]
        pair = np.repeat(np.arange(len(t)), held[t])
        wanted = e[pair] * len(self.vocabulary) + mine
        at = np.minimum(np.searchsorted(self.keyed, wanted), len(self.keyed) - 1)
        shared = np.bincount(pair[self.keyed[at] == wanted], minlength=len(t))
        whole = self.sizes[e] if self.measure == "containment" else self.sizes[e] + sizes[t] - shared
        good = shared >= self.threshold * whole - 1e-9
        return t[good], e[good], shared[good]


_BUILT: dict[int, _Index] = {}
_PAIRS = "eval_key bigint, train_key bigint, shared bigint, n_eval bigint, n_train bigint"


def _grams(texts: DataFrame, unit: str, n: int) -> DataFrame:
    """(key, grams) of texts (key, normal) with an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [gram_codes(t, unit, n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(codes)], ["key", "grams"]).filter(pa.array([len(x) > 0 for x in codes]))

    return texts.mapInArrow(run, "key bigint, grams array<bigint>")


def _by_broadcast(evals: DataFrame, train: DataFrame, threshold: float, measure: str) -> tuple[DataFrame, Broadcast]:
    collected = evals.toArrow()  # about INDEX_GRAMS n-grams
    parts = [_flat(chunk) for chunk in collected.column("grams").chunks]
    grams = np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)])
    sizes = np.concatenate([np.diff(p[1]) for p in parts] or [np.empty(0, np.int64)])
    index = evals.sparkSession.sparkContext.broadcast((collected.column("key").to_numpy(), grams, np.concatenate(([0], np.cumsum(sizes)))))
    number = uuid.uuid4().int

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, grams, offsets = index.value
        if number not in _BUILT:
            _BUILT.clear()
            _BUILT[number] = _Index(grams, offsets, threshold, measure)
        built = _BUILT[number]
        for batch in batches:
            values, own = _flat(batch.column(1))
            for t, e, shared in built.scan(values, own):
                columns = [pa.array(keys[e]), batch.column(0).take(pa.array(t)), pa.array(shared), pa.array(built.sizes[e]), pa.array(np.diff(own)[t])]
                yield pa.RecordBatch.from_arrays(columns, ["eval_key", "train_key", "shared", "n_eval", "n_train"])

    return train.mapInArrow(scan, _PAIRS), index


def _by_blocks(evals: DataFrame, train: DataFrame, blocks: int, threshold: float, measure: str) -> DataFrame:
    if blocks == 1:
        return _by_broadcast(evals, train, threshold, measure)[0]
    train = checkpointed(train)  # its n-grams are read once a block
    done = None
    for i in range(blocks):
        pairs, index = _by_broadcast(evals.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i), train, threshold, measure)
        found = checkpointed(pairs)
        index.destroy()
        done = found if done is None else done.union(found)
    return done


def _by_rare_grams(evals: DataFrame, train: DataFrame, threshold: float, measure: str) -> DataFrame:
    c = F.col
    need = lambda n: F.ceil(threshold * n - 1e-9)

    def exploded(sets: DataFrame) -> DataFrame:
        return sets.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))

    frequency = exploded(evals).groupBy("gram").agg(F.count("*").alias("df"))
    sides = {}
    for side, sets, asked in (("eval", evals, need(c("n"))), ("train", train, need(c("n")) if measure == "jaccard" else F.lit(0))):
        rows = exploded(sets).join(frequency, "gram")  # n-grams that no evaluation record has come first and match nothing
        w = Window.partitionBy("key")  # the n-grams of one text
        place = c("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "gram"))
        sides[side] = rows.withColumn("place", place).where(c("place") <= c("n") - asked + RARE_HITS).select("gram", c("key").alias(f"{side}_key"), c("n").alias(f"n_{side}"))
    pairs = sides["eval"].join(sides["train"], "gram").groupBy("eval_key", "train_key").agg(F.count("*").alias("hits"), F.first("n_eval").alias("n_eval"), F.first("n_train").alias("n_train"))
    most = F.greatest(need(c("n_eval")), need(c("n_train"))) if measure == "jaccard" else need(c("n_eval"))
    pairs = pairs.where(c("hits") >= F.least(F.lit(RARE_HITS), F.greatest(most, F.lit(1))))
    both = pairs.join(evals.toDF("eval_key", "x"), "eval_key").join(train.toDF("train_key", "y"), "train_key")
    sized = both.select("eval_key", "train_key", F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"), c("n_eval").cast("bigint").alias("n_eval"), c("n_train").cast("bigint").alias("n_train"))
    whole = c("n_eval") if measure == "containment" else c("n_eval") + c("n_train") - c("shared")
    return sized.where(c("shared") >= threshold * whole - 1e-9)


def overlapping_texts(normals: DataFrame, threshold: float = 0.6, unit: str = "chars", n: int = 3, measure: str = "jaccard") -> DataFrame:
    """(eval_normal, train_normal, shared, n_eval, n_train, containment, jaccard): all pairs of an evaluation and a training text that reach the threshold.

    ``normals`` has role (``eval`` or ``train``) and normal, see :func:`normal_text`. ``measure`` is the similarity the
    threshold is for: ``jaccard`` of the sets of ``n``-grams, or ``containment``, the share of the evaluation text's
    n-grams that the training text has, which also finds a short record inside a long text. Texts without an n-gram take
    no part; repeated texts count once; an empty side gives an empty result.
    """
    if measure not in MEASURES or unit not in ("chars", "words") or not 0 < threshold <= 1:
        raise ValueError(f"measure is one of {MEASURES}, unit chars or words, threshold in (0, 1]")
    spark = normals.sparkSession

    texts = checkpointed(normals.select("role", "normal").where("normal is not null").distinct().withColumn("key", F.monotonically_increasing_id()))

    def side(role: str, rows: int) -> DataFrame:
        parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows / TRAIN_PART))
        return _grams(texts.where(F.col("role") == role).select("key", "normal").repartition(parts, "key"), unit, n)

    counts = {r["role"]: r for r in texts.groupBy("role").agg(F.count("*").alias("rows"), F.sum(F.length("normal")).alias("chars")).collect()}
    rows = lambda role: counts[role]["rows"] if role in counts else 0
    # a text has at most as many n-grams as characters
    blocks = max(1, math.ceil((counts["eval"]["chars"] if "eval" in counts else 0) / max(INDEX_GRAMS, 1)))
    evals, train = side("eval", rows("eval")), side("train", rows("train"))
    pairs = _by_blocks(evals, train, blocks, threshold, measure) if blocks <= INDEX_BLOCKS else _by_rare_grams(evals, train, threshold, measure)
    of = lambda role: texts.where(F.col("role") == role).select(F.col("key").alias(f"{role}_key"), F.col("normal").alias(f"{role}_normal"))
    named = pairs.join(of("eval"), "eval_key").join(of("train"), "train_key").select("eval_normal", "train_normal", "shared", "n_eval", "n_train")
    return named.withColumn("containment", F.col("shared") / F.col("n_eval")).withColumn("jaccard", F.col("shared") / (F.col("n_eval") + F.col("n_train") - F.col("shared")))


def split_overlap(
    records: DataFrame, threshold: float = 0.6, min_chars: int = 12, eval_splits: tuple[str, ...] = ("development", "test"), train_split: str = "train", unit: str = "chars", n: int = 3, measure: str = "jaccard"
) -> DataFrame:
    """(eval_source, eval_split, eval_id, train_source, train_id, containment, jaccard) of all overlapping records.

    ``records`` has source, id, split, text. Splits are cleaned by :func:`clean_split`; null and other splits take no
    part, nor do null ids, null, empty and blank texts and those of under ``min_chars`` letters and digits. Repeated rows
    count once; a record found in an evaluation and a training split under one id is not paired with itself. N-grams and
    measure as in :func:`overlapping_texts`; clashing extra columns are not read.
    """
    c = F.col

    def normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal_text(t, unit) for t in batch.column(3).to_pylist()]
            kept = pa.array([len(t) - t.count(" ") >= min_chars for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["source", "id", "split", "normal"]).filter(kept)

    tidy = records.select(c("source").cast("string"), c("id").cast("string"), clean_split(c("split")).alias("split"), c("text").cast("string")).where("id is not null and text is not null")
    tidy = tidy.where(c("split").isin(*eval_splits, train_split))
    keyed = checkpointed(tidy.mapInArrow(normalize, "source string, id string, split string, normal string").distinct())
    role = F.when(c("split") == train_split, "train").otherwise("eval")
    pairs = overlapping_texts(keyed.select(role.alias("role"), "normal"), threshold, unit, n, measure)
    ends = keyed.where(c("split") != train_split).select(c("source").alias("eval_source"), c("split").alias("eval_split"), c("id").alias("eval_id"), c("normal").alias("eval_normal"))
    train = keyed.where(c("split") == train_split).select(c("source").alias("train_source"), c("id").alias("train_id"), c("normal").alias("train_normal"))
    return pairs.join(ends, "eval_normal").join(train, "train_normal").where("not (eval_source <=> train_source and eval_id = train_id)").select("eval_source", "eval_split", "eval_id", "train_source", "train_id", "containment", "jaccard").distinct()
