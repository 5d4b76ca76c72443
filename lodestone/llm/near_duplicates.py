"""Near-duplicate texts: SuperMinHash signatures, banding, exact verification, union-find groups.

1. A text's words are hashed in the JVM; an Arrow task turns them into shingles, signatures and band hashes. A text that
   a task has already seen is not signed again, so copies cost at most one entry a task and band.
2. Band entries travel as blocks (one row a task, band and hash range), 20 bytes an entry, and are sorted and compared
   in one task a band and hash range, one range at a time. Equal band hashes whose bit sketches are clearly unlike are
   dropped there. A bucket of more than TILE entries is cut into tiles, which are compared in tasks of their own.
3. Texts of the remaining candidates are joined in and their shingle sets compared exactly.
4. Links are between different texts. Copies of a text are members of its class; ids are brought in only at the end.

No bucket is capped: one of any size is compared whole, streaming its pairs, on as many tasks as it has tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.superminhash import band_hashes, bit_sketch, shingle_hashes, signatures
from lodestone.sources.workspace import checkpointed

#: Keys of candidates that are broadcast at most (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Entries of one band that one task compares, at about 20 bytes each.
ENTRIES_PER_TASK = 250_000
#: Entries of one bucket that are compared where they are; of a larger one each side of a tile.
TILE = 8_192
_FLUSH_ROWS = 10_000
_ENTRY = np.dtype([("bucket", "<u4"), ("key", "<i8"), ("sketch", "<u8")])


def words_of(text: Column) -> Column:
    """Hashes of the runs of letters and digits after lower-casing."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def text_key(kind: Column, text: Column) -> Column:
    return F.xxhash64(kind, text)


def _kind_salt(kinds: pa.Array) -> np.ndarray:
    return kinds.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


class NearDuplicates:
    """Links between texts of ``records`` (kind, id, text) whose sets of ``shingle``-word runs have Jaccard >= ``threshold``.

    Only records of one kind are compared. Null texts and texts under ``min_words`` words have no links; a null id is
    left out. Repeated rows of one id count once; an id that appears with several texts is linked by any of them, never
    to itself. With ``short_copies`` ids that share a text of at least one word are copies whatever its length. An empty table gives empty results. Columns besides those three are not read.

    A pair at similarity s becomes a candidate with probability 1 - (1 - s^rows)^bands at least: with 48 bands of 4
    rows 0.955 at 0.5, 0.998 at 0.6, above 0.9999 from 0.7. Every reported link is exact.
    """

    def __init__(self, records: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 20, bands: int = 48, rows: int = 4, short_copies: bool = False):
        self.records = records.select(F.col("kind").cast("string"), F.col("id").cast("string"), F.col("text").cast("string")).where("kind is not null and id is not null and text is not null")
        self.keyed = self.records.withColumn("key", text_key(F.col("kind"), F.col("text")))
        self.short_copies = short_copies
        self.threshold, self.shingle, self.min_words, self.bands, self.rows = threshold, shingle, min_words, bands, rows
        # 64 bits agree by (1 + s) / 2; three standard deviations below are let through
        agree = (1 + threshold) / 2
        self.max_unlike = 64 - math.floor(64 * agree - 3 * math.sqrt(64 * agree * (1 - agree)))
        self._links: DataFrame | None = None
        self._found: DataFrame | None = None

    def candidates(self) -> DataFrame:
        """Distinct (a, b) keys of texts that share a band and whose sketches are alike."""
        ranges = max(1, math.ceil(self.records.count() / ENTRIES_PER_TASK))
        shingle, bands, rows, m, max_unlike, tile = self.shingle, self.bands, self.rows, self.bands * self.rows, self.max_unlike, TILE

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def blocks() -> Iterator[pa.RecordBatch]:
                entries = np.concatenate([e for e, _ in held])
                places = np.concatenate([p for _, p in held])
                held.clear()
                groups, payloads = [], []
                for band in range(bands):
                    order = np.argsort(places[:, band], kind="stable")
                    cuts = np.searchsorted(places[order, band], np.arange(ranges + 1))
                    for r in range(ranges):
                        if cuts[r] < cuts[r + 1]:
                            groups.append(band * ranges + r)
                            payloads.append(np.ascontiguousarray(entries[order[cuts[r] : cuts[r + 1]], band]).tobytes())
                for at in range(0, len(groups), 16):
                    yield pa.RecordBatch.from_arrays([pa.array(groups[at : at + 16], pa.int32()), pa.array(payloads[at : at + 16], pa.binary())], ["grp", "payload"])

            for batch in batches:
                keys = batch.column(0).to_numpy()
                new = np.zeros(len(keys), bool)
                for i, key in enumerate(keys.tolist()):
                    if key not in seen:
                        seen.add(key)
                        new[i] = True
                batch = batch.filter(pa.array(new))
                if not len(batch):
                    continue
                lists = batch.column(2)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                words = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                offsets -= offsets[0]
                elements, owner = shingle_hashes(words, offsets, shingle)
                elements = elements ^ _kind_salt(batch.column(1))[owner]
                for first in range(0, len(batch), 2048):  # bounds the signatures held at once
                    last = min(first + 2048, len(batch))
                    part = slice(*np.searchsorted(owner, [first, last]))
                    signature = signatures(elements[part], owner[part] - first, last - first, m)
                    hashes = band_hashes(signature, rows)
                    entries = np.empty(hashes.shape, _ENTRY)
                    entries["bucket"] = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    entries["key"] = batch.column(0).to_numpy()[first:last, None]
                    entries["sketch"] = bit_sketch(signature)[:, None]
                    places = (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint32)
                    filled = np.bincount(owner[part] - first, minlength=last - first) > 0
                    held.append((entries[filled], places[filled]))
                if sum(len(p) for _, p in held) >= _FLUSH_ROWS:
                    yield from blocks()
            if held:
                yield from blocks()

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            payloads: list[bytes] = []
            for batch in batches:
                payloads += batch.column(1).to_pylist()
            entries = np.frombuffer(b"".join(payloads), _ENTRY)
            del payloads
            small, large = _buckets(entries, tile)
            for a, b in _alike(small, max_unlike):
                yield _candidate_rows(a, b)
            for bucket in large:
                cuts = [bucket[at : at + tile] for at in range(0, len(bucket), tile)]
                for i, left in enumerate(cuts):
                    for right in cuts[i:]:
                        yield _candidate_rows([None], [None], [left.tobytes()], [right.tobytes()])

        def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for a, b in _across(np.frombuffer(left, _ENTRY), np.frombuffer(right, _ENTRY), max_unlike):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        words = (
            self.keyed.select("key", F.xxhash64("kind").alias("salt"), words_of(F.col("text")).alias("words"))
            .where(F.size("words") >= max(self.min_words, self.shingle))
            .mapInArrow(sign, "grp int, payload binary")
        )
        # a task for each band and range, so that no task holds two of them
        found = checkpointed(words.repartitionById(bands * ranges, "grp").mapInArrow(compare, "a bigint, b bigint, left_tile binary, right_tile binary"))
        pairs, tiles = found.where("a is not null").select("a", "b"), found.where("left_tile is not null").select("left_tile", "right_tile")
        n_tiles = tiles.count()
        if n_tiles:
            pairs = pairs.union(tiles.repartition(min(n_tiles, 65_536)).mapInArrow(compare_tiles, "a bigint, b bigint"))
        return pairs.distinct()

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """(key, kind, id, words) of the texts in ``pairs`` and of texts that several ids share, of enough words."""
        copies = self.keyed.select("key", F.xxhash64("id").alias("h")).groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key")
        wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("key")).union(copies).distinct())
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
        return self.keyed.join(wanted, "key", "left_semi").select("key", "kind", "id", words_of(F.col("text")).alias("words")).where(F.size("words") >= (1 if self.short_copies else max(self.min_words, self.shingle)))

    def _resolve(self) -> None:
        pairs = checkpointed(self.candidates())
        found = checkpointed(self._texts(pairs))
        texts = found.select("key", "words").dropDuplicates(["key"])
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b")
        shingle, threshold = self.shingle, self.threshold

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared, union = shared_and_union(_lists(batch.column(2)), _lists(batch.column(3)), shingle)
                kept = pa.array(shared >= threshold * union - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(union)], ["a", "b", "shared", "total"]).filter(kept)

        self._found = found.select("key", "kind", "id").distinct()
        self._links = checkpointed(both.select("a", "b", "wa", "wb").mapInArrow(verify, "a bigint, b bigint, shared bigint, total bigint"))

    @property
    def links(self) -> DataFrame:
        """(a, b, shared, total): keys of different texts that are alike, with the exact sizes of overlap and union."""
        if self._links is None:
            self._resolve()
        return self._links

    @property
    def members(self) -> DataFrame:
        """(key, kind, id) of linked texts and of texts with several ids."""
        if self._found is None:
            self._resolve()
        return self._found

    def pairs(self) -> DataFrame:
        """(kind, id_a, id_b), id_a < id_b: all pairs of different ids of one kind, copies included."""
        m = self.members
        left, right = m.select(F.col("key").alias("a"), F.col("kind"), F.col("id").alias("x")), m.select(F.col("key").alias("b"), F.col("kind").alias("kind_b"), F.col("id").alias("y"))
        linked = self.links.select("a", "b").join(left, "a").join(right, "b").where("kind = kind_b and x <> y").select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        copies = left.join(right, (F.col("a") == F.col("b")) & (F.col("kind") == F.col("kind_b"))).where("x < y").select("kind", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        return linked.union(copies).distinct()

    def groups(self) -> DataFrame:
        """(kind, id, group_id, n_links): a row for every record with a text.

        group_id is the least id of the connected group; n_links the number of other ids linked to this one directly,
        counted by class of copies. A record without links is a group of its own with 0 links.
        """
        roots = connected_components(self.links.select("a", "b"))
        members = self.members
        size = members.groupBy("key").agg(F.count("*").alias("n"))
        ends = self.links.select(F.col("a").alias("key"), F.col("b").alias("other")).union(self.links.select(F.col("b").alias("key"), F.col("a").alias("other")))
        near = ends.join(size.select(F.col("key").alias("other"), "n"), "other").groupBy("key").agg(F.sum("n").alias("near"))
        per_text = (
            members.join(size, "key").join(near, "key", "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
            .select("kind", "id", F.coalesce("root", "key").alias("root"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
        )
        least = per_text.groupBy("kind", "root").agg(F.min("id").alias("group_id"))
        linked = per_text.join(least, ["kind", "root"]).groupBy("kind", "id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("n_links"))
        everyone = self.records.select("kind", "id").distinct()
        return everyone.join(linked, ["kind", "id"], "left").select("kind", "id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _candidate_rows(a, b, left=None, right=None) -> pa.RecordBatch:  # noqa: ANN001
    none = pa.nulls(len(a), pa.binary())
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(left, pa.binary()) if left else none, pa.array(right, pa.binary()) if right else none]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "left_tile", "right_tile"])


def _buckets(entries: np.ndarray, tile: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entries of buckets of two or more texts, by bucket and key, each text once a bucket; those of more than ``tile`` apart."""
    bucket = entries["bucket"]
    order = np.argsort(bucket)
    same = bucket[order[1:]] == bucket[order[:-1]]
    keep = np.zeros(len(order), bool)
    keep[1:] |= same
    keep[:-1] |= same
    part = entries[order[keep]]
    part = part[np.lexsort((part["key"], part["bucket"]))]
    if len(part):  # a text that several tasks signed
        again = (part["bucket"][1:] == part["bucket"][:-1]) & (part["key"][1:] == part["key"][:-1])
        part = part[np.concatenate(([True], ~again))]
    _, starts, sizes = np.unique(part["bucket"], return_index=True, return_counts=True)
    hot = np.flatnonzero(sizes > tile)
    inside = np.repeat(sizes <= tile, sizes)
    return part[inside], [part[starts[i] : starts[i] + sizes[i]] for i in hot]


def _alike(part: np.ndarray, max_unlike: int, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Key pairs a < b of equal bucket and sketches that differ in at most ``max_unlike`` bits; ``part`` as :func:`_buckets` gives it."""
    bucket, key, sketch = (np.ascontiguousarray(part[c]) for c in ("bucket", "key", "sketch"))
    at = np.arange(len(part))
    distance = 1
    while len(at := at[at + distance < len(part)]):
        at = at[bucket[at] == bucket[at + distance]]
        for first in range(0, len(at), step):
            i = at[first : first + step]
            close = np.bitwise_count(sketch[i] ^ sketch[i + distance]) <= max_unlike
            i = i[close]
            if len(i):
                yield key[i], key[i + distance]
        distance += 1


def _across(left: np.ndarray, right: np.ndarray, max_unlike: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Key pairs a < b of two parts of one bucket, which may be the same part."""
    for at in range(0, len(left), rows):
        mine = left[at : at + rows]
        i, j = np.nonzero(np.bitwise_count(mine["sketch"][:, None] ^ right["sketch"][None, :]) <= max_unlike)
        a, b = mine["key"][i], right["key"][j]
        up = a < b
        if up.any():
            yield a[up], b[up]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def shared_and_union(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the shingle sets of each pair of word lists."""
    n = len(left[1]) - 1
    sets = []
    for words, offsets in (left, right):
        h, owner = shingle_hashes(words, offsets, shingle)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        sets.append((h[first], owner[first]))
    h, owner = np.concatenate((sets[0][0], sets[1][0])), np.concatenate((sets[0][1], sets[1][1]))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    twice = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    shared = np.bincount(owner[1:][twice], minlength=n)
    return shared, np.bincount(owner, minlength=n) - shared
