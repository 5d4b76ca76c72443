"""Byte-level BPE by corpus-level merge replay.

A task's texts are cut into chunks, equal chunks count once, and the pieces of the distinct chunks form one corpus.
An inverted index maps each mergeable token pair to the places where it occurs. Ranks are taken in ascending order; a
merge touches only its own places, unlinks one symbol each and enters the two pairs it creates, which always rank later
than the merge that made them. One sweep over the ranks therefore encodes the whole corpus of the task, and each
text's ids are gathered from its chunks.

The work is proportional to the text, no shuffle is needed, and memory is bounded by one input partition.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Splits a text before any merge (fixed value of the vocabulary, as published with it).
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks a task keeps before it starts a new cache; a bound on memory only, results don't depend on it.
MAX_CACHED_CHUNKS = 2_000_000

_END = -1
_DEAD = -2


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> str:
    """Place of a vocabulary file; ``folder`` or the environment's LODESTONE_TOKENIZERS overrides the default."""
    return os.path.join(folder or os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers"), name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free code from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class MergeReplay:
    """Encodes many pieces together by replaying the merges in rank order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.size = max(vocab.values()) + 1
        self.rank_of: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = vocab[a], vocab[b]
            self.rank_of.setdefault(left * self.size + right, rank)
            self.merges.append((left, right, vocab[a + b]))
        keys = np.fromiter(self.rank_of.keys(), np.int64, len(self.rank_of))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.fromiter(self.rank_of.values(), np.int64, len(self.rank_of))[order]

    def encode(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after the other, and the number of ids of each piece."""
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        # one cell per byte, and an end cell before the first piece and after every piece
        starts = np.cumsum(lengths + 1) - lengths
        cells = np.full(int(lengths.sum()) + len(pieces) + 1, _END, np.int64)
        at = np.arange(len(flat)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        cells[at] = self.first[flat]
        index = self._pair_index(cells)
        result = self._replay(cells, index)
        kept = result >= 0
        owner = np.cumsum(result == _END) - 1  # the end cell that opens a piece counts for it
        counts = np.bincount(owner[kept], minlength=len(pieces))[: len(pieces)]
        return result[kept].astype(np.int32), counts.astype(np.int64)

    def _pair_index(self, cells: np.ndarray) -> dict[int, list[int]]:
        """Places of each mergeable pair of neighbours, by rank, ascending."""
        both = np.flatnonzero((cells[:-1] >= 0) & (cells[1:] >= 0))
        keys = cells[both] * self.size + cells[both + 1]
        found = np.searchsorted(self._keys, keys)
        found[found == len(self._keys)] = 0
        hit = self._keys[found] == keys
        places, ranks = both[hit], self._ranks[found[hit]]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        heads = ranks[np.concatenate(([0], cuts))] if len(ranks) else ranks
        return {int(r): p.tolist() for r, p in zip(heads, np.split(places, cuts))} if len(ranks) else {}

    def _replay(self, token: np.ndarray, index: dict[int, list[int]]) -> np.ndarray:
        after = np.arange(1, len(token) + 1)
        before = np.arange(-1, len(token) - 1)
        rank_of, size = self.rank_of.get, self.size
        for rank, (a, b, merged) in enumerate(self.merges):
            places = index.pop(rank, None)
            if places is None:
                continue
            p = np.array(places)
            if a == b:
                p = self._every_other(np.sort(p), token, after, a)
            q = after[p]
            valid = (token[p] == a) & (token[q] == b)
            if not valid.all():
                p, q = p[valid], q[valid]
            if not len(p):
                continue
            token[p] = merged
            token[q] = _DEAD
            n = after[q]
            after[p] = n
            before[n] = p
            o = before[p]
            left, right = token[o], token[n]
            # two merges side by side make one new pair, entered from its left end
            opens, closes = (left >= 0) & (left != merged), right >= 0
            keys = np.concatenate((left[opens] * size + merged, merged * size + right[closes]))
            for key, place in zip(keys.tolist(), np.concatenate((o[opens], p[closes])).tolist()):
                if (r := rank_of(key)) is not None:
                    if (found := index.get(r)) is None:
                        index[r] = [place]
                    else:
                        found.append(place)
        return token

    @staticmethod
    def _every_other(places: np.ndarray, token: np.ndarray, after: np.ndarray, a: int) -> np.ndarray:
        """Of a run of equal symbols the first and second merge, the third and fourth, and so on."""
        chosen, taken = [], -1
        for p in places.tolist():
            if token[p] == a and p != taken and token[q := after[p]] == a:
                chosen.append(p)
                taken = q
        return np.array(chosen, np.int64)

@lru_cache(maxsize=4)
def replayer(path: str) -> MergeReplay:
    """One per worker process and vocabulary."""
    return MergeReplay(path)


class ChunkEncoder:
    """Encodes texts of a task; a chunk already seen is not encoded again.

    A chunk is a space and what follows it up to the next space. Pieces never reach over a space that is not followed
    by more white space, so the chunks of a text can be encoded apart; a text with two spaces in one run of white
    space is cut into its pieces instead.
    """

    _wide = re.compile(r" [\s\x1c-\x1f\x85]* ")

    def __init__(self, path: str):
        self.replay = replayer(path)
        self.pieces = regex.compile(PIECE).findall
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _chunks(self, text: str) -> list[str]:
        if self._wide.search(text):
            return self.pieces(text)
        head, *rest = text.split(" ")
        chunks = [" " + c for c in rest]
        if head:
            chunks.insert(0, head)
        return chunks

    def _pieces_of(self, chunk: str) -> list[str]:
        if chunk.isascii():  # a word, or a word and one mark, needs no pattern
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word[:-1].isalpha() and word[-1] in ".,;:!?)":
                return [chunk[:-1], word[-1]]
        return self.pieces(chunk)

    def _learn(self, fresh: list[str]) -> None:
        cut = [self._pieces_of(c) for c in fresh]
        words: dict[str, int] = {}
        for pieces in cut:
            for piece in pieces:
                if piece not in words:
                    words[piece] = len(words)
        ids, counts = self.replay.encode([w.encode("utf-8") for w in words])
        where = np.cumsum(counts) - counts
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        used = np.fromiter((words[p] for pieces in cut for p in pieces), np.int64, int(sizes.sum()))
        self.ids = np.concatenate((self.ids, gather(ids, where, counts, used)))
        ends = np.concatenate(([0], np.cumsum(counts[used])))[np.cumsum(sizes)]
        self.starts = np.concatenate((self.starts, self.starts[-1] + ends))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text in them."""
        if len(self.known) > MAX_CACHED_CHUNKS:
            self._reset()
        known, fresh, used, sizes = self.known, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            chunks = self._chunks(text)
            for chunk in set(chunks).difference(known):
                known[chunk] = len(known)
                fresh.append(chunk)
            used.extend(map(known.__getitem__, chunks))
            sizes[i] = len(chunks)
        if fresh:
            self._learn(fresh)
        used_at = np.array(used, np.int64)
        counts = np.diff(self.starts)
        total = np.concatenate(([0], np.cumsum(counts[used_at])))
        offsets = total[np.concatenate(([0], np.cumsum(sizes)))]
        return gather(self.ids, self.starts[:-1], counts, used_at), offsets


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values`` one after the other."""
    n = counts[which]
    ends = np.cumsum(n)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[which] - (ends - n), n)]


def _text_batches(batches: Iterator[pa.RecordBatch], at: int, rows: int, most_bytes: int = 1 << 28) -> Iterator[pa.RecordBatch]:
    """Larger batches, so that more texts share one replay; one is closed at ``rows`` rows or ``most_bytes`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows or sum(b.nbytes for b in held) >= most_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()  # several where a column is beyond 2 GB
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None, batch_rows: int = 20_000
) -> DataFrame:
    """(id_col, ids array<int>) of every row, in one pass without a shuffle.

    A null and an empty text give an empty list; blank texts are encoded like any other; special-token strings in a
    text are ordinary text. Repeated rows come out as often as they come in. An empty table gives an empty result.
    Other columns, of whatever name, are left out before anything is computed.
    """
    path = vocabulary_path(vocabulary, folder)
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in _text_batches(batches, 1, batch_rows):
            ids, offsets = encoder.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            for at in range(0, len(batch), 2_000):
                part = lists.slice(at, 2_000)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 2_000), part], ["k", "ids"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None, batch_rows: int = 20_000
) -> DataFrame:
    """(id_col, n_tokens bigint) of every row: the lengths of :func:`encode_texts` without moving the ids."""
    path = vocabulary_path(vocabulary, folder)
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in _text_batches(batches, 1, batch_rows):
            _, offsets = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64())], ["k", "n"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, n bigint").toDF(id_col, "n_tokens")
