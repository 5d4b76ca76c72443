"""The N best items of every group, by statistics-guided skipping.

Rows are range-partitioned by group and falling score and written to Parquet files in the order of their groups. A file has
two zones: the first DEPTH rows of each of its groups, clustered by group, and behind them what larger groups have more of,
by falling score. Row groups end at the zone. The writer notes of every row group its first and last group and its highest
score, so no footer is read later.

A file's row groups are read in the order of their highest score. The reader keeps the N-th score of every group it has
seen N rows of. A row group whose highest score lies strictly below the greatest of these is looked at first: only its
group column is read, and if it lies strictly below the N-th score of every group in it, the rest is never decoded. A hot
group spreads over many files; of those the ones that can't reach it any more are left out by the notes alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.workspace import checkpointed, scratch_path

#: Rows of a file and of a row group, and rows of a group that lie in the first zone of its file.
FILE_ROWS = 400_000
ROW_GROUP_ROWS = 1_024
DEPTH = 8
_NOTES = "file string, row_group int, low string, high string, max_score double, n_rows bigint"


def _group_key(names: list[str]) -> Column:
    """One text for the group's columns; different groups, nulls included, have different texts."""
    texts = [F.col(n).cast("string") for n in names]
    return F.concat(*(F.when(t.isNull(), F.lit("n;")).otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts))


def _runs(grp: pa.Array, before: tuple[str | None, int]) -> tuple[np.ndarray, tuple[str | None, int]]:
    """The place of each row in its run of equal groups, where the first run goes on from ``before`` (group, rows so far)."""
    code = grp.dictionary_encode()
    values = code.indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(values)]))))
    if grp[0].as_py() == before[0]:
        place[: starts[1] if len(starts) > 1 else len(place)] += before[1]
    return place, (grp[-1].as_py(), int(place[-1]) + 1)


def _write_file(folder: str, rows: pa.Table, place: np.ndarray) -> list[tuple]:
    """Writes one file and returns its notes."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.parquet"
    notes: list[tuple] = []
    deep = rows.filter(pa.array(place >= DEPTH)).sort_by([("score", "descending")])
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as sink, pq.ParquetWriter(sink, rows.schema, compression="zstd", use_dictionary=["grp"]) as writer:
        for zone in (rows.filter(pa.array(place < DEPTH)), deep):
            for at in range(0, len(zone), ROW_GROUP_ROWS):
                part = zone.slice(at, ROW_GROUP_ROWS)
                writer.write_table(part, row_group_size=ROW_GROUP_ROWS)
                ends = pa.compute.min_max(part.column("grp")).as_py()
                notes.append((f"{folder}/{name}", len(notes), ends["min"], ends["max"], pa.compute.max(part.column("score")).as_py(), len(part)))
    return notes


def _writer(folder: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        places: list[np.ndarray] = []
        last: tuple[str | None, int] = (None, 0)

        def flush() -> pa.RecordBatch:
            notes = _write_file(folder, pa.Table.from_batches(held), np.concatenate(places))
            held.clear()
            places.clear()
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*notes), kinds)], ["file", "row_group", "low", "high", "max_score", "n_rows"])

        for batch in batches:
            if len(batch):
                if not held:
                    last = (None, 0)  # a file's first zone has the first rows of its own part of a group
                place, last = _runs(batch.column(0), last)
                held.append(batch)
                places.append(place)
                if sum(map(len, held)) >= FILE_ROWS:
                    yield flush()
        if held:
            yield flush()

    return write


def cluster(df: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """Writes (grp, item, score, group columns) clustered by group below the shared folder; returns the notes on the row groups.

    The notes are checkpointed, so files are written once; what a repeated or lost task wrote besides is not in them.
    """
    rows = df.select(_group_key(group).alias("grp"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), *(F.col(n).alias(f"g{i}") for i, n in enumerate(group)))
    rows = rows.where("score is not null and not isnan(score) and item is not null")
    best = rows.groupBy("grp", "item", *(f"g{i}" for i in range(len(group)))).agg((F.max("score") + 0.0).alias("score"))
    best = best.select("grp", "item", "score", *(f"g{i}" for i in range(len(group))))
    order = [F.col("grp"), F.col("score").desc(), F.col("item")]
    return checkpointed(best.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_writer(scratch_path(df.sparkSession, "clustered")), _NOTES))


class _Best:
    """The ``n`` highest scores of each group seen so far; a row group touches only its own groups."""

    def __init__(self, n: int):
        self.n = n
        self.code: dict[str, int] = {}
        self.top = np.full((1024, n), -np.inf)
        self.highest = -np.inf  # of all N-th scores

    def codes(self, groups: list[str]) -> np.ndarray:
        out = np.fromiter((self.code.setdefault(g, len(self.code)) for g in groups), np.int64, len(groups))
        while len(self.code) > len(self.top):
            self.top = np.concatenate((self.top, np.full_like(self.top, -np.inf)))
        return out

    def hopeless(self, groups: list[str], score: float) -> bool:
        """Whether ``score`` lies strictly below the N-th score of all ``groups``."""
        return all((at := self.code.get(g)) is not None and score < self.top[at, -1] for g in groups)

    def offer(self, code: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Which rows may be among the best, given those seen before."""
        hope = score >= self.top[code, -1]
        mine = np.unique(code[hope])
        owner = np.concatenate((np.repeat(mine, self.n), code[hope]))
        value = np.concatenate((self.top[mine].reshape(-1), score[hope]))
        order = np.lexsort((-value, owner))
        owner, value = owner[order], value[order]
        starts = np.searchsorted(owner, mine)
        self.top[mine] = value[starts[:, None] + np.arange(self.n)]
        if len(mine):
            self.highest = max(self.highest, float(self.top[mine, -1].max()))
        return hope


def _groups(rows: pa.Table) -> pa.DictionaryArray:
    """The group column of one row group, whose few rows are one chunk."""
    return pa.concat_arrays(rows.column("grp").unify_dictionaries().chunks)


def _reader(n: int, tally: tuple):  # noqa: ANN202
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(path) as opened:
                    source = pq.ParquetFile(opened, read_dictionary=["grp"])
                    best, kept = _Best(n), []
                    for part in sorted(row["parts"], key=lambda p: (-p["max_score"], p["row_group"])):
                        groups = None
                        if part["max_score"] < best.highest:
                            groups = _groups(source.read_row_group(part["row_group"], columns=["grp"])).dictionary.to_pylist()
                            if best.hopeless(groups, part["max_score"]):
                                for counter, more in zip(tally, (1, part["n_rows"])):
                                    counter.add(more)
                                continue
                        rows = source.read_row_group(part["row_group"])
                        grp = _groups(rows)
                        hope = best.offer(best.codes(grp.dictionary.to_pylist())[grp.indices.to_numpy()], rows.column("score").to_numpy())
                        kept.append(rows.set_column(0, "grp", grp.cast(pa.string())).filter(pa.array(hope)))
                    if kept:
                        yield from _first(pa.concat_tables(kept), n).to_batches(max_chunksize=20_000)

    return read


def _first(rows: pa.Table, n: int) -> pa.Table:
    """The first ``n`` rows of each group by falling score, then item."""
    rows = rows.sort_by([("grp", "ascending"), ("score", "descending"), ("item", "ascending")])
    place, _ = _runs(pa.concat_arrays(rows.column("grp").chunks), (None, 0))
    return rows.filter(pa.array(place < n))


def read_top(notes: DataFrame, schema: str, n: int, tally: tuple = ()) -> DataFrame:
    """At most ``n`` best rows a file and group of what :func:`cluster` noted; ``tally`` are accumulators of the row groups and rows left undecoded in their file."""
    # across files: once row groups of one group alone hold n rows, those strictly below the last of them are left out
    alone = F.col("low") == F.col("high")
    order = Window.partitionBy("low").orderBy(F.col("max_score").desc(), "file", "row_group")
    before = F.sum("n_rows").over(order.rowsBetween(Window.unboundedPreceding, -2))
    # everything up to the row group before the previous one is at or above the previous one's maximum
    previous = F.lag("max_score").over(order)
    singles = notes.where(alone).withColumn("skip", F.coalesce((before >= n) & (F.col("max_score") < previous), F.lit(False))).where("not skip").drop("skip")
    parts = singles.union(notes.where(~alone))
    work = parts.groupBy("file").agg(F.collect_list(F.struct("row_group", "low", "high", "max_score", "n_rows")).alias("parts"))  # FILE_ROWS / ROW_GROUP_ROWS entries
    files = notes.select("file").distinct().count()
    return work.repartition(max(1, min(files, 65_536)), "file").mapInArrow(_reader(n, tally), schema)


def top_items(df: DataFrame, group: list[str], item: str, score: str, n: int, tally: tuple = ()) -> DataFrame:
    """(group columns, item, score, rank): the ``n`` items of each group with the highest scores, ties to the lesser item.

    Of repeated (group, item) rows the highest score counts. Null and NaN scores and null items are left out; infinite
    scores are ordinary. A null in a group column is a group value of its own. Groups with fewer than ``n`` items come
    out whole; an empty table gives an empty result. Extra columns, of whatever name, are not read.
    """
    notes = cluster(df, group, item, score)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(item, *group).schema}
    schema = f"grp string, item {kinds[item]}, score double" + "".join(f", g{i} {kinds[g]}" for i, g in enumerate(group))
    best = read_top(notes, schema, n, tally)
    # a group that spans files comes with n rows of each; the rest is already final
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), "item")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(*(F.col(f"g{i}").alias(name) for i, name in enumerate(group)), F.col("item").alias(item), F.col("score").alias(score), "rank")
