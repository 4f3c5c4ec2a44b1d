"""Helpers shared by the text operators: column access, checkpoints, Arrow mapping, bounded samples and checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.shipping import ship

#: Texts handed to a Python function at once, in bytes; a longer single text goes alone.
SLICE_BYTES = 2 << 20

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


#: What this worker process remembers for the operator that it served last.
REMEMBERED: dict[tuple, object] = {}


def remembered(key: tuple, make: Callable[[], object]):
    """What ``make`` gave for this key in this worker process. Only one key is held, so that a worker that serves one operator after
    another never holds the tables of two."""
    if key not in REMEMBERED:
        forget()
        REMEMBERED[key] = make()
    return REMEMBERED[key]


def forget() -> None:
    """Let go of what this worker process remembers. Operators that remember nothing call it too: a worker serves all stages of a
    pipeline, and the tables of an earlier one would stand beside theirs."""
    if REMEMBERED:
        REMEMBERED.clear()
        give_back()


def give_back() -> None:
    """Hand memory that is free in this process back to the system; the C library else keeps it from one stage to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def named(name: str) -> Column:
    """The column of this exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. A temporary one stands for it in a local session alone; elsewhere its
    lack is an error, as executors can't read what another one wrote to its own disk."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="checkpoints-")


#: Whether the shuffle files of a finished execution go at once; read when a DataFrame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder. The shuffles behind it are not needed any more and go as soon as it is
    written, so that an operator of many steps never holds the shuffle files of all of them."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def texts_of(docs: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) with a null text as the empty one; of other columns only those ``carried`` are kept."""
    ship(docs.sparkSession)
    return docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"), *map(named, carried))


def partitions_for(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], added: dict[str, str], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Arrow-batched map over a text column.

    ``make()`` runs once per task and gives a function from a list of texts to columns (one list per name of ``added``).
    Columns named in ``keep`` pass through. Memory is bounded by ``SLICE_BYTES`` of text plus one text.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keep] + [f"{k} {v}" for k, v in added.items()])
    arrow = {k: ARROW[v] for k, v in added.items()}
    names = [*keep, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch, names_of(batch).index(text_col)):
                columns = function(part.column(names_of(part).index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(names_of(part).index(k)) for k in keep] + [pa.array(columns[k], t) for k, t in arrow.items()], names=names)
            give_back()

    return df.select(*keep, text_col).mapInArrow(run, schema)


def names_of(batch: pa.RecordBatch) -> list[str]:
    return batch.schema.names


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``SLICE_BYTES`` of the column's bytes, or one row."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).to_pylist()
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + (n or 0) > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n or 0
    if len(sizes) > at:
        yield batch.slice(at)


def sampled(docs: DataFrame, id_col: str, size: int, seed: int = 7) -> DataFrame:
    """About ``size`` rows, at most twice that, chosen by a hash of the id; every run chooses alike."""
    total = max(1, docs.count())
    return docs.filter(F.coalesce(F.pmod(F.xxhash64(named(id_col), F.lit(seed)), F.lit(total)), F.lit(0)) < size).limit(2 * size)


def only_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", most: int = 1_000_000, keys: list[str] | None = None) -> DataFrame:
    """Semi or anti join on doc_id (or ``keys``): a broadcast where the ids, counted first, are at most ``most``, else a shuffled join."""
    keys = keys or ["doc_id"]
    few = ids.select(*keys).limit(most + 1).count() <= most
    return df.join(F.broadcast(ids.select(*keys)) if few else ids.select(*keys).hint("merge"), keys, how)


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], size: str, large: int = 10_000, harmless: int = 1_000) -> DataFrame:
    """Inner join with a table of unique keys that knows, in ``size``, how many rows of ``left`` each key has.

    Keys with more than one in ``large`` of the rows, of which there are fewer than ``large``, and more than ``harmless``, are broadcast; the
    others are shuffled, and none of them fills a task. ``right`` is read several times, so it should be a checkpoint.
    """
    total, top = right.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    most = max(total / large, harmless)
    if top <= most:
        return left.join(right, keys).drop(size)
    few = F.broadcast(right.filter(F.col(size) > most))
    rest = left.join(few.select(*keys), keys, "left_anti").join(right.filter(F.col(size) <= most), keys)
    return left.join(few, keys).unionByName(rest).drop(size)


def map_groups(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """``function`` on the rows of each group, where groups are many and of bounded size.

    One shuffle and sort by the keys; a task streams over its groups, so a small group costs no call of its own machinery.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = list(zip(*(table[k].to_pylist() for k in keys), strict=True))
            at = 0
            for i, key in enumerate(rows):
                if key != last:
                    if i > at:
                        held.append(table.slice(at, i - at))
                    if held:
                        yield from done(held)
                    held, at, last = [], i, key
            held.append(table.slice(at))
        if held:
            yield from done(held)

    def done(parts: list[pa.Table]) -> list[pa.RecordBatch]:
        out = function(pa.concat_tables(parts))
        return [] if out is None else out.to_batches()

    return df.repartition(partitions_for(df), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def fold_groups(df: DataFrame, keys: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """Streams over the rows of each group, which may be many: ``make()`` gives an object whose ``add(table)`` takes some of a group's rows
    and whose ``end()`` closes the group; both give tables. One shuffle and sort by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, last = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = list(zip(*(table[k].to_pylist() for k in keys), strict=True))
            at = 0
            for i in range(1, len(rows) + 1):
                if i < len(rows) and rows[i] == rows[at]:
                    continue
                if fold is None or rows[at] != last:
                    if fold is not None:
                        yield from sent(fold.end())
                    fold, last = make(), rows[at]
                yield from sent(fold.add(table.slice(at, i - at)))
                at = i
            give_back()
        if fold is not None:
            yield from sent(fold.end())

    def sent(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            yield from (b for b in t.to_batches() if b.num_rows)

    return df.repartition(partitions_for(df), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
