"""What the operators share: reading tables, checkpoints, Arrow passes, components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a checkpoint's file, about, where the frame's size is known.
ROWS_A_FILE = 20_000


def checkpointed(df: DataFrame, about: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, with its lineage cut.

    ``about``: how many rows it has at most, or about how many; a few rows in very many shuffle partitions are then written by
    fewer tasks, at least one a core. On a local disk each file costs the executor a process or more (Hadoop's chmod).
    The folder is the session's ``spark.checkpoint.dir``; only where that is unset on one machine
    (``local``, as in tests) a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    if about is not None:
        df = df.coalesce(max(sc.defaultParallelism, about // ROWS_A_FILE + 1))
    return df.checkpoint()


def of_sized(rows: DataFrame, sizes: DataFrame, by: list[str], heavy: int = 1000) -> DataFrame:
    """The rows whose key ``by`` is in ``sizes`` (a row a key, ``n``: the key's rows). Keys with more than ``heavy`` rows and a
    thousandth of all, which are a thousand at most, are broadcast, so that no task takes a whole such group."""
    bound = max(heavy, (sizes.agg(F.sum("n")).first()[0] or 0) // 1000)
    many = sizes.where(F.col("n") > bound).select(*by)
    if many.isEmpty():
        return rows.join(sizes.select(*by), by)
    rest = rows.join(F.broadcast(many), by, "left_anti").join(sizes.where(F.col("n") <= bound).select(*by), by)
    return rows.join(F.broadcast(many), by).unionByName(rest)


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """A narrow pass of ``fn`` over Arrow batches; ``fn`` yields batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives what a task has freed back to the system: a worker lives on, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, so that few Python objects live at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Numbers(dict):
    """Words numbered from 0 in the order in which they are met; ``characters`` is their length in all."""

    def __init__(self):
        super().__init__()
        self.characters = 0

    def of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The numbers of different ``words``, and which of them are new."""
        numbers = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        fresh = [words[i] for i in new.tolist()]
        if fresh:
            numbers[new] = np.arange(len(self), len(self) + len(fresh))
            self.update(zip(fresh, numbers[new].tolist()))
            self.characters += sum(map(len, fresh))
        return numbers, fresh


class Grown:
    """An array that is added to: ``data`` up to ``size``."""

    def __init__(self):
        self.data, self.size = np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(max(need, 2 * self.size) - self.size, np.int64)])
        self.data[self.size : need] = values
        self.size = need


def distinct_words(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's place among the different ones, and those."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets into them; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` within [offsets[i], offsets[i + 1]), in double precision; empty: 0."""
    total = np.zeros((len(offsets) - 1,) + values.shape[1:], np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        total[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return total


def components(edges: DataFrame, rounds: int = 60, about: int | None = None) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b): the smallest node reachable.

    Every round each node takes the smallest label among its neighbours' and then
    the label of that label (pointer jumping), so that a chain needs about as many rounds
    as its length has binary digits. Labels stay distributed, and each round is
    checkpointed. Null ends are dropped; a pair of equal ends is a node. ``about``: how many nodes there are, if known.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = checkpointed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), about)
    labels = checkpointed(pairs.groupBy("a").agg(F.min(F.least("a", "b")).alias("l")), pairs.count())
    nodes = labels.count()
    for _ in range(rounds):
        near = (
            pairs.join(labels.select(F.col("a").alias("b"), "l"), "b")
            .groupBy("a").agg(F.min("l").alias("m"))
            .join(labels, "a").select("a", "l", F.least("l", "m").alias("m"))
        )
        # hook: the old label's node also learns of the smaller label
        hooked = near.where("m < l").groupBy(F.col("l").alias("a")).agg(F.min("m").alias("h"))
        near = checkpointed(near.join(hooked, "a", "left").select("a", "l", F.least("m", F.coalesce("h", "m")).alias("m")), nodes)
        jumped = checkpointed(
            near.join(near.select(F.col("a").alias("m"), F.col("m").alias("j")), "m", "left")
            .select("a", F.least("m", F.coalesce("j", "m")).alias("l"), F.col("l").alias("was")),
            nodes,
        )
        labels = jumped.select("a", "l")
        if jumped.where("l < was").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select(F.col("a").alias("node"), F.col("l").alias("component"))
