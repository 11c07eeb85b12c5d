"""What the operators share: the shared work folder, tables written on the way, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import importable, table  # noqa: F401

#: White space of the contracts: tab to carriage return, and space.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows and bytes of one Arrow batch that crosses to Python: long texts must not pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Only where it is unset and all of Spark runs in this process's machine (tests) a temporary folder is set in its place.
    """
    conf = spark.sparkContext.getConf()
    place = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not place:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


class Scratch:
    """Tables that an operator writes on its way, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = importable(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.written: dict[str, DataFrame] = {}
        # executors start separate workers for either value, and they would hold two sets of tables: one value for all
        spark.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
        for setting, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
            name = f"spark.sql.execution.arrow.{setting}"
            if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most:
                spark.conf.set(name, str(most))

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df and read it again."""
        df.write.options(**options).parquet(place := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(place)
        out.lexweave_path = place
        self.written[place] = out
        return out

    def only(self, *frames: DataFrame) -> None:
        """Delete all tables written so far but these, which the result reads."""
        self.drop(*(df for place, df in list(self.written.items()) if place not in {f.lexweave_path for f in frames}))

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            self.written.pop(df.lexweave_path, None)
            path = jvm.org.apache.hadoop.fs.Path(df.lexweave_path)
            path.getFileSystem(conf).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner", salts: int = 64) -> DataFrame:
    """left join right on keys, right unique by key; the rows of heavy keys in left go to `salts` tasks.

    heavy lists keys of proven number (see heavy_keys) and is broadcast; the rows of right with such keys are
    repeated once for each salt. Neither side may have a column named __salt.
    """
    hot = F.broadcast(heavy.select(*keys).withColumn("__hot", F.lit(True)))
    l = left.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    ).drop("__hot")
    r = right.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    return l.join(r, [*keys, "__salt"], how).drop("__salt")


def heavy_keys(counts: DataFrame, keys: list[str], n: str, total: int, share: int = 2000, least: int = 200) -> DataFrame:
    """Keys with at least total/share rows. There are at most `share` of them, whatever the data."""
    return counts.filter(F.col(n) >= max(least, total // share)).select(*keys)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of a task's batches.

    Workers live on between tasks, and an executor's memory counts theirs: one holds the tables of one module at a time (see built), and
    gives freed memory back to the system after each batch and at the end of the task.
    """
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_tables_of(module)
        try:
            for batch in fn(batches):
                yield batch
                del batch
                give_back()
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """map_stream with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    run.__module__ = fn.__module__
    return map_stream(df, run, schema)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def give_back() -> None:
    """Return memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Sorted batches put together so that no group is cut, each with the places where groups start and the end."""
    held: list[pa.RecordBatch] = []

    def cuts(batch: pa.RecordBatch) -> list[int]:
        change = np.zeros(max(0, len(batch) - 1), bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        return [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]

    for batch in batches:
        if not len(batch):
            continue
        if held and any(held[0].column(k)[0] != batch.column(k)[-1] for k in keys):
            batch = pa.concat_batches([*held, batch])
            held = []
        elif held:
            held.append(batch)
            continue
        at = cuts(batch)
        if len(at) > 2:
            yield batch.slice(0, at[-2]), at[:-1]
        held = [batch.slice(at[-2])]
    if held:
        batch = pa.concat_batches(held)
        yield batch, [0, len(batch)]


def read_local(path: str) -> bytes:
    """A vocabulary file, read on the driver; its bytes are broadcast, as executors may not have the path."""
    with open(path, "rb") as f:
        return f.read()


_BUILT: dict = {}
_MODULE = [""]


def hold_tables_of(module: str) -> None:
    """Forget what a Python worker has built for another module than this."""
    if _MODULE[0] != module:
        _MODULE[0] = module
        _BUILT.clear()
        gc.collect()  # encoders refer to themselves


def built(key: tuple, make: Callable):
    """What a Python worker has built once from broadcast bytes."""
    if key not in _BUILT:
        if len(_BUILT) > 8:
            _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


class Memory:
    """Values by key, of bounded number: when full, the entries become the old generation and the one before goes.

    table() gives the values of a batch's different keys as a small dict, so that the large one is asked once for each.
    Keys longer than LONGEST are made each time. A subclass gives make() or make_all().
    """

    LIMIT, LONGEST = 250_000, 64

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def make(self, key):
        raise NotImplementedError

    def make_all(self, keys: list) -> dict:
        return {k: self.make(k) for k in keys}

    def table(self, keys: set) -> dict:
        missing = keys.difference(self.young)
        known = keys.difference(missing)
        out = dict(zip(known, map(self.young.__getitem__, known), strict=True))
        if missing:
            again = missing.intersection(self.old)
            found = dict(zip(again, map(self.old.__getitem__, again), strict=True))
            found |= self.make_all(list(missing.difference(again)))
            out |= found
            longest = self.LONGEST
            self.young |= found if max(map(len, found)) <= longest else {k: v for k, v in found.items() if len(k) <= longest}
            if len(self.young) > self.LIMIT:
                self.old, self.young = self.young, {}
        return out


def by_size(texts: list[str], most: int = 4 << 20) -> Iterator[list[str]]:
    """The texts in order, in lists of at most `most` characters or one text."""
    out, n = [], 0
    for text in texts:
        if out and n + len(text) > most:
            yield out
            out, n = [], 0
        out.append(text)
        n += len(text)
    if out:
        yield out
