"""What the operators of this package share: scratch tables, ids, words, 64-bit hashing in numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Scratch tables of this process that have not been deleted: path -> session.
_scratch: dict[str, SparkSession] = {}
_shipped: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder for intermediate tables")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veldt-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Has Spark delete a query's shuffle files at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Queries that run in here leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _shrink(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage once its heap takes half of its limit or more: a full collection also unloads
    the classes of finished queries and gives memory back to the system, where young ones only let the heap grow."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() >= runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldt-{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(clear_scratch)
    _scratch[path] = spark
    with tidy(spark):
        df.write.parquet(path)
    _shrink(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def scratch_paths() -> set[str]:
    return set(_scratch)


def forget(*tables: DataFrame | str) -> None:
    """Delete scratch tables that nothing will read again, given as what `materialize` returned or by their paths."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "scratch_path", None)
        spark = _scratch.pop(path, None)
        if spark is not None:
            try:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # the JVM has gone, and its folder with the cluster's clean-up
                return


def clear_scratch() -> None:
    """Delete all scratch tables of this process; results that read them must have been written before."""
    forget(*list(_scratch))


#: Longs of the bitmaps below: a fixed size, whatever is filed in them. As filters they may be coarse.
FILTER_LONGS = 1 << 16


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """One row: array `bits` of FILTER_LONGS longs with a bit for each key's hash."""
    h = F.xxhash64(key)
    word = F.pmod(F.shiftrightunsigned(h, 8), F.lit(FILTER_LONGS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    found = keys.groupBy(word.alias("at")).agg(F.bit_or(one).alias("bits"))
    filled = keys.sparkSession.range(FILTER_LONGS).select(F.col("id").alias("at")).join(found, "at", "left")
    row = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits"))
    return materialize(row, "bits")


def may_hold(bits: DataFrame, key: Column) -> Column:
    """False only where the bitmap's keys lack this one."""
    h = F.xxhash64(key)
    word = F.get(bits.scalar(), F.pmod(F.shiftrightunsigned(h, 8), F.lit(FILTER_LONGS)).cast("int"))
    return F.call_function("getbit", word, h.bitwiseAND(63).cast("int")) == 1


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def unused(name: str, names: list[str]) -> str:
    """name, lengthened until no column has it."""
    while any(n.lower() == name for n in names):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once. Whole texts are long: Spark's 10,000 would take tens of MB on either side.
BATCH_ROWS = 1000

#: In a Python worker, which Spark keeps for later tasks: what an operator holds between its tasks, and how to let it go.
held: dict[str, Callable[[], None]] = {}


def _alone(owner: str) -> None:
    """Let go what other operators hold in this worker."""
    for name in [n for n in held if n != owner]:
        held.pop(name)()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next operator's task may run in this one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def one_blas_thread() -> None:
    """In a Python worker: matrix products by the calling thread alone. Executors run as many tasks as they have cores, and threads that wait spin."""
    for library in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        loaded = ctypes.CDLL(str(library))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(loaded, name):
                getattr(loaded, name)(1)
                break


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with this package shipped to the executors, which need not have it installed."""
    owner = run.__module__

    def alone(batches):
        _alone(owner)
        one_blas_thread()
        try:
            yield from run(batches)
        finally:
            give_back()

    sc = df.sparkSession.sparkContext
    if _shipped.get("context") != sc.applicationId:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="veldt-ship-")) / "veldt.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((root / "veldt").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(archive))
        _shipped["context"] = sc.applicationId
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(alone, schema)


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words of a text. bytes.lower() and bytes.split() touch ASCII only, as the word rule asks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Hashes(dict):
    """64-bit hashes of words, kept for words seen before; emptied when full, so memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the one of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
