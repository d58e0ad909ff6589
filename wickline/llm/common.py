"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIFT, _FIRST, _SECOND = np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only

# The words of all operators are maximal runs of other bytes than these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark wherever it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only on one machine, as in tests, one is made where the session names none;
    on a cluster a machine's own folder would be lost with it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wickline-"))
        named = context.getCheckpointDir()
    return named


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wickline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(base: str, taken: list[str]) -> str:
    """A column name that is not among those taken, in any case."""
    held = {t.lower() for t in taken}
    while base in held:
        base += "_"
    return base


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def doc_remainder(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> _SHIFT)) * _FIRST
    x = (x ^ (x >> _SHIFT)) * _SECOND
    return x ^ (x >> _SHIFT)


class Hasher:
    """64-bit hashes of words, remembered for those met before."""

    #: Words that a worker remembers at most; then it starts anew.
    REMEMBERED = 50_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes) -> list[int]:
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        known, new = self.known.get, self._new
        return [known(w) or new(w) for w in text.lower().split()]

    def _new(self, word: bytes) -> int:
        found = self.known[word] = xxhash.xxh3_64_intdigest(word) or 1
        return found


class PackedHasher(Hasher):
    """The same hashes in eight bytes each, lowest first, which arrays take as they are."""

    def _new(self, word: bytes) -> bytes:
        found = self.known[word] = (xxhash.xxh3_64_intdigest(word) or 1).to_bytes(8, "little")
        return found


def give_back() -> None:
    """Return what this worker has freed to the system: it stays on idle beside others that need the memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidied(run: Callable[[Iterator], Iterator]):
    """``run``, giving memory back at its end."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidy
