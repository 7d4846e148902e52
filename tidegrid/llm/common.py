"""What the corpus operators share: table access, checkpoints, the held-out fold and word hashing."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package

#: The white space that separates words, as patterns and as characters; a character of a word.
SPACE_CLASS = r"[ \t\n\x0B\f\r]+"
SPACES = " \t\n\x0b\f\r"
WORD = r"[^ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, as in tests, a temporary one, if there are no other machines."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidegrid-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder.

    Shuffle files behind it are of no more use, but Spark removes them only when the driver's garbage is collected, which
    a driver with little to do puts off; so it is collected here.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    _let_go(spark)
    return out


def _let_go(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder: later reads take only the columns they need."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder, compression=compression)
    _let_go(spark)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written() tables that nothing will read any more."""
    for df in tables:
        removed(df.sparkSession, df._folder)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed() -> None:
    """Gives what numpy and Arrow have freed back to the system: Python workers live on between tasks, and would keep it."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, mod 4, is 2. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_block))


# -- words as 64-bit hashes, a batch of texts at a time ----------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLDED_CODE = _BYTE_CODE.copy()
_FOLDED_CODE[ord("A") : ord("Z") + 1] = _BYTE_CODE[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[name] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit reaches all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and each text's first word (one entry more than texts).

    A word is a run without ASCII white space; A-Z count as a-z. A null text has no words. About a MB of text is
    hashed at a time, as it takes some forty bytes of memory a byte.
    """
    parts = [_word_hashes(texts[a:b]) for a, b in by_bytes(texts)]
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(at) for _, at in parts)])
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)]), np.cumsum(sizes)


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is white space, so each word ends
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_FOLDED_CODE[data] * _power(_BASE, "up", len(data)), dtype=np.uint64)))
        hashes = mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, "down", len(data))[starts])
    after = np.cumsum([len(e) + 1 for e in encoded])
    return hashes, np.concatenate(([0], np.searchsorted(starts, after))).astype(np.int64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; entry i starts at word i. Runs across texts are the caller's to leave out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * _BASE + words[k : len(words) - n + 1 + k])
        return out


def slices(values: list, size: int):
    for k in range(0, len(values), size):
        yield k, values[k : k + size]


def by_bytes(texts: list[str | None], most: int = 1 << 20):
    """Ranges of texts of about `most` characters; one text is never divided."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t or "") > most:
            yield start, k
            start, total = k, 0
        total += len(t or "") + 1
    if start < len(texts):
        yield start, len(texts)
