"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.session import checkpoint_dir

#: ASCII white space; a word is a longest run of other characters.
SPACE = r"[\x20\x09-\x0D]+"
TWO_60 = float(1 << 60)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}/{name}"


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage with files that outlive any executor, and Catalyst then knows the real
    size in bytes: a small table is broadcast and a large one shuffled, without a hint."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def hash60(seed, *cols) -> Column:
    """Uniform bigint in [0, 2^60) from the md5 of seed and columns (null differs from empty)."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def unit(seed, *cols) -> Column:
    """Uniform double in [0, 1) of the row's content."""
    return hash60(seed, *cols) / F.lit(TWO_60)


def crc_fold(c: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; -1 for a null id (in no fold)."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where lambdas refer to it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit keys over all bits (the public splitmix64 constants)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hashes(items: list[bytes] | list[str]) -> np.ndarray:
    """64-bit hash of each byte string (a text counts as its UTF-8 bytes)."""
    from xxhash import xxh3_64_intdigest as h
    return np.fromiter(map(h, items), np.uint64, len(items))


def worker_memo(key, make):
    """What a Python worker keeps from task to task.  Functions are shipped by value, so module
    variables start afresh with each task; a module of its own outlives them.  A memo only saves
    work: a new worker makes it again."""
    import sys
    import types
    held = sys.modules.setdefault("lexispark_worker_memo", types.ModuleType("lexispark_worker_memo"))
    if key not in held.__dict__:
        held.__dict__[key] = make()
    return held.__dict__[key]


class Numbers(dict):
    """Numbers keys in the order they are first asked for; ``new`` lists keys not yet handled."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


def word_numbers(text, number: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, words of each text) of an Arrow array of texts, lower-cased in ASCII.
    Words are split and coded by Arrow, so Python sees each distinct word of the batch once."""
    import pyarrow.compute as pc
    words = pc.ascii_split_whitespace(pc.ascii_lower(text.fill_null("")))
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if "" in known:                     # what stands before leading and behind trailing blanks
        keep = at != known.index("")
        size = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
        at = at[keep]
    numbers = np.fromiter((number[w] if w else 0 for w in known), np.int64, len(known))
    return numbers[at], size


def text_pieces(batch, column: str, most: int):
    """Slices of an Arrow batch of about ``most`` bytes of a text column; a row at least."""
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size.astype(np.int64)) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def open_out(uri: str):
    """(file system, path) for a URI or plain path, usable from any task."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, parts) -> int:
    """Write byte strings to ``uri`` under a name of this attempt, then move it into place, so a
    repeated or speculative task leaves one whole file; its size in bytes."""
    files, path = open_out(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}", 0
    with files.open_output_stream(part, compression=None) as out:
        for x in parts:
            size += len(x)
            out.write(x)
    files.move(part, path)
    return size
