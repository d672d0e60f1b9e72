"""What the training-data operators share: shipping code, shared tables, text arrays."""

from __future__ import annotations

import re
import unicodedata
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Characters handled at once by the numpy passes; keeps their arrays within the processor's cache.
CHUNK_CHARS = 1 << 16


#: Rows and bytes of one batch between Spark and Python, where the session names none: whole texts make rows long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def ship(spark: SparkSession) -> None:
    """Ready a session for Python operators: bounded batches, and this package on the executors, whatever their own search path is."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    session.ship(spark)


@contextmanager
def set_for_now(spark: SparkSession, key: str, value: str):
    """A session setting for what runs within; the caller's own comes back after."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


class Shared:
    """Tables of one run, written to the shared folder so that a lost executor costs no lineage.

    A table's shuffle files go as soon as it is written, as nothing reads them again; the tables go by drop(), the rest when the
    session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        folder, fs = self._at(self.root)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, share: int = 1, even: bool = False, by: str | None = None) -> DataFrame:
        """Write df and read it back. by: a column of few values that the files are laid out by. share: for tables narrower than what the session's shuffle partitions are counted for, one file for
        so many partitions, as small files cost more than their rows; even: dealt out anew after work that must keep all its
        tasks."""
        self.n += 1
        if share > 1:
            n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share)
            df = df.repartition(n) if even else df.coalesce(n)
        path = f"{self.root}/{self.n:03d}"
        with set_for_now(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.partitionBy(*[by] if by else []).option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete table()s that no later plan reads."""
        for df in tables:
            self.remove(df._shared_path)

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id="doc_id"):
    """True for the fifth of the rows that no model may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


_kept: dict[str, tuple] = {}


def kept(kind: str, key, make):
    """What make() gave in this worker for the key, kept from task to task; only the kind used last is kept, so that stages that
    follow one another don't add up."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept.clear()
        _kept[kind] = key, make()
    return _kept[kind][1]


# ---------------------------------------------------------------- text as arrays


def codes(text: str) -> np.ndarray:
    """Code points of a text; a lone surrogate counts as a question mark."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def chunks(texts: list[str | None], most: int = CHUNK_CHARS):
    """Runs (first, end) of texts of about ``most`` characters together; a longer text is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one zero, with the start and the end of each text."""
    arrays = [codes(t or "") for t in texts]
    sizes = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
    out = np.zeros(int(sizes.sum()) + len(arrays), np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    for a, s, e in zip(arrays, starts, ends, strict=True):
        out[s:e] = a
    return out, starts, ends


_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 17), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 1 << 22:
            _powers[name] = got
    return got


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span c[start:end]; equal spans have equal hashes wherever they stand."""
    n = len(c) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _table("power", _POWER, n)[: len(c)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _table("inverse", _INVERSE, n)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


_classes: dict[str, np.ndarray] = {}


def char_class(name: str) -> np.ndarray:
    """A truth table over all code points: 'word' (letters, digits, marks), 'letter' or 'space'."""
    if name not in _classes:
        every = map(chr, range(0x110000))
        if name == "word":
            got = (x.isalnum() or unicodedata.category(x)[0] == "M" for x in every)
        elif name == "letter":
            got = (x.isalpha() for x in every)
        else:
            got = (x.isspace() or x == "\0" for x in every)
        _classes[name] = np.fromiter(got, bool, 0x110000)
    return _classes[name]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    steps = np.diff(padded)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


# Blocks of scripts that are written without spaces between words (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Bopomofo, Han, Yi, Tai Viet, Han beyond the basic plane).
UNSPACED = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF)]
_BOUNDS = np.array(UNSPACED, np.uint32).ravel() + np.tile(np.array([0, 1], np.uint32), len(UNSPACED))


def word_spans(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among code points: runs of letters, digits and marks; in scripts without spaces each character is a word, as
    whole clauses would be one."""
    word = char_class("word")[np.minimum(c, 0x10FFFF)]
    if not len(c) or c.max() < UNSPACED[0][0]:
        return runs(word)
    alone = np.searchsorted(_BOUNDS, c, "right") % 2 == 1
    cut = ~word
    starts, ends = word.copy(), word.copy()
    starts[1:] &= cut[:-1] | alone[1:] | alone[:-1]
    ends[:-1] &= cut[1:] | alone[1:] | alone[:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """The hashed words of each text, lower-cased and composed (NFC); see word_spans()."""
    out: list[np.ndarray] = []
    for first, end in chunks(texts):
        part = [unicodedata.normalize("NFC", t.lower()) if t else "" for t in texts[first:end]]
        c, starts, ends = joined(part)
        s, e = word_spans(c)
        h = span_hashes(c, s, e)
        cut = np.searchsorted(s, starts), np.searchsorted(s, ends)
        out += [h[a:b] for a, b in zip(*cut, strict=True)]
    return out


# ---------------------------------------------------------------- character classes of other libraries


def every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


class Strangers:
    """Characters that a library's Unicode tables know otherwise than the tables here, being older or newer."""

    #: Neither letter nor number nor space, in any version.
    STAND_IN = "\ue000"

    def __init__(self, characters: str):
        known = np.zeros(0x110000, bool)
        known[list(map(ord, characters))] = True
        spans = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(*runs(known), strict=True))
        self.table = dict.fromkeys(map(ord, characters), self.STAND_IN)
        self.far = re.compile(f"[{min(characters)}-\U0010ffff]").search if characters else None
        self.any = re.compile(f"[{spans}]").search if characters else None

    def within(self, text: str) -> bool:
        return self.far is not None and not text.isascii() and self.far(text) is not None and self.any(text) is not None
