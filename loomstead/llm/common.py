"""What the corpus operators share: the shared folder, staged tables and word arithmetic."""

from __future__ import annotations

import ctypes
import gc
import re
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomstead.sources.shared import fresh_path

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


_WATCHED: list[list[str]] = []


@contextmanager
def scratch():
    """Lists the paths that are staged inside."""
    paths: list[str] = []
    _WATCHED.append(paths)
    try:
        yield paths
    finally:
        _WATCHED.remove(paths)


def staged(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it: cuts lineage, survives lost executors. Its path is added to ``used``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    for paths in ([used] if used is not None else []) + _WATCHED:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a staged table for which a file of its own is written, and files that are written of fewer rows at most.
FILE_ROWS, FEW_FILES = 1 << 17, 8


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, of about ``rows`` narrow rows, for writing: not a file for each shuffle partition (the local store forks the JVM for each)."""
    return df.coalesce(FEW_FILES + rows // FILE_ROWS)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more; the list is emptied."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def give_back() -> None:
    """Return what this process has freed to the system; else the driver holds the peak of one stage through all later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def scanned(df: DataFrame) -> DataFrame:
    """df itself if it is read straight from files, so that each pass over it sees its rows in the same places; else a staged copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    steps = {line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()}
    return df if steps <= {"Project", "Filter", "Relation"} else staged(df, "rows")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch so that the texts of a slice hold about ``limit`` bytes (one row at least)."""
    lengths = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


_SPACES = b" \t\n\r\x0b\x0c"
_BREAK = re.compile(rb"[ \n]")


def cut_at_space(text: bytes, limit: int) -> list[bytes]:
    """A text in parts of about ``limit`` bytes, each but the first beginning with a run of white space; a longer word stays whole."""
    parts, at = [], 0
    while len(text) - at > limit:
        found = max(text.rfind(s, at + 1, at + limit) for s in (b" ", b"\n"))
        if found < 0:
            later = _BREAK.search(text, at + limit)
            if later is None:
                break
            found = later.start()
        while found > at + 1 and text[found - 1] in _SPACES:
            found -= 1
        if found <= at + 1:  # white space alone
            break
        parts.append(text[at:found])
        at = found
    return [*parts, text[at:]]


def parts_of(texts: list[bytes], limit: int = 4 << 20):
    """Texts, the long ones cut at white space, in groups of about ``limit`` bytes: (parts, the text of each)."""
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for part in cut_at_space(text, limit):
            if parts and held + len(part) > limit:
                yield parts, np.array(owners, np.int64)
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(i)
            held += len(part)
    if parts:
        yield parts, np.array(owners, np.int64)


#: Bytes of a text whose runs are hashed at once.
HASHED = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = np.uint64(_BASE if kind == "up" else _INVERSE)
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; h is changed in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of a text, joined by single spaces, with hashes of any run of words.

    ``starts[i]``/``ends[i]`` are byte offsets of word i in ``line``. Hashes are
    polynomial over the bytes of a run, the same for the same bytes anywhere.
    """

    def __init__(self, text: bytes):
        words = text.split()
        self.line = b" ".join(words)
        self.n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self._sums = None

    def run_hashes(self, k: int) -> np.ndarray:
        """Hash of words i .. i+k-1 for each i; a long text is taken HASHED bytes at a time."""
        count = max(0, self.n - k + 1)
        out = np.empty(count, np.uint64)
        a = 0
        while a < count:
            b = count if len(self.line) <= HASHED else max(a + 1, int(np.searchsorted(self.ends[k - 1 :], self.starts[a] + HASHED, side="right")))
            low = int(self.starts[a])
            sums = self._prefix_sums(low, int(self.ends[b + k - 2]))
            s, e = self.starts[a:b] - low, self.ends[a + k - 1 : b + k - 1] - low
            h = (sums[e] - sums[s]) * _powers("down", len(sums))[s]
            out[a:b] = mix(h + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
            a = b
        return out

    def _prefix_sums(self, low: int, high: int) -> np.ndarray:
        whole = len(self.line) <= HASHED
        if whole and self._sums is not None:
            return self._sums
        high = len(self.line) if whole else high
        data = np.frombuffer(self.line, np.uint8, high - low, low).astype(np.uint64) + np.uint64(1)
        data *= _powers("up", len(data))[: len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data, dtype=np.uint64)])
        if whole:
            self._sums = sums
        return sums
