"""Token counts with a two-tier table of lengths.

Text is cut at ASCII white space, which no token of the vocabulary crosses. A run's token count is
looked up first in a broadcast table of frequent runs, then in the worker's own cache; what both miss
is encoded by the library. Only runs of the rows that the table is taken from are shuffled, to be counted.
"""

from __future__ import annotations

import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_text

#: Rows that the table of frequent runs is taken from, and its largest size. Both only set how often
#: the table hits: counts are the same with any table.
TABLE_ROWS = 2000
TABLE_ENTRIES = 50_000
#: Runs that a worker's cache holds before it starts anew, and the longest run that it keeps.
CACHE_ENTRIES = 400_000
CACHE_RUN_BYTES = 64
#: Texts are cut into runs in pieces of about this many bytes.
PIECE_BYTES = 1 << 20

_TOKENIZERS: dict[str, object] = {}
_CACHES: dict[str, RunLengths] = {}


def _tokenizer(spec: str):
    """The library's tokenizer for a JSON text, made once in each process."""
    from tokenizers import Tokenizer

    if (key := str(hash(spec))) not in _TOKENIZERS:
        tok = Tokenizer.from_str(spec)
        tok.no_padding()
        tok.no_truncation()
        _TOKENIZERS[key] = tok
    return _TOKENIZERS[key]


def _cuts(data: bytes, size: int = PIECE_BYTES):
    """Pieces of about ``size`` bytes that end before ASCII white space, or sooner nowhere."""
    start = 0
    while len(data) - start > size:
        at = min((x for x in (data.find(b" ", start + size), data.find(b"\n", start + size)) if x >= 0), default=-1)
        if at < 0:
            break
        yield data[start:at]
        start = at
    yield data[start:] if start else data


class RunLengths(dict):
    """Token counts of runs: the worker's cache, which encodes what it lacks."""

    def __init__(self, tok, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.tok, self.frequent = tok, frequent

    def __missing__(self, run: bytes) -> int:
        n = len(self.tok.encode(run.decode(), add_special_tokens=False).ids)
        if len(run) <= CACHE_RUN_BYTES:
            if len(self) >= CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[run] = n
        return n

    def count(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, piece.split())) for piece in _cuts(text.encode()))


def _worker_lengths(name: str, shared) -> RunLengths:
    """The worker's own table for a broadcast, kept from task to task."""
    if name not in _CACHES:
        spec, frequent = shared.value
        _CACHES.clear()
        _CACHES[name] = RunLengths(_tokenizer(spec), frequent)
    return _CACHES[name]


def frequent_runs(docs: DataFrame, spec: str, text: str = "text", rows: int = TABLE_ROWS, entries: int = TABLE_ENTRIES) -> dict[bytes, int]:
    """Token counts of the most frequent runs in about ``rows`` rows spread over all of ``docs``.

    The sample only warms the table. It is grouped and counted in Spark, and at most ``entries`` short
    runs reach the driver.
    """
    n = docs.count()
    if not n:
        return {}
    some = docs.select(F.col(text).alias("t")).sample(fraction=min(1.0, rows / n), seed=7)
    runs = some.select(F.explode(F.split("t", r"[\x20\x09-\x0D]+")).alias("run")).where((F.col("run") != "") & (F.octet_length("run") <= CACHE_RUN_BYTES))
    top = runs.groupBy("run").count().where("count > 1").orderBy(F.desc("count"), "run").limit(entries)
    tok = _tokenizer(spec)
    words = [r.run for r in top.select("run").toLocalIterator()]
    return {w.encode(): len(tok.encode(w, add_special_tokens=False).ids) for w in words}


def token_counts(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row's whole text.

    Tokens are those of the ``tokenizers`` JSON file without added special tokens; special strings in a
    text count as the library's default has it. Null and empty texts have 0 of both. Rows are counted
    one by one: repeated rows, null keys and further columns make no difference, an empty table gives an
    empty result. ``docs`` is read three times: for its number of rows, the sample and the counts.
    """
    spec = Path(tokenizer_file).read_text()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((spec, frequent_runs(docs, spec, text)))
    name = uuid.uuid4().hex

    def make():
        lengths = _worker_lengths(name, shared)

        def turn(texts: list[str]) -> dict[str, pa.Array]:
            return {
                "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                "n_tokens": pa.array(list(map(lengths.count, texts)), pa.int64()),
            }

        return turn

    return map_text(docs, text, make, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], [key])
