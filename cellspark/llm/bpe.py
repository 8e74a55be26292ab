"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import lists, map_text

#: Texts longer than this many characters are encoded in pieces of about this length.
PIECE_CHARS = 100_000
#: A match of the pattern never crosses from a character that is surely no white space to a space or
#: line feed, nor from a plain letter to a full stop, comma or CJK stop; and no match looks behind.
SAFE = re.compile(r"[^\s\x1c-\x1f\x85](?=[ \n])|[A-Za-z一-鿿](?=[.,、。，])")

#: White space as the library's pattern has it, in runs that its regular expression may be too deep for: one of
#: about a million characters overflows its stack.
LONG_WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")

_ENCODINGS: dict[int, object] = {}


def encoding(ranks: bytes, pattern: str):
    """The library's encoding for a rank file's content, made once in each process."""
    import tiktoken

    if (key := hash((ranks, pattern))) not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def _whole(enc):
    """The same ranks with a pattern that takes a text whole: it encodes one pre-token."""
    import tiktoken

    if (key := id(enc)) not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=enc._mergeable_ranks, special_tokens={})
    return _ENCODINGS[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text at safe places, each the first after ``size`` characters; whole if there is none."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:] if start else text


def split_at_white(text: str) -> Iterator[tuple[bool, str]]:
    """The text in order, as (whether it is one pre-token, part): long runs of white space apart.

    Within a text, the last character of a run belongs to what follows, and all before it are one
    pre-token; a run at the end is one whole. No pre-token goes from other characters into a run.
    """
    start = 0
    for m in LONG_WHITE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > start:
            yield False, text[start : m.start()]
        yield True, text[m.start() : end]
        start = end
    if start < len(text):
        yield False, text[start:]


def encode(enc, text: str) -> np.ndarray:
    """The ids of one whole text, as the library gives them for the uncut text."""
    if len(text) <= PIECE_CHARS:
        return np.array(enc.encode_ordinary(text), np.int32)
    parts = ((whole, x) for whole, part in split_at_white(text) for x in ([part] if whole else safe_pieces(part)))
    return np.concatenate([np.array((_whole(enc) if whole else enc).encode_ordinary(x), np.int32) for whole, x in parts])


def _shared(docs: DataFrame, rank_file: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast((Path(rank_file).read_bytes(), pattern))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), containsNull=True))
DECODED = T.StructField("decoded", T.BinaryType())


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids``, the tokens of every whole text, to columns ``keep`` (all).

    No special tokens are made; their strings are ordinary text. Null and empty texts have no ids. Rows
    are encoded one by one, so repeated rows and null keys make no difference; a column named ``ids`` is replaced. An
    empty table gives an empty result. ``docs`` is not shuffled.
    """
    shared = _shared(docs, rank_file, pattern)

    def make():
        enc = encoding(*shared.value)
        return lambda texts: {"ids": lists([encode(enc, x) for x in texts])}

    return map_text(docs, text, make, [IDS], keep if keep is not None else docs.columns)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As :func:`encode_texts`, with ``decoded``, the raw bytes that the ids stand for, in the same pass (a column of
    that name is replaced too)."""
    shared = _shared(docs, rank_file, pattern)

    def make():
        enc = encoding(*shared.value)

        def turn(texts: list[str]) -> dict[str, pa.Array]:
            ids = [encode(enc, x) for x in texts]
            return {"ids": lists(ids), "decoded": pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())}

        return turn

    return map_text(docs, text, make, [IDS, DECODED], keep if keep is not None else docs.columns)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the raw bytes of the token ids in column ``ids``; null or no ids give no bytes.

    The bytes need not be UTF-8: ids may end within a character. An id outside the file raises.
    """
    shared = _shared(df, rank_file, pattern)
    kept = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([df.schema[c] for c in kept] + [DECODED])

    def work(batches):
        enc = encoding(*shared.value)
        for batch in batches:
            made = pa.array([enc.decode_bytes(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, "decoded"])

    return df.select(*kept).mapInArrow(work, schema)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of the ids (decimal, one space between) and of the decoded bytes."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
