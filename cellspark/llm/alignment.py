"""Alignment of two tokenizers over the same texts, with counts of the pairs of tokens that overlap.

A text is cut into words at whose ends both tokenizers end a token, so a word's tokens, links and groups are those of the text. Each
task keeps what it knows of short words. The pairs of a document, packed into one integer each, are counted by NumPy
within partitions; partial counts are sorted by range over all partitions and summed run by run. The sorted shards of counts are
given to the executors as files, which tasks map into memory and search.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import lists, map_text, quoted
from .common import Scratch
from .sentencepieces import CACHE_CHARS, SPACE, Model, model

#: Words that a task keeps the tokens of.
CACHE_WORDS = 120_000
#: Distinct pairs that a task counts before it gives its counts on.
PARTIAL_PAIRS = 1_000_000
#: New words that are taken through at once: the first tokenizer's encodings are large.
ENCODE_WORDS = 5000
#: Encoded rows are gone through in pieces of about so many tokens.
PIECE_TOKENS = 200_000
#: Texts are encoded in pieces of about so many bytes, as words and tokens take several times as much.
TEXT_BYTES = 1 << 20
#: White space other than a space before a space: the first tokenizer takes such runs together, so nothing is cut there.
ODD = re.compile(r"[^\S ] ")

_ALIGNERS: dict[int, Aligner] = {}


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the stretches that begin at ``start`` and have ``size`` members, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of what they have in ``n``."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


class Aligner:
    """What two tokenizers make of words: a byte-level BPE of the ``tokenizers`` library (A) and a SentencePiece model (B).

    A must split by the usual byte-level pattern, without a normaliser; B must be cut at spaces (see
    :class:`cellspark.llm.sentencepieces.Model`). Others are refused.
    """

    def __init__(self, spec: str, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        own = json.loads(spec)
        split = own.get("pre_tokenizer") or {}
        if own.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("the first tokenizer must be byte-level BPE without a normaliser or added spaces")
        self.a = Tokenizer.from_str(spec)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b: Model = model(data)
        if not self.b.cuts:
            raise ValueError("the second tokenizer's pieces go on behind spaces, so texts can't be cut")
        bytes_of, vocabulary = _byte_characters(), self.a.get_vocab()
        spelt = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelt[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        self.a_bytes = np.frombuffer(b"".join(spelt), np.uint8)
        self.a_len = np.array(list(map(len, spelt)), np.int64)
        self.a_start = np.cumsum(self.a_len) - self.a_len
        self._clear()

    @cached_property
    def texts(self) -> np.ndarray:
        """Ids as text with what may come behind."""
        return np.array([[f"{i}{c}" for i in range(max(len(self.a_len), self.b.n_pieces))] for c in (",", "|", ";", "")], object)

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        #: By word: where its tokens of A and of B begin and how many they are, and whether both spell it.
        self.facts = np.zeros((5, 0), np.int64)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def words(self, text: str) -> list[str]:
        """The words of a space and the text, each without its first space; none for a text with the second
        tokenizer's mark of a space, which it does not give back."""
        if not text or SPACE in text:
            return []
        words = self.b.words(self.b.normalised(text))
        if not ODD.search(text):
            return words
        out: list[str] = []
        for w in words:
            if out and out[-1][-1:].isspace():
                out[-1] += SPACE + w
            else:
                out.append(w)
        return out

    def _spelt(self, texts: list[str], ids: tuple[np.ndarray, ...], counts: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether the tokens' bytes are those of each text, for both tokenizers."""
        raw = [x.encode() for x in texts]
        sizes, joined, ok = np.array(list(map(len, raw)), np.int64), b"".join(raw), np.ones(len(texts), bool)
        for held, start, length, own, count in zip((self.a_bytes, self.b.piece_bytes), (self.a_start, self.b.piece_start), (self.a_len, self.b.piece_len), ids, counts, strict=True):
            data = held[_ragged(start[own], length[own])].tobytes()
            made = np.bincount(np.repeat(np.arange(len(texts)), count), weights=length[own], minlength=len(texts)).astype(np.int64)
            if data != joined or (made != sizes).any():
                ends = np.cumsum(made).tolist()
                ok &= [data[e - n : e] == x for e, n, x in zip(ends, made.tolist(), raw, strict=True)]
        return ok

    def ends(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """For A and B, whether a token ends behind each byte of texts that both spell."""
        ends = [np.cumsum(length[own]) for length, own in zip((self.a_len, self.b.piece_len), ids, strict=True)]
        out = [np.zeros(int(ends[0][-1]) + 1 if len(ids[0]) else 0, bool) for _ in ids]
        for flags, own in zip(out, ends, strict=True):
            flags[own] = True
        return out

    def links(self, ids: list[np.ndarray], ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Links as keys in the texts' order, and the byte that each ends at: between two ends of either lies one."""
        at = np.flatnonzero(ends[0] | ends[1])
        a, b = (own[np.cumsum(flags)[at] - flags[at]].astype(np.int64) for own, flags in zip(ids, ends, strict=True))
        return a << 32 | b, at

    def written(self, ids: list[np.ndarray], counts: list[np.ndarray], ends: list[np.ndarray]) -> list[str]:
        """The groups of each of some texts, whose numbers of tokens are ``counts``, as text."""
        both = ends[0] & ends[1]
        last = [both[flags] for flags in ends]  # whether a token is the last of its group
        group = [np.cumsum(x) - x for x in last]
        # A token's text and what comes behind it: a comma within a side, a bar behind A's, a semicolon between groups.
        closes = np.zeros(len(ids[1]), bool)
        closes[np.cumsum(counts[1])[counts[1] > 0] - 1] = True
        behind = [np.where(last[0], 1, 0), np.where(last[1], np.where(closes, 3, 2), 0)]
        upto = [np.concatenate([[0], np.flatnonzero(x) + 1]) for x in last]
        flat = np.empty(len(ids[0]) + len(ids[1]), object)
        flat[np.arange(len(ids[0])) + upto[1][group[0]]] = self.texts[behind[0], ids[0]]
        flat[np.arange(len(ids[1])) + upto[0][group[1] + 1]] = self.texts[behind[1], ids[1]]
        flat, cuts = flat.tolist(), np.cumsum(counts[0] + counts[1]).tolist()
        return ["".join(flat[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _made(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Facts (with where tokens begin from 0) and tokens of both for new words."""
        texts = [" " + w.replace(SPACE, " ") for w in words]
        held = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        a_count = np.array(list(map(len, held)), np.int64)
        a = np.fromiter(chain.from_iterable(held), np.int32, int(a_count.sum()))
        b, b_count = self.b.merge([SPACE + w for w in words])
        ok = self._spelt(texts, (a, b), (a_count, b_count))
        a, b = a[np.repeat(ok, a_count)], b[np.repeat(ok, b_count)]
        a_count, b_count = a_count * ok, b_count * ok
        return np.stack([np.cumsum(a_count) - a_count, a_count, np.cumsum(b_count) - b_count, b_count, ok]), [a, b]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Tokens of A and of B of whole texts; none where a tokenizer does not give the text back."""
        if len(self.code) > CACHE_WORDS:
            self._clear()
        lists = [self.words(x) for x in texts]
        new = sorted({w for x in lists for w in x if w not in self.code}, key=len)
        kept = len(self.code) + sum(len(w) <= CACHE_CHARS for w in new)
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        more = [(self.facts, self.ids)]
        for i in range(0, len(new), ENCODE_WORDS):
            facts, ids = self._made(new[i : i + ENCODE_WORDS])
            for side in (0, 1):
                facts[2 * side] += sum(len(x[side]) for _, x in more)
            more.append((facts, ids))
        self.facts, self.ids = np.concatenate([f for f, _ in more], 1), [np.concatenate([x[side] for _, x in more]) for side in (0, 1)]
        codes = [np.fromiter(map(self.code.__getitem__, x), np.int64, len(x)) for x in lists]
        codes = [c if self.facts[4, c].all() else c[:0] for c in codes]
        flat, n = np.concatenate([np.zeros(0, np.int64), *codes]), np.cumsum([0, *map(len, codes)])
        out = []
        for side, held in enumerate(self.ids):
            start, size = self.facts[2 * side, flat], self.facts[2 * side + 1, flat]
            upto = np.concatenate([[0], np.cumsum(size)])[n].tolist()
            ids = held[_ragged(start, size)]
            out.append([ids[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)])
        if kept < len(self.code):
            # Long words are not kept.
            for w in new[len(new) - (len(self.code) - kept) :]:
                del self.code[w]
            self.ids = [x[: self.facts[2 * side, kept]].copy() for side, x in enumerate(self.ids)]
            self.facts = self.facts[:, :kept].copy()
        return out[0], out[1]


def _aligner(shared) -> Aligner:
    """The aligner of two files, kept from task to task in each process."""
    if (key := hash(shared.value)) not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*shared.value)
    return _ALIGNERS[key]


def _shared(docs: DataFrame, a_file: str, b_file: str):
    return docs.sparkSession.sparkContext.broadcast((Path(a_file).read_text(), Path(b_file).read_bytes()))


ENCODED = [T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))]


def encoded(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) with the tokens ``a`` and ``b`` of every whole text; empty for texts that are null, empty or
    not given back by a tokenizer."""
    shared = _shared(docs, a_file, b_file)

    def make():
        own = _aligner(shared)

        def turn(texts: list[str]) -> dict[str, pa.Array]:
            a, b = own.encode(texts)
            return {"a": lists(a), "b": lists(b)}

        return turn

    return map_text(docs, text, make, ENCODED, keep if keep is not None else docs.columns, TEXT_BYTES)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    """Encoded rows in pieces of about ``PIECE_TOKENS`` tokens of A (or one row), with all tokens of both and how many each row has."""
    for batch in batches:
        size = pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // PIECE_TOKENS)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            own = batch.slice(i, j - i)
            sides = [own.column(c) for c in ("a", "b")]
            yield own, [c.flatten().to_numpy(zero_copy_only=False) for c in sides], [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in sides]


def _by_row(own: Aligner, ids: list[np.ndarray], counts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """How many of some ascending bytes lie in each row."""
    size = np.bincount(np.repeat(np.arange(len(counts[0])), counts[0]), weights=own.a_len[ids[0]], minlength=len(counts[0]))
    return np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(size)]), "right"), prepend=0)[1:]


def pair_counts(rows: DataFrame, scratch: Scratch, a_file: str, b_file: str) -> DataFrame:
    """``key`` (A id times 2**32, and B id) and ``n``, how many of the :func:`encoded` rows hold the pair linked, sorted by key over all
    partitions. Within a task counts are summed by NumPy, and given on when it knows many pairs."""
    shared = _shared(rows, a_file, b_file)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = _aligner(shared), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for _, ids, counts in _some(batches):
            keys, at = own.links(ids, own.ends(ids))
            cuts = np.cumsum(_by_row(own, ids, counts, at)).tolist()
            once = np.concatenate([_distinct(keys[i:j]) for i, j in zip([0, *cuts[:-1]], cuts, strict=True)])
            held.append(_totals(once, np.ones(len(once), np.int64)))
            n += len(held[-1][0])
            if n > PARTIAL_PAIRS:
                held = [_totals(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > PARTIAL_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), schema=schema)
                    held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _totals(*map(np.concatenate, zip(*held, strict=True))))), schema=schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last key of a batch may go on in the next.
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, n = _totals(*(np.concatenate([x, c.to_numpy()]) for x, c in zip((keys, n), batch.columns, strict=True)))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(n[:-1])], schema=schema)
                keys, n = keys[-1:], n[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], schema=schema)

    some = scratch.write(rows.select("a", "b").mapInArrow(partial, "key long, n long"), "partial")
    counts = scratch.write(some.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(summed, "key long, n long"), "counts")
    scratch.drop(some)
    return counts


class Counts:
    """Sorted shards of counts, mapped into memory from the executor's copies of their files."""

    def __init__(self, names: list[str]):
        self.shards = []
        for name in names:
            keys, n = (np.load(f"{p}.npy", mmap_mode="r") for p in self._mapped(name))
            if len(keys):
                self.shards.append((int(keys[0]), keys, n))
        self.shards.sort(key=lambda s: s[0])
        self.first = np.array([s[0] for s in self.shards], np.int64)

    @staticmethod
    def _mapped(name: str) -> list[str]:
        """Uncompressed arrays of a shard beside the executor's copy of it, made by the first task that needs them."""
        at = SparkFiles.get(name)
        out = [f"{at}.{c}" for c in ("key", "n")]
        if not os.path.exists(f"{out[1]}.npy"):
            table = pq.read_table(at)
            for c, path in zip(("key", "n"), out, strict=True):
                own = f"{path}-{uuid.uuid4().hex}.npy"
                np.save(own, table.column(c).to_numpy())
                os.replace(own, f"{path}.npy")
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys in order, which may repeat; 0 for those that are not there."""
        out = np.zeros(len(keys), np.int64)
        bounds = np.append(np.searchsorted(keys, self.first), len(keys))
        for (_, held, n), lo, hi in zip(self.shards, bounds[:-1], bounds[1:], strict=True):
            if hi > lo:
                at = np.minimum(np.searchsorted(held, keys[lo:hi]), len(held) - 1)
                out[lo:hi] = np.where(held[at] == keys[lo:hi], n[at], 0)
        return out


def _shipped(counts: DataFrame) -> list[str]:
    """The counts' files, given to every executor by Spark; their names."""
    sc = counts.sparkSession.sparkContext
    paths = counts.inputFiles()
    for p in paths:
        sc.addFile(p)
    return [p.rsplit("/", 1)[1] for p in paths]


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups", T.StringType())]


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add to columns ``keep`` (all) how A's tokens of a space and the text meet B's tokens of the text.

    ``n_a``, ``n_b``: tokens of each; ``n_groups``: stretches between byte offsets where both end, which ``groups`` lists as
    ``a1,a2|b1;a3|b2,b3`` (ids in order); ``n_links``: pairs of tokens whose bytes overlap; ``count_sum``: over links, how many
    documents of all hold the pair of ids linked; ``n_best``: links of which that is the highest of their A id. Special tokens' strings
    are plain text. Null and empty texts, and those whose bytes a tokenizer does not give back, have zeros and no groups. Each row is a
    document of its own, repeated ones too; columns named as new ones are replaced; an empty table gives an empty result.

    Texts are encoded once, to a table with the kept columns; its pairs are counted (see :func:`pair_counts`) and then looked up. Rows are
    never shuffled. Each executor fetches the counts' files once, 16 bytes for every distinct pair, on its disk; the highest
    counts of A ids, no more than A's vocabulary, are broadcast.
    """
    scratch, shared = Scratch(docs.sparkSession), _shared(docs, a_file, b_file)
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in {f.name for f in FIELDS}]
    own = [f"k{i}" for i in range(len(kept))]
    narrow = docs.select(*(F.col(quoted(c)).alias(n) for c, n in zip(kept, own, strict=True)), F.col(quoted(text)).alias("text"))
    rows = scratch.write(encoded(narrow, a_file, b_file, keep=own), "encoded", "zstd", 16 << 20)
    counts = pair_counts(rows, scratch, a_file, b_file)
    names = _shipped(counts)
    highest = counts.groupBy(F.shiftright("key", 32).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()
    best_of = docs.sparkSession.sparkContext.broadcast((highest.column("a").to_numpy(), highest.column("n").to_numpy()))
    schema = T.StructType(rows.schema.fields[: len(own)] + FIELDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held = _aligner(shared), Counts(names)
        best = np.zeros(len(aligner.a_len), np.int64)
        best[best_of.value[0]] = best_of.value[1]
        for batch, ids, counts in _some(batches):
            ends = aligner.ends(ids)
            keys, at = aligner.links(ids, ends)
            order, n = np.argsort(keys), np.zeros(len(keys), np.int64)
            n[order] = held.of(keys[order])
            n_links = _by_row(aligner, ids, counts, at)
            row = np.repeat(np.arange(batch.num_rows), n_links)
            sums = [np.bincount(row, weights=x, minlength=batch.num_rows).astype(np.int64) for x in (n == best[keys >> 32], n)]
            numbers = [*counts, _by_row(aligner, ids, counts, np.flatnonzero(ends[0] & ends[1])), n_links, *sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *map(pa.array, numbers), pa.array(aligner.written(ids, counts, ends), pa.string())], names=schema.names)

    out = rows.mapInArrow(work, schema)
    return out.select(*(F.col(a).alias(b) for a, b in zip(schema.names, [*kept, *(f.name for f in FIELDS)], strict=True)))


def digests(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts, and SHA-256 of the groups; without tokens an empty text."""
    return aligned.select(key, *(f.name for f in FIELDS[:-1]), F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))
