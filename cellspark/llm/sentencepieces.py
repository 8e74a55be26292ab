"""SentencePiece BPE encoding and decoding by rounds of merges over flat arrays.

A normalised text is cut into words where no piece of the model could cross. All words that a task does not know yet are
merged together: symbols of all of them lie in one array, a round finds each word's best pair and merges its leftmost
occurrences at once, and words without a pair left drop out. The task keeps the ids of short words.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import lists, map_text, quoted

#: The library's mark of a space.
SPACE = "▁"
#: Words of more symbols, or with more marks in a row, are merged one pair at a time from a queue: rounds over
#: arrays would be as many as their pieces.
LONG_WORD, LONG_MARKS = 4096, 64
#: Words that a task keeps the ids of, and the longest that it keeps.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = np.iinfo(np.int32).max

_MODELS: dict[int, Model] = {}
_ENCODERS: dict[int, Encoder] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """The pieces of a BPE model with byte fallback, and what merges need of them as arrays.

    A model of another kind, or with pieces that are unused or defined by hand, is refused.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        rows, kind, own = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                rows.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value))
            elif number == 3:
                own = dict(_fields(value))
        types = np.array([t for _, _, t in rows])
        if kind.get(3) != 2 or not kind.get(35) or not np.isin(types, (NORMAL, UNKNOWN, CONTROL, BYTE)).all():
            raise ValueError("only BPE models with byte fallback and without unused or user-defined pieces are read")
        #: Whether normalising is more than a mark before the text and one for each space.
        self.plain = not own.get(2) and own.get(3, 1) == 1 and own.get(4, 1) == 0 and own.get(5, 1) == 1 and not kind.get(24, 0)
        ids = {piece: i for i, (piece, _, t) in enumerate(rows) if t == NORMAL}
        self.n_pieces = len(rows)
        more = sorted({c for p in ids for c in p} - ids.keys())
        self.symbols = ids | {c: self.n_pieces + i for i, c in enumerate(more)}
        self.chars = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.chars[ord(c)] = i
        #: Byte pieces by byte.
        self.bytes = np.zeros(256, np.int32)
        for i, (piece, _, t) in enumerate(rows):
            if t == BYTE:
                self.bytes[int(piece[1:-1], 16)] = i
        order = {s: r for r, s in enumerate(sorted({s for _, s, t in rows if t == NORMAL}, reverse=True))}
        count = np.zeros(len(order), np.int64)
        pairs: dict[int, tuple[int, int]] = {}
        self.n_symbols = len(self.symbols) + self.n_pieces
        for piece, i in ids.items():
            rank = order[rows[i][1]]
            count[rank] += 1
            for at in range(1, len(piece)):
                if (left := self.symbols.get(piece[:at])) is not None and (right := self.symbols.get(piece[at:])) is not None:
                    pairs[left * self.n_symbols + right] = rank, i
        #: Ranks that several pieces share: of such pairs the leftmost alone is merged in a round.
        self.tied = count > 1
        self.pairs = pairs
        # Pairs in a table of slots by hash, a pair in the first free one from its own on.
        self.bits = max(8, len(pairs).bit_length() + 2)
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks, self.merged, self.probes = np.zeros(len(self.keys), np.int32), np.zeros(len(self.keys), np.int32), 1
        own = self._slots(np.array(list(pairs), np.int64)).tolist()
        for (key, (rank, i)), slot in zip(pairs.items(), own, strict=True):
            at = slot
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, i
            self.probes = max(self.probes, at - slot + 1)
        #: No piece has a mark behind another character, so texts may be cut before marks.
        self.cuts = self.plain and not any(SPACE in p.lstrip(SPACE) for p in ids)
        #: Neighbours within pieces: between all others no merge can be made.
        letters = sorted({c for p in ids for c in p})
        self.letters = np.zeros(0x110000, np.int32)
        self.letters[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        self.near = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in ids:
            at = self.letters[np.frombuffer(p.encode("utf-32-le"), np.uint32)]
            self.near[at[:-1], at[1:]] = True
        held = [b"" if t == CONTROL else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in rows]
        self.piece_bytes = np.frombuffer(b"".join(held), np.uint8)
        self.piece_len = np.array([len(x) for x in held], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.whole = np.array([t in (NORMAL, BYTE) for _, _, t in rows])
        self.marked = np.array([t == NORMAL and p.startswith(SPACE) for p, _, t in rows])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pairs, and their slots."""
        at = self._slots(keys)
        which, slots, left = [], [], np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys[left]
            which.append(left[hit])
            slots.append(at[hit])
            more = ~hit & (held >= 0)
            left, at = left[more], at[more] + 1
            if not len(left):
                break
        return np.concatenate(which), np.concatenate(slots)

    def normalised(self, text: str) -> str:
        """What pieces are made from; without characters for a text without any."""
        if not self.plain:
            return self.library.normalize(text)
        return SPACE + text.replace(" ", SPACE) if text else ""

    def words(self, text: str) -> list[str]:
        """The normalised text's words, each without its first mark where texts are cut at marks."""
        if not text or not self.cuts:
            return [text] if text else []
        parts = text[1:].split(SPACE)
        if SPACE * 2 not in text:
            return parts
        out, marks = [], 0
        for part in parts:
            if part:
                out.append(SPACE * marks + part)
                marks = 0
            else:
                marks += 1
        return out + ([SPACE * (marks - 1)] if marks else [])

    def _queued(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Symbols after all merges, one pair at a time by rank and place, and where each begins."""
        n, size = len(symbols), self.n_symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int]] = []

        def add(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and min(symbols[left], symbols[right]) >= 0 and (found := self.pairs.get(symbols[left] * size + symbols[right])):
                heapq.heappush(queue, (found[0], left, symbols[left], symbols[right]))

        for i in range(n - 1):
            add(i, i + 1)
        while queue:
            _, left, a, b = heapq.heappop(queue)
            right = after[left]
            if symbols[left] != a or right < 0 or symbols[right] != b:
                continue
            symbols[left], symbols[right] = self.pairs[a * size + b][1], -2
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            add(before[left], left)
            add(left, after[left])
        at = [i for i, s in enumerate(symbols) if s != -2]
        return [symbols[i] for i in at], at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        lengths = np.array(list(map(len, words)), np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, place = self.chars[points].astype(np.int64), np.arange(len(points))
        if not len(points):
            return np.array([], np.int32), np.zeros(len(words), np.int64)
        # A part of a word: its symbols merge with no other's.
        of = np.repeat(np.arange(len(words)), lengths)
        letters = self.letters[points]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | ~self.near[letters[:-1], letters[1:]]]))
        lengths = np.diff(np.append(first, len(points)))
        of, word = of[first], np.repeat(np.arange(len(first)), lengths)
        marks = np.add.reduceat((points == ord(SPACE)).astype(np.int64), first)
        queued = set(np.flatnonzero((lengths > LONG_WORD) | (marks > LONG_MARKS)).tolist())
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queued:
            left = ~np.isin(word, np.fromiter(queued, np.int64))
            symbols, place, word = symbols[left], place[left], word[left]
        last_rank, last_count = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(starts, len(word)))
            rank, into = np.full(len(symbols), NEVER, np.int64), np.zeros(len(symbols), np.int64)
            known = np.flatnonzero((word[1:] == word[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0))
            right, found = self._found(symbols[known] * self.n_symbols + symbols[known + 1])
            rank[known[right]], into[known[right]] = self.ranks[found], self.merged[found]
            low, own = np.minimum.reduceat(rank, starts), word[starts]
            # A better pair came up between merges that were made at once: such a word goes to the queue.
            early = (last_count[own] > 1) & (low < last_rank[own])
            queued.update(own[early].tolist())
            over = early | (low == NEVER)
            if over.any():
                ended = np.repeat(over & ~early, counts)
                done.append((word[ended], symbols[ended], place[ended]))
                left = ~np.repeat(over, counts)
                symbols, place, word, rank, into = symbols[left], place[left], word[left], rank[left], into[left]
                counts, low, own = counts[~over], low[~over], own[~over]
                starts = np.cumsum(counts) - counts
                if not len(symbols):
                    break
            index = np.arange(len(symbols))
            hit = rank == np.repeat(low, counts)
            begins = hit & ~np.concatenate([[False], hit[:-1]])
            take = hit & ((index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0)
            tied = self.tied[low]
            if tied.any():
                take &= ~np.repeat(tied, counts)
                take[np.minimum.reduceat(np.where(hit, index, len(index)), starts)[tied]] = True
            last_rank[own], last_count[own] = low, np.add.reduceat(take.astype(np.int64), starts)
            symbols = np.where(take, into, symbols)
            kept = ~np.concatenate([[False], take[:-1]])
            symbols, place, word = symbols[kept], place[kept], word[kept]
        for i in queued:
            at = slice(first[i], first[i] + lengths[i])
            made, where = self._queued(self.chars[points[at]].tolist())
            done.append((np.full(len(made), i), np.array(made, np.int64), np.array(where, np.int64) + first[i]))
        word, symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbols, place = word[order], symbols[order], place[order]
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n_pieces))
        if len(odd):
            spelt = [self.bytes[np.frombuffer(chr(p).encode("utf-8", "surrogatepass"), np.uint8)] for p in points[place[odd]].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(x) for x in spelt]
            isodd = np.zeros(len(symbols), bool)
            isodd[odd] = True
            word, isodd, symbols = np.repeat(word, times), np.repeat(isodd, times), np.repeat(symbols, times)
            symbols[isodd] = np.concatenate(spelt)
        return symbols.astype(np.int32), np.bincount(of[word], minlength=len(words))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts that lists of ids stand for, as the library decodes them. Bytes that are no UTF-8, and unknown and control ids, are
        left to the library."""
        flat = np.concatenate(ids) if ids else np.array([], np.int32)
        if len(flat) and (flat.min() < 0 or flat.max() >= self.n_pieces):
            raise ValueError("an id is not in the model")
        lengths = np.array([len(x) for x in ids], np.int64)
        size = self.piece_len[flat]
        ends = np.cumsum(size)
        at = np.repeat(self.piece_start[flat] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.piece_bytes[at].tobytes()
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        out = []
        for i, x in enumerate(ids):
            if not len(x):
                out.append("")
                continue
            try:
                text = data[upto[i] + bool(self.marked[x[0]]) : upto[i + 1]].decode()
            except UnicodeDecodeError:
                text = None
            plain = text is not None and self.plain and bool(self.whole[x].all())
            out.append(text if plain else self.library.decode(x.tolist()))
        return out


def model(data: bytes) -> Model:
    """The model of a file's content, made once in each process."""
    if (key := hash(data)) not in _MODELS:
        _MODELS[key] = Model(data)
    return _MODELS[key]


class Encoder:
    """Ids of texts: those of short words are kept, all others of a list of texts are merged together."""

    def __init__(self, model_: Model):
        self.model = model_
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (as :meth:`Model.words` gives them) one after the other, and how many each has."""
        if len(self.code) > CACHE_WORDS:
            self._clear()
        new = sorted({w for w in words if w not in self.code}, key=len)
        kept, base, ids = sum(len(w) <= CACHE_CHARS for w in new), len(self.code), len(self.flat)
        if new:
            flat, size = self.model.merge([SPACE + w for w in new] if self.model.cuts else new)
            self.start = np.concatenate([self.start, ids + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            self.code.update((w, base + i) for i, w in enumerate(new))
        at = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        counts = self.size[at]
        ends = np.cumsum(counts)
        out = self.flat[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        if kept < len(new):
            self.flat = self.flat[: self.start[base + kept]].copy()
            self.start, self.size = self.start[: base + kept], self.size[: base + kept]
            for w in new[kept:]:
                del self.code[w]
        return out, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, as the library's encode gives them."""
        words = [self.model.words(self.model.normalised(x)) for x in texts]
        ids, counts = self.word_ids([w for x in words for w in x])
        upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, words)])]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def encoder(data: bytes) -> Encoder:
    """The encoder of a file's content, kept from task to task in each process."""
    if (key := hash(data)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(model(data))
    return _ENCODERS[key]


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), containsNull=True))
DECODED = T.StructField("decoded", T.StringType())


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """Add ``ids``, the pieces of every whole text, to columns ``keep`` (all), and ``decoded``, their text, if asked for.

    Ids are those of the library's ``encode``: without ids of begin or end, without sampling; control pieces' names in a text are
    ordinary text. Null and empty texts have no ids and decode to an empty text. Rows are encoded one by one, so repeated rows, null keys
    and texts of any length make no difference; columns named as the new ones are replaced. An empty table gives an empty
    result. ``docs`` is not shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())

    def make():
        own = encoder(shared.value)

        def turn(texts: list[str]) -> dict[str, pa.Array]:
            ids = own.encode(texts)
            out = {"ids": lists(ids)}
            return out | {"decoded": pa.array(own.model.decode(ids), pa.string())} if decode else out

        return turn

    return map_text(docs, text, make, [IDS, DECODED] if decode else [IDS], keep if keep is not None else docs.columns)


def decode_ids(df: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids in a column, as the library's ``decode`` gives it; null or no ids give an empty text. Bytes that
    are no UTF-8 become U+FFFD, control ids nothing; an id outside the model raises. A column named ``decoded`` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())
    kept = [c for c in df.columns if c != "decoded"]
    names = [f"c{i}" for i in range(len(kept))]
    narrow = df.select(*(F.col(quoted(c)).alias(n) for c, n in zip(kept, names, strict=True)), F.col(quoted(ids)).cast("array<int>").alias("ids"))
    schema = T.StructType([*narrow.schema.fields[:-1], DECODED])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(shared.value)
        for batch in batches:
            made = own.decode([np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=schema.names)

    out = narrow.mapInArrow(work, schema)
    return out.select(*(F.col(a).alias(b) for a, b in zip(schema.names, [*kept, "decoded"], strict=True)))


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids, SHA-256 of the ids (decimal, a comma between) and of the decoded text in UTF-8."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
