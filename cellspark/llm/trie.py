"""A prefix trie over all conversations.

A conversation is one array of turn digests of fixed width, so the order of the concatenated digests is that of the sequences. All
arrays are sorted by range; a task goes through its part once, takes the common prefix of neighbours and sweeps a stack of
open nodes. Nodes that may go on in another part are left as fragments, which a last small step stitches together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import quoted
from .common import Scratch, small

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns that a range should hold, ids of members that are joined to one text, rows given back at once.
PART_TURNS, ENDS_CHUNK, BATCH = 2_000_000, 8192, 20_000
NOTHING = hashlib.sha256(b"").hexdigest()

#: kind: 0 a node, 1 a fragment of one, 2 ends of a fragment's node. ``node`` and ``parent`` are digests of paths, there where
#: fragments are named: of a fragment both, of a node whose parent is one ``parent``.
SWEPT = "kind int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long, first long, ends string"
FRAGMENT = "node binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_arrays(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and its ``turns``, an array of (digest, n_bytes of the text) in order of turn (null first).

    Turns of one number are ordered by role, then digest; repeated rows are turns of their own. A null role or text is empty. Rows
    with a null id belong to no conversation and are left out. Texts are not shuffled: a turn is 16 bytes and its size.
    """
    role_, text_ = (F.coalesce(F.col(quoted(c)), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary")))
    at = conversations.where(F.col(quoted(conv)).isNotNull()).select(F.col(quoted(conv)).cast("long").alias("conv_id"), F.struct(F.col(quoted(turn)).alias("turn"), role_.alias("role"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("n_bytes")).alias("x"))
    by = at.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return by.select("conv_id", F.transform("xs", lambda x: F.struct(x["digest"].alias("digest"), x["n_bytes"].alias("n_bytes"))).alias("turns"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """Conversations that share beginnings: the first h turns of conversation c - c % 5 (rounded down; all if fewer, none if there is none), then c's
    own turns after its first h, for h = crc32 of c in decimal, modulo 9. Takes and gives what :func:`turn_arrays` gives."""
    base = arrays.where("conv_id % 5 = 0").select(F.col("conv_id").alias("__base"), F.slice("turns", 1, 8).alias("__first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    at = arrays.join(base, F.col("conv_id") - F.pmod("conv_id", F.lit(5)) == F.col("__base"), "left").withColumn("__h", h)
    first = F.coalesce(F.slice("__first", F.lit(1), F.col("__h")), F.expr("slice(turns, 1, 0)"))
    own = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    return at.select("conv_id", F.concat(first, own).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """How many turns two keys begin with in common."""
    hi = min(len(a), len(b)) // WIDTH
    lo, step = 0, 1
    while lo < hi:
        at = min(lo + step, hi) * WIDTH
        if a[lo * WIDTH : at] == b[lo * WIDTH : at]:
            lo, step = at // WIDTH, step * 2
        elif step == 1:
            return lo
        else:
            hi, step = at // WIDTH - 1, 1
    return lo


class _Open:
    """A node on the stack: sums over its closed children and own ends, and children that wait for its smallest member."""

    __slots__ = ("least", "n", "children", "leaves", "saved", "size", "ends", "texts", "waiting")

    def __init__(self, size: int):
        self.least, self.n, self.children, self.leaves, self.saved, self.size = None, 0, 0, 0, 0, size
        self.ends: list[int] = []
        self.texts: list[tuple[int, str]] = []
        self.waiting: list[tuple] = []


class _Sweep:
    """One pass over sorted (key, id, sizes) rows of one part.

    Nodes on the paths of the first and the last key may lie in other parts too, and become fragments; all others are closed
    here. Rows of a closed node wait on its parent until that closes.
    """

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.key = b""
        #: Digests of the first key's path, and the depth to which the stack is still on it.
        self.names: list[bytes] = []
        self.left = 0
        self.out: list[tuple] = []

    def add(self, key: bytes, conv: int, sizes) -> None:
        depth = len(key) // WIDTH
        if not self.stack:
            self.stack = [_Open(0), *map(_Open, sizes)]
            self.left, self.names = depth, _names(key)
        elif key != self.key:
            lcp = _common(self.key, key)
            self._close(lcp)
            self.stack += map(_Open, sizes[lcp:])
        self.key = key
        self._member(self.stack[depth], conv)

    def _member(self, node: _Open, conv: int) -> None:
        # Rows of one key come together, in order of their ids.
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ends.append(conv)
        if len(node.ends) >= ENDS_CHUNK:
            self._spill(node)

    def _spill(self, node: _Open) -> None:
        """Keep the ends of a node as joined text instead of numbers."""
        node.texts.append((node.ends[0], ",".join(map(str, node.ends))))
        node.ends = []

    def _chunks(self, node: _Open) -> list[tuple[int, str]]:
        if node.ends:
            self._spill(node)
        return node.texts

    def _close(self, depth: int) -> None:
        """Close what is open deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            at = len(self.stack) - 1
            if at <= self.left:
                self._fragment(self.stack.pop(), at, self.names)
                self.left = at - 1
                continue
            node, parent = self.stack.pop(), self.stack[-1]
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            ends = hashlib.sha256()
            for i, (_, text) in enumerate(self._chunks(node)):
                ends.update(("," * bool(i) + text).encode())
            for row in node.waiting:
                self.out.append((0, None, None, *row[:2], node.least, *row[2:]))
            parent.waiting.append((node.least, at, node.n, node.children, leaves, saved, None, None, ends.hexdigest()))
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved

    def _fragment(self, node: _Open, depth: int, names: list[bytes]) -> None:
        name = names[depth]
        for row in node.waiting:
            self.out.append((0, None, name, *row[:2], None, *row[2:]))
        self.out.append((1, name, names[depth - 1] if depth else None, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.size, None, None))
        self.out += [(2, name, None, None, None, None, None, None, None, None, None, first, text) for first, text in self._chunks(node)]

    def end(self) -> None:
        names = _names(self.key)
        while self.stack:
            at = len(self.stack) - 1
            self._fragment(self.stack.pop(), at, names)


def _names(key: bytes) -> list[bytes]:
    """A digest for every prefix of a key, the empty one first."""
    out, held = [], hashlib.md5()
    out.append(held.digest())
    for i in range(0, len(key), WIDTH):
        held.update(key[i : i + WIDTH])
        out.append(held.digest())
    return out


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _swept(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep()
    for batch in batches:
        for key, conv, sizes in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            sweep.add(key, conv, sizes)
        if len(sweep.out) >= BATCH:
            yield _batches(sweep.out, schema)
            sweep.out = []
    sweep.end()
    if sweep.out:
        yield _batches(sweep.out, schema)


def _stitched(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Fragments, one row for each node, with what lies below added from the deepest up."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: -r["depth"])
    of = {r["node"]: r for r in rows}
    for r in rows:
        r["n_leaves"] = r["n_leaves"] or int(not r["n_children"])
        r["saved_tokens"] += (r["n_convs"] - 1) * r["n_bytes"]
        if (up := of.get(r["parent"])) is not None:
            up["n_convs"] += r["n_convs"]
            up["conv_id"] = min((x for x in (up["conv_id"], r["conv_id"]) if x is not None), default=None)
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    for at in range(0, len(rows), BATCH):
        yield pa.RecordBatch.from_pylist(rows[at : at + BATCH], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends, whose texts come in order; no more than one batch is held."""
    node, held, out = None, None, []
    for batch in batches:
        for name, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if name != node:
                out += [(node, held.hexdigest())] if node is not None else []
                node, held = name, hashlib.sha256()
            else:
                held.update(b",")
            held.update(text.encode())
    out += [(node, held.hexdigest())] if node is not None else []
    if out:
        yield _batches(out, schema)


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """A row for every distinct beginning of ``turns``, from the empty one (depth 0) on, over all of ``arrays`` (see :func:`turn_arrays`).

    ``conv_id``: the smallest id of its members, the conversations that begin so; ``depth``; ``parent_conv_id``: that of the
    node above (root: null); ``n_convs``: members; ``n_children``; ``n_leaves``: nodes without children in its subtree, itself
    included; ``saved_tokens``: over its subtree, members but one times the bytes of the node's last text; ``ends_sha256``: of
    the ids of members that end here, in order, a comma between. Equal conversations are members each; a conversation without turns ends at
    the root. No conversations give no rows. Ids should be unique; an id given twice counts twice.

    Arrays are sorted by key and then id, so equal conversations, however many, are dealt over ranges. Held in one task: its open path,
    nodes that wait for their parent, and in the last step the fragments, of at most two paths a range.
    """
    scratch = Scratch(arrays.sparkSession)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    keyed = scratch.write(arrays.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes")), "keys")
    turns = keyed.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    least = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(max(least, -(-turns // PART_TURNS)), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    empty = arrays.sparkSession.createDataFrame([], SWEPT)
    schema = _arrow(empty)
    swept = scratch.write(ranged.mapInArrow(lambda b: _swept(b, schema), SWEPT), "swept")
    scratch.drop(keyed)
    parts = swept.where("kind = 1").groupBy("node", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("n_bytes").alias("n_bytes")
    )
    fragment = _arrow(arrays.sparkSession.createDataFrame([], FRAGMENT))
    fragments = scratch.write(parts.select(*fragment.names).coalesce(1).mapInArrow(lambda b: _stitched(b, fragment), FRAGMENT), "fragments")
    hashed = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    pieces = swept.where("kind = 2").select("node", "first", "ends").repartition("node").sortWithinPartitions("node", "first")
    ends = pieces.mapInArrow(lambda b: _hashed(b, hashed), "node binary, ends_sha256 string")
    of = small(fragments.select(F.col("node").alias("__up"), F.col("conv_id").alias("__least")))
    spine = fragments.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    spine = spine.select("parent", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    closed = swept.where("kind = 0").select("parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    # Most closed nodes know their parent; those below a fragment ask for it.
    lone = closed.where("parent IS NULL").unionByName(spine.where("parent IS NULL"))
    below = closed.where("parent IS NOT NULL").unionByName(spine.where("parent IS NOT NULL")).join(of, F.col("parent") == F.col("__up"))
    below = below.withColumn("parent_conv_id", F.col("__least"))
    names = [c.split()[0] for c in NODE.split(", ")]
    return lone.select(*names).unionByName(below.select(*names))


def _arrow(empty: DataFrame) -> pa.Schema:
    """The Arrow schema of a table's columns."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in empty.dtypes])


def with_last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of a trie over the conversations as they are (not :func:`rebuilt`), with ``role`` and ``text`` of their last turn, taken from
    the smallest member; the root's are null. Turns are numbered as :func:`turn_arrays` orders them."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), role, digest)
    last = conversations.where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).cast("long").alias("depth"), role.alias("role"), text.alias("text"))
    return nodes.join(last, ["conv_id", "depth"], "left")
