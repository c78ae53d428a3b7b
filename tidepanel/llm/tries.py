"""Conversation prefix trie by burst tries.

Each conversation is a sequence of turn ids (128-bit hashes of role and text; no
text is shuffled). All sequences start in the container of the root. A container
of more than ``most`` turns is burst: its sequences move on by their next turn
ids, and each prefix that more than ``most`` turns still share becomes a trie
head. A sequence's rest then lies in the container of the turn below its deepest
head, or ends at that head. A burst looks ``stride`` turns ahead, twice as many
each time, so a long shared chain takes few bursts. A burst is an aggregation by
prefix, summed before the shuffle, so no head's sequences meet in one task.

The containers that are left, at most ``most`` turns each, are dealt to shards;
there each is sorted and swept once into its nodes. What a head's subtree holds
is the sum over the containers and heads below it: each of them is named by its
smallest conversation, and that conversation's own prefixes are the heads above.

Defined results: turns are ordered by their number, a missing number first, equal
numbers by the hash of role and text; repeated rows are turns of their own; null
roles and texts are empty; rows without a conv_id take no part; a conversation
without turns is a member of the root alone; an empty table has no root and gives
an empty result; extra columns are not read. A conversation's turn ids (20 bytes
a turn, not its texts) must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, on_workers

_ROOT = hashlib.md5(b"").digest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def conversation_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order, an array of (id binary, chars int)."""
    on_workers(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # the length keeps role and text apart
    turn = F.struct(F.col(turn_col).isNotNull().alias("has"), F.col(turn_col).alias("turn"), F.unhex(F.md5(whole)).alias("id"), F.length(text).alias("chars"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(turns: DataFrame, block: int = 100, shared: int = 6, **columns: str) -> DataFrame:
    """Conversations with their first h turns taken from the first of their block of ids; h is the crc32 of the id modulo ``shared``."""
    own = keep(conversation_turns(turns, **columns), "trie-turns")
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    both = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % block}).join(first, "base", "left")
    lead = F.slice(F.coalesce("lead", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(lead, rest).alias("turns"))


def _prefixes(stride: int, first: bool):
    """A row for each of a sequence's next ``stride`` prefixes (of the first burst: and for the root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, keys, parents, chars, sizes = [], [], [], [], [], []
            for c, key, base, turns in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "base", "turns")), strict=True):
                n = len(turns)
                if first:
                    conv.append(c), depth.append(0), keys.append(key), parents.append(None), chars.append(0), sizes.append(1 + n)
                for j, t in enumerate(turns[:stride]):
                    parent, key = key, hashlib.md5(key + t["id"]).digest()
                    conv.append(c), depth.append(base + j + 1), keys.append(key), parents.append(parent), chars.append(t["chars"]), sizes.append(n - j)
            columns = zip((conv, depth, keys, parents, chars, sizes), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["conv_id", "depth", "key", "parent", "chars", "size"])

    return run


_PREFIX = "conv_id long, depth long, key binary, parent binary, chars long, size long"


def burst(sequences: DataFrame, most: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The trie heads (key, parent, depth, conv_id, n_convs, chars, n_children), which heads each conversation passes, its end at a head, and the rests in containers."""
    active = sequences.select("conv_id", F.lit(bytearray(_ROOT)).alias("key"), F.lit(0).cast("long").alias("base"), F.lit(None).cast("long").alias("head_conv"), "turns")
    counts, paths, ends, rests, stride = [], [], [], [], 1
    while True:
        steps = keep(active.mapInArrow(_prefixes(stride, stride == 1), _PREFIX), "trie-prefixes")
        sums = (F.count("*").alias("n_convs"), F.min("conv_id").alias("head"), F.sum("size").alias("size"), F.max("chars").alias("chars"))
        counted = keep(steps.groupBy("key", "parent", "depth").agg(*sums), "trie-counted")
        heads = counted.where((F.col("size") > most) | (F.col("depth") == 0)).select("key", "head")
        path = keep(steps.select("conv_id", "depth", "key").join(heads, "key"), "trie-paths")
        deepest = path.groupBy("conv_id").agg(F.max(F.struct("depth", "key", "head")).alias("at"))
        now = active.join(deepest, "conv_id", "left")
        depth, key, conv = (F.coalesce(F.col(f"at.{a}"), F.col(b)) for a, b in (("depth", "base"), ("key", "key"), ("head", "head_conv")))
        skip = (depth - F.col("base")).cast("int")
        left = F.slice("turns", skip + 1, F.greatest(F.size("turns"), F.lit(1)))
        state = F.when(F.size("turns") == skip, "end").when(skip == stride, "on").otherwise("rest")
        moved = keep(now.select("conv_id", key.alias("key"), depth.alias("base"), conv.alias("head_conv"), left.alias("turns"), state.alias("state")), "trie-moved")
        counts.append(counted), paths.append(path.select("conv_id", "depth", "key"))
        ends.append(moved.where("state = 'end'").select("key", "conv_id")), rests.append(moved.where("state = 'rest'").drop("state"))
        active, stride = moved.where("state = 'on'").drop("state"), 2 * stride
        if active.isEmpty():
            break
    counted, path, end, rest = (_union(x) for x in (counts, paths, ends, rests))
    heads = counted.where((F.col("size") > most) | (F.col("depth") == 0)).withColumnRenamed("head", "conv_id").drop("size")
    children = counted.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    heads = heads.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return keep(heads, "trie-heads"), path, end, rest


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _joined(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


def sweep(rows: list[tuple[int, tuple, tuple]], base: int, above: int | None) -> list[tuple]:
    """The nodes below depth ``base`` of one container: (conv_id, turn ids, chars) a row, all with the same first id. One pass over the sorted rows, a stack of open nodes."""
    out, stack = [], []  # an open node: [members, smallest, children, leaves, saved, chars, ends]

    def close() -> None:
        n, least, children, leaves, saved, chars, ends = stack.pop()
        leaves, saved, depth = leaves + (children == 0), saved + (n - 1) * chars, base + len(stack) + 1
        out.append([least, depth, above, n, children, leaves, saved, hashlib.sha256(_joined(sorted(ends))).hexdigest()])
        for i in below.pop(depth + 1, ()):
            out[i][2] = least
        below.setdefault(depth, []).append(len(out) - 1)
        if stack:
            up = stack[-1]
            up[0], up[1], up[2], up[3], up[4] = up[0] + n, min(up[1], least), up[2] + 1, up[3] + leaves, up[4] + saved

    below: dict[int, list[int]] = {}
    last: tuple = ()
    for conv, ids, chars in sorted(rows, key=lambda r: r[1]):
        same, n = 0, min(len(ids), len(last))
        while same < n and ids[same] == last[same]:
            same += 1
        while len(stack) > same:
            close()
        for c in chars[same:]:
            stack.append([0, conv, 0, 0, 0, c, []])
        top = stack[-1]
        top[0], top[1], last = top[0] + 1, min(top[1], conv), ids
        top[6].append(conv)
    while stack:
        close()
    return list(map(tuple, out))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers one after the other; each row of a container's top says so by its parent's key in ``above``."""
    names = [*(c.split()[0] for c in _NODE.split(", ")), "top"]
    types = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    held, now, out = [], None, []

    def flush() -> None:
        (base, above), nodes = now[1:], sweep(held, now[1], now[2])
        out.extend((*n, n[1] == base + 1) for n in nodes)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)

    for batch in batches:
        for container, base, above, conv, turns in zip(*(batch.column(n).to_pylist() for n in ("container", "base", "head_conv", "conv_id", "turns")), strict=True):
            if now != (container, base, above):
                if held:
                    flush()
                held, now = [], (container, base, above)
            held.append((conv, tuple(t["id"] for t in turns), tuple(t["chars"] for t in turns)))
        if len(out) > 10_000:
            yield batch_of(out)
            out.clear()
    if held:
        flush()
    yield batch_of(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's sorted ids, fed as they come: a key's ids are never held together."""
    now, sha, out = None, None, []
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        lo = 0
        while lo < len(keys):
            hi = lo + 1
            while hi < len(keys) and keys[hi] == keys[lo]:
                hi += 1
            part = _joined(ids[lo:hi])
            if keys[lo] == now:
                sha.update(b"," + part)
            else:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = keys[lo], hashlib.sha256(part)
            lo = hi
    if sha is not None:
        out.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["key", "ends_sha256"])


def prefix_trie(sequences: DataFrame, most: int = 4096) -> DataFrame:
    """The nodes of the trie over ``sequences`` (conv_id, turns: array of (id, chars)), one row a node."""
    sequences = keep(sequences, "trie-sequences")
    heads, paths, ends, rests = burst(sequences, most)

    dealt = rests.withColumn("container", F.concat("key", F.col("turns")[0]["id"]))
    shards = dealt.repartition("container").sortWithinPartitions("container")
    nodes = keep(shards.select("container", "base", "head_conv", "conv_id", "turns").mapInArrow(_swept, f"{_NODE}, top boolean"), "trie-swept")

    # what a head's subtree adds up to
    below = nodes.where("top").select("conv_id", "depth", "n_leaves", "saved_tokens")
    own = heads.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    both = below.unionByName(own).unionByName(paths, allowMissingColumns=True)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    added = [F.sum(c).over(deeper).alias(c) for c in ("n_leaves", "saved_tokens")]
    sums = both.select("key", *added).where("key IS NOT NULL").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    told = ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "key binary, ends_sha256 string")
    parents = heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = heads.join(sums, "key").join(told, "key", "left").join(parents, "parent", "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    columns = [c.split()[0] for c in _NODE.split(", ")]
    return whole.withColumn("ends_sha256", digest).select(columns).unionByName(nodes.select(columns))
