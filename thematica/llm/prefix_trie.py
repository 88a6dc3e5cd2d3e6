"""Prefix trie of conversations: a skeleton of splitter paths, finished shards around it.

A conversation's path is the sequence of its turns' 128-bit names (SHA-256 of
role and text, so texts never leave the scan).  Paths are sorted and dealt to
shards by splitters taken from a hash sample of (path, conversation).  In that order a
node's members are neighbours, and a node lies in more than one shard only if it
is a prefix of a splitter's path.  So:

* the trie of the splitters' paths, the skeleton, is broadcast.  Its size is bounded by
  ``SKELETON`` turns, whatever the table's size: splitters are cut shorter if needed,
  which moves shard limits and changes no result;
* each shard is read in order with a stack of open nodes and finishes every node outside the
  skeleton; a node's rows wait only for its parent's least member, within one
  subtree below the skeleton;
* of skeleton nodes each shard gives what it has seen, and a reduction by node, then up the
  skeleton, finishes them.  Splitters hold the conversation too, so that a path that a third
  of all conversations share is cut like any other.

The conversations that end in a node are digested in ascending order.  Outside
the skeleton that order is the shard's; of skeleton nodes the shards write the ids as runs of
text, and one reader a node hashes them as they come, never holding them.

A conversation's own turns are one sequence and one row of 24 bytes a turn; a shard
holds the nodes of one subtree below the skeleton.

Defined results: turns in ascending order, null first, then by name where they
tie; null role or text is empty; rows with a null conversation are in none and left out;
repeated rows are turns of their own; an empty table gives no nodes; texts of any length
are hashed in the scan; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, pick

FAMILY = 5
HEADS = 9
NAME = 16
#: turns in the skeleton, over all splitters
SKELETON = 1 << 18
#: turns of a sampled path that may become a splitter
SPLITTER = 1024
MOST_SHARDS = 4096
OVERSAMPLE = 8
#: ids in one run of text
RUN = 8192


def named_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, name, size): a turn's 16-byte name and its text's UTF-8 bytes."""
    x = pick(df, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id is not null")
    said = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text_ = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, text_), 256)
    return x.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(name), 1, NAME).alias("name"),
                    F.octet_length(text_).cast("long").alias("size"))


def shared_head(conv: int) -> int:
    """Turns that a conversation takes from its family's first."""
    return zlib.crc32(str(conv).encode()) % HEADS


_PATHS = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("sizes", pa.binary())])


def _rebuilt(batches):
    """(conv_id, path, sizes) from turns in order of family, the family's first, conversation, turn."""
    family = conv = None
    head: list = []  # first HEADS - 1 turns of the family's first conversation
    own: list = []
    out: list = []

    def close():
        if conv is None:
            return
        if conv == family:
            head[:] = own[:HEADS - 1]
        h = shared_head(conv)
        turns = own if conv == family else head[:h] + own[h:]
        out.append((conv, b"".join(t[0] for t in turns), np.array([t[1] for t in turns], "<i8").tobytes()))
        own.clear()

    def batch():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _PATHS, strict=True)], schema=_PATHS)

    for b in batches:
        for f, c, name, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if c != conv:
                close()
                conv = c
                if f != family:
                    family = f
                    head.clear()
            own.append((name, size))
        if len(out) >= 1024:
            yield batch()
    close()
    if out:
        yield batch()


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation c with the first ``shared_head(c)`` turns of c - c % 5."""
    x = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    x = x.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "name")
    return x.select("family", "conv_id", "name", "size").mapInArrow(_rebuilt, "conv_id long, path binary, sizes binary")


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 pairs (path, conv_id) from a sample by hash; a path that is cut has the least id."""
    rows = paths.count()
    every = max(1, rows // (OVERSAMPLE * shards))
    # of bounded size: some OVERSAMPLE * shards rows of SPLITTER turns
    sample = paths.where(F.pmod(F.xxhash64("conv_id", F.lit(11)), F.lit(every)) == 0).select(
        "conv_id", F.length("path").alias("n"), F.substring("path", 1, NAME * SPLITTER).alias("path")).collect()
    keys = sorted((bytes(r["path"]), r["conv_id"] if r["n"] <= NAME * SPLITTER else -(1 << 63)) for r in sample)
    picked = sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []
    turns = SPLITTER
    while sum(len(p) for p, _ in picked) > NAME * SKELETON and turns > 1:
        turns //= 2
        picked = sorted({(p, c) if len(p) <= NAME * turns else (p[:NAME * turns], -(1 << 63)) for p, c in picked})
    return picked


class Skeleton:
    """The trie of paths: node 0 is the root; parents come before children."""

    def __init__(self, paths: list[bytes]):
        self.kids: list[dict[bytes, int]] = [{}]
        self.parent = [-1]
        for p in paths:
            at = 0
            for i in range(0, len(p), NAME):
                name = p[i:i + NAME]
                if name not in self.kids[at]:
                    self.kids[at][name] = len(self.parent)
                    self.kids.append({})
                    self.parent.append(at)
                at = self.kids[at][name]


class _Open:
    """A node whose members are still coming."""

    __slots__ = ("skel", "size", "depth", "n", "least", "kids", "children", "leaves", "saved", "digest", "ends")

    def __init__(self, skel: int, size: int, depth: int):
        self.skel, self.size, self.depth = skel, size, depth
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None
        self.kids: list[list] = []  # rows of children, waiting for this node's least member
        self.digest = None
        self.ends: list[str] = []

    def take(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least


NODE, PART, ENDS = 0, 1, 2
_ROW = "kind int, skel long, shard int, seq long, conv_id long, depth long, parent_conv_id long, n long, children long, leaves long, saved long, size long, digest string, ends string"
_ROW_ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in _ROW.split(", ")])
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Scan:
    """Reads a shard's conversations in order and gives rows of ``_ROW``."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.rows: list[list] = []
        self.waiting: list[list] = []  # rows of the open subtree below the skeleton
        self.stack: list[_Open] = []
        self.path = b""
        self.seq = 0

    def add(self, shard: int, conv: int, path: bytes, sizes: np.ndarray) -> None:
        stack = self.stack
        if not stack:
            stack.append(_Open(0, 0, 0))
        self.shard = shard
        same, most = 0, min(len(path), len(self.path))
        if path[:most] == self.path[:most]:
            same = most // NAME
        else:
            while path[same * NAME:(same + 1) * NAME] == self.path[same * NAME:(same + 1) * NAME]:
                same += 1
        while len(stack) > same + 1:
            self.close()
        for d in range(same, len(path) // NAME):
            above = stack[-1]
            skel = self.skeleton.kids[above.skel].get(path[d * NAME:(d + 1) * NAME], -1) if above.skel >= 0 else -1
            stack.append(_Open(skel, int(sizes[d]), d + 1))
        self.path = path
        end = stack[-1]
        end.take(1, conv)
        if end.skel >= 0:
            end.ends.append(str(conv))
            if len(end.ends) >= RUN:
                self.run(end)
        elif end.digest is None:
            end.digest = hashlib.sha256(str(conv).encode())
        else:
            end.digest.update(b",%d" % conv)

    def run(self, node: _Open) -> None:
        if node.ends:
            self.seq += 1
            self.rows.append([ENDS, node.skel, self.shard, self.seq, *[None] * 9, ",".join(node.ends)])
            node.ends = []

    def close(self) -> None:
        node = self.stack.pop()
        if node.skel >= 0:
            self.run(node)
            self.rows.append([PART, node.skel, self.shard, None, node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, node.size, None, None])
            return
        above = self.stack[-1]
        saved = node.saved + (node.n - 1) * node.size
        leaves = node.leaves if node.children else 1
        row = [NODE, None, None, None, node.least, node.depth, None, node.n, node.children, leaves, saved, None,
               node.digest.hexdigest() if node.digest else _EMPTY, None]
        for kid in node.kids:
            kid[6] = node.least
        self.waiting.append(row)
        above.take(node.n, node.least)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skel >= 0:
            row[1] = above.skel
            self.rows += self.waiting
            self.waiting = []
        else:
            above.kids.append(row)

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True))
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ROW_ARROW, strict=True)], schema=_ROW_ARROW)


def _scan(batches, skeleton: Skeleton):
    scan = _Scan(skeleton)
    for b in batches:
        for shard, conv, path, sizes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            scan.add(shard, conv, path, np.frombuffer(sizes, "<i8"))
            if len(scan.rows) > 16384:
                yield scan.batch()
    while scan.stack:
        scan.close()
    if scan.rows:
        yield scan.batch()


def _dealt(paths: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    def run(batches):
        for b in batches:
            at = [bisect_right(cuts, (p, c)) for p, c in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["shard", "conv_id", "path", "sizes"])

    x = paths.mapInArrow(run, "shard int, conv_id long, path binary, sizes binary")
    return x.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("path", "conv_id")


def _digests(batches):
    """(skel, digest) of rows (skel, ends) in order of skel, shard and run."""
    skel, digest = None, None
    for b in batches:
        done = []
        for s, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if s != skel:
                if digest is not None:
                    done.append((skel, digest.hexdigest()))
                skel, digest = s, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["skel", "digest"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([skel]), pa.array([digest.hexdigest()])], ["skel", "digest"])


def _reduced(found: DataFrame, skeleton: Skeleton) -> list[list]:
    """Finished rows (skel, conv_id, depth, parent_conv_id, n, children, leaves, saved, digest) of the
    skeleton: a reduction by node in Spark, then up its at most ``SKELETON`` + 1 nodes."""
    part = found.where(f"kind = {PART}").groupBy("skel").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    ends = found.where(f"kind = {ENDS}").select("skel", "shard", "seq", "ends").repartition("skel").sortWithinPartitions("skel", "shard", "seq")
    digests = {r["skel"]: r["digest"] for r in ends.select("skel", "ends").mapInArrow(_digests, "skel long, digest string").collect()}
    at = {r["skel"]: r.asDict() for r in part.collect()}
    for i in sorted(at, reverse=True):  # children before parents
        r = at[i]
        r["leaves"] = r["leaves"] if r["children"] else 1
        r["saved"] += (r["n"] - 1) * r["size"]
        if i:
            above = at[skeleton.parent[i]]
            above["children"] += 1
            for c in ("n", "leaves", "saved"):
                above[c] += r[c]
            above["conv_id"] = min(x for x in (above["conv_id"], r["conv_id"]) if x is not None)
    return [[i, r["conv_id"], r["depth"], at[skeleton.parent[i]]["conv_id"] if i else None, r["n"], r["children"], r["leaves"],
             r["saved"], digests.get(i, _EMPTY)] for i, r in sorted(at.items())]


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path, sizes): a written table, as it is read twice."""
    spark = paths.sparkSession
    shards = min(MOST_SHARDS, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(paths, shards)
    skeleton = Skeleton([p for p, _ in cuts])
    sent = spark.sparkContext.broadcast(skeleton)
    found = materialise(_dealt(paths, cuts).mapInArrow(lambda it: _scan(it, sent.value), _ROW), "nodes")
    top = spark.createDataFrame(
        _reduced(found, skeleton),
        "skel long, conv_id long, depth long, parent_conv_id long, n long, children long, leaves long, saved long, digest string")
    of = F.broadcast(top.select(F.col("skel").alias("_skel"), F.col("conv_id").alias("_above")))  # at most SKELETON + 1 rows
    rest = found.where(f"kind = {NODE}").join(of, F.col("skel") == F.col("_skel"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    cols = ["conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "digest"]
    return rest.select(*cols).unionByName(top.select(*cols)).toDF(*COLUMNS)


def conversation_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      shards: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations; columns as in ``COLUMNS``."""
    return trie(materialise(rebuilt(named_turns(df, conv_id, turn, role, text)), "paths"), shards)
