"""SimHash near-duplicates: every pair of fingerprints within 3 bits, by balls that meet in the middle.

Two fingerprints that differ in at most 3 bits meet if each emits the variants
within half that distance.  Half of 3 isn't whole: a ball of radius 1 around each meets
up to distance 2, one of radius 2 around one of the two costs 2,081 variants.  The odd
bit is absorbed instead: one of ``BLOCKS`` blocks of 16 bits is left out at a time.  If
three bits differ, leaving out a block that holds one of them leaves two or
fewer; so some block's remainders are within 2, and their balls of radius 1 meet.  That
is ``BLOCKS`` * 49 = 196 variants a fingerprint, each a key of 48 bits and the block's
number; distinct fingerprints only (equal ones are one vertex), shuffled on the variant.
All that meet are verified on the full 64 bits.

A variant's members are read in order, in bounded memory.  Up to ``GROUP`` of them
are compared with the first, and the group's own links are walked only if some are
farther than that; a group of m gives at most m - 1 links.  Members of larger groups
(near copies by the hundred) are set aside and take the plain balls of all 64 bits, radius 1
around fingerprints of even parity and 2 around those of odd parity: two that
differ in 1 or 3 bits have unlike parity, so they meet, and those that differ in 2 meet
half-way.  There all members of a variant link to its least one of radius 1, which needs
no pairs whatever the group's size.  Nothing is capped: both ways are exact.

Defined results: null, empty and wordless texts have the fingerprint zero, linked
like any other; texts are read in blocks, so a very long one needs no more memory
than its bytes; each row is a vertex of its own, also if it repeats an id; a null id is
no candidate for the least of a component, which is null where all are; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise, pick, texts

SHINGLE = 3
DISTANCE = 3
BLOCKS = 4
#: members of one variant that are compared with each other; larger groups take the plain balls
GROUP = 256
SEED = 42
TEXT_BLOCK = 1 << 20
HASHES = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(text: str | None, k: int):
    """Arrays of the XXH64 of a text's k-word shingles, repeats included."""
    import xxhash

    h = xxhash.xxh64_intdigest
    b = (text or "").encode("utf-8", "surrogatepass")
    left: list[bytes] = []  # the words before this block that its first shingles begin with
    whole, at = True, 0
    while at < len(b):
        end = len(b)
        if end - at > TEXT_BLOCK:
            space = _SPACE.search(b, at + TEXT_BLOCK)
            end = space.start() if space else end
        words = left + b[at:end].lower().split()
        at = end
        if len(words) >= k:
            whole = False
            n = len(words) - k + 1
            yield np.fromiter((h(s, SEED) for s in map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False))), np.uint64, n)
            left = words[n:]
        else:
            left = words
    if whole and left:
        yield np.array([h(b" ".join(left), SEED)], np.uint64)


def _bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run (beginning at ``starts``) have each of the 64 bits set.

    Eight bits are counted at once, each in a byte of its own, over at most 255 hashes."""
    ends = np.append(starts[1:], len(h))
    pieces = -(-(ends - starts) // 255)
    first = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    runs = np.cumsum(pieces) - pieces
    out = np.empty((len(starts), 64), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, first)
        of_bytes = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, j::8] = np.add.reduceat(of_bytes, runs, axis=0)
    return out


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; a bit is 1 if more than half the shingles' hashes have it."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = np.zeros(b.num_rows, np.uint64)
            runs: list[np.ndarray] = []
            rows: list[int] = []

            def count():
                if runs:
                    sizes = np.array([len(x) for x in runs])
                    counts = _bit_counts(np.concatenate(runs), np.cumsum(sizes) - sizes)
                    of, at = np.unique(np.array(rows), return_index=True)  # a long text has several runs
                    set_bits, total = np.add.reduceat(counts, at, axis=0), np.add.reduceat(sizes, at)
                    partial.append((of, set_bits, total))
                    runs.clear()
                    rows.clear()

            partial: list[tuple] = []
            held = 0
            for i, t in enumerate(texts(b, "_text")):
                for x in _shingle_hashes(t, k):
                    runs.append(x)
                    rows.append(i)
                    held += len(x)
                    if held > HASHES:
                        count()
                        held = 0
            count()
            if partial:
                of, bits, total = (np.concatenate(x) for x in zip(*partial, strict=True))
                of, at = np.unique(of, return_index=True)
                bits, total = np.add.reduceat(bits, at, axis=0), np.add.reduceat(total, at)
                fp[of] = ((2 * bits > total[:, None]) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], schema=schema)

    return pick(df, doc_id=doc_id, _text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_variants() -> list[tuple[int, list[int]]]:
    """Of each block left out: the bits that stay, and what the variants differ by (the block's
    number takes its bits' place)."""
    width = 64 // BLOCKS
    out = []
    for i in range(BLOCKS):
        gone = ((1 << width) - 1) << (width * i)
        keep = ((1 << 64) - 1) ^ gone
        flips = [0] + [1 << p for p in range(64) if keep >> p & 1]
        out.append((_signed(keep), [_signed(f | i << (width * i)) for f in flips]))
    return out


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")"


def _by_block(fps: DataFrame) -> DataFrame:
    """(key, fp): the variants of each fingerprint, one block left out."""
    parts = [f"transform({_longs(flips)}, x -> (fp & {keep}L) ^ x)" for keep, flips in _block_variants()]
    return fps.select(F.explode(F.expr(f"flatten(array({', '.join(parts)}))")).alias("key"), "fp")


def _by_ball(fps: DataFrame) -> DataFrame:
    """(key, near, fp): the variants within 1 bit, near, and of odd fingerprints within 2."""
    one = [_signed(1 << p) for p in range(64)]
    two = [_signed(1 << p | 1 << q) for p in range(64) for q in range(p)]
    near = F.expr(f"transform({_longs([0] + one)}, x -> struct(fp ^ x as key, 0 as near))")
    far = F.expr(f"transform(if(bit_count(fp) % 2 = 1, {_longs(two)}, array()), x -> struct(fp ^ x as key, 1 as near))")
    return fps.select(F.inline(F.concat(near, far)), "fp").select("key", "near", "fp")


_OUT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("aside", pa.bool_())])


def _out(u, v, aside: bool) -> pa.RecordBatch:
    u, v = np.asarray(u, np.uint64).view(np.int64), np.asarray(v, np.uint64).view(np.int64)
    return pa.record_batch([pa.array(u), pa.array(v), pa.array(np.full(len(u), aside))], schema=_OUT)


def _walk(m: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what is within ``DISTANCE`` in a group."""
    near = np.bitwise_count(m[:, None] ^ m[None, :]) <= DISTANCE
    unseen = np.ones(len(m), bool)
    links = []
    for i in range(len(m)):
        if unseen[i]:
            unseen[i] = False
            queue = [i]
            while queue:
                x = queue.pop()
                new = np.flatnonzero(near[x] & unseen)
                unseen[new] = False
                links += [(x, y) for y in new.tolist()]
                queue += new.tolist()
    return links


def _meet(batches, most: int):
    """Verified links of rows (key, fp) in order of both; members of groups over ``most`` set aside."""
    key_left, fp_left = np.empty(0, np.int64), np.empty(0, np.uint64)
    large = None  # the key of a group that was found to be too large
    for b in _and_end(batches):
        last = b is None
        if last:
            key, fp = key_left, fp_left
        else:
            key = np.concatenate([key_left, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp_left, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        if large is not None:  # the rest of such a group
            n = np.searchsorted(key, large, "right")
            yield _out(fp[:n], fp[:n], True)
            key, fp = key[n:], fp[n:]
            if not len(key):
                key_left, fp_left = key, fp
                continue
            large = None
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        if not last:  # the last group may go on
            if sizes[-1] > most:
                large = key[-1]
            else:
                key_left, fp_left = key[starts[-1]:], fp[starts[-1]:]
                starts, sizes = starts[:-1], sizes[:-1]
        if large is not None:
            key_left, fp_left = key[:0], fp[:0]
        for s, n in zip(starts[sizes > most].tolist(), sizes[sizes > most].tolist(), strict=True):
            yield _out(fp[s:s + n], fp[s:s + n], True)
        some = (sizes > 1) & (sizes <= most)
        starts, sizes = starts[some], sizes[some]
        if not len(starts):
            continue
        at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        head, member = np.repeat(fp[starts], sizes), fp[at]
        off = np.bitwise_count(head ^ member) > DISTANCE
        yield _out(head[~off & (head != member)], member[~off & (head != member)], False)
        stray = np.logical_or.reduceat(off, np.cumsum(sizes) - sizes) & (sizes > 2)
        u, v = [], []
        for s, n in zip(starts[stray].tolist(), sizes[stray].tolist(), strict=True):
            m = fp[s:s + n]
            for x, y in _walk(m):
                u.append(m[x])
                v.append(m[y])
        if u:
            yield _out(u, v, False)


def _and_end(batches):
    yield from batches
    yield None


def _stars(batches):
    """Links of rows (key, near, fp) in that order: each of a key's rows to its first, if that is near."""
    key, hub = None, None
    for b in batches:
        keys, far = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        fp = b.column(2).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        first = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(first)
        hubs = fp[starts]
        ok = far[starts] == 0
        lead = starts[0] if len(starts) else len(keys)
        of = np.cumsum(first) - 1
        hub_of = np.where(of >= 0, hubs[np.maximum(of, 0)] if len(starts) else 0, 0)
        ok_of = np.where(of >= 0, ok[np.maximum(of, 0)] if len(starts) else False, False)
        if lead:  # goes on from the batch before
            hub_of[:lead], ok_of[:lead] = (hub, True) if hub is not None else (0, False)
        take = ok_of & (hub_of != fp)
        yield _out(hub_of[take].astype(np.int64).view(np.uint64), fp[take].view(np.uint64), False)
        key = keys[-1]
        hub = hub_of[-1] if ok_of[-1] else None


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(u, v): links that hold together all that are within ``DISTANCE`` among ``fps`` (fp, distinct)."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(n, "fp")  # a few MB of fingerprints, else a task or two, make some 200 rows each
    by_block = _by_block(fps).repartition("key").sortWithinPartitions("key", "fp")
    met = materialise(by_block.mapInArrow(lambda it: _meet(it, group), "u long, v long, aside boolean"), "met")
    large = materialise(met.where("aside").select(F.col("u").alias("fp")).distinct(), "large")
    by_ball = _by_ball(large.repartition(n, "fp")).repartition("key").sortWithinPartitions("key", "near", "fp")
    stars = by_ball.mapInArrow(_stars, "u long, v long, aside boolean")
    both = met.where("not aside").select("u", "v").union(stars.select("u", "v"))
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    docs = materialise(fingerprints(df, doc_id, text, k), "fingerprints")
    classes = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    comp = connected_components(materialise(links(classes.select("fp")), "links"))
    rooted = classes.join(comp, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    of_root = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(of_root, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return docs.join(of_fp, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
