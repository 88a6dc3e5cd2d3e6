"""Exact repeated substrings: bytes covered by a string of ``LENGTH`` bytes that
also starts earlier are removed.

The suffixes are sampled by content, as a difference cover does by position:
of the ``GRAM``-byte strings within each window of LENGTH bytes the one with the
least hash is the window's sample.  Equal windows have their sample at the same
place, so two suffixes that agree on LENGTH bytes both reach a sampled suffix
after the same number of bytes.  About one position in forty is sampled, against
two in three for the cover modulo 3, and no other position is ever shuffled.

1. Sampled suffixes are named by the triple (what precedes, gram, what follows):
   ``gram`` is the sampled string's name, ``context`` that of the whole stretch of
   text whose windows it samples.  They are sorted by (gram, context, place).
2. Neighbours are compared.  A gram that occurs once can't be in a repeated
   window.  All but the first of equal contexts repeat it wholly.
3. The remaining suffixes, those between samples, matter only where one gram has
   several contexts.  The first of each context is taken up again with its text,
   sorted by (gram, place), and each of its windows is merged with the equal ones
   of the same gram and distance: all but the first repeat it.
4. The covered intervals are brought together by document and cut out.

Names are 64-bit hashes, and two things are equal only if two of them agree (gram
and context, or gram and window), so no order of all suffixes is needed.
Whole copies of a text are found first, by SHA-256 and length, and skip steps 1
to 3: all their bytes are removed, or none if they are shorter than LENGTH.

Defined results: null and empty texts have no bytes; rows without an id match
nothing and lose nothing; rows that repeat an id must hold the same text, and get
the same result; text that repeats itself is removed from its second start on;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLOTS, materialise, mix64, pick, seeds

LENGTH = 100
GRAM = 24
CHUNK = 1 << 19  # window starts handled at once
SAMPLES_HELD = 1_000_000  # samples that a task combines at once
_PLACE = np.uint64((1 << 20) - 1)


class _Hashes:
    """Tables for rolling hashes modulo 2^64."""

    def __init__(self, size: int):
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = 0xD1342543DE82EF95
        self.up = _powers(base, size)
        self.down = _powers(pow(base, -1, 1 << 64), size)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(x * self.up[:len(x)], dtype=np.uint64)]

    def of(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [a, b)."""
        return mix64((prefix[b] - prefix[a]) * self.down[a])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:  # out[done:2*done] = out[:done] * base^done
        m = min(done, n - done)
        out[done:done + m] = out[:m] * np.uint64(step)
        done, step = done + m, step * step % (1 << 64)
    return out


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each stretch of ``gram`` bytes, put together from halves."""
    mult = seeds(64, 21)
    have, width, out, covered, shift = x, 1, None, 0, 0
    rest = gram
    while rest:
        if rest & 1:
            n = len(x) - gram + 1
            part = have[covered:covered + n]
            out = part.copy() if out is None else out * mult[40 + shift] + part
            covered += width
        rest >>= 1
        if rest:
            have = have[:-width] * mult[shift] + have[width:]
            width *= 2
            shift += 1
    return mix64(out)


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    width, have = 1, v
    while 2 * width <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    return have if width == w else np.minimum(have[:len(v) - w + 1], have[w - width:len(v) - width + 1])


def samples(b: np.ndarray, tables: _Hashes, length: int = LENGTH, gram: int = GRAM):
    """(gram, context, sample, first window, last window) arrays of one text."""
    out = []
    for at in range(0, max(0, len(b) - length + 1), CHUNK):
        part = b[at:at + CHUNK + length - 1]
        x = tables.byte[part]
        h = _gram_hashes(x, gram)
        v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        own = (_window_min(v, length - gram + 1) & _PLACE).astype(np.int64)
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        lo = np.r_[0, cut]
        hi = np.r_[cut, len(own)] - 1
        p = own[lo]
        c = tables.of(tables.prefix(x), lo, hi + length)
        c = mix64(c + ((p - lo) * 128 + (hi - lo)).astype(np.uint64))
        out.append((h[p], c, p + at, lo + at, hi + at))
    if not out:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    return [np.concatenate(z) for z in zip(*out)]


def _buffer(col, i) -> np.ndarray:
    v = col[i]
    return np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)


# place, and where the windows of a sample start, in one number
def _pack(p, lo, hi):
    return (p << 16) | ((p - lo) << 8) | (p - hi)


def _unpack(z):
    p = z >> 16
    return p, p - ((z >> 8) & 255), p - (z & 255)


def sample_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, context, doc, at, again) of all sampled suffixes of ``docs`` (doc, bytes).

    A stretch that a task meets many times, such as a line that a third of all
    documents share, is combined before the exchange: ``again`` marks all but
    the first of equal (gram, context) among the samples a task holds at once.
    That they are repeats is certain, so they needn't meet the others."""
    schema = pa.schema([(n, pa.int64()) for n in ("gram", "context", "doc", "at")] + [("again", pa.bool_())])

    def combined(rows):
        g, c, d, z = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((z, d, c, g))
        g, c, d, z = g[order], c[order], d[order], z[order]
        again = np.zeros(len(g), bool)
        again[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & ((d[1:] != d[:-1]) | (z[1:] != z[:-1]))
        return pa.record_batch([pa.array(x) for x in (g, c, d, z, again)], schema=schema)

    def run(batches):
        tables = _Hashes(CHUNK + 2 * length)
        rows, size = [], 0
        for b in batches:
            for i, doc in enumerate(b.column(0).to_pylist()):
                g, c, p, lo, hi = samples(_buffer(b.column(1), i), tables, length, gram)
                rows.append((g.view(np.int64), c.view(np.int64), np.full(len(g), doc, np.int64), _pack(p, lo, hi)))
                size += len(g)
                if size > SAMPLES_HELD:
                    yield combined(rows)
                    rows, size = [], 0
        if rows:
            yield combined(rows)

    return docs.select("doc", "bytes").mapInArrow(run, "gram long, context long, doc long, at long, again boolean")


def compare_neighbours(rows: DataFrame, length: int) -> DataFrame:
    """Step 2: (doc, start, end, at, gram); ``at`` is set on rows to take up again,
    start and end on those that are repeated wholly."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("at", pa.int64()), ("gram", pa.int64())])

    def run(batches):
        held: list = []  # rows of the gram that the batches so far end with: its first row, and whether it has been given out
        for b in batches:
            g, c, d, z, again = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if again.any():  # they come last
                _, lo, hi = _unpack(z[again])
                yield pa.record_batch([pa.array(x) for x in (d[again], lo, hi + length, np.full(again.sum(), -1), g[again])], schema=schema)
                g, c, d, z = g[~again], c[~again], d[~again], z[~again]
            n = len(g)
            if not n:
                continue
            new_gram = np.r_[True, g[1:] != g[:-1]]
            new_context = new_gram | np.r_[True, c[1:] != c[:-1]]
            if held and held[0][0] == g[0]:
                new_gram[0] = False
                new_context[0] = held[0][1] != c[0]
            first = np.maximum.accumulate(np.where(new_context, np.arange(n), -1))  # row of the context's first, -1: in an earlier batch
            same_row = np.zeros(n, bool)
            later = ~new_context
            fd = np.where(first >= 0, d[first], held[0][4] if held else 0)
            fz = np.where(first >= 0, z[first], held[0][5] if held else 0)
            same_row[later] = (fd[later] == d[later]) & (fz[later] == z[later])  # the same place again
            out_d, out_s, out_e, out_z, out_g = [], [], [], [], []
            rep = later & ~same_row
            _, lo, hi = _unpack(z[rep])
            out_d.append(d[rep])
            out_s.append(lo)
            out_e.append(hi + length)
            out_z.append(np.full(rep.sum(), -1))
            out_g.append(g[rep])
            # firsts of contexts whose gram has several contexts
            starts = np.flatnonzero(new_gram)
            group = np.cumsum(new_gram) - 1  # -1: the held gram
            contexts = np.bincount(group + 1, weights=new_context, minlength=len(starts) + 1).astype(np.int64)
            if held and not new_gram[0]:
                contexts[0] += held[0][2]
            take = new_context & (contexts[group + 1] > 1)
            last = group[-1] + 1
            take &= (group + 1 != last) | (contexts[last] > 1)
            if held and contexts[0] > 1 and not new_gram[0] and held[0][3] is False:  # the one held back
                out_d.append(np.array([held[0][4]]))
                out_z.append(np.array([held[0][5]]))
                out_g.append(np.array([held[0][0]]))
                out_s.append(np.array([-1]))
                out_e.append(np.array([-1]))
                held[0][3] = True
            out_d.append(d[take])
            out_z.append(z[take])
            out_g.append(g[take])
            out_s.append(np.full(take.sum(), -1))
            out_e.append(np.full(take.sum(), -1))
            cols = [np.concatenate(x).astype(np.int64) for x in (out_d, out_s, out_e, out_z, out_g)]
            if len(cols[0]):
                yield pa.record_batch([pa.array(x) for x in cols], schema=schema)
            # the state of the last gram: [gram, context, contexts, given out, first doc, first at] of its last context
            f = first[-1]
            kept = held[0] if held and group[-1] < 0 else None
            given = bool(contexts[last] > 1)
            fd1, fz1 = (int(d[f]), int(z[f])) if f >= 0 else (kept[4], kept[5])
            held = [[int(g[-1]), int(c[-1]), int(contexts[last]), given, fd1, fz1]]

    return rows.mapInArrow(run, "doc long, start long, end long, at long, gram long")


def with_text(rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(gram, doc, at, text): the rows of step 3 with the text around them."""
    by_doc = rows.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("gram", "at")).alias("rows"))  # samples of one document
    x = meeting(docs, "doc", by_doc, "_doc").select("doc", "bytes", "rows")
    schema = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("text", pa.binary())])

    def run(batches):
        for b in batches:
            g, d, z, t, size = [], [], [], [], 0
            for i, doc in enumerate(b.column(0).to_pylist()):
                raw = memoryview(b.column(1)[i].as_buffer())
                for r in b.column(2)[i].as_py():
                    _, lo, hi = _unpack(r["at"])
                    g.append(r["gram"])
                    d.append(doc)
                    z.append(r["at"])
                    t.append(bytes(raw[lo:hi + length]))
                    size += 1
                if size > 50_000:
                    yield pa.record_batch([pa.array(g, pa.int64()), pa.array(d, pa.int64()), pa.array(z, pa.int64()), pa.array(t, pa.binary())], schema=schema)
                    g, d, z, t, size = [], [], [], [], 0
            if g:
                yield pa.record_batch([pa.array(g, pa.int64()), pa.array(d, pa.int64()), pa.array(z, pa.int64()), pa.array(t, pa.binary())], schema=schema)

    return x.mapInArrow(run, "gram long, doc long, at long, text binary")


def merge_windows(rows: DataFrame, length: int) -> DataFrame:
    """Step 3, over rows sorted by (gram, doc, at): (doc, start, end) of repeated windows."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        tables = _Hashes(10_000 * (2 * length + 64))
        held, seen = None, np.zeros(0, np.uint64)  # windows so far of the gram the rows so far end with
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                b = whole.slice(at, 10_000)
                g, d, z = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                p, lo, hi = _unpack(z)
                size = hi + length - lo
                flat = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8)
                base = np.r_[0, np.cumsum(size)[:-1]]
                many = hi - lo + 1
                row = np.repeat(np.arange(len(g)), many)
                place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)  # the window's number in its row
                start = base[row] + place
                key = tables.of(tables.prefix(tables.byte[flat]), start, start + length)
                off = (p[row] - lo[row] - place).astype(np.uint64)
                key = mix64(key + mix64(g[row].view(np.uint64) + off * np.uint64(0x9E3779B97F4A7C15)))
                order = np.argsort(key, kind="stable")
                again = np.zeros(len(key), bool)
                again[order[1:]] = key[order[1:]] == key[order[:-1]]
                if held is not None and held == g[0]:
                    own = row < np.searchsorted(g != held, True) if (g != held).any() else np.ones(len(row), bool)
                    again[own] |= np.isin(key[own], seen)
                first = np.flatnonzero(again & np.r_[True, ~again[:-1] | (row[1:] != row[:-1])])
                last = np.flatnonzero(again & np.r_[~again[1:] | (row[1:] != row[:-1]), True])
                if len(first):
                    yield pa.record_batch([pa.array(d[row[first]]), pa.array(lo[row[first]] + place[first]),
                                           pa.array(lo[row[last]] + place[last] + length)], schema=schema)
                own = g[row] == g[-1]
                seen = np.unique(np.r_[seen, key[own]] if held == g[-1] else key[own])
                held = g[-1]

    return rows.mapInArrow(run, "doc long, start long, end long")


def _slot(c: str):
    return F.pmod(F.xxhash64(F.col(c)), F.lit(SLOTS)).cast("int")


def meeting(df: DataFrame, key: str, other: DataFrame, other_key: str, rest: bool = False) -> DataFrame:
    """``df`` joined with ``other`` (one row a key).  Rows of ``df`` whose hashed
    key no key of ``other`` shares skip the exchange; they are dropped, or with
    ``rest`` come out with nulls.  The table of hashed keys has SLOTS rows at most."""
    filled = F.broadcast(other.select(_slot(other_key).alias("_slot")).distinct())
    near = df.join(filled, _slot(key) == F.col("_slot"), "left_semi").join(other, F.col(key) == F.col(other_key), "left" if rest else "inner")
    if not rest:
        return near
    far = df.join(filled, _slot(key) == F.col("_slot"), "left_anti")
    return near.unionByName(far, allowMissingColumns=True)


def intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, start, end): stretches covered by repeated windows, of ``docs`` (doc, bytes)."""
    rows = sample_rows(docs, length, gram)
    rows = rows.repartition(F.when(F.col("again"), F.xxhash64("doc", "at")).otherwise(F.col("gram")))
    rows = rows.sortWithinPartitions("again", "gram", "context", "doc", "at")
    met = materialise(compare_neighbours(rows, length), "met")
    again = met.where("at >= 0").select("gram", "doc", "at").distinct()
    text = with_text(again, docs, length)
    text = text.repartition(F.col("gram")).sortWithinPartitions("gram", "doc", "at")
    return met.where("at < 0").select("doc", "start", "end").union(merge_windows(text, length))


def _cut(raw, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, the rest) for covered intervals."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    keep, at = [], 0
    for s, e in merged:
        keep.append(bytes(raw[at:s]))
        at = e
    keep.append(bytes(raw[at:]))
    return sum(e - s for s, e in merged), len(merged), b"".join(keep)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   with_text_left: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row."""
    docs = pick(df, doc=doc_id, bytes=text).withColumns({
        "doc": F.col("doc").cast("long"), "bytes": F.coalesce(F.col("bytes").cast("binary"), F.lit(b"").cast("binary"))})
    long = docs.where(F.col("doc").isNotNull() & (F.octet_length("bytes") >= length))
    name = long.select("doc", F.sha2("bytes", 256).alias("sha"), F.octet_length("bytes").alias("n"))
    name = materialise(name, "names")
    first = name.groupBy(F.col("sha").alias("_sha"), F.col("n").alias("_n")).agg(F.min("doc").alias("_first"))
    copies = (name.join(first, (F.col("sha") == F.col("_sha")) & (F.col("n") == F.col("_n"))).where(F.col("doc") > F.col("_first"))
              .select(F.col("doc").alias("_copy"), F.col("n").cast("long").alias("_whole")).distinct())
    copies = materialise(copies, "copies")
    alone = meeting(long, "doc", copies, "_copy", rest=True).where(F.col("_copy").isNull()).select("doc", "bytes")
    spans = intervals(alone, length, gram).union(copies.select("_copy", F.lit(0).cast("long"), "_whole"))
    by_doc = materialise(spans.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    x = meeting(docs, "doc", by_doc, "_doc", rest=True).select("doc", "bytes", "spans")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())] + ([("kept", pa.binary())] if with_text_left else [])
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for i, doc in enumerate(b.column(0).to_pylist()):
                raw = memoryview(b.column(1)[i].as_buffer())
                spans = b.column(2)[i].as_py()
                gone, runs, kept = _cut(raw, [(s["start"], s["end"]) for s in spans or ()]) if spans else (0, 0, raw)
                for col, v in zip(out, (doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(v)
            yield pa.record_batch([pa.array([bytes(v) for v in c] if n == "kept" else c, t) for c, (n, t) in zip(out, fields)], schema=schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text_left else "")
    return x.mapInArrow(run, ddl)
