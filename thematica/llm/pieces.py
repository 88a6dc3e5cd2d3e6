"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text is cut into marked words (the mark stands for a blank) and at characters
that no piece contains, as no piece crosses either.  The distinct words of a
batch that aren't in the bounded cache are sorted, which lays out their trie,
and walked depth-first: a stack holds the forward state of each prefix, and a
word starts from the state of the prefix it shares with the word before it.

Unigram models: the state of a prefix is its best score and last piece
(Viterbi).  BPE models: the best-scoring path isn't what merging by rank gives,
so the state is the last piece of the prefix's own encoding; the only piece
that may end the longer prefix is the one that stays apart from the piece before
it when the two are merged on their own.  That gives the library's ids.

Characters without a piece become their UTF-8 bytes' pieces (byte fallback), or
the unknown id where the model has none.  Decoding joins pieces, turns byte
pieces back into characters and marks into blanks.

Defined results: a null text has null ids and decodes to null, an empty one has
no ids; texts with control marks or the mark character itself are encoded as the
library does; null ids and repeated rows are handled row by row; an empty table
gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import tokenizer_path
from .shared import pick, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE_ENTRIES = 600_000
LONGEST = 64  # longer words aren't kept in the cache
STEP_BYTES = 4 << 20  # text whose new words are walked together
DECODE_ROWS = 500  # id lists that are decoded together


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, pieces: list[tuple[str, float]], unigram: bool, unknown: int, fallback: dict[int, int] | None,
                 control: set[int] = frozenset(), dummy_prefix: bool = True):
        self.text = [p for p, _ in pieces]
        self.score = [s for _, s in pieces]
        self.unigram, self.unknown, self.fallback, self.control, self.dummy_prefix = unigram, unknown, fallback, control, dummy_prefix
        skip = set(fallback.values() if fallback else ()) | set(control) | {unknown}
        self.id = {p: i for i, (p, _) in enumerate(pieces) if i not in skip}
        self.longest = max(map(len, self.id), default=1)
        self.letters = {c for p in self.id for c in p}
        lengths: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.ends = {e: sorted(n, reverse=True) for e, n in lengths.items()}  # by the last three letters of pieces, how long they are
        self.byte_of = {i: b for b, i in fallback.items()} if fallback else {}
        self.special = np.zeros(len(pieces), bool)  # ids that aren't a plain piece
        self.special[[i for i in {*self.byte_of, *control, unknown} if 0 <= i < len(pieces)]] = True
        # what an id adds to the decoded bytes where texts are decoded together; 0xFF, never valid, for ids that add nothing
        plain = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") or b"\xff" for p in self.text]
        for i in np.flatnonzero(self.special).tolist():
            plain[i] = bytes([self.byte_of[i]]) if i in self.byte_of else " \u2047 ".encode() if i == unknown else b"\xff"
        self.raw = pa.array(plain, pa.large_binary())
        self._apart: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        fallback = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)} or None
        proto = sp.serialized_model_proto()
        kind, dummy = _settings(proto)
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], kind == 1, sp.unk_id(), fallback,
                   {i for i in range(n) if sp.is_control(i)}, dummy)

    # --- merging a short string by rank, only to see whether two pieces stay apart
    def _merged(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.id.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: str, b: str) -> bool:
        got = self._apart.get((a, b))
        if got is None:
            if len(self._apart) > CACHE_ENTRIES:
                self._apart.clear()
            got = self._apart[(a, b)] = self._merged(a + b) == ([a, b] if a else [b])
        return got

    def walk(self, words: list[str]):
        """(word, ids as bytes) for sorted distinct words, sharing the forward
        states of common prefixes."""
        start = [0]  # start[i]: where the last piece of the prefix of i letters begins
        score = [0.0]
        before = ""
        unknown_score = min(self.score, default=0.0) - 10.0
        ids, longest, ends, known = self.id, self.longest, self.ends, self._apart
        for w in words:
            n = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                n += 1
            del start[n + 1:], score[n + 1:]
            for i in range(n + 1, len(w) + 1):
                if self.unigram:
                    best, at = score[i - 1] + unknown_score, i - 1
                    for a in range(max(0, i - longest), i):
                        j = ids.get(w[a:i])
                        if j is not None and (s := score[a] + self.score[j]) > best:
                            best, at = s, a
                    score.append(best)
                else:
                    at = i - 1
                    for n in ends.get(w[i - 3:i], ()):  # no slice of 3 letters where i < 3
                        if n <= i and (t := w[i - n:i]) in ids:
                            b = w[start[i - n]:i - n]
                            if (apart := known.get((b, t))) is None:
                                apart = self.apart(b, t)
                            if apart:
                                at = i - n
                                break
                    else:
                        if i > 1 and (t := w[i - 2:i]) in ids and self.apart(w[start[i - 2]:i - 2], t):
                            at = i - 2
                    score.append(0.0)
                start.append(at)
            before = w
            out, i = [], len(w)
            while i:
                out.append(w[start[i]:i])
                i = start[i]
            yield w, self._bytes(reversed(out))

    def _bytes(self, parts) -> bytes:
        out = []
        unknown = False
        for p in parts:
            j = self.id.get(p)
            if j is not None:
                out.append(j)
                unknown = False
            elif self.fallback:
                out.extend(self.fallback[b] for b in p.encode("utf-8", "surrogatepass"))
            elif not unknown:  # a run of unknown letters is one id
                out.append(self.unknown)
                unknown = True
        return struct.pack(f"<{len(out)}I", *out)

    def decode(self, ids) -> str:
        """Stretches of plain pieces are joined at once; only bytes, unknown and control ids are looked at one by one."""
        ids = np.asarray(ids, np.int64)
        piece, every = self.text.__getitem__, ids.tolist()
        out, raw, done = [], bytearray(), 0

        def flush(to):
            if raw and to > done:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.extend(map(piece, every[done:to]))

        for j in np.flatnonzero(self.special[ids]).tolist():
            flush(j)
            done = j + 1
            b = self.byte_of.get(every[j])
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if every[j] == self.unknown:
                out.append(" ⁇ ")
        flush(len(every))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        s = "".join(out).replace(MARK, " ")
        return s[1:] if self.dummy_prefix and s.startswith(" ") else s


    def decode_lists(self, lists: pa.Array) -> list[str | None]:
        """The texts of an array of id lists.  What its ids stand for is laid end to end at once; a text whose bytes
        aren't valid UTF-8, or hold the mark as single bytes, is decoded on its own."""
        ids = lists.flatten()  # without null lists
        joined = self.raw.take(ids)
        data = memoryview(joined.buffers()[2] or b"")
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        null = lists.is_null().to_numpy(zero_copy_only=False).tolist()
        out: list[str | None] = []
        for a, b, i, j, none in zip(at[ends - sizes].tolist(), at[ends].tolist(), (ends - sizes).tolist(), ends.tolist(), null, strict=True):
            if none:
                out.append(None)
                continue
            try:
                s = str(data[a:b], "utf-8")
            except UnicodeDecodeError:
                s = MARK
            if MARK in s:
                out.append(self.decode(ids[i:j].to_numpy(zero_copy_only=False)))
            else:
                out.append(s[1:] if self.dummy_prefix and s.startswith(" ") else s)
        return out


def _settings(proto: bytes) -> tuple[int, bool]:
    """(model type, dummy prefix) from a serialised model: field 2 is the trainer's
    settings (3: model type), field 3 the normaliser's (3: dummy prefix)."""
    def fields(b):
        i = 0

        def number():
            nonlocal i
            v = shift = 0
            while True:
                c = b[i]
                i += 1
                v |= (c & 127) << shift
                shift += 7
                if c < 128:
                    return v
        while i < len(b):
            tag = number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, number()
            else:
                size = number() if kind == 2 else 8 if kind == 1 else 4
                yield tag >> 3, b[i:i + size]
                i += size

    kind, dummy = 1, True
    for f, v in fields(proto):
        if f == 2:
            kind = next((x for n, x in fields(v) if n == 3), 1)
        elif f == 3:
            dummy = bool(next((x for n, x in fields(v) if n == 3), 1))
    return kind, dummy


class Codec:
    """Encodes texts with a bounded cache of words."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        hard = [c for c in "\n\t\r" if c not in pieces.letters]
        self.hard = hard
        stop = "".join(map(re.escape, hard))
        # a word: marks and what follows them; a hard character stands alone
        self.words = re.compile(f"[{stop}]|{MARK}*[^{MARK}{stop}]+|{MARK}+" if hard else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        s = text.replace(" ", MARK)
        return self.words.findall(MARK + s if self.p.dummy_prefix and s else s)

    def encode(self, batch: list[str | None]) -> list[bytes | None]:
        cut = [None if t is None else self.cut(t) for t in batch]
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = set()
        for ws in cut:
            if ws:
                new.update(ws)
        new = sorted(new - cache.keys())
        long = {}
        for w, ids in self.p.walk(new):
            (cache if len(w) <= LONGEST else long)[w] = ids

        def joined(ws):
            try:
                return b"".join(map(cache.__getitem__, ws))
            except KeyError:  # a text with long words
                return b"".join(cache[w] if w in cache else long[w] for w in ws)

        return [None if ws is None else joined(ws) for ws in cut]


def encode(df: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts (replacing a column of that name)."""
    keep = [c for c in df.columns if c != ids]
    x = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_t"))
    out = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
                       + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = Codec(Pieces.load(tokenizer_path(model)))
        for b in batches:
            done, part, size = [], [], 0

            def flush():
                got = codec.encode(part)
                sizes = np.array([0] + [len(g or b"") // 4 for g in got]).cumsum()
                offsets = pa.array(sizes, pa.int32(), mask=np.array([g is None for g in got] + [False]))
                return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(g or b"" for g in got), "<i4")))

            at = 0
            for t in texts(b, "_t"):
                part.append(t)
                size += len(t or "")
                if size >= STEP_BYTES:
                    done.append((at, len(part), flush()))
                    at, part, size = at + len(part), [], 0
            if part:
                done.append((at, len(part), flush()))
            for a, n, arr in done:
                yield pa.RecordBatch.from_arrays([*b.slice(a, n).columns[:-1], arr], names=[*b.schema.names[:-1], "ids"])

    got = x.mapInArrow(run, out)
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids))


def decoder(model: str = MODEL):
    """A column function from ids to text."""
    state: dict = {}

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        p = state.get("pieces")
        if p is None:
            p = state["pieces"] = Pieces.load(tokenizer_path(model))
        steps = [p.decode_lists(ids.slice(i, DECODE_ROWS)) for i in range(0, len(ids), DECODE_ROWS)]
        return pa.array([t for step in steps for t in step], pa.string())

    return decode


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_ids, ids, restored): the ids, and whether they decode to the text."""
    x = encode(pick(df, doc_id=doc_id, _text=text), "_text", model)
    x = x.withColumn("_back", decoder(model)(F.col("ids")))
    return x.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.col("_back").eqNullSafe(F.col("_text")).alias("restored"))
