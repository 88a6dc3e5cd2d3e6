"""Best-fit packing of tokenised documents, planned on the length histogram.

Documents become token ids followed by an end id; a document longer than the
capacity is cut into pieces of exactly that length, the last one shorter.  The
plan is made over counts: the histogram has at most ``capacity`` lengths,
whatever the number of documents, so it alone goes to the driver.  Lengths are
placed in falling order, each into the open sequences with the least room that
still fits; sequences filled alike are handled as one interval.  Each piece
then takes the slot that the plan holds for its rank within its length: an
equi-join on (length, rank), both unique, so no length can be a hot key.

Ranks come from two steps: a rank within (length, salt), and the running
count of the salts before it; a length with a third of all rows is spread over
all salts.

Defined results: a null or empty text is one piece holding the end id only;
null ids are packed like others; rows that repeat an id are packed one by one;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialise, pick, texts

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: rows that one (length, salt) group has on average when all rows share a length
RANK_ROWS = 250_000
#: bounds of a worker's caches (entries of about 200 bytes)
RUNS_KEPT, WORDS_KEPT = 1_000_000, 700_000
SLOT_ROWS = 50_000


def tokenizer_path(name: str) -> str:
    """A path is used as it is; a bare name is looked up among the public
    tokenizer files of the machine that runs the task."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, as the tokenizer
    gives them.  White space separates pre-tokens, so runs between blanks,
    tabs and line ends are encoded one by one and kept in a bounded cache.
    Plain Latin words with at most one closing comma or stop go to the
    tokenizer's model directly: lower-casing and the byte alphabet are all
    that its other parts would do to them; the rest takes the whole tokenizer."""

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
    BREAKS = str.maketrans("\t\n\r", "   ")
    LONGEST = 64  # longer runs are encoded without being kept

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.cache: dict[str, bytes] = {}  # runs as they stand
        self.words: dict[str, bytes] = {}  # plain words in lower case, without marks

    @staticmethod
    def _pack(ids) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _run(self, w: str) -> bytes:
        m = self.PLAIN.fullmatch(w)
        if not m:
            return self._pack(self.tok.encode(w, add_special_tokens=False).ids)
        out = self._word(m[1].lower())
        return out + self._word(m[2]) if m[2] else out

    def _word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            letters = word.encode().decode("latin-1").translate(self.alphabet)
            out = self._pack([t.id for t in self.model.tokenize(letters)])
            if len(word) <= self.LONGEST:
                self.words[word] = out
        return out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        runs = text.translate(self.BREAKS).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
        cache = self.cache
        if len(cache) > RUNS_KEPT:
            cache.clear()
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        cache[""] = b""
        try:
            return b"".join(map(cache.__getitem__, runs))
        except KeyError:
            out = []
            for w in runs:
                b = cache.get(w)
                if b is None:
                    b = self._run(w)
                    if len(w) <= self.LONGEST:
                        cache[w] = b
                out.append(b)
            return b"".join(out)


def token_pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                 end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    x = pick(df, doc_id=doc_id, text=text)
    id_type = pa.string() if dict(x.dtypes)["doc_id"] == "string" else pa.int64()
    fields = [("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches):
        enc = Encoder(tokenizer_path(tokenizer))
        end = end_id.to_bytes(4, "little")
        for b in batches:
            out = [[] for _ in fields]
            ids_of = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            size = 0
            for doc, t in zip(ids_of, texts(b, "text")):
                ids = enc(t) + end
                for piece, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at:4 * (at + capacity)]
                    for col, v in zip(out, (doc, piece, at, len(part) // 4, zlib.crc32(part), part)):
                        col.append(v)
                    size += len(part) * with_ids
                if size > 16 << 20:
                    yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(out, fields)], schema=schema)
                    out, size = [[] for _ in fields], 0
            yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(out, fields)], schema=schema)

    ddl = (f"doc_id {'string' if id_type == pa.string() else 'long'}, piece int, start long, length long, ids_crc32 long"
           + (", ids binary" if with_ids else ""))
    return x.mapInArrow(run, ddl)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts.  Returns segments
    (length, first rank, items, items per sequence, first sequence, offset):
    item i of a segment goes to sequence first + i // per, at offset + (i % per) * length."""
    room: dict[int, list[list[int]]] = {}  # room left -> intervals [first sequence, how many]
    rooms: list[int] = []
    out, sequences = [], 0

    def leave(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append([first, many])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                need = -(-left // per)
                leave(capacity, sequences, need)
                sequences += need
                continue
            space = rooms[at]
            first, many = room[space][-1]
            per = space // length
            if left < per:  # one sequence takes what is left
                per, use = left, 1
            else:
                use = min(many, left // per)
            out.append((length, rank, use * per, per, first, capacity - space))
            rank += use * per
            left -= use * per
            if use == many:
                room[space].pop()
                if not room[space]:
                    del room[space]
                    rooms.pop(at)
            else:
                room[space][-1] = [first + use, many - use]
            leave(space - per * length, first, use)
    return out


def with_ranks(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, 0 upwards within each length."""
    salts = total // RANK_ROWS + 16
    order = ["doc_id", "piece", "start", "ids_crc32"]
    x = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = (x.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n"))
    local = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order)) - 1
    return (x.withColumn("_local", local).join(before, ["length", "_salt"])
            .withColumn("rank", F.col("_before") + F.col("_local")).drop("_salt", "_before", "_local"))


def slots(spark, segments) -> DataFrame:
    """One row per planned slot: (length, rank, sequence_id, offset)."""
    seg = spark.createDataFrame(segments, "length long, first long, items long, per long, seq long, at long")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("items") - 1).cast("long"), F.lit(SLOT_ROWS).cast("long")))
    x = seg.select("*", blocks.alias("_b")).repartition(F.col("length"), F.col("first"), F.col("_b"))
    item = F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + SLOT_ROWS, F.col("items")) - 1))
    return x.select("*", item.alias("_i")).select(
        "length", (F.col("first") + F.col("_i")).alias("rank"),
        (F.col("seq") + F.expr("_i div per")).cast("long").alias("sequence_id"),
        (F.col("at") + F.expr("_i % per") * F.col("length")).cast("long").alias("offset"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a piece table (see ``token_pieces``)."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    if not hist:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ranked = with_ranks(pieces, sum(hist.values()))
    return ranked.join(slots(spark, plan(hist, capacity)), ["length", "rank"]).drop("rank")


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                   end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    pieces = materialise(token_pieces(df, doc_id, text, tokenizer, end_id, capacity, with_ids), "pieces")
    out = pack(pieces, capacity)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    return out.select(*cols)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, pieces): the packed sequences themselves, from
    pieces with ids.  A group holds at most ``capacity`` tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    x = packed.groupBy("sequence_id").agg(parts.alias("_p"))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p.ids))
    return x.select("sequence_id", joined.alias("ids"),
                    F.transform("_p", lambda p: F.struct(p.doc_id.alias("doc_id"), p.piece.alias("piece"),
                                                         p.offset.alias("offset"))).alias("pieces"))
