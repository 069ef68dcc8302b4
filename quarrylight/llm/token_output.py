"""Token-ID output: one concatenated id array with Elias-Fano document boundaries.

File format (a folder of Parquet files, which any store that Spark writes to can
hold; a lost task is simply run again):

``chunks``  one row for each run of consecutive documents:
    shard int, seq int     shards are ascending ranges of doc_id, chunks ascending within them
    base long              ids of this shard before the chunk
    n_docs int, n_ids long
    width int              bytes of an id, 2 or 4
    first long, last long  the smallest and the largest doc_id, by which a look-up prunes
    ids binary             the ids, little-endian
    doc_ids binary         ascending doc_id, as differences in byte planes
    low_bits int, low binary, high binary, samples binary
                           Elias-Fano code of the documents' ends (see `EliasFano`)
``shards``  shard int, start long, n_docs long, n_ids long: where each shard starts

The start of a document is the shard's start + the chunk's base + select(k - 1)
of the chunk's code; no table of 64-bit offsets is kept.  `read_documents` looks
documents up so: it reads the chunks that may hold them and selects two ends of
each, the others stay coded.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Stands before the first word of a line while a text is cut into words.
FIRST = "\x01"
#: Ids after which a chunk ends.
CHUNK_IDS = 1 << 20
#: Words that a worker remembers the ids of.
CACHE_PIECES = 400_000
#: Bytes of text that are encoded together: a worker needs about 25 times as much for it.
TOGETHER = 4 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 16 << 20
_CHUNK = "shard int, seq int, base long, n_docs int, n_ids long, width int, first long, last long, ids binary, doc_ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """n ascending numbers up to u in about n * (2 + log2(u / n)) bits.

    Each number's lowest ``low_bits`` bits stand in ``low``; the rest are in
    unary in ``high``, where the one for number i is at bit (number >> low_bits) + i.
    ``samples`` holds the bit place of every STEP-th one: select reads a sample
    and then counts ones from there.
    """

    STEP = 64

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, np.uint32)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, int(np.floor(np.log2(max(1, top) / n)))) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits.astype(np.uint8).ravel()), pack(high), places[:: cls.STEP].astype(np.uint32).tobytes())

    def select(self, i: int) -> int:
        """Number i, from 0."""
        place, left = int(self.samples[i // self.STEP]), i % self.STEP
        while left:  # count ones after the sample, a stretch of bytes at a time
            first = (place + 1) // 8
            ones = np.flatnonzero(np.unpackbits(self.high[first : first + 64], bitorder="little")) + 8 * first
            ones = ones[ones > place]
            place, left = (int(ones[left - 1]), 0) if len(ones) >= left else (8 * (first + 64) - 1, left - len(ones))
        at = i * self.low_bits
        word = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little") >> at % 8
        return (place - i) << self.low_bits | word & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little")[: 8 * len(self.high)])[: self.n]
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.int64)
        return ((places - np.arange(self.n)) << self.low_bits) + bits @ (1 << np.arange(self.low_bits, dtype=np.int64))


def _shown() -> dict[int, str]:
    """How byte-level tokenizers show each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


_SHOWN = _shown()


class _Encoder:
    """The tokenizer, with remembered ids of words.

    A byte-level tokenizer whose pattern starts a new piece at each blank gives
    the same ids for a text as for its blank-separated words one by one, if no
    two white-space characters stand together and no special token occurs; such
    texts are put together from words.  All others go to the tokenizer whole.

    A worker lives on between tasks and remembers words that come again within an
    input; most words of a long tail come once, and remembering costs more than
    their ids do.
    """

    held: dict[str, _Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.raw(["\n"])[0]
        self.by_word = self.tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex and len(self.line) == self.dtype().itemsize
        self.blank = re.compile(r"\s").search
        self.ended = re.compile(r"(.*[^\W_])([^\w\s]+)", re.S).fullmatch
        self.model = self.tokenizer.model
        #: Ids of remembered words; a word at the start of a line stands with FIRST before it.
        self.known: dict[str, bytes] = {"\n": self.line}
        #: Ids of runs of marks that follow a letter or digit.
        self.marks: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of new words, which hold no white space.

        Marks at a word's end, after a letter or digit, are a piece of their own,
        so such a word is its stem and the marks.  A word of letters is one piece
        for the pattern: it goes straight to the model, as the model sees bytes.
        Other words are encoded as the ready pieces of one input, which keeps the
        piece of every id.
        """
        known, stems, marks, tokenize, blank, ended = self.known, {}, self.marks, self.model.tokenize, _SHOWN[32], self.ended
        k = self.dtype().itemsize
        code = "H" if k == 2 else "I"
        out: list[bytes] = []
        rest: list[tuple[int, str, bytes]] = []
        for w in words:
            tail = b""
            if not w[-1].isalnum() and (m := ended(w)):
                w, mark = m.groups()
                tail = marks.get(mark)
                if tail is None:
                    tail = marks[mark] = self.raw([mark])[0]
                ids = known.get(w) or stems.get(w)
                if ids:
                    out.append(ids + tail)
                    continue
            first = w[0] == FIRST
            core = w[1:] if first else w
            if core.isalpha():
                shown = core if core.isascii() else core.encode().decode("latin-1").translate(_SHOWN)
                ids = array(code, [x.id for x in tokenize(shown if first else blank + shown)]).tobytes()
                if tail:
                    stems[w] = ids
                out.append(ids + tail)
            else:
                rest.append((len(out), core if first else " " + core, tail))
                out.append(b"")
        if len(marks) > CACHE_PIECES // 10:
            marks.clear()
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            found = self.tokenizer.encode([w for _, w, _ in part], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, self.dtype).tobytes()
            ends = (k * np.cumsum(np.bincount(found.word_ids, minlength=len(part)))).tolist()
            for (i, _, tail), a, b in zip(part, [0, *ends], ends):
                out[i] = raw[a:b] + tail
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # many small objects and no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = np.array([not t or FIRST in t or any(x in t for x in self.special) for t in texts]) if self.by_word else np.ones(len(texts), bool)
        marked = pa.array(["" if skip else FIRST + t for t, skip in zip(texts, whole)], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", f" \n {FIRST}"), " ")
        words = lists.flatten().dictionary_encode()
        distinct, index, ends = words.dictionary.to_pylist(), words.indices.to_numpy(), lists.offsets.to_numpy()
        if len(self.known) > CACHE_PIECES:
            self.known = {w: self.known[w] for w in distinct if w in self.known} | {"\n": self.line}
        parts = list(map(self.known.get, distinct))
        missing = [k for k, p in enumerate(parts) if p is None]
        # Where white space stands together a word is empty or holds some: such texts aren't put together.
        spaced = self.blank("".join([distinct[k] for k in missing])) is not None
        odd = np.zeros(len(distinct), bool)
        odd[[k for k in missing if distinct[k] in ("", FIRST) or spaced and self.blank(distinct[k])]] = True
        fresh = [k for k in missing if not odd[k]] if odd.any() else missing
        for k in np.flatnonzero(odd).tolist():
            parts[k] = b""
        again = (np.bincount(index, minlength=len(distinct)) > 1).tolist()
        for k, ids in zip(fresh, self.learn([distinct[k] for k in fresh])):
            parts[k] = ids
            if again[k]:
                self.known[distinct[k]] = ids
        pool, sizes = np.frombuffer(b"".join(parts), self.dtype), np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype().itemsize
        begins = np.cumsum(sizes) - sizes
        size = sizes[index]
        at = np.cumsum(size)
        ids = pool[np.repeat(begins[index] - (at - size), size) + np.arange(int(at[-1]) if len(at) else 0)]
        cuts = np.r_[0, at][ends]
        together = np.r_[0, np.cumsum(odd[index])][ends]
        whole |= np.diff(together) > 0
        rest = iter(self.raw([t for t, w in zip(texts, whole) if w]))
        return [np.frombuffer(next(rest), self.dtype) if w else ids[a:b] for w, a, b in zip(whole, cuts.tolist(), cuts[1:].tolist())]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode every text, end each document with end_id and write the ids in ascending doc_id order.

    Null texts are empty: such documents hold the end id alone.  Rows without a
    doc_id come last; rows that share one are ordered by a hash of their text.  An empty
    table gives files without rows.  Other columns are ignored.
    """
    _, n_bytes = C.shape_of(docs)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer_path)
        end = np.array([end_id], encoder.dtype)
        shard, seq, base = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            width = encoder.dtype().itemsize
            ends = np.cumsum([len(p) for p in parts])
            ef = EliasFano.build(ends)
            row = (shard, seq, base, len(ids), int(ends[-1]), width, ids[0], ids[-1], np.concatenate(parts).tobytes(), C.encode_sorted(np.array(ids, np.int64).astype(np.uint64)), ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [x.split()[0] for x in _CHUNK.split(", ")])

        for batch in batches:
            begin, held, n = 0, [], 0
            for k, text in enumerate(batch.column(1).to_pylist(), 1):
                held.append(text)
                n += len(held[-1])
                if k < batch.num_rows and n < TOGETHER:
                    continue
                for i, found in zip(batch.column(0).slice(begin, len(held)).to_pylist(), encoder.encode(held)):
                    ids.append(i)
                    parts.append(np.r_[found, end])
                    size += len(parts[-1])
                    if size >= CHUNK_IDS:
                        yield chunk()
                        seq, base, size = seq + 1, base + size, 0
                        ids, parts = [], []
                begin, held, n = k, [], 0
        if ids:
            yield chunk()
            ids, parts = [], []
        C.release()

    # One doc_id may have many rows: its text's hash and the place of the row split them, so that no range is above the others.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), C.text_key().alias("key"), F.monotonically_increasing_id().alias("nth"))
    ordered = rows.repartitionByRange(shards, "doc_id", "key", "nth").sortWithinPartitions("doc_id", "key", "nth").select("doc_id", "text")
    ordered.mapInArrow(run, _CHUNK).write.parquet(f"{path}/chunks")
    shard_starts(docs.sparkSession.read.parquet(f"{path}/chunks")).write.parquet(f"{path}/shards")


def shard_starts(chunks: DataFrame, together: int = 1024) -> DataFrame:
    """shard, start, n_docs, n_ids: running sums within stretches of shards, and over the stretches' totals."""
    totals = chunks.groupBy("shard").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids")).withColumn("stretch", F.floor(F.col("shard") / together))
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w), F.lit(0))
    inner = totals.withColumn("inner", upto(Window.partitionBy("stretch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    outer = totals.groupBy("stretch").agg(F.sum("n_ids").alias("n_ids")).select("stretch", upto(Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("outer"))
    return inner.join(outer, "stretch").select("shard", (F.col("inner") + F.col("outer")).alias("start"), "n_docs", "n_ids")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                ends = ef.all()
                starts = np.r_[0, ends[:-1]]
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                docs = C.decode_sorted(row["doc_ids"]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [C.id_column(docs), pa.array(starts + row["base"] + row["start"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.r_[starts, ends[-1:]].astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    chunks = spark.read.parquet(f"{path}/chunks").drop("n_ids", "seq", "first", "last")
    return chunks.join(spark.read.parquet(f"{path}/shards").select("shard", "start"), "shard").mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start and ids of a few documents: two selects for each, of the chunks that may hold them alone."""
    wanted = sorted(set(doc_ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                docs = C.decode_sorted(row["doc_ids"]).astype(np.int64)
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                places = np.concatenate([np.arange(*np.searchsorted(docs, [i, i + 1])) for i in wanted]) if len(docs) else docs
                ends = [(ef.select(k - 1) if k else 0, ef.select(k)) for k in places.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(docs[places]), pa.array([row["start"] + row["base"] + a for a, _ in ends], pa.int64()), pa.array([ids[a:b].astype(np.int32) for a, b in ends], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    maybe = F.lit(False)
    for i in wanted:
        maybe = maybe | ((F.col("first") <= i) & (F.col("last") >= i))
    chunks = spark.read.parquet(f"{path}/chunks").where(maybe).drop("n_ids", "seq", "first", "last")
    return chunks.join(spark.read.parquet(f"{path}/shards").select("shard", "start"), "shard").mapInArrow(run, "doc_id long, start long, ids array<int>")


def token_files_folder(spark: SparkSession) -> str:
    """A new folder for token files below the shared checkpoint folder."""
    import uuid

    C.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
