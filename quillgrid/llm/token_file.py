"""Token ids in a file format with random access: directly addressable codes.

An id is split into chunks of ``WIDTH`` bits.  Level 0 holds the lowest chunk of every id and a bitmap
that says which ids go on; level 1 holds the next chunk of those, and so on.  With each bitmap goes a
directory of the ones before every 512th bit, so the place of any id in the next level is a directory
entry and a short count: one token is read without decoding its block.

A file set is a Parquet folder; a row is a segment of about ``SEGMENT`` tokens with the codes as one
binary value, beside the ids and the offsets of its documents.  Spark's writer commits it, so it works
on any store and lost executors leave no halves.  The files are neither compressed nor dictionary coded:
the codes lie in them as they are, and a token can be read by its place in the file.  Segments follow each other in ascending document id.

Null and empty texts have the end id alone.  Null ids come first.  Rows of one id stand as they
are read.  An empty table gives an empty file set and no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim_worker, fresh_path, kept_by, no_shuffles_left, settings, table

WIDTH, SEGMENT, END_ID, DIRECTORY = 8, 1 << 20, 0, 512
CACHED_WORDS, BLOCK = 100_000, 1 << 22  # stems kept by a worker; bytes of text encoded at once
BROADCAST_SEGMENTS, BATCH_ROWS = 200_000, 4096
MAGIC = b"DAC1"
MARKS = string.punctuation  # ASCII characters that are neither letters, digits nor white space
MARKS_APART, JOINED = 3, 50  # marks that may be cut from a stem; stems given to the tokenizer at once
MARK, PLAIN = np.zeros(256, np.int32), np.zeros(256, bool)
MARK[list(MARKS.encode())] = np.arange(1, len(MARKS) + 1)
PLAIN[list((string.ascii_letters + string.digits).encode())] = True
SPACES = r"[\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # all white space, and more


class Encoder:
    """Ids of texts by a byte-level tokenizer, with the stems between spaces kept once they are encoded.

    The tokenizer's pattern never joins a space to what stands before it, nor a single line break to
    anything, so a text may be cut before both where no other white space follows.  A piece is a word after
    a space, or a line break with the word after it.  Up to three marks at its end are apart for the pattern
    if a letter or digit stands before them; what is left is a stem.  One dictionary holds the stems kept and
    those of a block of texts, so no stem is looked up alone and only the new ones become Python objects.
    Texts with other white space, or with the content of an added token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer
        how = json.loads(cut.__getstate__()) if cut else {}
        plain = self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        self.cuttable = plain and how.get("type") == "ByteLevel" and how["use_regex"] and not how["add_prefix_space"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character of a token stands for a byte
        # the characters that stand for the bytes; stems that the pattern would not cut are given in them, one after another
        plainly = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        self.letters = "".join(chr(b if b in plainly else next(others)) for b in range(256))
        self.words, self.lines = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)  # the model is shared; they hold no added tokens
        self.words.pre_tokenizer = pre_tokenizers.Split(self.letters[32], "merged_with_next")
        self.lines.pre_tokenizer = pre_tokenizers.Split(self.letters[10], "isolated")
        # stems, where their ids lie in the pool, and the last block they were in
        self.stems = pa.array([], pa.string())
        self.n, self.start, self.used = (np.zeros(0, np.int32) for _ in range(3))
        self.bad, self.pool, self.block = np.zeros(0, bool), np.zeros(0, "<u4"), 0
        # the same of marks, by their code; code 0 is none
        self.tail_n, self.tail_start = np.full(33**MARKS_APART, -1, np.int32), np.zeros(33**MARKS_APART, np.int32)
        self.tail_n[0], self.tail_pool = 0, np.zeros(0, "<u4")

    def whole(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        # the same ids as those of encode(); only the offsets of tokens, which nobody asks for, are not made
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _each(self, tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words``, and the number of ids of each."""
        ends = np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
        # a character stands for a byte, so the words lie in the text as they do in the array
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "")[0].as_buffer().to_pybytes().decode("latin-1").translate(self.letters)
        stops = [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), len(text)]
        found = [e.ids for e in tokenizer.encode_batch_fast([text[a:b] for a, b in zip(stops, stops[1:])], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), "<u4", sum(map(len, found)))
        # a word ends where the bytes of the tokens so far are those of the words so far
        return ids, np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1, prepend=0)

    def _learn(self, new: pa.Array) -> None:
        """Keep the ids of stems that follow those kept so far."""
        lines = pc.starts_with(new, "\n")
        words = pc.ascii_ltrim(new, characters="\n")
        lines, sizes = lines.to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy()
        one = pc.or_(pc.utf8_is_alpha(words), pc.ascii_is_decimal(words)).to_numpy(zero_copy_only=False)
        n, start, bad = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32), np.zeros(len(new), bool)
        pools, at = [self.pool], len(self.pool)

        def keep(which: np.ndarray, ids: np.ndarray, each: np.ndarray) -> None:
            nonlocal at
            n[which], start[which] = each, at + np.cumsum(each) - each
            pools.append(ids)
            at += len(ids)

        for tokenizer, which, lead in ((self.words, one & ~lines, " "), (self.lines, one & lines, "\n")):
            which = np.flatnonzero(which)
            if len(which):
                keep(which, *self._each(tokenizer, pc.binary_join_element_wise(lead, words.take(which), "")))
        odd = np.flatnonzero(~one)
        if len(odd):
            spaced = (sizes[odd] == 0) | pc.match_substring_regex(words.take(odd), SPACES).to_numpy(zero_copy_only=False)
            bad[odd[spaced]] = True
            odd = odd[~spaced]
            line = np.frombuffer(self.whole("\n"), "<u4").tolist()
            texts = [w if after else " " + w for w, after in zip(words.take(odd).to_pylist(), lines[odd])]
            found = [line + e.ids if after else e.ids for e, after in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), lines[odd])]
            keep(odd, np.fromiter(itertools.chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int32, len(found)))
        self.n, self.start, self.bad = np.append(self.n, n), np.append(self.start, start), np.append(self.bad, bad)
        self.used, self.pool = np.append(self.used, np.zeros(len(new), np.int32)), np.concatenate(pools)

    def _forget(self) -> None:
        """Keep those of the stems that were used last."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: CACHED_WORDS // 2])
        n = self.n[kept]
        ends = np.cumsum(n, dtype=np.int32)
        self.pool = self.pool[np.repeat(self.start[kept] - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)]
        self.stems, self.n, self.start, self.used, self.bad = self.stems.take(pa.array(kept)), n, ends - n, self.used[kept], self.bad[kept]

    def _stems(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Stems of ``pieces`` and the codes of the marks behind them."""
        offsets, data = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :][: len(pieces) + 1], pieces.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        trimmed = pc.ascii_rtrim(pieces, characters=MARKS)
        size = pc.binary_length(trimmed).to_numpy()
        tail = np.diff(offsets) - size
        last = np.minimum(offsets[:-1] + np.maximum(size, 1) - 1, len(data) - 1)
        apart = (size > 0) & (tail <= MARKS_APART) & PLAIN[data[last]]
        code = np.zeros(len(pieces), np.int32)
        for k in range(MARKS_APART):
            some = np.flatnonzero(apart & (tail > k))
            code[some] += 33**k * MARK[data[offsets[some] + size[some] + k]]
        unknown = np.unique(code[self.tail_n[code] < 0])
        for c in unknown.tolist():
            marks = "".join(MARKS[c // 33**k % 33 - 1] for k in range(MARKS_APART) if c // 33**k)
            ids = np.frombuffer(self.whole(marks), "<u4")
            self.tail_n[c], self.tail_start[c] = len(ids), len(self.tail_pool)
            self.tail_pool = np.append(self.tail_pool, ids)
        return (trimmed if apart[tail > 0].all() else pc.if_else(pa.array(apart), trimmed, pieces)), code

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text (no nulls)."""
        if not len(texts):
            return []
        apart = np.full(len(texts), not self.cuttable)
        for a in self.added:
            apart |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        # a line break in front makes the first word a piece like the others; before it is an empty piece
        lines = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        cut = pc.split_pattern(lines, " ")
        del lines
        first = cut.offsets.to_numpy()[:-1]
        stems, code = self._stems(cut.flatten())
        del cut
        if len(self.stems) > CACHED_WORDS:
            self._forget()
        here = pa.chunked_array([self.stems, stems]).dictionary_encode().chunks[-1]
        self.stems, at = here.dictionary, here.indices.to_numpy()
        del here, stems
        if len(self.stems) > len(self.n):
            self._learn(self.stems.slice(len(self.n)))
        self.block += 1
        self.used[at] = self.block
        bad = self.bad[at]
        bad[first] = False
        # offsets of 32 bits: a block has far fewer tokens.  A piece has the ids of its stem, then those of its marks
        here, source = np.empty((len(at), 2), np.int32), np.empty((len(at), 2), np.int32)
        here[:, 0], source[:, 0] = self.n[at], self.start[at]
        here[:, 1], source[:, 1] = self.tail_n[code], self.tail_start[code] + len(self.pool)
        source[first + 1, 0] += 1  # without the added line break
        here[first + 1, 0] -= ~bad[first + 1]
        here, source = here.reshape(-1), source.reshape(-1)
        ends = np.cumsum(here, dtype=np.int32)
        source -= ends - here
        places = np.repeat(source, here)
        places += np.arange(ends[-1], dtype=np.int32)
        ids = memoryview(np.concatenate([self.pool, self.tail_pool]).take(places)).cast("B")
        apart |= np.add.reduceat(bad, first) > 0
        stops = [0, *(4 * ends[2 * np.append(first[1:], len(at)) - 1].astype(np.int64)).tolist()]
        return [self.whole(texts[j].as_py()) if w else bytes(ids[a:b]) for j, (w, a, b) in enumerate(zip(apart.tolist(), stops, stops[1:]))]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, Encoder] = {}
kept_by("token_file", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would hold memory of their own
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def dac_encode(ids: np.ndarray, width: int = WIDTH) -> bytes:
    """Codes of a sequence of unsigned ids; ``width`` is 8, 16 or 32."""
    rest = np.asarray(ids)
    rest = rest if rest.dtype == np.uint32 and width < 32 else rest.astype(np.uint64)
    levels, step = [], rest.dtype.type(width)
    while True:
        chunk = rest.astype(f"<u{width // 8}")  # the lowest bits
        rest = rest >> step
        on = rest != 0
        bits = np.packbits(on, bitorder="little")
        counts = np.zeros(-(-len(on) // DIRECTORY) * (DIRECTORY // 8), np.uint8)
        counts[: len(bits)] = np.bitwise_count(bits)
        ones = np.append(0, np.cumsum(counts.reshape(-1, DIRECTORY // 8).sum(axis=1, dtype=np.int64)))
        levels.append(struct.pack("<QQQ", len(on), len(bits), len(ones)) + ones.astype("<u8").tobytes() + bits.tobytes() + chunk.tobytes())
        if not on.any():
            break
        rest = rest[on]
    return MAGIC + struct.pack("<HH", width, len(levels)) + b"".join(levels)


def _levels(blob: bytes):
    width, n_levels = struct.unpack_from("<HH", blob, 4)
    at = 8
    for _ in range(n_levels):
        n, n_bits, n_ones = struct.unpack_from("<QQQ", blob, at)
        at += 24
        yield width, n, at + 8 * n_ones, at + 8 * n_ones + n_bits
        at += 8 * n_ones + n_bits + n * (width // 8)


def dac_get(blob: bytes, i: int) -> int:
    """The id at place ``i``."""
    return dac_read(lambda at, n: blob[at : at + n], i)


def dac_read(read: Callable[[int, int], bytes], i: int) -> int:
    """The id at place ``i`` of codes behind ``read(at, size)``, such as a range of a file.

    Read are the few bytes of each level's head and of one chunk, one directory entry and one stretch of the bitmap.
    """
    width, n_levels = struct.unpack("<HH", read(4, 4))
    at, size, out, shift = 8, width // 8, 0, 0
    for _ in range(n_levels):
        n, n_bits, n_ones = struct.unpack("<QQQ", read(at, 24))
        ones_at, bits_at, data_at = at + 24, at + 24 + 8 * n_ones, at + 24 + 8 * n_ones + n_bits
        if not 0 <= i < n:
            raise IndexError(i)
        out |= int.from_bytes(read(data_at + i * size, size), "little") << shift
        shift += width
        base = i // DIRECTORY
        first = bits_at + base * DIRECTORY // 8
        stretch = int.from_bytes(read(first, bits_at + i // 8 + 1 - first), "little")
        if not stretch >> (i - base * DIRECTORY) & 1:
            return out
        before = stretch & ((1 << (i - base * DIRECTORY)) - 1)
        i = struct.unpack("<Q", read(ones_at + 8 * base, 8))[0] + before.bit_count()
        at = data_at + n * size
    raise ValueError("codes end too soon")


def dac_decode(blob: bytes) -> np.ndarray:
    """All ids of a sequence."""
    out, where, shift = None, None, 0
    kind = np.dtype(np.uint32 if struct.unpack_from("<HH", blob, 4) in ((8, 1), (8, 2), (8, 3), (8, 4), (16, 1), (16, 2)) else np.uint64).type
    for width, n, bits_at, data_at in _levels(blob):
        chunk = np.frombuffer(blob, f"<u{width // 8}", n, data_at).astype(kind)
        on = np.unpackbits(np.frombuffer(blob, np.uint8, data_at - bits_at, bits_at), bitorder="little")[:n].view(bool)
        if out is None:
            out, where = chunk, np.flatnonzero(on)
        else:
            out[where] |= chunk << kind(shift)
            where = where[on]
        shift += width
    return out


SCHEMA = "part int, seq int, n_tokens long, ids array<long>, offsets array<long>, codes binary"


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of ids and texts, of about ``BLOCK`` bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def write_tokens(documents: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, segment: int = SEGMENT, parts: int | None = None) -> None:
    """Encode every whole text and write the file set to ``path``, in ascending id."""
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("token_file")
        enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        ids, offsets, held, n = [], [0], [], 0

        def flush():
            codes = dac_encode(np.frombuffer(b"".join(held), "<u4"))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array([v], k) for v, k in zip((part, seq, n, ids, offsets, codes), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_tokens", "ids", "offsets", "codes"])

        for batch in batches:
            for block in _blocks(batch):
                for i, b in zip(block.column(0).to_pylist(), enc.encode_all(block.column(1))):
                    held += [b, end]
                    n += len(b) // 4 + 1
                    ids.append(i)
                    offsets.append(n)
                    if n >= segment:
                        yield flush()
                        ids, offsets, held, n, seq = [], [0], [], 0, seq + 1
        if held:
            yield flush()

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the second key parts the rows of one id, so that they needn't lie in one task
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row")
    files = ordered.select("id", "text").mapInArrow(encode, SCHEMA).write
    with no_shuffles_left(spark), settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        # plain bytes, so that codes can be read in place
        files.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, start (tokens in all segments before), n_tokens, ids, offsets, codes of each segment."""
    segs = spark.read.schema(SCHEMA).parquet(path)
    meta = segs.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = meta.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row for each written partition
    by_part = by_part.select("part", before(Window.orderBy("part")).alias("base"))
    inner = meta.withColumn("inner", before(Window.partitionBy("part").orderBy("seq"))).drop("n_tokens")
    starts = inner.join(by_part, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("start"))
    if meta.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    return segs.join(starts, ["part", "seq"])


def document_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the segments."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("token_file")
        for batch in batches:
            for i in range(batch.num_rows):
                start, ids, offsets, codes = (c[i] for c in batch.columns)
                raw = memoryview(dac_decode(codes.as_buffer()).astype("<u4").tobytes())
                o = offsets.values.to_numpy()
                ends = (4 * o).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]
                columns = [ids.values, pa.array(start.as_py() + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # few rows a batch, as each holds a whole segment
    return segments.select("start", "ids", "offsets", "codes").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_and_digest(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    spark = documents.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(documents, path, vocabulary or vocabulary_path())
    return document_digests(read_tokens(spark, path))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
