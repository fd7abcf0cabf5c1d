"""Token ids as binary files: ranks by frequency in a byte-aligned code, control bytes apart from data.

A file holds the documents of a range of doc_ids, in ascending order:

    magic "GLID", version, ids in a block (unsigned 32-bit), documents, ids, blocks (unsigned 64-bit)
    the documents' ids (64-bit), whether they have one (a byte each), and their numbers of token ids (64-bit)
    the byte where each block begins, and the end of the last (64-bit, counted from the first block)
    the blocks: two control bits for every id, four to a byte, then the bytes of all ids

All numbers are little-endian. A token id is stored as its rank, the most frequent first, in as many
bytes (one to four) as its control bits tell, less one. ``ranks.bin`` beside the files has the token
id of every rank, 32 bits each. Blocks are decoded on their own: lengths come from a table by control
byte, the data bytes are spread by a mask from a table by length, ranks turn into ids by a table.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphlake.llm.common import discard, gathered, setting, written
from glyphlake.sources.durable import shared_dir
from glyphlake.sources.files import Attempt, Files, FilesWriter, read_files, write_files

MAGIC, VERSION, HEAD = b"GLID", 1, struct.Struct("<4sIIQQQ")
#: Ids in a block, in a file (more only if one document has more) and in a task that writes files.
BLOCK_IDS, FILE_IDS, TASK_IDS = 1 << 18, 16 << 20, 64 << 20
#: Texts in a batch, and words that a worker remembers, up to twice.
BATCH, WORDS = 256, 100_000
#: Words that are encoded as one text where their tokens tell them apart, and texts that the library has at once.
TOGETHER, AT_ONCE = 200, 50
#: Marks that may stand after a word's letters, and the first character beyond the Latin ones.
MARKS, LATIN = ".,;:!?$&*#%()[]-", "\u0250"
RANKS = "ranks.bin"

#: The four lengths of every control byte; which of four bytes are there at each length.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
THERE = np.arange(4) < np.arange(5)[:, None]


def coded(ranks: np.ndarray) -> bytes:
    """A block: control bytes, then data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = np.searchsorted([1 << 8, 1 << 16, 1 << 24], ranks, side="right").astype(np.uint8) + 1
    bits = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    bits[: len(ranks)] = lengths - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes() + ranks.view(np.uint8).reshape(-1, 4)[THERE[lengths]].tobytes()


def decoded(block: bytes | memoryview, n: int) -> np.ndarray:
    """The n ranks of a block; an error if its bytes are not as many as its control bytes tell."""
    control = -(-n // 4)
    lengths = LENGTHS[np.frombuffer(block, np.uint8, control)].ravel()[:n]
    data = np.frombuffer(block, np.uint8)[control:]
    if len(data) != lengths.sum(dtype=np.int64):
        raise ValueError("a damaged block of token ids")
    out = np.zeros((n, 4), np.uint8)
    out[THERE[lengths]] = data
    return out.view("<u4").ravel()


def packed(doc_ids: list, ranks: list[np.ndarray]) -> bytes:
    """A file of documents with these ids (None: none) and ranks of token ids."""
    flat = np.concatenate(ranks) if ranks else np.zeros(0, "<u4")
    blocks = [coded(flat[i : i + BLOCK_IDS]) for i in range(0, len(flat), BLOCK_IDS)]
    starts = np.r_[0, np.cumsum([len(b) for b in blocks])]
    head = HEAD.pack(MAGIC, VERSION, BLOCK_IDS, len(doc_ids), len(flat), len(blocks))
    own = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    return b"".join([head, own, np.array([len(r) for r in ranks], "<i8").tobytes(), starts.astype("<i8").tobytes(), *blocks])


def unpacked(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, numbers of token ids, ranks of all documents one after another) of a file; a ValueError if it is damaged."""
    magic, version, size, docs, ids, blocks = HEAD.unpack_from(content)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a file of token ids")
    at = HEAD.size
    own = np.frombuffer(content, "<i8", docs, at)
    there = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(content, "<i8", docs, at + 9 * docs)
    starts = np.frombuffer(content, "<i8", blocks + 1, at + 17 * docs)
    first, view = at + 17 * docs + 8 * (blocks + 1), memoryview(content)
    ranks = np.empty(ids, "<u4")
    for b in range(blocks):
        part = ranks[b * size : (b + 1) * size]
        part[:] = decoded(view[first + starts[b] : first + starts[b + 1]], len(part))
    if counts.sum() != ids or first + starts[-1] != len(content):
        raise ValueError("a damaged file of token ids")
    return [int(d) if t else None for d, t in zip(own, there, strict=True)], counts, ranks


class Recent(dict):
    """What is known of words, for those that were met lately: twice ``most`` at most, and a word that is met again stays."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        """Where too many words are known, those of the time before last are forgotten."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def unknown(self, wanted: set[str]) -> list[str]:
        """The wanted words that nothing is known of; the others are at hand until the next turn."""
        new = wanted.difference(self)
        again = new & self.old.keys()
        self.update((w, self.old[w]) for w in again)
        return list(new - again)


class Words:
    """A tokenizer and what is known of words and their pieces, for one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.tokenizer, self.words, self.pieces = Tokenizer.from_file(path), Recent(WORDS), Recent(WORDS)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def encoded(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of the texts, some at a time: the library keeps far more of a text than its ids."""
        for i in range(0, len(texts), AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False):
                yield e.ids

    def learn(self, parts: list[str], code: str) -> None:
        """Encode pieces, those of letters alone many to a text: a token that ends a word tells where the next one begins."""
        plain = [p for p in parts if p.isalpha()] if self.ends.any() else []
        rest = list(set(parts).difference(plain))
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self.encoded([" ".join(g) for g in groups]), strict=True):
            upto = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(upto) != len(group) or upto[-1] != len(ids):
                rest += group
                continue
            data, size = array(code, ids).tobytes(), array(code).itemsize
            at = 0
            for piece, end in zip(group, upto, strict=True):
                self.pieces[piece] = data[at : end * size]
                at = end * size
        for piece, ids in zip(rest, self.encoded(rest), strict=True):
            self.pieces[piece] = array(code, ids).tobytes()


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def id_type(path: str, end_id: int) -> str:
    """The narrowest of numpy's kinds that holds all ids of a tokenizer."""
    return "<u2" if max(_words(path).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"


def _apart(word: str) -> tuple[str, str]:
    """A word's letters and the marks after them, where it is Latin letters and plain marks, else all of it and nothing.

    Letters and marks are never one token, and the tokenizer makes letters small itself.
    """
    letters = word.rstrip(MARKS)
    small = letters.lower()
    if small.isalpha() and (letters.isascii() or max(letters) < LATIN):  # small letters may bring marks of their own
        return small, word[len(letters) :]
    return word, ""


def encoded_texts(texts: pa.Array | list, path: str, kind: str, by_words: bool) -> list[bytes]:
    """Ids of each text (null: empty), as bytes; ``by_words`` looks each different word between spaces and line ends up once."""
    at_hand = _words(path)
    code = {"<u2": "H", "<u4": "I"}[kind]
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    if not by_words:
        return [array(code, ids).tobytes() for ids in at_hand.encoded(texts.to_pylist())]
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    places = cut.flatten().dictionary_encode()
    own = places.dictionary.to_pylist()
    words, pieces = at_hand.words, at_hand.pieces
    words.turn()
    new = {w: _apart(w) for w in words.unknown(set(own))}
    pieces.turn()
    at_hand.learn(pieces.unknown(set(chain.from_iterable(new.values()))), code)
    words.update((w, pieces[a] + pieces[b]) for w, (a, b) in new.items())
    ids = pa.array(map(words.__getitem__, own), pa.large_binary()).take(places.indices)  # all words' ids, one after another
    _, ends, data = ids.buffers()
    if data is None:
        return [b""] * len(texts)
    ends = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
    view = memoryview(data)
    return [bytes(view[a:b]) for a, b in zip(ends, ends[1:])]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, by_words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids): the token ids of every text, null counting as empty, and the end id after them.

    ``ids`` are little-endian numbers of ``id_type``. The tokenizer's file must be at its path on every
    executor. ``by_words`` may be set for tokenizers that drop white space, so that no token depends on
    what is beyond a space or line end; ids are then those of the whole text.
    """
    kind = id_type(tokenizer_path, end_id)
    end = np.array([end_id], kind).tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            ids = [b + end for b in encoded_texts(batch.column("text"), tokenizer_path, kind, by_words)]
            n = pa.array([len(b) // len(end) for b in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(kernel, "doc_id long, n long, ids binary")


def id_counts(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each token id stands in all documents; a task hands on no more rows than there are ids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORDS.clear()
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            total = np.r_[total, np.zeros(max(0, len(got) - len(total)), np.int64)]
            total[: len(got)] += got
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])

    return encoded.select("ids").mapInArrow(kernel, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def packed_files(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Files (name, content) of documents (doc_id, ids) that come in order, named by the task and their place in it."""
    part, k, own, ranks, size = TaskContext.get().partitionId(), 0, [], [], 0

    def file() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{k:06d}.ids"]), pa.array([packed(own, ranks)], pa.binary())], ["name", "content"])

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            got = rank_of[np.frombuffer(ids.as_buffer(), kind)]
            if own and size + len(got) > FILE_IDS:
                yield file()
                k, own, ranks, size = k + 1, [], [], 0
            own.append(doc_id)
            ranks.append(got)
            size += len(got)
    if own:
        yield file()


class IdFilesWriter(FilesWriter):
    """Packs rows (doc_id, ids) into files where they are written, so that a task has one Python worker."""

    def __init__(self, path: str, overwrite: bool, kind: str):
        super().__init__(path, overwrite)
        self.kind = kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        _WORDS.clear()  # a worker that has encoded texts before needs its room now
        store, root, _ = self._area()
        with store.open_input_file(f"{root}/{RANKS}") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
        rank_of[by_rank] = np.arange(len(by_rank))
        return super().write(packed_files(iterator, rank_of, self.kind))


class IdFiles(Files):
    """The data source ``glyphlake_ids``; its options are path, a folder with a file of ranks, and kind, see ``id_type``."""

    @classmethod
    def name(cls) -> str:
        return "glyphlake_ids"

    def writer(self, schema: StructType, overwrite: bool) -> IdFilesWriter:
        return IdFilesWriter(self.options["path"], overwrite, self.options["kind"])


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, by_words: bool = False) -> None:
    """Encode all texts of (doc_id, text) and write files of token ids under the folder, in ascending doc_id order.

    Documents without an id come first, repeated ids in the order of a hash of their token ids. File
    names in alphabetical order are the documents' order. Ranks need the counts of all documents, so
    encoded texts are kept in between. An empty table writes ranks of no ids and no other file. The
    ranks are written first, the files of ids then appear together once all are written.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer_path, end_id)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        encoded = written(encode(docs, tokenizer_path, end_id, by_words), "ids")
        counts = id_counts(encoded, kind).orderBy(F.desc("n"), "id").collect()  # a row for each id of the vocabulary at most
        by_rank = np.array([r.id for r in counts], "<u4")
        write_files(spark.createDataFrame([(RANKS, bytearray(by_rank.tobytes()))], "name string, content binary"), folder)
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.n for r in counts) // TASK_IDS))
        mark = F.xxhash64("ids")
        placed = encoded.select("doc_id", "ids", mark.alias("mark")).repartitionByRange(n, F.asc_nulls_first("doc_id"), "mark").sortWithinPartitions(F.asc_nulls_first("doc_id"), "mark", "ids")
        spark.dataSource.register(IdFiles)
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            placed.select("doc_id", "ids").write.format(IdFiles.name()).option("kind", kind).mode("append").save(folder)
    discard(encoded)


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(file, place, doc_id, first, n, ids) of every document in the files of a folder.

    ``place`` counts the documents of a file, ``first`` the token ids before the document there; ids are
    bytes of little-endian unsigned 32-bit numbers, or with ``digest`` their crc32 in the column crc32.
    """
    table = read_files(spark, folder, RANKS).collect()  # one row, four bytes for each id of the vocabulary
    by_rank = np.frombuffer(bytes(table[0].content), "<u4") if table else np.zeros(0, "<u4")

    def documents(contents: Iterable[tuple[str, bytes]]) -> Iterator[tuple]:
        for name, content in contents:
            own, counts, ranks = unpacked(content)
            firsts = np.r_[0, np.cumsum(counts)]
            ids = by_rank[ranks]
            yield name, own, firsts[:-1], counts, [ids[a:b].tobytes() for a, b in zip(firsts, firsts[1:])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((n.as_py(), c.as_buffer()) for n, c in zip(batch.column("name"), batch.column("content"), strict=True))
            for name, own, firsts, counts, ids in documents(rows):
                last = pa.array([zlib.crc32(b) for b in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                columns = [pa.array([name] * len(own)), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), last]
                yield pa.RecordBatch.from_arrays(columns, ["file", "place", "doc_id", "first", "n", "crc32" if digest else "ids"])

    kind = "crc32 long" if digest else "ids binary"
    return read_files(spark, folder, "*.ids").mapInArrow(kernel, f"file string, place int, doc_id long, first long, n long, {kind}")


def digests(docs: DataFrame, tokenizer_path: str, end_id: int, by_words: bool = False) -> DataFrame:
    """doc_id, start (token ids of all documents before it), n_tokens and ids_crc32 of every document, as the files have them.

    Writes the files, reads them back and removes them. A file's start is a running sum over the
    files, whose number follows from TASK_IDS and FILE_IDS.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/glyphlake-idfiles-{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer_path, end_id, by_words)
    read = written(read_ids(spark, folder, digest=True), "id-digests")
    discard(read_files(spark, folder))
    sizes = read.groupBy("file").agg(F.sum("n").alias("size"))
    offsets = sizes.select("file", (F.sum("size").over(W.orderBy("file")) - F.col("size")).alias("offset"))
    return read.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
