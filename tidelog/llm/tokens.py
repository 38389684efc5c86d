"""Token-id output: documents as files of compressed token ids, and reading them back.

Documents are dealt to shards by ranges of their id, so shards and documents within a shard are in
ascending order; the number of shards grows with the table's bytes, and is that of the cores at least. A shard is a run of segments; a
segment holds whole documents, about SEGMENT ids of them, as an index of lengths, the table of its ids'
frequencies and the frames of the context-mixing coder (see coder.py). Segments are rows of a table in
the shared folder, so a lost executor costs its tasks only.

The tokenizer is one of the given vocabularies. Its rules never join characters across white
space, so a text's ids are those of its white-space-separated pieces in turn, which are kept.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import coder, merges
from tidelog.llm import textkit as tk

END = 2
SEGMENT = coder.BLOCK * 4096
#: Bytes of the words that a worker remembers: those it meets first, in arrays, some 30 bytes each. Others are kept for their batch.
MEMORY = 512 << 10
#: Bytes of texts that are tokenized together.
TEXTS = 4 << 20
#: Bytes of texts after which a worker gives back free memory.
GIVEN_BACK = 16 << 20
#: Stands between pieces that are encoded in one call; a control character that is one token of its own.
PART, TOGETHER = "\x01", 512

#: The rules under which plain pieces can be cut here: lower case, then runs of letters, single digits, runs of signs.
RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
_DIGIT, _SIGN = 1, 2
#: Kinds of bytes; 0 are letters, of which those beyond ASCII that are plain are U+00C0 to U+00FF, in UTF-8 0xC3 and one more.
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
#: Bytes that no plain piece has: apostrophes, controls, the starts of other letters.
_ODD = np.ones(256, bool)
_ODD[0x21:0x7F] = _ODD[0x80:0xC0] = _ODD[0xC3] = False
_ODD[0x27] = True
#: The letter that stands for each byte in the vocabulary; white space stays.
_LETTERS = np.arange(256, dtype="<u4")
_hidden = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_LETTERS[_hidden] = 256 + np.arange(len(_hidden))
_LETTERS[0x20] = 0x20
#: That of each byte that plain words have.
_PLAIN = {b: chr(_LETTERS[b]) for b in range(0x21, 0x100) if not _ODD[b]}

#: Bytes of a shard as the table's files or plan hold them, at most about.
SHARD_BYTES = 16 << 20

SCHEMA = "shard int, segment int, shard_start long, n_ids long, doc_ids binary, known binary, lengths binary, prior binary, frames binary"


class Tokenizer:
    """Ids of texts from a tokenizers file that splits at white space before anything else.

    Of the distinct pieces between white space, those of plain characters are cut into the words, in lower case, that
    the file's rules make of them, and only the library's model is asked for a word's ids. Other pieces, and all where
    the file has other rules, go through the library whole. Ids of words and whole pieces are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library
        from tokenizers import pre_tokenizers

        self.library = Library.from_file(path)
        self.part = self.library.encode(PART, add_special_tokens=False).ids
        rules = json.loads(self.library.to_str())
        self.plain = [rules["normalizer"], rules["pre_tokenizer"]] == RULES and len(self.part) == 1 and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        try:
            self.merges = merges.Merges(rules["model"], _PLAIN) if self.plain else None
        except (KeyError, ValueError):
            self.merges = None
        del rules
        self.words = Library(self.library.model)  # the same model, without the rules
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known = pa.array([], pa.large_binary())
        self.stored, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int32)
        self.held = 0

    def cut(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers for n parts, from ids with the sign between the parts; none if a part holds the sign."""
        signs = np.flatnonzero(ids == self.part[0]) if len(self.part) == 1 else ids[:0]
        if len(signs) != n - 1:
            return None
        sizes = np.diff(np.concatenate([[-1], signs, [len(ids)]])) - 1
        return np.delete(ids, signs).astype(np.uint16), sizes

    def encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in turn, and how many each has."""
        texts = [p.decode() for p in pieces]
        ids = np.array(self.library.encode_batch_fast([f" {PART} ".join(texts)], add_special_tokens=False)[0].ids, np.int64)
        found = self.cut(ids, len(texts))
        if found is None:
            each = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
            found = np.array([i for x in each for i in x], np.uint16), np.array([len(x) for x in each])
        return found

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, all at once."""
        data, at = tk.raw(words)
        return self.merges.ids(data, at[:-1], np.diff(at))

    def modelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words that ``merges`` doesn't take."""
        text = _LETTERS[np.frombuffer(f" {PART} ".encode().join(words), np.uint8)].tobytes().decode("utf-32-le")
        return self.cut(np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), len(words))

    def parts(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words of plain pieces and other pieces whole; how many parts each piece has; whether a part is a whole piece."""
        data, at = tk.raw(pieces)
        lead, after = data == 0xC3, (data & 0xC0) == 0x80
        behind, ahead = np.zeros(len(data), bool), np.zeros(len(data), bool)
        behind[1:], ahead[:-1] = lead[:-1], after[1:]
        odd = _ODD[data] | (after != behind) | (lead & ~ahead) | (after & ((data == 0x97) | (data == 0xB7)))
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        sizes = np.diff(at)
        if self.plain:
            marks = np.concatenate([[0], np.cumsum(odd)])
            whole = marks[at[1:]] > marks[at[:-1]]
        else:
            whole = np.ones(len(sizes), bool)
        inside = np.repeat(whole, sizes)
        kind = _KIND[data]
        first = kind == _DIGIT
        first[1:] |= kind[1:] != kind[:-1]
        first &= ~inside
        first[at[:-1][sizes > 0]] = True
        lower = tk.LOWER[data] + ((after & (data < 0x9F)).view(np.uint8) << 5)
        starts = np.append(np.flatnonzero(first), len(data))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(np.where(inside, data, lower))])
        return found, np.diff(np.searchsorted(starts[:-1], at)), inside[starts[:-1]]

    def ids(self, texts: pa.Array | list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts, each with the end id."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        # ASCII white space only: all of it is white space to the tokenizer as well
        split = pc.ascii_split_whitespace(texts)
        pieces, ends = split.flatten().dictionary_encode(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        del split
        parts, counts, whole = self.parts(pieces.dictionary)
        parts = parts.dictionary_encode()
        where, distinct = parts.indices.to_numpy(), parts.dictionary
        as_piece = np.zeros(len(distinct), bool)
        as_piece[where[whole]] = True
        place = pc.index_in(distinct, value_set=self.known)
        fresh = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        # words that are merged here, other words, whole pieces
        way = np.ones(len(fresh), np.int8)
        if self.merges:
            way[np.diff(tk.raw(distinct)[1])[fresh] <= merges.LONGEST] = 0
        way[as_piece[fresh]] = 2
        fresh = fresh[np.argsort(way, kind="stable")]
        n_merged, n_words = np.cumsum(np.bincount(way, minlength=3))[:2].tolist()
        place = place.fill_null(0).to_numpy().copy()
        place[fresh] = len(self.known) + np.arange(len(fresh))
        new = distinct.take(pa.array(fresh))
        found = [(self.stored, self.sizes)]
        if n_merged:
            found.append(self.merged(new.slice(0, n_merged)))
        for encode, i, j in ((self.modelled, n_merged, n_words), (self.encoded, n_words, len(fresh))):
            found += [encode(new.slice(k, min(TOGETHER, j - k)).to_pylist()) for k in range(i, j, TOGETHER)]
        stored, sizes = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int32)
        # distinct pieces, then the end as one more, then the texts
        of_piece, n_of_piece = _joined(stored, sizes, place[where], counts)
        of_piece, n_of_piece = np.append(of_piece, np.uint16(END)), np.append(n_of_piece, np.int32(1))
        order = np.insert(pieces.indices.to_numpy(), ends, len(n_of_piece) - 1)
        every, lengths = _joined(of_piece, n_of_piece, order, np.diff(ends + np.arange(1, len(ends) + 1), prepend=0))
        if self.held < MEMORY and len(fresh):
            self.held += int(pc.sum(pc.binary_length(new)).as_py())
            self.known, self.stored, self.sizes = pa.concat_arrays([self.known, new]), stored, sizes
        return np.split(every, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _joined(items: np.ndarray, sizes: np.ndarray, order: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ``counts`` runs each: the items of run after run in ``order``, and how many each group has."""
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    taken = sizes[order]
    ends = np.cumsum(taken, dtype=np.int32)
    places = np.repeat(starts[order] - ends + taken, taken)
    places += np.arange(len(places), dtype=np.int32)
    total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return items[places], np.diff(total).astype(np.int32)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def write(docs: DataFrame, path: str, vocabulary: str, shards: int | None = None, segment: int = SEGMENT) -> None:
    """Segments of (doc_id, text) as a table at ``path``.

    Null and empty texts are the end id alone. A null doc_id comes first. Rows that share a doc_id are in
    order of the hash of their text, then of the text, so that they can lie in several shards; rows alike
    in both are one after the other. Other columns are left out. An empty table gives a table of no rows.
    A text is tokenized whole; its ids are held twice, and its pieces as arrays once, in its task.
    """
    tk.short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # no more than that: the coder's cost falls with the number of blocks that it works on at once
    shards = shards or max(docs.sparkSession.sparkContext.defaultParallelism, -(-tk.size_of(docs) // SHARD_BYTES))
    # rows alike in id and text may be of any number: their own number deals them out and changes nothing else
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(shards, "doc_id", "hash", "number").sortWithinPartitions("doc_id", "hash", "text").drop("hash", "number")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        docs: list[np.ndarray] = []
        ids: list[tuple[int, bool]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(d) for d in docs], np.int64)
            whole = np.concatenate(docs)
            docs.clear()
            prior, frames = coder.compress(whole)
            numbers = np.array([i for i, _ in ids], np.int64)
            known = np.array([k for _, k in ids], np.uint8)
            cells = [[shard], [number], [start], [held], [numbers.tobytes()], [known.tobytes()], [lengths.tobytes()], [prior], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in tk.lean(batches, GIVEN_BACK):
            texts = tk.text_array(b.column("text"))
            sizes = np.diff(tk.raw(texts)[1])
            keys, valid = b.column("doc_id").fill_null(0).to_pylist(), b.column("doc_id").is_valid().to_pylist()
            for i, j in tk.pieces(sizes, TEXTS):
                for k, doc in enumerate(tokenizer(vocabulary).ids(texts.slice(i, j - i)), i):
                    if docs and held + len(doc) > segment:
                        yield flush()
                        number, start, held = number + 1, start + held, 0
                        ids.clear()
                    docs.append(doc)
                    ids.append((keys[k], valid[k]))
                    held += len(doc)
                    del doc
            del texts, sizes, keys, valid, b
        if docs:
            yield flush()

    ranged.mapInArrow(work, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ``ids`` if asked for.

    Everything comes from the files: frames are decoded and checked, documents cut by the index.
    """
    segments = spark.read.schema(SCHEMA).parquet(path)
    # as many rows as shards
    totals = sorted((r.shard, r.n) for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    starts = tk.values(spark, shard=pa.array([s for s, _ in totals], pa.int32()), before=pa.array(before[:-1], pa.int64()))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.lean(batches):
            for r in b.to_pylist():
                tokens = coder.decompress(r["prior"], r["frames"])
                lengths = np.frombuffer(r["lengths"], np.int64)
                if len(tokens) != lengths.sum():
                    raise coder.CorruptBlock("the index and the frames differ in length")
                ends = np.cumsum(lengths)
                wide = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                known = np.frombuffer(r["known"], np.uint8) == 0
                columns = [pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=known), pa.array(r["before"] + r["shard_start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return segments.join(F.broadcast(starts), "shard").mapInArrow(work, schema)


def digest(docs: DataFrame, vocabulary: str, **options: object) -> DataFrame:
    """Write the documents to the shared folder and return what the files say of each."""
    path = tk.shared_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, **options)
    return read(docs.sparkSession, path, ids=False)
