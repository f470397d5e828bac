"""Token ids in seekable zstandard files.

A file holds the documents of one range of ids, in order: independent zstandard frames of
whole documents (little-endian unsigned 32-bit ids, each frame with its content
checksum), then a skippable frame with the index of documents, then the seek table of the
public seekable format: compressed size, size and checksum of every frame. A reader fetches
the tail, looks a document up and decompresses that document's frame only.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import cut, held, map_arrow, shared_folder

#: Frames end with the first document that brings them to this many bytes of ids.
FRAME_BYTES = 1 << 18
#: Fixed values of the seekable format: skippable frames' and the table's magic numbers.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<u4"), ("frame", "<u4"), ("start", "<u8"), ("n", "<u8")])
#: Words that a worker remembers the encoding of, in each of two generations.
REMEMBERED = 500_000
#: Text that is encoded at a time, and text that one file holds at most on average.
GROUP_BYTES, FILE_BYTES = 4 << 20, 256 << 20
#: White space of Unicode, as tokenizers' patterns know it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Last characters after which a space does not start a token of its own: white space, or nothing.
_OPEN = frozenset(["", *(c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c))])
#: Letters and marks (without the apostrophe, which starts tokens like 's) that are sure to part tokens.
_LETTERS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-&(-/:-@\[-`{-~"
is_word = re.compile(f"[{_LETTERS}]+").fullmatch
#: No token of the byte-level pattern crosses these pieces' ends, so each can be encoded alone.
_PIECE = re.compile(f" ?[{_LETTERS}]+(?=[{_WS}{_MARKS}]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def open_fs(uri: str):
    """The file system and path of a folder or file in any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def byte_characters() -> list[str]:
    """The printable character of every byte, by the byte-level rule: printable Latin-1
    bytes stand for themselves, the others for the characters from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def gather(pieces: list[bytes], index: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Ids of texts: text i is the pieces index[first[i]], ..., up to the next text's first one."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    n = sizes[index]
    ends = np.cumsum(n)
    ids = np.frombuffer(b"".join(pieces), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - n), n) + np.arange(n.sum())]
    raw, edges = ids.tobytes(), [0, *(4 * ends[np.append(first[1:], len(index)) - 1]).tolist()]
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


class Encoder:
    """Encodes whole texts with the tokenizers library, distinct words once.

    With the byte-level pattern and no normalizer a text can be cut before any space that follows
    no white space, and the parts encoded alone; a word of letters is one token of the pattern and goes to the
    library's model as it is. Files with other rules get whole texts, and so do
    texts that hold special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.by_word = spec["normalizer"] is None and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        self.by_word = self.by_word and model["type"] == "BPE" and not model["dropout"] and not any(c in _OPEN for s in self.special for c in s)
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        #: Ids of words after a space, as they were met lately and before, and of other pieces.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, letters: str) -> bytes:
        """Ids of letters, with or without a space before them."""
        spelled = letters.encode().decode("latin-1").translate(self.bytes)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece at whose ends tokens end."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > REMEMBERED // 2:
                self.pieces.clear()
            found = self.pieces[piece] = self.run(piece) if is_word(piece) else self.whole(piece)
        return found

    def word(self, word: str) -> bytes:
        """Ids of a space and a word."""
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                if is_word(word):
                    found = self.run(" " + word)
                else:
                    first, *rest = _PIECE.findall(" " + word)
                    found = b"".join([self.word(first[1:]) if is_word(first[1:]) else self.piece(first), *map(self.piece, rest)])
            if "\n" not in word:
                if len(self.young) > REMEMBERED:
                    self.young, self.old = {}, self.young  # words that come again move to the young ones
                self.young[word] = found
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; texts are not null."""
        if not len(texts):
            return []
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        split = pc.split_pattern(texts, " ")
        coded, first = split.flatten().dictionary_encode(), split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)
        # a space after white space is no place to cut, but for one at the start
        open_ = pc.is_in(pc.utf8_slice_codeunits(coded.dictionary, -1), pa.array(_OPEN, coded.dictionary.type)).to_numpy(zero_copy_only=False)
        wrong = open_[index]
        wrong[np.append(first[1:], len(index)) - 1] = False
        wrong[first[(words == "")[index[first]]]] = False
        slow = np.logical_or.reduceat(wrong, first)
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        slow |= special
        # pieces: the distinct words, the texts' first words (or whole slow texts), and nothing
        index[np.repeat(slow, np.diff(np.append(first, len(index))))] = len(words) + len(texts)
        heads = []
        for i, (at, odd) in enumerate(zip(coded.indices.to_numpy()[first], slow)):
            text = texts[i].as_py() if odd else words[at]
            heads.append(self.whole(text) if special[i] else b"".join(map(self.piece, _PIECE.findall(text))))
        index[first] = len(words) + np.arange(len(texts))
        used = np.zeros(len(words) + len(texts) + 1, bool)
        used[index] = True
        known = self.young.get
        pieces = [known(w) or self.word(w) if u else b"" for w, u in zip(words, used)] + [*heads, b""]
        return gather(pieces, index, first)

    def encode_long(self, text: str, most: int = GROUP_BYTES) -> bytes:
        """Ids of one text of any length, cut where spaces start tokens so that no part is much longer than ``most``."""
        if not self.by_word:
            return self.whole(text)
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + most)
            while to > 0 and text[to - 1] in _OPEN:
                to = text.find(" ", to + 1)
            to = len(text) if to < 0 else to
            out += self.encode(pa.array([text[at:to]], pa.large_string()))
            at = to
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary."""
    return held(path, lambda: Encoder(path))


def groups(batch: pa.RecordBatch, column: str, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group) | (sizes[1:] > most) | (sizes[:-1] > most)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Writer:
    """Writes one file; ``add`` takes a document's ids in order."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts: list[bytes] = []
        self.size, self.tokens, self.table, self.index = 0, 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(self.table), self.size // 4, len(ids) // 4))
        self.parts.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.parts:
            raw = b"".join(self.parts)
            frame = self.compressor.compress(raw)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.sink.write(frame)
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.compressor.compress(np.array(self.index, INDEX).tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table + struct.pack("<I", len(index) + 8))


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        end = source.size()
        tail = source.read_at(13, end - 13)
        frames, flags, magic, index_size = struct.unpack("<IBII", tail)
        if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a file of token ids")
        table_at = end - 13 - 12 * frames
        self.table = np.frombuffer(source.read_at(12 * frames, table_at), "<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index_at = table_at - 8 - index_size
        index = source.read_at(index_size, index_at)
        if struct.unpack_from("<I", index)[0] != INDEX_MAGIC or index_at != self.at[-1]:
            raise ValueError("the index of documents is missing")
        self.index = np.frombuffer(self.decompressor.decompress(index[8:]), INDEX)

    def frame(self, k: int) -> np.ndarray:
        """The ids of one frame; both checksums are verified."""
        import xxhash

        raw = self.decompressor.decompress(self.source.read_at(int(self.table[k, 0]), int(self.at[k])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in order, of all documents or of the wanted ones; only their frames are read."""
        k, ids = -1, None
        for doc_id, has_id, frame, start, n in self.index.tolist():
            if wanted is None or (has_id and doc_id in wanted):
                if frame != k:
                    k, ids = frame, self.frame(frame)
                yield doc_id if has_id else None, ids[start : start + n]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document and write the files; returns ``file, path, n_docs, n_tokens, start``.

    ``start`` is the number of ids in the files before. Files are numbered by ascending
    doc_id (rows without one come first); rows with equal ids follow by text, equal rows are documents of
    their own. ``end_id`` ends each document, also null and empty texts. A task writes its file under a name of
    its own and renames it at the end, so lost and repeated tasks leave one whole file. An empty table
    makes no file; other columns, whatever their names, are ignored. By default there are as many files as the
    session has shuffle partitions, and more where a file would hold more than FILE_BYTES of text. A file's index is
    all of it that a task holds in memory.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        fs, at = open_fs(folder)
        name, writer, sink, docs_here = f"{at}/part-{number:07d}.ids", None, None, 0
        own = f"{at}/_{uuid.uuid4().hex}.tmp"
        code = encoder(tokenizer)
        for batch in batches:
            for group in groups(batch, "text"):
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    sink = fs.open_output_stream(own)
                    writer = Writer(sink)
                texts = group.column("text")
                long = len(texts) == 1 and len(texts[0].as_buffer()) > 2 * GROUP_BYTES
                for doc_id, ids in zip(group.column("doc_id").to_pylist(), [code.encode_long(texts[0].as_py())] if long else code.encode(texts)):
                    writer.add(doc_id, ids + end)
                docs_here += len(group)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, name)
            uri = f"{folder}/part-{number:07d}.ids"
            yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int32()), "path": [uri], "n_docs": pa.array([docs_here], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})

    written = cut(map_arrow(rows, write, "file int, path string, n_docs long, n_tokens long", keep=tokenizer))
    # one row for each file
    return written.withColumn("start", F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens"))


def read_token_files(written: DataFrame) -> DataFrame:
    """Read all documents back: ``doc_id, start, n_tokens, ids_crc32``; a task reads one file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as source:
                    out: list[tuple] = []
                    for doc_id, ids in Reader(source).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    files = (written.agg(F.max("file")).first()[0] or 0) + 1
    return map_arrow(written.select("file", "path", "start").repartitionById(files, "file"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])
