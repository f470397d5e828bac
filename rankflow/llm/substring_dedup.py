"""Substring deduplication with Rabin-Karp hashes of token windows.

Every window of ``window`` consecutive words gets a rolling hash; windows whose hash occurs at
more than one place of the corpus are repeated, and the words that repeated windows cover
are removed as maximal intervals.

How windows are counted: a task hashes the windows of a batch of documents and sends each
*distinct* hash of the batch once to the bucket of that hash, packed in one row for each
bucket. A hash that the batch holds twice is known to be repeated there; its places go
back to their documents and its bucket entry only tells other batches. So a passage
that a third of all documents share costs a bucket one entry for each batch, and no list of
its places is ever gathered. A bucket sorts its hashes and returns, for single occurrences
that another batch has as well, the places. Places travel packed, one row for each bucket and route; documents are dealt by
the same routes, and a task reads a route's places before its documents.

A hash is 64 bits with a bucket number from an independent one, so that n windows
hold about n * n / 2**(65 + log2(buckets)) pairs of different windows that count as equal: 3e-6 for
the 10**8 windows of one gigabyte of text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import map_arrow

#: Odd bases of the two rolling hashes and the odd multipliers that mix them.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Words hashed at a time, and most text in a bucket on average.
BATCH_WORDS, BUCKET_BYTES = 1 << 19, 16 << 20
#: Words whose hash a worker remembers.
REMEMBERED = 300_000


class WordHashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()


def forget() -> None:
    """At a task's end: the worker may run tasks of other operators next."""
    _hashes.clear()
    _tables.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]), dtype=np.uint64)[:n]


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows: the difference of two prefix sums of value * base**i,
    divided by base**start (odd numbers have inverses modulo 2**64)."""
    n = len(values)
    if n < window:
        return np.empty(0, np.uint64)
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * BATCH_WORDS)
        have = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        if size == 2 * BATCH_WORDS:
            _tables[base] = have
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * have[0][:n], dtype=np.uint64)])
    return mix((sums[window:] - sums[: n - window + 1]) * have[1][: n - window + 1])


def _pack(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray, places: np.ndarray, again: np.ndarray) -> bytes:
    """A bucket's entries of one batch, by document: documents' keys and entry counts, then of
    each entry its hash and its distance from the one before in one or two bytes, whose last
    bit tells whether the batch has it again; distances too large for them follow in full."""
    step = np.diff(places, prepend=0)
    first = np.cumsum(counts) - counts
    step[first] = places[first]
    kind = np.uint8 if np.mean(step) < 100 else np.uint16
    most = np.iinfo(kind).max >> 1
    code = np.minimum(step, most).astype(kind) << 1 | again.astype(kind)
    long = step[step >= most].astype(np.uint32)
    head = np.array([len(keys), len(hashes), len(long), code.itemsize], np.uint32)
    return b"".join(x.tobytes() for x in (head, keys, counts.astype(np.uint32), long, code.astype(kind), hashes))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, entry counts, hashes, places, and whether the batch has them again."""
    n_keys, n, n_long, wide = (int(x) for x in np.frombuffer(blob, np.uint32, 4))
    kind, at, parts = (np.uint8 if wide == 1 else np.uint16), 16, []
    for dtype, length in ((np.int64, n_keys), (np.uint32, n_keys), (np.uint32, n_long), (kind, n), (np.uint64, n)):
        parts.append(np.frombuffer(blob, dtype, length, at))
        at += length * np.dtype(dtype).itemsize
    keys, counts, long, code, hashes = parts
    step = (code >> 1).astype(np.int64)
    step[step == np.iinfo(kind).max >> 1] = long
    places, first = np.cumsum(step), (np.cumsum(counts) - counts).astype(np.int64)
    places -= np.repeat(places[first] - step[first], counts)
    return keys, counts, hashes, places, (code & 1).astype(bool)


def _hash_batches(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _documents(batches):
            yield from _send(rows, window, buckets)
        forget()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Groups of (key, words) with about BATCH_WORDS words."""
    group, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            words = text.as_py().split()  # of bytes: at the space and tab ... carriage return
            group.append((key, words))
            size += len(words)
            if size >= BATCH_WORDS:
                yield group
                group, size = [], 0
    if group:
        yield group


def _send(rows: list[tuple[int, list[bytes]]], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    rows = [r for r in rows if len(r[1]) >= window]
    if not rows:
        return
    lengths = np.array([len(w) for _, w in rows])
    values = np.concatenate([word_hashes(w) for _, w in rows])
    ends = np.cumsum(lengths)
    # windows must not run over the end of their document
    start = np.arange(len(values) - window + 1)
    doc = np.repeat(np.arange(len(rows)), lengths)[: len(start)]
    inside = start + window <= ends[doc]
    hashes = rolling(values, window, BASE_A)[inside]
    bucket = (rolling(mix(values), window, BASE_B)[inside] % np.uint64(buckets)).astype(np.int64)
    doc, place = doc[inside], (start - (ends - lengths)[doc])[inside]
    _, first, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    keys = np.array([k for k, _ in rows], np.int64)

    again = count[which] > 1
    out: list[tuple[int, bool, bytes]] = []
    if again.any():
        out += [(r, True, blob) for r, blob in _by_route(keys[doc[again]], place[again], buckets)]
    once = np.sort(first)
    once = once[np.argsort(bucket[once], kind="stable")]  # by bucket, then document and place
    edges = np.flatnonzero(np.diff(bucket[once], prepend=-1))
    for part in np.split(once, edges[1:]):
        d = doc[part]
        docs_at = np.flatnonzero(np.diff(d, prepend=-1))
        counts = np.diff(np.append(docs_at, len(d)))
        out.append((int(bucket[part[0]]), False, _pack(keys[d[docs_at]], counts, hashes[part], place[part], again[part])))
    for i in range(0, len(out), 64):
        b, known, blob = zip(*out[i : i + 64])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(known, pa.bool_()), pa.array(blob, pa.binary())], ["bucket", "known", "blob"])


def _count(buckets: int):
    """Repeated places of whole buckets, one row for each route that documents take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            passed = []
            for bucket, known, blob in zip(batch.column("bucket").to_pylist(), batch.column("known").to_pylist(), batch.column("blob")):
                if known:
                    passed.append((bucket, blob.as_py()))
                    continue
                if bucket != now and blobs:
                    yield from _repeated(blobs, buckets)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
            if passed:
                yield _routed(passed)
        if blobs:
            yield from _repeated(blobs, buckets)

    return run


def _by_route(keys: np.ndarray, places: np.ndarray, routes: int) -> Iterator[tuple[int, bytes]]:
    """Places of documents, packed by the route of their key: keys, counts, places."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(edges, len(keys)))
    route = keys[edges] % routes
    order = np.argsort(route, kind="stable")
    cuts = np.flatnonzero(np.diff(route[order])) + 1
    starts = edges.astype(np.int64)
    for some in np.split(order, cuts):
        # the places of the chosen documents, one document after the other
        n = counts[some]
        at = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield int(route[some[0]]), b"".join(x.tobytes() for x in (np.array([len(some)], np.uint32), keys[edges][some], n.astype(np.uint32), places[at].astype(np.uint32)))


def _places_of(blob: bytes) -> Iterator[tuple[int, np.ndarray]]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    keys, counts = np.frombuffer(blob, np.int64, n, 4), np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
    places = np.frombuffer(blob, np.uint32, -1, 4 + 12 * n)
    yield from zip(keys.tolist(), np.split(places, np.cumsum(counts)[:-1]))


def _repeated(blobs: list[bytes], routes: int) -> Iterator[pa.RecordBatch]:
    opened = [_unpack(b) for b in blobs]
    hashes = np.concatenate([x[2] for x in opened])
    order = np.sort(hashes)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    del order
    if not len(twice):
        return
    keys_out, places_out = [], []
    for keys, counts, own, places, again in opened:
        at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        hit = np.flatnonzero((twice[at] == own) & ~again)
        keys_out.append(np.repeat(keys, counts)[hit])
        places_out.append(places[hit])
    keys, places = np.concatenate(keys_out), np.concatenate(places_out)
    if len(keys):
        yield _routed(_by_route(keys, places, routes))


def _routed(rows: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    routes, blobs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(routes, pa.int32()), pa.array(blobs, pa.binary())], ["_route", "_blob"])


def removed_mask(n: int, places: list[np.ndarray], window: int) -> np.ndarray:
    """Which of n words are covered: windows merge into maximal intervals."""
    edges = np.zeros(n + 1, np.int64)
    for start in places:
        np.add.at(edges, start, 1)
        np.add.at(edges, start.astype(np.int64) + window, -1)
    return np.cumsum(edges[:n]) > 0


def _with_places(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The documents, dealt by route, each route's after the rows that hold its places.

    Columns ``_route, _key, _known, _blob`` come before those of ``docs``.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).cast("binary").alias("text"))
    sent = map_arrow(texts, _hash_batches(window, buckets), "bucket int, known boolean, blob binary")
    # known repeats go on to their route; a task counts its buckets one after the other
    dealt = sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    places = map_arrow(dealt, _count(buckets), "_route int, _blob binary")
    rows = docs.select(F.pmod(key, F.lit(buckets)).cast("int").alias("_route"), key.alias("_key"), F.lit(None).cast("binary").alias("_blob"), *docs.columns)
    rows = rows.unionByName(places, allowMissingColumns=True)
    return rows.repartitionById(buckets, "_route").sortWithinPartitions("_route", F.col("_blob").isNull())


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """Batches of documents, with the places of each; a route's places come before its documents."""
    now, known = None, {}
    for batch in batches:
        found, documents = [], []
        for i, (route, key, blob) in enumerate(zip(batch.column("_route").to_pylist(), batch.column("_key").to_pylist(), batch.column("_blob"))):
            if route != now:
                now, known = route, {}
            if blob.is_valid:
                for k, places in _places_of(blob.as_py()):
                    known.setdefault(k, []).append(places)
            else:
                documents.append(i)
                found.append(known.get(key, []))
        if documents:
            yield (batch if len(documents) == len(batch) else batch.take(pa.array(documents))), found


def digest(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document ``doc_id, n_words, n_removed, kept_sha256``; kept words joined by a space.

    Null, empty and short texts lose nothing. Repeated rows, also with the same id, are places
    of their own and so lose all windows. The table may be empty and have other columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _gather(batches):
            rows = []
            for doc_id, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), found):
                words = (text.as_py() or b"").split()
                n = len(words)
                if places:
                    words = list(itertools.compress(words, (~removed_mask(n, places, window)).tolist()))
                rows.append((doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _with_places(rows, "doc_id", "text", window).withColumn("text", F.col("text").cast("binary"))
    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated windows' words cut out of the texts.

    A removed word goes with the white space behind it; all else of a text stays as it
    is. Rows and columns stay, whatever their names; a document may end up empty. Nulls and repeated rows: see
    :func:`digest`.
    """
    word = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
    names, schema = [f"c{i}" for i in range(len(docs.columns))], docs.schema  # the operator's own columns start with _
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _gather(batches):
            texts = []
            for text, places in zip(batch.column(names[at_text]).to_pylist(), found):
                if places:
                    raw = text.encode()
                    spans = [m.span() for m in word.finditer(raw)]
                    gone = removed_mask(len(spans), places, window).tolist()
                    text = (raw[: spans[0][0]] + b"".join(raw[a:b] for (a, b), g in zip(spans, gone) if not g)).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at_text else batch.column(c) for i, c in enumerate(names)], schema.names)

    return map_arrow(_with_places(docs.toDF(*names), names[at_id], names[at_text], window), cut_out, schema)
