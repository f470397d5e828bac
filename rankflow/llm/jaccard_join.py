"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word n-grams. Documents with equal sets form a class that
is handled once. For sets whose Jaccard similarity reaches the threshold:

* Tokens are ordered from rare to frequent. Of a set of n tokens a partner misses at most
  m = n - ceil(threshold * n). Rare tokens are indexed one by one: any m + 1 of them hold one that the partner has.
* Frequent tokens are dealt to classes by their hash and indexed as combinations of k tokens of one class.
  c tokens of a class are as good as c - k + 1 rare ones, as a partner that misses fewer has k of them, so
  the prefix is extended until rare tokens and classes together outnumber the misses. Prefixes are heads of one
  order, so what the shorter one shares with the partner's set lies in the partner's prefix as well.
* The number of classes grows with the misses, so entries grow in proportion to a set at any size. Sizes from one power of two to
  the next, a band, have one number of classes; sets that a partner in the next band can have are indexed for that band too.
* A token that a single document has needs no entry, as no partner can share it.
* Candidates are verified on the exact sets.

Frequencies are counted over all documents in a table whose size follows the data up to SLOTS counters (a
token adds to the counter of its hash; no count is capped), which is broadcast in one byte for each counter, its level. Any
common order is right; the counts only make it a good one: the more tokens share a counter, the
more candidates are compared in vain. Which documents have candidates at
all is told to the scan by a bit table of fixed size, so only their sets are shuffled;
what the table lets through by chance a join takes out again.

Groups that share an index entry are not expanded into pairs at once. In star rounds every
member is compared with one leader of its entry; members that are already connected need no
further comparison, and the last round compares what is still in different components: pairs in
entries of few members, and blocks of members in larger ones. Large entries of the same leader
(their member of least hash) overlap and form one group. A task holds two blocks of a
group, counts common tokens as a product of two matrices, and emits links that span the blocks'
components, never pairs. So components are exact. What an entry needs to know of all its members (leader, components,
number) is an aggregate with partial results that is joined back, so that a large entry does not meet in one task.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import cut, map_arrow
from rankflow.llm.components import components, spanning
from rankflow.llm.substring_dedup import forget, mix, rolling, word_hashes

#: Most counters of token frequencies (there is one for so many bytes of text), and bits of the table of candidates.
SLOTS, SLOT_BYTES, BITS = 1 << 26, 4, 1 << 24
#: A token is frequent if its counter is this far above twice the mean counter.
FREQUENT = 256
#: Frequent tokens that are combined, and misses for each class of them.
COMBINED, CLASS_MISSES = 2, 3
STAR_ROUNDS = 2
#: Members up to which the last round compares an entry in pairs; members and tokens of a block beyond; width of a product.
FEW, BLOCK, BLOCK_TOKENS, WIDTH = 16, 512, 1 << 21, 4096
BASE = 0x9FB21C651E98DF25


def token_set(text: bytes, ngram: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text's words, A-Z in lower case.

    A text with fewer words gives its whole sequence as one token; without words, none.
    """
    words = text.lower().split()  # of bytes: only A-Z change, and only the six white space bytes part
    if not words:
        return np.empty(0, np.uint64)
    values = word_hashes(words)
    if len(words) < ngram:
        return rolling(values, len(words), BASE) + np.uint64(len(words))
    return np.unique(rolling(values, ngram, BASE))


def misses(n: int, percent: int) -> int:
    """How many tokens of a set of n a partner can miss."""
    return n - -(-percent * n // 100)


def bands(n: int, percent: int) -> list[int]:
    """The bands for which a set of n tokens is indexed: its own, and the next where partners can be in it."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n >= percent << own + 1 else [own]


@cache
def combining(band: int, percent: int, k: int = COMBINED) -> tuple[int, int]:
    """Tokens in a combination and classes of frequent tokens, for a band.

    The smallest set that is indexed for the band must have more tokens than its misses and the k - 1 that
    every class can take without effect; very small sets combine fewer tokens.
    """
    least = max(1, -(-percent * (1 << band) // 100))
    shared = -(-percent * least // 100)  # tokens that the smallest set and its partner have in common
    while k > 1 and shared <= k - 1:
        k -= 1
    wanted = max(1, misses((2 << band) - 1, percent) // CLASS_MISSES)
    return k, min(wanted, (shared - 1) // (k - 1)) if k > 1 else wanted


@cache
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


def combinations(tokens: np.ndarray, needed: int, k: int, classes: int) -> np.ndarray:
    """Entries of so many frequent tokens, the first ones, that they are worth ``needed`` rare ones."""
    kind = (mix(tokens) % np.uint64(classes)).astype(np.int64)
    by_kind = np.argsort(kind, kind="stable")
    sizes = np.bincount(kind, minlength=classes)
    rank = np.empty(len(tokens), np.int64)
    rank[by_kind] = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    enough = np.searchsorted(np.cumsum(rank >= k - 1), needed) + 1  # the k-th token of a class is the first that counts
    tokens, by_kind = tokens[:enough], by_kind[by_kind < enough]
    out = []
    for some in np.split(by_kind, np.flatnonzero(np.diff(kind[by_kind])) + 1):
        if len(some) >= k:
            chosen = tokens[some][_choices(len(some), k)]  # in the order of frequency, which partners share
            entry = mix(chosen[:, 0])
            for column in chosen.T[1:]:
                entry = mix(entry * np.uint64(BASE) + column)
            out.append(entry)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent: float, percent: int, k: int = COMBINED) -> np.ndarray:
    """Index entries of a set; ``counts`` has the levels of a power of two of counters."""
    size = len(tokens)
    m = misses(size, percent)
    count = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]
    plans = [combining(b, percent, k) for b in bands(size, percent)]
    take = min(size, m + 1 + max((k_ - 1) * classes for k_, classes in plans))
    if size > 4 * take:  # only the head of the order is needed
        edge = np.partition(count, take - 1)[take - 1]
        near = count <= edge
        tokens, count = tokens[near], count[near]
    order = np.lexsort((tokens, count))[:take]
    tokens, count = tokens[order], count[order]
    rare = min(m + 1, int((count < frequent).sum()))
    out = [tokens[:rare][count[:rare] > 1]]
    if rare <= m:
        out += [combinations(tokens[rare:], m + 1 - rare, k_, classes) for k_, classes in plans]
    return np.unique(np.concatenate(out))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        yield doc_id, text.as_py() or b""


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte, in order: exact below 128, then eight steps for each doubling."""
    counts = np.asarray(counts, np.float64)
    return np.where(counts < 128, counts, np.minimum(255, 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128)))).astype(np.uint8)


def _table(part: int, *blobs: np.ndarray) -> pa.RecordBatch:
    """A row with the number of a part and compressed arrays."""
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in blobs)], ["part", "table", "slots", "above"][: 1 + len(blobs)])


PACKED = "part int, table binary"
COUNTED = "part int, table binary, slots binary, above binary"


def _count_slots(ngram: int, size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(size, np.uint8), [], 0
        above: dict[int, int] = {}  # what the few counters that are full have counted beyond 255

        def add() -> None:
            slots, n = np.unique(np.concatenate(waiting), return_counts=True)
            total = counts[slots] + n
            full = total > 255
            for slot, more in zip(slots[full].tolist(), (total[full] - 255).tolist()):
                above[slot] = above.get(slot, 0) + more
            counts[slots] = np.minimum(255, total)

        for batch in batches:
            for _, text in _texts(batch):
                waiting.append((token_set(text, ngram) & np.uint64(size - 1)).astype(np.uint32))
                held += len(waiting[-1])
                if held > 1 << 20:
                    add()
                    waiting, held = [], 0
        if held:
            add()
        forget()
        slots = np.sort(np.fromiter(above, np.int64, len(above)))
        more, width = np.array([above[s] for s in slots.tolist()], np.int64), size // parts
        for i, part in enumerate(np.split(counts, parts)):
            if part.any():
                lo, hi = np.searchsorted(slots, [i * width, (i + 1) * width])
                yield _table(i, part, slots[lo:hi] - i * width, more[lo:hi])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, *blobs in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in ("table", "slots", "above"))):
            table, slots, above = (np.frombuffer(zlib.decompress(x.as_py()), kind) for x, kind in zip(blobs, (np.uint8, np.int64, np.int64)))
            if part not in sums:
                sums[part] = np.zeros(len(table), np.int64)
            sums[part] += table
            sums[part][slots] += above
    for part, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(levels(counts).tobytes(), 1)], pa.binary()), pa.array([int(counts.sum())], pa.int64())], ["part", "table", "total"])


def _parts(rows: DataFrame) -> int:
    """A power of two of parts in which tables are added up: as many as shuffle partitions, and 64 at least."""
    return 1 << max(6, (int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def token_levels(rows: DataFrame, ngram: int) -> tuple[int, list[tuple[int, bytes]], int]:
    """The number of counters, documents by counter over all rows as levels, and the level from which tokens are frequent.

    Compressed tables, of SLOTS bytes together at most before compression, pass through the driver.
    """
    text = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = _parts(rows)
    size = max(parts << 10, min(SLOTS, 1 << max(0, text // SLOT_BYTES - 1).bit_length()))
    counted = map_arrow(rows, _count_slots(ngram, size, parts), COUNTED).repartitionById(parts, "part")
    found = map_arrow(counted, _add_counts, PACKED + ", total long").collect()
    mean = sum(p.total for p in found) / size
    return size, [(p.part * (size // parts), bytes(p.table)) for p in found], int(levels(np.array(2 * mean + FREQUENT)))


def unpacked(parts: list[tuple[int, bytes]], size: int) -> np.ndarray:
    """One table of the parts that are there, by where they start; the others are zero."""
    table = np.zeros(size, np.uint8)
    for at, blob in parts:
        part = np.frombuffer(zlib.decompress(blob), np.uint8)
        table[at : at + len(part)] = part
    return table


def _bit_slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[_bit_slots(batch.column("doc_id").to_numpy(zero_copy_only=False))] = True
    for i, part in enumerate(np.split(bits, 64)):
        if part.any():
            yield _table(i, np.packbits(part))


def _or_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("table")):
            found[part] = found.get(part, np.uint8(0)) | np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
    for part, table in found.items():
        yield _table(part, table)


def id_bits(ids: DataFrame) -> list[tuple[int, bytes]]:
    """A bit table of the ids' hashes; compressed tables of fixed size pass through the driver."""
    set_bits = map_arrow(ids.select("doc_id"), _set_bits, PACKED).repartitionById(64, "part")
    return [(p.part * (BITS // 8 // 64), bytes(p.table)) for p in map_arrow(set_bits, _or_bits, PACKED).collect()]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _set_key(tokens: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(tokens.tobytes()))


def _sign(ngram: int, percent: int, shared, size: int, frequent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = unpacked(shared.value, size)
        listed: set[int] = set()  # copies of a set have their entries once in a task
        for batch in batches:
            ids, sizes, keys, entries = [], [], [], []
            for doc_id, text in _texts(batch):
                tokens = token_set(text, ngram)
                ids.append(doc_id)
                sizes.append(len(tokens))
                key = _set_key(tokens) if len(tokens) and doc_id is not None else None
                keys.append(key)
                if key is None or key in listed:
                    entries.append(np.empty(0, np.int64))
                else:
                    listed.add(key)
                    entries.append(signatures(tokens, counts, frequent, percent, k).view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(entries, pa.list_(pa.int64()))], ["doc_id", "n", "k", "entries"])
        forget()

    return run


def _sets(ngram: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(shared.value, BITS // 8)
        for batch in batches:
            ids, keys, sets = [], [], []
            for (doc_id, text), slot in zip(_texts(batch), _bit_slots(batch.column("doc_id").to_numpy(zero_copy_only=False)).tolist()):
                if bits[slot >> 3] >> (7 - (slot & 7)) & 1:
                    tokens = token_set(text, ngram)
                    ids.append(doc_id)
                    keys.append(_set_key(tokens))
                    sets.append(tokens.view(np.int64))
                if len(ids) >= 512:
                    yield _set_batch(ids, keys, sets)
                    ids, keys, sets = [], [], []
            if ids:
                yield _set_batch(ids, keys, sets)
        forget()

    return run


def _set_batch(ids: list, keys: list, sets: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "k", "tokens"])


def shared_entries(base: DataFrame) -> DataFrame:
    """``k, entry`` of the entries that more than one set has; copies of a set count once.

    All entries are shuffled once: the count and the join read the same exchange. That holds as long as
    both need the same columns of it, which is why sizes are joined to what is left.
    The rows of an entry, one for each set and task that listed it, meet in one task here.
    """
    listed = base.where("k is not null").select("k", F.explode("entries").alias("entry")).repartition("entry")
    several = listed.groupBy("entry").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("entry")
    return listed.join(several.hint("merge"), "entry").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs, whether they link."""
    a, b = (sets.select(F.col("k").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("same", F.size(F.array_intersect("ta", "tb")))
    return both.select("a", "b", (F.lit(100) * F.col("same") >= F.lit(percent) * (F.size("ta") + F.size("tb") - F.col("same"))).alias("links"))


def common_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    mine, other = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(mine, other)
    total = np.zeros((len(left), len(right)), np.int64)

    def spots(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.searchsorted(shared, flat)
        column[column == len(shared)] = 0
        held = shared[column] == flat
        order = np.argsort(column[held], kind="stable")
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held][order], column[held][order]

    if not len(shared):
        return total
    (row_l, col_l), (row_r, col_r) = spots(left, mine), spots(right, other)
    for start in range(0, len(shared), WIDTH):
        tables = []
        for sets, rows, columns in ((left, row_l, col_l), (right, row_r, col_r)):
            lo, hi = np.searchsorted(columns, [start, start + WIDTH])
            table = np.zeros((len(sets), min(WIDTH, len(shared) - start)), np.float32)
            table[rows[lo:hi], columns[lo:hi] - start] = 1
            tables.append(table)
        total += (tables[0] @ tables[1].T).astype(np.int64)  # whole numbers up to WIDTH are exact
    return total


def _block_links(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        block, k, c = (rows.column(x).to_numpy() for x in ("block", "k", "c"))
        sets = [np.asarray(t.values.to_numpy(zero_copy_only=False)) for t in rows.column("tokens")]
        sizes = np.array([len(t) for t in sets], np.int64)
        first = block == rows.column("i")[0].as_py()
        i, j = np.flatnonzero(first), np.flatnonzero(block == rows.column("j")[0].as_py())
        if not len(i) or not len(j):
            x = y = np.empty(0, np.int64)
        else:
            same = common_tokens([sets[x] for x in i], [sets[y] for y in j])
            links = (100 * same >= percent * (sizes[i][:, None] + sizes[j][None, :] - same)) & (c[i][:, None] != c[j][None, :])
            at_i, at_j = np.nonzero(links)
            x, y = i[at_i], j[at_j]
            _, node = np.unique(c, return_inverse=True)
            kept = spanning(node[x], node[y], len(c))
            x, y = x[kept], y[kept]
        return pa.table({"a": pa.array(np.minimum(k[x], k[y]), pa.int64()), "b": pa.array(np.maximum(k[x], k[y]), pa.int64())})

    return run


def in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join all components ``c`` of a group ``g`` which its members' links join.

    A group is cut into blocks by hash; every two of its blocks, and each with itself, meet in one task.
    """
    size = members.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    size = size.select("g", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("all") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    dealt = members.join(size, "g").withColumn("block", F.expr("cast(pmod(xxhash64(k, 'block'), blocks) as int)"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("g", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "k", "c")
    return dealt.join(sets, "k").groupBy("g", "i", "j").applyInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, combined: int = COMBINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id``.

    Two documents link if 100 * intersection >= percent * union of their sets. component_id is
    the least doc_id that links reach. Null, empty and wordless texts have no tokens and
    link with nothing, nor do rows without an id; their component is their own id. Repeated rows
    link with each other. An empty table gives an empty result; other columns, whatever their names, are ignored.
    ``combined`` is the number of frequent tokens in a combination.
    """
    if not 50 < percent <= 100 or combined < 1:
        raise ValueError("percent must be above 50 and at most 100, combined positive")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size, table, frequent = token_levels(rows, ngram)
    shared = spark.sparkContext.broadcast(table)
    del table
    base = cut(map_arrow(rows, _sign(ngram, percent, shared, size, frequent, combined), "doc_id long, n long, k long, entries array<long>"))
    shared.destroy()  # nothing computes base again

    sets_of = base.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    index = cut(shared_entries(base))
    wanted = cut(index.select("k").distinct().join(sets_of, "k"))
    index = cut(index.join(wanted.select("k", "n"), "k"))
    bits = spark.sparkContext.broadcast(id_bits(wanted))
    sets = map_arrow(rows.where("doc_id is not null"), _sets(ngram, bits), "doc_id long, k long, tokens array<long>")
    # rows can share an id, so the key decides; equal rows are one
    sets = cut(sets.join(wanted.select("doc_id", "k"), ["doc_id", "k"]).groupBy("k").agg(F.first("tokens").alias("tokens")))
    bits.destroy()

    def alike(x: str, y: str) -> str:
        return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"

    links = found = done = None
    for turn in range(STAR_ROUNDS + 1):
        here = index if found is None else index.join(found.select(F.col("node").alias("k"), "component"), "k", "left")
        here = here.withColumn("c", F.col("k") if found is None else F.coalesce("component", "k")).select("entry", "k", "n", "c")
        leader = F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("h"), "k", "n", "c")).alias("l")
        entries = here.groupBy("entry").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("members"), leader).where("least < most")
        here = here.join(entries.select("entry", "members", "l"), "entry")
        if turn < STAR_ROUNDS:
            tied = here.where(f"l.c != c and {alike('l.n', 'n')}")
            pairs = tied.select(F.least("k", "l.k").alias("a"), F.greatest("k", "l.k").alias("b"))
        else:
            here = cut(here.select("entry", "k", "n", "c", "members", F.col("l.k").alias("g")))
            x, y = (here.where(F.col("members") <= FEW).select("entry", F.col("k").alias(f"{s}k"), F.col("n").alias(f"{s}n"), F.col("c").alias(f"{s}c")) for s in "xy")
            pairs = x.join(y, "entry").where(f"xk < yk and xc != yc and {alike('xn', 'yn')}").select(F.col("xk").alias("a"), F.col("yk").alias("b"))
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        checked = cut(_verified(pairs, sets, percent))
        linked = checked.where("links").select("a", "b")
        links = linked if links is None else links.union(linked)
        if turn == STAR_ROUNDS:
            links = links.union(cut(in_blocks(here.where(F.col("members") > FEW).select("g", "k", "n", "c").distinct(), sets, percent)))
        done = checked.select("a", "b") if done is None else done.union(checked.select("a", "b"))
        found = cut(components(links))

    least = sets_of.join(found.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    smallest = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = least.join(smallest, "component").select("k", "component_id")
    out = base.select("doc_id", "n", "k").join(named, "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
