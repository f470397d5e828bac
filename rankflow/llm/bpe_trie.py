"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch of whole texts form a trie. A depth-first walk keeps, for every
prefix on the path, the last token of that prefix's encoding; words that share a prefix
share these states, so each prefix is worked out once. The last token of a prefix is its one
suffix token that may follow the last token of what is left before it: two tokens may
stand side by side exactly if merging their characters gives these two tokens again, which is told by undoing their merges. A
word's tokens are read off backwards through the states.

The walk over the words in sorted order is the depth-first walk of the trie, so its path is
all that has to be kept of it. Texts are cut at spaces, where no token can cross; distinct parts of a
batch are normalized and split as the vocabulary's file says
(composed, lower case, the file's pattern, bytes as printable characters, a mark on each
word's last character). Files with other rules raise ValueError.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import held, map_arrow
from rankflow.llm.token_files import GROUP_BYTES, byte_characters, gather, groups, is_word

#: Words and parts of texts of which a worker remembers the tokens, in each generation; pairs of tokens.
REMEMBERED, PAIRS = 300_000, 300_000


class TrieEncoder:
    """Encodes and decodes texts with a word-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.check(spec)
        self.mark = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.decimal = [str(i) for i in range(max(self.text_of) + 1)]
        self.texts = [self.text_of.get(i, "") for i in range(max(self.text_of) + 1)]
        #: Ranks of merges by pair of tokens; of each token the rank of its merge (-1 for none) and its two parts.
        self.rank: dict[int, int] = {}
        self.made = [-1] * len(self.decimal)
        self.halves: list[tuple[int, int]] = [(0, 0)] * len(self.decimal)
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, ab = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[a << 20 | b] = r
            if self.made[ab] < 0:
                self.made[ab], self.halves[ab] = r, (a, b)
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.mark)}
        self.final = {t.removesuffix(self.mark): i for t, i in self.vocab.items() if t.endswith(self.mark) and t != self.mark}
        self.inner_sizes, self.final_sizes = Sizes(self.inner), Sizes(self.final)
        self.length = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.final.items()}
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        #: Ids of words, and of parts of texts as they were met lately and before.
        self.known: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def check(spec: dict) -> None:
        """Raise ValueError unless a file's rules are those that this encoder follows."""
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        byte_level = steps[-1] if steps else {}
        known = model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        known = known and normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in steps] == ["Split", "ByteLevel"]
        known = known and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not byte_level["add_prefix_space"] and not byte_level["use_regex"]
        known = known and spec["decoder"] is None and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(" " in t["content"] for t in spec["added_tokens"])
        if not known:
            raise ValueError("the vocabulary file's rules are not: composed lower case, words by pattern, byte-level BPE with word ends, no decoder")

    def border_holds(self, left: int, right: int, limit: int = 1 << 30) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the border of two tokens that stand side by side.

        Their merges are undone, the latest first: what then stands at the border must not merge before the undone
        merge takes its place. Of equal ranks the one further left comes first.
        """
        rank, made, halves = self.rank, self.made, self.halves
        while True:
            crossing = rank.get(left << 20 | right)
            if crossing is not None and crossing < limit:
                return False
            at_left, at_right = made[left], made[right]
            if at_left > at_right:
                limit, left = at_left, halves[left][1]
            elif at_right >= 0:
                limit, right = at_right + 1, halves[right][0]
            else:
                return True

    def stands_alone(self, token: int) -> bool:
        """Whether the token is what its own characters are merged to."""
        found = self.alone.get(token)
        if found is None:
            left, right = self.halves[token]
            found = self.alone[token] = self.made[token] < 0 or (self.stands_alone(left) and self.stands_alone(right) and self.border_holds(left, right, self.made[token]))
        return found

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs = {}
            found = self.pairs[key] = self.stands_alone(right) and self.border_holds(left, right)
        return found

    def last_token(self, prefix: str, states: list[int], vocab: dict[str, int], sizes: Sizes) -> int:
        """The last token of a prefix, given the last tokens of all shorter ones."""
        n = len(prefix)
        for size in sizes[prefix[-3:]]:
            if size <= n:
                token = vocab.get(prefix[n - size :])
                if token is not None and (self.stands_alone(token) if size == n else self.may_follow(states[n - size], token)):
                    return token
        raise ValueError(f"the vocabulary has no token for the end of {prefix!r}")

    def learn(self, words: set[str]) -> None:
        """Work out the tokens of new words in one depth-first walk."""
        spelled = sorted((w.encode().decode("latin-1").translate(self.bytes), w) for w in words)
        path, states = "", [0]  # states[i]: last token of the first i characters of the path
        for spelling, word in spelled:
            shared = 0
            for a, b in zip(path, spelling):
                if a != b:
                    break
                shared += 1
            del states[min(shared, len(states) - 1) + 1 :]
            path = spelling
            for n in range(len(states), len(spelling)):  # the last character is always a marked one
                states.append(self.last_token(spelling[:n], states, self.inner, self.inner_sizes))
            token, at, tokens = self.last_token(spelling, states, self.final, self.final_sizes), len(spelling), []
            while True:
                tokens.append(token)
                at -= self.length[token]
                if at <= 0:
                    break
                token = states[at]
            tokens.reverse()
            self.known[word] = struct.pack(f"<{len(tokens)}I", *tokens)

    def split(self, part: str) -> list[str]:
        """Words of a part of a text, and the special tokens in it."""
        out: list[str] = []
        at = 0
        if "<" in part:
            for m in self.special_pattern.finditer(part):
                out += [*self.words(part[at : m.start()]), m[0]]
                at = m.end()
        return out + self.words(part[at:])

    def words(self, text: str) -> list[str]:
        if is_word(text):
            return [text.lower()]
        composed = text if text.isascii() else unicodedata.normalize("NFC", text)
        return self.pattern.findall(lower(composed))

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts of texts that hold no space."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young  # parts that come again move to the young ones
        if len(self.known) > REMEMBERED:
            self.known = {}
        young, old, known = self.young, self.old, self.known
        found = list(map(young.get, parts))
        missing = []
        for i, x in enumerate(found):
            if x is None:
                x = old.get(parts[i])
                if x is None:
                    missing.append((i, self.split(parts[i])))
                else:
                    found[i] = young[parts[i]] = x
        self.learn({w for _, some in missing for w in some if w not in known and w not in self.special})
        special = {t: struct.pack("<I", i) for t, i in self.special.items()}
        for i, some in missing:
            found[i] = young[parts[i]] = known[some[0]] if len(some) == 1 and some[0] not in special else b"".join([special.get(w) or known[w] for w in some])
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; texts are not null."""
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        return gather(self.parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy().astype(np.int64), first)

    def encode_long(self, text: str, most: int = GROUP_BYTES) -> bytes:
        """Ids of one text of any length, cut at spaces so that no part is much longer than ``most``."""
        out, at = [], 0
        while at < len(text):
            to = text.find(" ", at + most)
            to = len(text) if to < 0 else to
            out += self.encode(pa.array([text[at:to]], pa.large_string()))
            at = to
        return b"".join(out)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: without a decoder in the file, the tokens joined by spaces; special ones stay, unknown ids go."""
        known = self.text_of
        if len(ids) and (min(ids) < 0 or max(ids) >= len(self.texts)):
            return " ".join([known[i] for i in map(int, ids) if i in known])
        return " ".join(map(self.texts.__getitem__, ids if isinstance(ids, list) else ids.tolist()))


class Sizes(dict):
    """By the last three characters of a prefix, the lengths of tokens that can end it, longest first."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab, self.long = vocab, defaultdict(set)
        for t in vocab:
            if len(t) >= 3:
                self.long[t[-3:]].add(len(t))

    def __missing__(self, end: str) -> list[int]:
        sizes = sorted(self.long.get(end, ()), reverse=True)
        found = self[end] = [*sizes, *(k for k in (2, 1) if len(end) >= k and end[-k:] in self.vocab)]
        return found


def lower(text: str) -> str:
    """Lower case character by character; a final sigma is no special case."""
    if text.isascii() or "Σ" not in text:
        return text.lower()
    return "σ".join(part.lower() for part in text.split("Σ"))


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder for a vocabulary."""
    return held(path, lambda: TrieEncoder(path))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], code: TrieEncoder) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Groups of ids of documents, and their tokens."""
    for batch in batches:
        for group in groups(batch, "text"):
            texts = group.column("text")
            long = len(texts) == 1 and len(texts[0].as_buffer()) > 2 * GROUP_BYTES
            done = [code.encode_long(texts[0].as_py())] if long else code.encode(texts)
            yield group.column("doc_id"), [np.frombuffer(x, "<u4") for x in done]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens: ``doc_id, ids, decoded``.

    Null, empty and wordless texts have no ids and decode to an empty text. Special tokens'
    strings in a text are the special tokens, as in the tokenizers library. Rows with equal
    or no ids are encoded each; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for doc_id, ids in _encoded(batches, code):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(map(code.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return map_arrow(_rows(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string", keep=tokenizer)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """All rows with ``decoded``, the text of the ids; a column of that name is replaced.

    Null ids decode to null, ids that the vocabulary lacks are left out.
    """
    rows = encoded.drop("decoded").withColumn("decoded", F.lit(None).cast("string"))
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            texts = [None if x is None else code.decode([i for i in x if i is not None]) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)

    return map_arrow(rows, run, rows.schema, keep=tokenizer)


def digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of :func:`encode` and of what its ids decode to: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        decimal = code.decimal.__getitem__
        for doc_id, ids in _encoded(batches, code):
            columns: list[list] = [[], [], []]
            for some in ids:
                listed = some.tolist()
                columns[0].append(len(listed))
                columns[1].append(hashlib.sha256(" ".join(map(decimal, listed)).encode()).hexdigest())
                columns[2].append(hashlib.sha256(code.decode(listed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(_rows(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep=tokenizer)
