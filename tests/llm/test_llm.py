"""Small fixtures with nulls, empty and long texts, ties, repeats, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rankflow.llm import bpe_trie, chat, embedding_dedup, jaccard_join, mixing, quality_classifier, quality_rules, sharding, substring_dedup, token_files
from rankflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names operators use themselves.
CLASH = ("key", "size", "shard", "n", "kept", "bucket", "places", "taken", "target", "k", "label2")


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120, 10_000)
    passage = prose(2, 60, 10_000)
    out = [base, base, base, base.replace("w", "W", 3), base + " tail", None, "", " \n\t ", "a b", "A b", "a b", "one", passage + " " + prose(3, 50, 10_000), prose(4, 40, 10_000) + "\n" + passage, "x " * 5000, "é\x85 ü\xa0ß  z　q", "l1\nl1\n\n l1\nl2 ***", prose(5, 3000, 50)]
    words = base.split()
    for i in range(40):  # near copies
        some = list(words)
        some[i * 3 % 120] = f"edit{i}"
        out.append(" ".join(some))
    out += [prose(100 + i, 80 + i, 10_000) for i in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", None, "de")[i % 3], (None, "b", "a", "a", "a")[i % 5], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_empty_tables(spark, empty):
    assert substring_dedup.digest(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0
    assert quality_rules.text_stats(empty).count() == 0
    assert sharding.interleave_shards(empty).count() == 0 and mixing.plan_mix(empty).count() == 0 and mixing.mix(empty.drop("shard")).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0
    assert bpe_trie.digest(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(none).count() == 0
    assert chat.read_chat(chat.format_chat(chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(empty, labels) is None and quality_classifier.score(empty, None).count() == 0
    assert quality_rules.apply_rules(empty, labels).count() == 0


@pytest.mark.parametrize("window", [5, 35])
def test_substring_dedup(docs, texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    got, cut = rows_of(substring_dedup.digest(docs, window)), rows_of(substring_dedup.remove_repeats(docs, window))
    assert set(cut[0].asDict()) == set(docs.columns)
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert WORD.findall(cut[i].text or "") == kept and (gone or cut[i].text == texts[i])


def test_repeated_rows_lose_all_windows(docs):
    twice = docs.where("doc_id = 17").union(docs.where("doc_id = 17"))
    assert [r.n_removed == r.n_words > 0 for r in substring_dedup.digest(twice).collect()] == [True, True]


def test_pack_round_trip():
    r = np.random.default_rng(0)
    for top in (3, 5000, 10**6):
        counts = r.integers(1, 50, 20)
        places = np.concatenate([np.sort(r.choice(top * 60, c, replace=False)) for c in counts])
        keys, hashes, again = r.integers(-(2**62), 2**62, 20), r.integers(0, 2**63, len(places)).astype(np.uint64), r.random(len(places)) < 0.5
        for a, b in zip(substring_dedup._unpack(substring_dedup._pack(keys, counts, hashes, places, again)), (keys, counts, hashes, places, again)):
            assert np.array_equal(a, b)


def test_text_stats(docs, texts):
    got = rows_of(quality_rules.text_stats(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {j for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for j in (s, s + 1, s + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want


def test_text_stats_of_long_texts(spark, monkeypatch):
    """Texts whose positions do not fit the packed integer, by a lowered bound."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 5)
    long = [" ".join(f"u{i}" for i in range(90)), " ".join(f"u{i}" for i in [*range(60), *range(50, 60), *range(3)]), prose(8, 200, 6), prose(9, 31, 3), prose(9, 32, 3)]
    got = rows_of(quality_rules.text_stats(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")))
    for i, t in enumerate(long):
        w = t.split()
        grams = Counter(zip(w, w[1:], w[2:]))
        assert got[i].n_repeat_words == len({j for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for j in (s, s + 1, s + 2)}), i


def test_rules_learn_thresholds(spark):
    rows = [(i, prose(i, 100, 5000) + (" ***" * 30 if i % 4 == 0 else ""), int(i % 4 != 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality_rules.learn_rules(quality_rules.labelled_stats(df, df.select("doc_id", "quality")))
    assert 1 <= len(rules) <= 3
    for r in quality_rules.apply_rules(df, df.select("doc_id", "quality")).collect():
        assert r.kept == (r.doc_id % 4 != 0) or r.base_failed
    assert quality_rules.learn_rules(quality_rules.labelled_stats(df, df.where("false").select("doc_id", "quality"))) == []


def test_sharding(docs, texts):
    got = rows_of(sharding.interleave_shards(docs, 7))
    assert len(got) == len(texts)
    by = defaultdict(list)
    for i, r in got.items():
        assert r.size == len((texts[i] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[i] or "").encode())
        by[r.shard].append(r)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 7 and max(sizes) - min(sizes) <= 1
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        a = sum(r.source == "a" for r in rows)
        assert abs(a - len(rows) * 0.6) <= 3
    again = sharding.interleave_shards(docs.repartition(3).unionByName(docs.limit(0)), 7)
    assert {(r.doc_id, r.shard, r.slot) for r in again.collect()} == {(r.doc_id, r.shard, r.slot) for r in got.values()}


def test_mixing(docs, texts):
    got = rows_of(mixing.plan_mix(docs, shards=3))
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    total = sum(sizes.values())
    source = defaultdict(int)
    for i, r in got.items():
        assert r.size == sizes[i] and r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * len(r.draws)
        source[r.source] += r.size
    targets = {r.source: r.target for r in got.values()}
    open_, level = dict(zip(["a", "b", None], (3.0, 1.0, 2.0))), None
    want, left = {}, 1.5 * total
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level >= 2 * source[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * source[s]
            left -= want[s]
            del open_[s]
    want |= {s: w * level for s, w in open_.items()}
    for s, t in want.items():
        assert targets[s] == pytest.approx(t)
        taken = sum(r.taken for r in got.values() if r.source == s)
        assert abs(taken - t) <= max(r.size for r in got.values() if r.source == s)
    mixed = mixing.mix(docs.drop("shard"), shards=3).collect()
    assert Counter(r.doc_id for r in mixed) == Counter({i: len(r.draws) for i, r in got.items() if r.draws})
    for shard in range(3):
        slots = sorted(r.slot for r in mixed if r.shard == shard)
        assert slots == list(range(len(slots)))


def brute_components(texts, ngram, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + ngram]) for j in range(len(w) - ngram + 1)} if len(w) >= ngram else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            m = len(sets[a] & sets[b])
            if m and 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("ngram, percent", [(3, 90), (5, 80)])
def test_jaccard_join(docs, texts, ngram, percent, monkeypatch):
    got = rows_of(jaccard_join.near_duplicates(docs, ngram, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts, ngram, percent)


@pytest.mark.parametrize("stars", [0, 2])
def test_jaccard_join_in_blocks(spark, stars, monkeypatch):
    """A large group of near copies, most of which do not link, is joined in blocks as in pairs."""
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = ["alone and short"]
    for _ in range(150):
        words = list(base)
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"x{r.randrange(9)}"
        texts.append(" ".join(words[: r.choice([120, 110, 60])]))
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", stars)
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(jaccard_join.near_duplicates(docs, 3, 90))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == brute_components(texts, 3, 90)


def test_common_tokens(monkeypatch):
    monkeypatch.setattr(jaccard_join, "WIDTH", 7)
    r = np.random.default_rng(1)
    left, right = ([np.sort(r.choice(60, r.integers(1, 30), replace=False)) for _ in range(n)] for n in (9, 5))
    assert (jaccard_join.common_tokens(left, right) == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


def test_token_levels_do_not_depend_on_partitions(spark):
    """A token that one task alone sees more than 255 times is counted in full."""
    df = spark.createDataFrame([(i, f"a b c d{i % 3}") for i in range(3000)], "doc_id long, text string")
    (size, one, limit), (same, many, again) = (jaccard_join.token_levels(df.selectExpr("doc_id", "cast(text as binary) text").repartition(n), 3) for n in (1, 20))
    tables = [jaccard_join.unpacked(x, size) for x in (one, many)]
    assert limit == again and size == same and np.array_equal(*tables)
    assert sorted(tables[0][tables[0] > 0]) == sorted(jaccard_join.levels(np.array([1000, 1000, 1000, 3000]))) and limit < tables[0].max()


@pytest.mark.parametrize("percent", [51, 80, 90, 100])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_signatures_meet_for_all_similar_sets(percent, k):
    """Pairs at or above the threshold share an index entry, whatever is frequent and however large they are."""
    r = np.random.default_rng(5)
    for trial in range(300):
        n = int(r.integers(1, 12 if trial % 3 == 0 else 400 if trial % 3 == 1 else 5000))
        tokens = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop, add = int(r.integers(0, n // 4 + 1)), int(r.integers(0, n // 4 + 1))
        other = np.unique(np.concatenate([r.permutation(tokens)[drop:], r.integers(0, 2**63, add).astype(np.uint64)]))
        m = len(np.intersect1d(tokens, other))
        if m and not np.array_equal(tokens, other) and 100 * m >= percent * (len(tokens) + len(other) - m):
            both = np.unique(np.concatenate([tokens, other]))
            counts = np.zeros(1 << 20, np.uint8)  # as few as hold for these two sets alone
            np.add.at(counts, (np.concatenate([tokens, other]) & np.uint64(len(counts) - 1)).astype(np.int64), 1)
            hot = r.random() * 1.2
            counts[(both[r.random(len(both)) < hot] & np.uint64(len(counts) - 1)).astype(np.int64)] = 200
            a, b = (jaccard_join.signatures(x, counts, 100, percent, k) for x in (tokens, other))
            assert len(np.intersect1d(a, b)), (trial, n, m)


def test_entries_grow_in_proportion():
    """Also where all tokens are frequent, a set has few entries for each token."""
    r = np.random.default_rng(6)
    counts = np.full(1 << 16, 200, np.uint8)
    for percent, n in ((80, 100), (80, 1000), (80, 30_000), (90, 300), (90, 30_000)):
        entries = jaccard_join.signatures(np.unique(r.integers(0, 2**63, n).astype(np.uint64)), counts, 100, percent)
        assert len(entries) < 2 * n, (percent, n, len(entries))


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_few_links_need_few_jobs(spark):
    links = [(i, i + 1) for i in range(1, 150)] + [(7000 - i, 7001 - i) for i in range(50)] + [(9000, 9000), (3, 3)]
    df = spark.createDataFrame(links, "a long, b long").cache()
    want = {i: 1 for i in range(1, 151)} | {i: 6951 for i in range(6951, 7002)} | {9000: 9000}
    assert {r.node: r.component for r in components(df, gathered=0).collect()} == want
    spark.sparkContext.setJobGroup("few links", "")
    try:
        found = components(df)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = found.collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert jobs <= 12  # of rounds, each has several
    none = components(df.where("a < 0"))
    assert none.count() == 0 and none.dtypes == found.dtypes == [("node", "bigint"), ("component", "bigint")]


def test_copies_have_entries_once_in_a_task():
    class Shared:
        value = [(0, zlib.compress(bytes([2]) * 1024))]

    text = " ".join(f"w{i}" for i in range(40))
    batches = [pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())}) for ids, texts in (([None, 1, 2], [text.encode()] * 3), ([3, 4, 5], [text.upper().encode(), b"other words here", None]))]
    rows = [r for b in jaccard_join._sign(3, 90, Shared, 1024, 200, 2)(iter(batches)) for r in b.to_pylist()]
    assert [(r["doc_id"], r["n"]) for r in rows] == [(None, 38), (1, 38), (2, 38), (3, 38), (4, 1), (5, 0)]
    assert [len(r["entries"]) > 0 for r in rows] == [False, True, False, False, True, False]
    assert rows[0]["k"] is None and rows[1]["k"] == rows[2]["k"] == rows[3]["k"] != rows[4]["k"]


def test_entries_are_shuffled_once(spark):
    r = random.Random(3)
    rows = [(k, sorted(r.sample(range(300), 5)) + [1000 + k]) for k in range(60)]
    base = spark.createDataFrame([*rows, *rows[:20], (None, [1, 2])], "k long, entries array<long>").repartition(5)
    found = jaccard_join.shared_entries(base)
    having = defaultdict(set)
    for k, entries in rows:
        for e in entries:
            having[e].add(k)
    assert Counter(map(tuple, found.select("k", "entry").collect())) == Counter((k, e) for e, ks in having.items() if len(ks) > 1 for k in ks)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(entry" in x]
    assert sum("ReusedExchange" not in x for x in exchanges) == 1, plan


def test_chat(spark):
    tricky = ["<|im_end|>", "<\\|im_start|>", "<\\\\|im_end|><|im_start|>assistant ok", "", None, "a\nb", "<|im_start|", "é😀"]
    rows = [(c, t, ("user", "assistant", "sys\ntem", None)[(c + t) % 4], tricky[(3 * c + t) % len(tricky)]) for c in range(20) for t in range(c % 5 + 1)]
    rows += [(None, 0, "assistant", "x"), (7, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = rows_of(chat.read_chat(chat.format_chat(chat.canonical_turns(df))), "conv_id")
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_layouts(spark):
    want = [("user", "q"), ("assistant", "r")]
    layouts = [
        ("conv_id long, messages array<struct<role: string, content: string>>", (1, [("user", "q"), ("assistant", "r")])),
        ("conv_id long, conversations array<struct<`from`: string, value: string>>", (1, [("human", "q"), ("gpt", "r")])),
        ("conv_id long, prompt string, response string, extra int", (1, "q", "r", 3)),
        ("conv_id long, prompt string, completion string", (1, "q", "r")),
        ("conv_id long, instruction string, output string", (1, "q", "r")),
        ("conv_id long, instruction string, input string, output string", (1, "q", "", "r")),
    ]
    for schema, row in layouts:
        turns = chat.canonical_turns(spark.createDataFrame([row], schema)).orderBy("turn").collect()
        assert [(t.role, t.text) for t in turns] == want
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_chat_clashing_columns_and_mixed_layouts(spark):
    def turns(schema, *rows):
        return [(t.conv_id, t.turn, t.role, t.text) for t in chat.canonical_turns(spark.createDataFrame(list(rows), schema)).orderBy("conv_id", "turn").collect()]

    for name in ("input", "prompt", "output", "response", "completion", "instruction"):
        assert turns(f"conv_id long, turn long, role string, text string, {name} string", (1, 3, "gpt", "q", "clash"), (1, 4, None, None, "clash")) == [(1, 3, "gpt", "q"), (1, 4, "", "")]
    mixed = "conv_id long, turn long, role string, text string, messages array<struct<role: string, content: string>>, prompt string, response string, input int"
    rows = [
        (1, 5, "gpt", "q", None, None, None, 1),
        (2, None, None, None, [("human", "q"), ("gpt", "r")], None, None, 1),
        (3, None, None, None, None, "q", "r", 1),
        (4, 2, "user", "most fields first", [("human", "no")], "no", "no", 1),
        (5, None, None, None, [("human", "before prompts")], "no", "no", 1),
        (6, None, "no", None, None, "whole before part", "r", None),
        (7, 8, None, "part", None, None, None, None),
        (8, None, None, None, None, "part", None, None),
    ]
    assert turns(mixed, *rows) == [
        (1, 5, "gpt", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "r"), (3, 0, "user", "q"), (3, 1, "assistant", "r"), (4, 2, "user", "most fields first"),
        (5, 0, "user", "before prompts"), (6, 0, "user", "whole before part"), (6, 1, "assistant", "r"), (7, 8, "", "part"), (8, 0, "user", "part"), (8, 1, "assistant", ""),
    ]


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 100)
    parts = list(chat._format(iter(spark.createDataFrame([(1, "user", "x" * 60)] * 7 + [(2, "assistant", "y")], "conv_id long, role string, text string").toArrow().to_batches())))
    assert sum(p.num_rows for p in parts) == 5
    read = [r for b in chat._read(iter(parts)) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in read] == [(1, 7, 0), (2, 1, 1)]


FUZZ = [" ", "  ", "\n", "a", "Bc", "'s", "'ll", "12", "é", "中文", "İ", "Σ", "ß", "\x1c", "\x85", "!?", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "_", "é", "the,", "ing", "²", "Ⅷ", "　", "-", "x's"]


@pytest.fixture(scope="module")
def fuzz():
    r = random.Random(3)
    return ["".join(r.choice(FUZZ) for _ in range(r.randrange(30))) for _ in range(1500)]


def test_token_files(spark, docs, texts, fuzz, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate([*texts, *fuzz])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    written = token_files.write_token_files(df, path, folder=str(tmp_path))
    got, at = rows_of(token_files.read_token_files(written)), 0
    ids = {}
    for i, t in rows:
        ids[i] = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    part = sorted(tmp_path.glob("*.ids"))[1]
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(part)) as f:
        reader = token_files.Reader(f)
        wanted = set(reader.index["doc_id"][::7].tolist())
        for i, x in reader.documents(wanted):
            assert np.array_equal(x, ids[i])
    raw = bytearray(part.read_bytes())
    raw[20] ^= 255
    part.write_bytes(raw)
    with fs.LocalFileSystem().open_input_file(str(part)) as f, pytest.raises(Exception):
        list(token_files.Reader(f).documents())


def test_bpe_trie(texts, fuzz):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe_trie.TrieEncoder(path)
    some = [*[t or "" for t in texts], *fuzz]
    for t, raw in zip(some, own.encode(pa.array(some))):
        want, ids = tok.encode(t, add_special_tokens=False).ids, np.frombuffer(raw, "<u4")
        assert ids.tolist() == want and own.decode(ids) == own.decode(want) == tok.decode(want, skip_special_tokens=False)
    for text in (" ".join(some), "x" * 3000 + " " * 9 + "y"):
        assert np.frombuffer(own.encode_long(text, 200), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert own.decode([0, 10**6]) == tok.decode([0, 10**6], skip_special_tokens=False)
    with pytest.raises(ValueError, match="rules"):
        bpe_trie.TrieEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_byte_level_encoder(texts, fuzz):
    """Texts cut at spaces, long ones in parts, and files with other rules, against whole texts."""
    tok, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    some = [*[t or "" for t in texts], *fuzz, " ", "  ", "   a", "a   b", "a \n b", "a\n", " a ", "x<|endoftext|> y"]
    for t, raw in zip(some, own.encode(pa.array(some))):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    text = " ".join(some)
    assert np.frombuffer(own.encode_long(text, 50), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), token_files.Encoder(path)
    assert not own.by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(some))] == [tok.encode(t, add_special_tokens=False).ids for t in some]


def test_bpe_rows(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    full, short = rows_of(bpe_trie.encode(docs, path)), rows_of(bpe_trie.digest(docs, path))
    assert len(full) == len(short) == len(texts)
    again = rows_of(bpe_trie.decode(bpe_trie.encode(docs, path).drop("decoded"), path))
    assert {i: r.decoded for i, r in again.items()} == {i: r.decoded for i, r in full.items()}
    for i in full:
        assert hashlib.sha256(" ".join(map(str, full[i].ids)).encode()).hexdigest() == short[i].ids_sha256 and short[i].n_tokens == len(full[i].ids)


def test_classifier(spark):
    rows = [(i, prose(i, 60 + i % 50) if i % 3 else "*** $$$ " * (10 + i % 9), "en", f"s{i % 4}", 100) for i in range(400)] + [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 200)] + [(None, 1, 0), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_classifier.score(df, quality_classifier.train(df, labels)))
    assert len(got) == len(rows)
    held = [got[i].kept == (i % 3 > 0) for i in range(200, 400)]
    assert sum(held) / len(held) > 0.97
    assert quality_classifier.train(df, labels.where("quality = 1")) is None


def test_classifier_uses_the_whole_pool(spark):
    """A source of which only the last documents by hash are, none of them labelled: the text view teaches the metadata view."""
    ids = sorted(range(1000, 9500), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert len(ids) - 50 > 8000
    rare = set(ids[-50:])
    good, junk = [prose(i, 40) for i in range(20)], ["*** $$$ " * (10 + i) for i in range(20)]
    rows = [(i, junk[i % 20], "rare") if i in rare else (i, (good if i % 3 else junk)[i % 20], f"s{i % 3 if i % 10 else i % 4}") for i in [*range(300), *ids]]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = quality_classifier.train(df, labels)
    ask = spark.createDataFrame([(0, "x", "en", "rare", 300), (1, "x", "en", "never seen", 300)], df.schema)
    got = rows_of(quality_classifier.score(ask, model))
    assert got[0].meta_score < got[1].meta_score - 0.1
    again = rows_of(quality_classifier.score(ask, quality_classifier.train(df.repartition(3), labels)))
    assert all(abs(got[i].score - again[i].score) < 1e-6 for i in got)


def test_classifier_on_given_labels(spark):
    """Held-out accuracy: trained on the labels of even ids, judged on those of odd ones."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_classifier.train(docs, labels.where("doc_id % 2 = 0"))
    odd = quality_classifier.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in odd) / len(odd) > 0.97


def exact_links(vectors, labels):
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and labels[i] is not None for i, v in enumerate(vectors)]
    unit = {i: np.array(vectors[i], np.float64) / np.linalg.norm(np.array(vectors[i], np.float64)) for i in range(n) if ok[i]}
    links = {i: set() for i in range(n)}
    for i in unit:
        for j in unit:
            if i != j and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i].add(j)
    return links


@pytest.mark.parametrize("few, block", [(10**9, 512), (0, 512), (0, 3), (256, 5)])
def test_embedding_dedup(spark, few, block, monkeypatch):
    """Joined cells, cells in blocks, and both give the same links; repeated and null ids, odd vectors."""
    monkeypatch.setattr(embedding_dedup, "FEW_PAIRS", few)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(1)
    vectors, labels = [], []
    for c in range(12):
        centre = r.normal(size=32)
        for k in range(8 if c else 40):
            v = centre + (0 if k < 3 else 0.1) * r.normal(size=32)
            vectors.append([float(np.float32(x)) for x in v])
            labels.append(c % 3)
    vectors += [[float(x) for x in range(1, 9)], [float(x) for x in range(1, 9)], [float(2 * x) for x in range(1, 9)]]  # of another length
    labels += [0, 0, 0]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1e-30] * 32, [1e30] * 32]
    vectors += [*odd, vectors[0]]
    labels += [0] * len(odd) + [None]
    df = spark.createDataFrame([(i, v, lab) for i, (v, lab) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<float>, label int")
    extra = spark.createDataFrame([(None, vectors[0], 0)], df.schema)
    df = df.union(extra).withColumn("cid", F.lit(3)).withColumn("home", F.lit("clash"))
    rows = embedding_dedup.near_duplicates(df).collect()
    assert [(x.n_links, x.component_id, x.kept) for x in rows if x.vec_id is None] == [(0, None, True)]
    got, links = {x.vec_id: x for x in rows if x.vec_id is not None}, exact_links(vectors, labels)
    assert len(got) == len(vectors)
    found, true = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert 0.98 * true <= found <= true
    for i, r in got.items():
        assert r.kept == (r.component_id == i) and r.component_id <= i
        assert r.n_links <= len(links[i])


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_recall_at_the_threshold(spark, dim):
    """Random pairs at a cosine of just above 0.98, each with a partner of its own."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=(400, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.9803 * x + np.sqrt(1 - 0.9803**2) * y
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>, label int")
    got = rows_of(embedding_dedup.near_duplicates(df), "vec_id")
    assert sum(got[i].n_links > 0 and got[400 + i].component_id == got[i].component_id for i in range(400)) >= 0.97 * 400


def test_embedding_ids_that_repeat(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(2, 16)).tolist()
    df = spark.createDataFrame([(1, a, 0), (1, a, 0), (1, b, 0), (2, b, 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_lattice_decoding_is_nearest():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 8)) * 2
    point = embedding_dedup.decode(x)
    best = ((x - point) ** 2).sum(axis=1)
    for v in embedding_dedup.NEIGHBOURS:
        assert (((x - point - v) ** 2).sum(axis=1) >= best - 1e-9).all()
    assert (best <= 1 + 1e-9).all()  # the covering radius


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        if name == "near_duplicates":
            ids, texts = zip(*[(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()])
            want = {ids[i] for i, (_, c) in brute_components(texts, 5, 80).items() if c == i}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "repeated_passages":
            assert docs.count() == before.count()
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_near_duplicates_by_row(spark):
    """Repeated rows, ids that different texts share, and rows without an id."""
    a, b, c, d = (prose(900 + i, 60, 10_000) for i in range(4))
    rows = [(1, a, "x"), (2, b, "x"), (2, a, "x"), (3, c, "x"), (3, c, "x"), (None, c, "x"), (None, d, "x"), (None, d, "x"), (None, d, None), (4, " ", "x"), (4, " ", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter([(1, a), (2, b), (3, c), (None, d), (4, " "), (4, " "), (None, None)])
    assert Counter(got.collect()) == Counter(corpus_pipeline.near_duplicates(spark, docs.repartition(5), "").collect())


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Repeated ids, rows without an id, repeated rows, nulls, and columns that operators use themselves."""
    a, b, c = (prose(700 + i, 60 + i, 10_000) for i in range(3))
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (None, a, "x"), (None, None, None), (2, "", "y"), (2, " \n", None), (3, c, "y"), (None, c, "y"), (4, b + " end", "y")]
    df = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    for name in ("_row", "_key", "_route", "_blob", "_draw", "draws", "_slice", "_id", "_label", "_text", "_y", "shard", "slot", "entry", "k", "cell", "kept", "score", "group"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


def pairs_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_odd_rows_in_text_operators(spark, odd_rows):
    texts = [(r.doc_id, r.text) for r in odd_rows.collect()]
    words = {t: len(WORD.findall(t or "")) for _, t in texts}
    cut = substring_dedup.remove_repeats(odd_rows)
    assert cut.columns == odd_rows.columns and {r._blob for r in cut.collect()} == {"clash"}
    assert pairs_of(substring_dedup.digest(odd_rows), "doc_id", "n_words") == Counter((i, words[t]) for i, t in texts)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 0)], "doc_id long, quality int")
    stats = quality_rules.apply_rules(odd_rows, labels)
    assert pairs_of(stats, "doc_id", "n_words", "base_failed") == Counter((i, words[t], words[t] < 50) for i, t in texts)
    assert quality_rules.labelled_stats(odd_rows, labels).count() == 6 and quality_rules.labelled_stats(odd_rows, labels, max_labelled=2).count() == 2
    byte, word = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    tok = Tokenizer.from_file(byte)
    written = token_files.read_token_files(token_files.write_token_files(odd_rows, byte, files=3)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in written) == Counter((i, len(tok.encode(t or "").ids) + 1) for i, t in texts)
    ordered = sorted(written, key=lambda r: r.start)
    assert [r.doc_id is None for r in ordered] == [True] * 3 + [False] * 7 and [r.doc_id for r in ordered[3:]] == sorted(i for i, _ in texts if i is not None)
    tok = Tokenizer.from_file(word)
    assert pairs_of(bpe_trie.digest(odd_rows, word), "doc_id", "n_tokens") == Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)


def test_odd_rows_in_joins(odd_rows):
    texts = [(r.doc_id, r.text) for r in odd_rows.collect()]
    for ngram, percent in ((3, 90), (5, 80)):
        known = [(i, t) for i, t in texts if i is not None]
        sets = brute_components([t for _, t in known], ngram, percent)
        first = {c: min(known[j][0] for j, (_, d) in sets.items() if d == c) for _, c in sets.values()}
        want = Counter((i, sets[j][0], first[sets[j][1]]) for j, (i, _) in enumerate(known))
        want += Counter((None, brute_components([t], ngram, percent)[0][0], None) for i, t in texts if i is None)
        assert pairs_of(jaccard_join.near_duplicates(odd_rows, ngram, percent), "doc_id", "n_shingles", "component_id") == want


def test_odd_rows_in_sharding_and_mixing(odd_rows):
    texts = [(r.doc_id, r.text) for r in odd_rows.collect()]
    shards = sharding.interleave_shards(odd_rows, 3).collect()
    assert Counter((r.doc_id, r.size) for r in shards) == Counter((i, len((t or "").encode()) + 8) for i, t in texts)
    assert sorted(Counter(r.shard for r in shards).values()) == [3, 3, 4]
    assert all(sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards))) for s in range(3))
    planned = mixing.plan_mix(odd_rows, shards=2).collect()
    assert Counter((r.doc_id, r.size) for r in planned) == Counter((i, len(WORD.findall(t or ""))) for i, t in texts)
    mixed, laid = (f(odd_rows, shards=2) for f in (mixing.mix, mixing.mix_in_order))
    assert mixed.columns[-2:] == ["shard", "slot"] and laid.columns[-1] == "shard" and {r._row for r in mixed.collect()} == {"clash"}
    taken = Counter({(r.doc_id, r.size): 0 for r in planned})
    for r in planned:
        taken[r.doc_id, r.size] += len(r.draws)
    for rows in (mixed.collect(), laid.collect()):
        assert Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows) == +taken
    assert pairs_of(mixed, "doc_id", "shard") == pairs_of(laid, "doc_id", "shard")


def test_odd_rows_in_the_classifier(spark, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    found = quality_classifier.train(odd_rows.withColumn("doc_id", F.expr("coalesce(doc_id, 5)")), labels, max_labelled=3)
    scored = quality_classifier.score(odd_rows, found)
    assert scored.count() == odd_rows.count() and scored.where("kept is null").count() == 0


def test_mixed_rows_are_laid_out_by_shard_and_key(spark, docs, tmp_path):
    """Files hold the shards in order, each shuffled: neighbours in a source's order are apart."""
    rows = spark.range(600).selectExpr("id as doc_id", "concat('a b ', id) as text", "if(id % 3 = 0, 'x', 'y') as source")
    laid = mixing.mix_in_order(rows, shards=4)
    laid.write.parquet(str(tmp_path / "laid"))
    read = [r for p in sorted((tmp_path / "laid").glob("part-*")) for r in spark.read.parquet(str(p)).collect()]
    assert [r.shard for r in read] == sorted(r.shard for r in read) and {r.shard for r in read} == set(range(4))
    slots = sorted(mixing.mix(rows, shards=4).collect(), key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.shard) for r in read] == [(r.doc_id, r.shard) for r in slots]
    steps = [abs(a.doc_id - b.doc_id) for a, b in zip(read, read[1:])]
    assert sum(steps) / len(steps) > 100


def test_splitting_tree(spark):
    """Leaves hold equally many units and together the quotas; a source's share is a hypergeometric draw."""
    quotas = spark.createDataFrame([(False, f"s{i:02d}", 24 + i % 3) for i in range(60)], "_none boolean, _source string, _quota int")
    units = mixing._split_tree(quotas, 5, 42).collect()
    total = sum(24 + i % 3 for i in range(60))
    assert len({(r._source, r._unit) for r in units}) == len(units) == total
    leaves = Counter(r.shard for r in units)
    assert set(leaves) == set(range(5)) and max(leaves.values()) - min(leaves.values()) <= 3  # one for each level
    assert Counter(r._source for r in units) == Counter({f"s{i:02d}": 24 + i % 3 for i in range(60)})
    halves = mixing._split_tree(quotas, 2, 7).collect()
    left = [sum(r.shard == 0 for r in halves if r._source == f"s{i:02d}") / (24 + i % 3) for i in range(60)]
    mean, spread = np.mean(left), np.std(left)
    assert abs(mean - 0.5) < 0.02 and 0.07 < spread < 0.13  # of a draw of half of 1,500 units: 0.1
    again, other = mixing._split_tree(quotas, 2, 7).collect(), mixing._split_tree(quotas, 2, 8).collect()
    assert Counter(again) == Counter(halves) != Counter(other)


def test_drawn_blocks_are_disjoint(docs):
    """Every epoch of a document goes to one shard, and quotas are the blocks that the target reaches."""
    planned = mixing.plan_mix(docs, shards=4).collect()
    for r in planned:
        assert len({d.epoch for d in r.draws}) == len(r.draws) <= 2 and all(0 <= d.shard < 4 for d in r.draws)
    assert len({d.shard for r in planned for d in r.draws}) == 4


def test_formatted_chat_is_read_in_any_order(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of {c} " * 9) for c in [*range(30), None] for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = spark.createDataFrame([r for b in chat._format(iter(df.orderBy("conv_id", "turn").toArrow().to_batches())) for r in b.to_pylist()], chat.FORMATTED)
    split = formatted.where("conv_id = 3 or conv_id is null").select("conv_id").collect()
    assert len(split) == 2
    want = rows_of(chat.read_chat(chat.format_chat(df)), "conv_id")
    formatted.repartition(7).write.parquet(str(tmp_path / "chat"))
    assert rows_of(chat.read_chat(spark.read.parquet(str(tmp_path / "chat")).withColumn("n_turns", F.lit(0))), "conv_id") == want
    with pytest.raises(Exception, match="part"):
        chat.read_chat(formatted.withColumn("part", F.lit(1))).collect()


def test_pipeline_stages_on_odd_rows(spark, odd_rows):
    """No stage fails on nulls, repeated rows, clashing names or an empty table; clean rows and their columns stay."""
    d = "/root/testdata/sf0.001"
    for docs in (odd_rows, odd_rows.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            if name != "tokens":
                assert out.columns == docs.columns, name
                rows = out.collect()
                assert all(r[c] == "clash" for r in rows for c in docs.columns[5:]) and (name == "repeated_passages" or {r.text for r in rows} <= {r.text for r in docs.collect()}), name
            else:
                assert out.count() == docs.count()
    kept = corpus_pipeline.near_duplicates(spark, odd_rows, d)
    assert len({r.text for r in kept.where("text rlike 'w'").collect()}) == kept.where("text rlike 'w'").count() == 3
