"""The operators against brute force, on the smallest table and on awkward rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from ripplework.llm import components, mixing, packing, quality_rules, simhash, substring, suffix_index, tokens, topk

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank long, data string, anchor long"


def _made():
    rng = random.Random(7)
    vocabulary = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(90))
    long = " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n", " É"]) for _ in range(30_000))
    texts = [None, "", " \n\t ", "one", "one", "a b c", passage, passage, passage + " end", "start " + passage, long, "x" + long[:90_000],
             "same " * 500, "é" * 900 + "ü" * 900, "<|endoftext|> hi <|startoftext|>there", "tab\tsep\x0bvt\x0cff\rcr\x1cfs\x85nel em", "It's I'LL 12³ don't!'s"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 200))) + " " + (passage[60:460] if i % 3 == 0 else "") for i in range(30)]
    texts += [" ".join(passage.split()[:80] + [str(i)]) for i in range(20)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), None, "clash", 5, "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, passage, None, None, 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(_made(), DOCUMENT)


def _sample(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def _pairs(frame):
    return [(r.doc_id, (r.text or "").encode()) for r in frame.select("doc_id", "text").collect()]


def _both(spark, made):
    yield made
    yield made.limit(0)
    if os.path.isdir(FOLDER):
        yield _sample(spark)


def test_quality_rules(spark, made):
    for docs in _both(spark, made):
        want = []
        for doc_id, data in _pairs(docs):
            words = data.split()
            grams = Counter(zip(words, words[1:], words[2:]))
            covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
            lines = data.decode().split("\n")
            want.append((doc_id, len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in data.decode()),
                         sum(bool(x.encode().split()) and x in lines[:i] for i, x in enumerate(lines)), len(covered),
                         len(words) < 50 or 100 * len(covered) > 50 * len(words)))
        got = [tuple(r[:6]) + (r.base_failed,) for r in quality_rules.judge(docs).collect()]
        assert Counter(got) == Counter(want)


def test_a_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad, "junk") for i in range(400)] + [(999, good, "junk"), (1000, good, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and not got[999] and got[1000] and not got[100]


def _spanned(words, spans):
    return substring.kept_words(words, spans)


def test_substring(spark, made):
    for docs in _both(spark, made):
        first = {}
        for doc_id, data in _pairs(docs):
            words = data.split()
            rank = substring.LAST_RANK if doc_id is None else doc_id
            for i in range(len(words) - 12):
                key = tuple(words[i:i + 13])
                first[key] = min(first.get(key, rank), rank)
        want = Counter()
        for doc_id, data in _pairs(docs):
            words = data.split()
            rank = substring.LAST_RANK if doc_id is None else doc_id
            gone = {i + j for i in range(len(words) - 12) if first[tuple(words[i:i + 13])] < rank for j in range(13)}
            want[doc_id, len(words), tuple(w for i, w in enumerate(words) if i not in gone)] += 1
        got = Counter()
        for r in substring.with_factors(docs).collect():
            words = bytes(r.data or b"").split()
            got[r.doc_id, len(words), tuple(_spanned(words, substring.removed_words(len(words), r.is_copy, r.starts, r.counts)))] += 1
        assert got == want


def test_substring_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 900)) for _ in range(60))
    rows = [(1, passage)] + [(5, passage + " and more")] * 4000 + [(None, f"n{i} " + passage) for i in range(4000)] + [(None, "gone " + passage)] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    found = substring.factors(docs).collect()
    assert len(found) == 4002 and max(len(r.starts) for r in found) <= 60
    got = Counter()
    for r in substring.with_factors(docs).collect():
        words = bytes(r.data).split()
        got[r.doc_id, len(words), len(_spanned(words, substring.removed_words(len(words), r.is_copy, r.starts, r.counts)))] += 1
    assert set(got) == {(1, 60, 60), (5, 62, 2), (None, 61, 1)} and sum(got.values()) == len(rows)


@pytest.mark.parametrize("group", [256, 2])
def test_suffix_index(spark, made, group):
    for docs in _both(spark, made):
        pairs, times = _pairs(docs), Counter()
        for _, data in pairs:
            times.update(data[i:i + 400] for i in range(len(data) - 399))
        want = Counter()
        for doc_id, data in pairs:
            gone = np.zeros(len(data), bool)
            for i in range(len(data) - 399):
                if times[data[i:i + 400]] > 1:
                    gone[i:i + 400] = True
            want[doc_id, len(data), bytes(x for x, y in zip(data, gone) if not y)] += 1
        got = Counter()
        for r in suffix_index.with_duplicates(docs, group=group).collect():
            data, out, at = bytes(r.data or b""), b"", 0
            for a, b in suffix_index.removed_bytes(len(data), r.is_copy, r.starts, r.ends):
                out, at = out + data[at:a], b
            got[r.doc_id, len(data), out + data[at:]] += 1
        assert got == want


def _removed(docs, **how):
    found = Counter()
    for r in suffix_index.with_duplicates(docs, **how).collect():
        found[r.doc_id, tuple(suffix_index.removed_bytes(len(r.data or b""), r.is_copy, r.starts, r.ends))] += 1
    return found


def test_suffix_index_of_a_passage_in_thousands_of_documents(spark):
    """Passages over and under the length, some grown by a shared word on either side, in documents that differ otherwise."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(410))
    texts = []
    for i in range(1500):
        shared = passage[:300] if i % 3 == 0 else passage
        more = rng.choice(["", "xy", "xyz", "é", "ê"])
        texts.append("".join(rng.choice("klmno") for _ in range(rng.randint(0, 60))) + more + shared + more + "".join(rng.choice("klmno") for _ in range(rng.randint(0, 150))))
    data = [t.encode() for t in texts]
    times = Counter(hash(d[i:i + 400]) for d in set(data) for i in range(len(d) - 399))
    want = Counter()
    for n, d in enumerate(data):
        gone = np.zeros(len(d), np.int64)
        for i in range(len(d) - 399):
            if times[hash(d[i:i + 400])] > 1:
                gone[i:i + 400] = 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).tolist()
        want[n, tuple(zip(edges[::2], edges[1::2]))] += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert _removed(docs, group=64) == want


def test_suffix_index_of_repeated_rows(spark):
    """Rows repeated with their id, and texts without an id, are copies of each other; the rest is found as without them."""
    rng = random.Random(6)
    text, other = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (900, 600))
    rows = [(7, text)] * 3000 + [(None, text)] * 3000 + [(8, "start " + other), (9, other[:450] + " end"), (None, None)]
    found = _removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), group=4)
    assert found == Counter({(7, ((0, 900),)): 3000, (None, ((0, 900),)): 3000, (8, ((6, 456),)): 1, (9, ((0, 450),)): 1, (None, ()): 1})


def _simhash(data):
    words = data.translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))).split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("group", [1024, 4])
def test_simhash(spark, made, group):
    for docs in _both(spark, made):
        prints = [(i, _simhash(d)) for i, d in _pairs(docs)]
        values = sorted({p for _, p in prints})
        root = {v: v for v in values}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, a in enumerate(values):
            for b in values[:i]:
                if (a ^ b).bit_count() <= 4:
                    root[top(a)] = top(b)
        least = defaultdict(list)
        for doc_id, p in prints:
            if doc_id is not None:
                least[top(p)].append(doc_id)
        want = Counter((i, f"{p:016x}", None if i is None else min(least[top(p)])) for i, p in prints)
        assert Counter(tuple(r) for r in simhash.near_duplicates(docs, group=group).collect()) == want


def test_a_cluster_of_near_fingerprints_in_small_groups(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = [base]
    for _ in range(300):  # a chain that wanders away
        values.append(values[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values += [rng.getrandbits(64) for _ in range(300)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    tied = {r.a: r.b for r in components.components(simhash.links(frame, group=16)).collect()}
    assert len({tied.get(v, v) for v in signed}) == len(signed) - len(tied)
    groups = {}
    for a, b in components.forest([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]):
        groups[a] = b
    assert tied == groups


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 512), (700, 40)])
def test_tokens(spark, made, chunk, overlap):
    library = Tokenizer.from_file(PATH)
    for docs in _both(spark, made):
        want = Counter((i, len(d), len(library.encode(d.decode(), add_special_tokens=False).ids)) for i, d in _pairs(docs))
        assert Counter(tuple(r) for r in tokens.count_tokens(docs, PATH, chunk, overlap).collect()) == want


@pytest.mark.parametrize("batch_tokens", [4_000_000, 3000])
def test_packing(spark, made, batch_tokens):
    library = Tokenizer.from_file(PATH)
    for docs in _both(spark, made):
        want = Counter()
        for i, d in _pairs(docs):
            want[i, tuple(library.encode(d.decode(), add_special_tokens=False).ids + [1])] += 1
        rows = packing.pack_documents(docs, PATH, batch_tokens=batch_tokens).collect()
        sequences, tokens_of = defaultdict(list), Counter()
        for r in rows:
            sequences[r.sequence_id].append(r)
            tokens_of[r.doc_id] += r.length
        for pieces in sequences.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048 and (at & (at - 1)) == 0
        ids = {}
        for (i, x), n in want.items():
            ids.setdefault(i, []).append(x)
        total = Counter()
        for (i, x), n in want.items():
            total[i] += n * len(x)
        assert tokens_of == total
        for r in rows:
            assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])


def test_rests_that_fill_no_sequence_are_packed_once_a_batch(monkeypatch):
    """Rests of one token less than a sequence leave a gap in each; what waits is not packed again for every document."""
    import pyarrow as pa
    from pyspark import TaskContext

    calls, assign = [], packing.assign
    monkeypatch.setattr(packing, "assign", lambda lengths, *how: calls.append(len(lengths)) or assign(lengths, *how))
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda _: type("Task", (), {"partitionId": lambda _: 0})()))
    text = b" ".join([b"a"] * 2046)
    batches = (pa.record_batch({"doc_id": pa.array(range(i, i + 100), pa.int64()), "data": pa.array([text] * 100, pa.binary())}) for i in range(0, 3000, 100))
    rows = pa.Table.from_batches(packing._pack(PATH, 2048, 2_000_000, 1)(batches))
    assert len(calls) <= 5 and sum(rows["length"].to_pylist()) == 3000 * 2047


def test_assign_prefers_the_cheapest_sequence():
    filled = packing.assign([60, 60, 40, 30, 10], 100)
    assert sorted(sum(x[2] for x in s) for s in filled) == [100, 100]
    assert {tuple(sorted(x[0] for x in s)) for s in filled} == {(0, 2), (1, 3, 4)}


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(60)]
    rows += [(1000, None), (1001, []), (1050, [float("nan")] * 8), (1100, [None] * 8), (None, [1.0] * 8), (1150, [0.1, 0.2]), (450, [0.25] * 8), (450, [0.25] * 8), (50, rows[50][1])]
    rows = [(*r, "clash", 7, "clash", 9) for r in rows]
    shape = "vec_id long, embedding array<float>, row string, size int, x string, query_row int"
    got = Counter(tuple(r) for r in topk.search(spark.createDataFrame(rows, shape), F.col("vec_id") % 50 == 0, 5, first=20, block=32).collect())
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float))) for i, x, *_ in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    want = Counter()
    for at, (query, q) in enumerate(good):
        if query % 50 == 0:
            best = sorted((-int(q @ x), i) for n, (i, x) in enumerate(good) if n != at and len(x) == len(q))[:5]
            want.update((query, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want and max(got.values()) > 1
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_of_one_row_repeated(spark):
    """A row that makes up most of the table, query itself, lies in blocks of bounded size and has results for each of its copies."""
    rows = [(50, [0.5, 0.25])] * 700 + [(i, [i / 100, 0.5]) for i in range(40)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5, first=20, block=16, query_block=16)
    assert Counter(r.query_id for r in got.collect()) == {0: 5, 50: 3500}


def test_mixing_makes_up_shortages_among_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)]
    frame = spark.createDataFrame(leaves, "top string, low string, tokens long")
    got = {(r.top, r.low): r.budget for r in mixing.leaf_budgets(frame, ["top", "low"], 400 / 3010, 1, {}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    poor = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 1000), ("b", "y", 1000)], "top string, low string, tokens long")
    got = {(r.top, r.low): r.budget for r in mixing.leaf_budgets(poor, ["top", "low"], 400 / 2030, 1, {}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 185, ("b", "y"): 185}


def test_mixing(spark, made):
    path = {"lang": F.col("lang"), "source": F.col("source")}
    for docs in _both(spark, made):
        rows = mixing.mix(docs, path, {"lang": {"en": 3}}, 0.5, 3, 11).collect()
        assert len(rows) == docs.count()
        taken = sum(r.mix_tokens * r.mix_copies for r in rows)
        total = sum(r.mix_tokens for r in rows)
        assert taken <= 0.5 * total
        by_leaf = defaultdict(list)
        for r in rows:
            assert 0 <= r.mix_copies <= 3 and r.mix_tokens == len((r.text or "").encode().split())
            by_leaf[r.lang, r.source].append(r)
        for members in by_leaf.values():
            assert max(r.mix_copies for r in members) - min(r.mix_copies for r in members) <= 1
    assert mixing.mix(made.limit(0), path, {}, 0.5, 3, 11).collect() == []


def test_mixing_of_repeated_rows_and_null_ids(spark):
    rows = [(i, "a b c") for i in range(300)] + [(7, "a b")] * 4000 + [(None, f"x{i} y") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(16)
    for share in (0.02, 0.3, 0.6, 0.9):
        got = mixing.mix(docs, {"source": F.col("source")}, {}, share, 1, 11).collect()
        total, taken = sum(r.mix_tokens for r in got), sum(r.mix_tokens * r.mix_copies for r in got)
        groups = defaultdict(set)
        sizes = Counter()
        for r in got:
            groups[r.doc_id].add(r.mix_copies)
            sizes[r.doc_id] += r.mix_tokens
        assert len(got) == len(rows) and taken <= share * total and all(len(x) == 1 for x in groups.values())
        # Keys are taken in one order until the next one doesn't fit, so the rest is less than the largest left out.
        assert share * total - taken < max(n for key, n in sizes.items() if groups[key] == {0})


def _letters_that_come_apart():
    """Words whose last letter is a letter and a mark in normal form, before each mark of punctuation."""
    letters = [*map(chr, range(0x958, 0x960)), "\u09dc", "\u09dd", "\u09df", "\u0a33", "\u0a5e", "\ufb2a", "\ufb1d", "\ufb4e", "\u0130", "\u00e9"]
    return [base + letter + mark for letter in letters for base in ("", "\u09b9", "ab") for mark in ("", ",", ".", "!", "?", ":", ";")]


def test_letters_that_come_apart_before_marks():
    library, encoder = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    for word in _letters_that_come_apart():
        want = library.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(word.encode()), "<u4").tolist() == want, ascii(word)


def test_packing_and_counts_of_letters_that_come_apart(spark):
    library = Tokenizer.from_file(PATH)
    texts = [*_letters_that_come_apart(), " ".join(_letters_that_come_apart())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PATH).collect()} == {i: len(x) for i, x in enumerate(ids)}
    for r in packing.pack_documents(docs, PATH).collect():
        assert zlib.crc32(np.array([*ids[r.doc_id], 1][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
