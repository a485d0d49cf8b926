"""Periodic runs, licence scans and importance resampling against brute force, on awkward rows and the smallest table."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest

from ripplework.llm import importance, licenses, periodic, queries

FOLDER = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, n_words long, label string, data string, weight string, score string, rank long, runs string, row string, place string, part string"
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _made():
    rng = random.Random(11)
    stretch = " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(700))
    notices = ["Released under the MIT License.", "Licensed under the Apache License,\nVersion 2.0.", "the mit\tLICENSE mit license", "GNU General   Public License, version 3",
               "general public license", "Licensed under CC BY-NC 4.0.", "cc by sa 4 0", "ALL RIGHTS RESERVED", "permitté license", "apache é license", "mit licenses"]
    texts = [None, "", " \x0b ", "a", "a a a a a", "a a a a a a", "a b " * 40, "x " + "a b c " * 4 + "a b", stretch, (stretch + " ") * 5, "é É ÉÉ x_y z-9 É", "same " * 3000,
             ("p q r s t " * 9 + "u ") * 6, licenses.TEMPLATES[1][1], licenses.TEMPLATES[1][1].replace("charge", "Charge (c)").replace("rights", "rights of any"),
             " ".join(x[1] for x in licenses.TEMPLATES), *notices, " filler words ".join(notices)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    texts += [" ".join(rng.choice(stretch.split()[:9]) for _ in range(60)) + " " + " ".join((stretch.split()[:k] * 6)[:5 * k + 3]) for k in (1, 2, 3, 4, 5, 7, 8, 15, 16, 31, 64)]
    rows = [(i, t, 5, *["clash"] * 4, 3, *["clash"] * 4) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, stretch, *[None] * 10), (None, None, *[None] * 10)]


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(_made(), DOCUMENT)


def _tables(spark, made):
    yield made
    yield made.limit(0)
    if os.path.isdir(FOLDER):
        yield spark.read.parquet(f"{FOLDER}/documents.parquet")


def _pairs(frame):
    return [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]


def _brute_runs(words, least=6, exponent=4):
    out, n = [], len(words)
    for p in range(1, n // exponent + 1):
        at = 0
        while at + p < n:
            begin = at
            while at + p < n and words[at] == words[at + p]:
                at += 1
            end = at + p
            if end - begin >= max(least, exponent * p):
                stretch = words[begin:begin + 2 * p]
                if not any(p % q == 0 and stretch[:p] == stretch[q:q + p] for q in range(1, p)):
                    out.append((begin, end - begin, p))
            at += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_random_words():
    rng, documents = random.Random(1), []
    for _ in range(600):
        kinds, words = rng.choice([1, 2, 3, 8]), []
        for _ in range(rng.randint(0, 4)):
            stretch = [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 25))]
            if rng.random() < 0.3:
                stretch = stretch * rng.randint(2, 6) + [b"9"]
            words += stretch if rng.random() < 0.4 else (stretch * rng.randint(2, 8))[:rng.randint(1, 250)]
        documents.append(words)
    assert periodic.find_runs(documents) == [_brute_runs(x) for x in documents]
    assert periodic.find_runs([]) == []


def test_words_that_defeat_polynomial_hashes():
    """Thue-Morse words hold no run of three periods; Fibonacci words hold runs of less than four."""
    a, b = [b"x"], [b"y"]
    for _ in range(13):
        a, b = a + b, b + a
    assert periodic.find_runs([a]) == [[]]
    assert periodic.find_runs([a + a + a + a]) == [[(0, 4 * len(a), len(a))]]


def _digest(lines):
    return hashlib.sha256(lines).hexdigest()


def test_query_of_periodic_runs(spark, made, tmp_path):
    for number, docs in enumerate(_tables(spark, made)):
        docs.select("doc_id", "text").write.parquet(f"{tmp_path}/{number}/documents.parquet")
        want = Counter()
        for doc_id, text in _pairs(docs):
            words = text.encode().split()
            h, n = zlib.crc32(str(doc_id).encode()), len(words)
            if doc_id is not None and h % 10 == 0 and n:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            found = _brute_runs(words)
            gone = {i for s, length, p in found for i in range(s + p, s + length)}
            best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
            want[doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                 _digest("".join(f"{s},{length},{p}\n" for s, length, p in found).encode()), _digest(b" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
        assert Counter(tuple(r) for r in queries.op11(spark, f"{tmp_path}/{number}").collect()) == want


def test_query_of_licences(spark, made, tmp_path):
    for number, docs in enumerate(_tables(spark, made)):
        docs.select("doc_id", "text").write.parquet(f"{tmp_path}/{number}/documents.parquet")
        want = Counter()
        for doc_id, text in _pairs(docs):
            words = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
            at = {i: label for i in range(len(words)) for phrase, label in licenses.BASE.items() if words[i:i + len(phrase.split())] == phrase.split()}
            labels = set(at.values())
            for label, wording, keys in licenses.TEMPLATES:
                wording = PLAIN.findall(wording.lower())
                begins = [{i - next(k for k in range(len(wording)) if wording[k:k + len(key)] == key) for i in range(len(words)) if words[i:i + len(key)] == key} for key in map(str.split, keys)]
                if all(begins) and any(all(any(abs(a - b) <= licenses.DRIFT for b in other) for other in begins) for a in begins[0]):
                    labels.add(label)
            want[doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(set(at.values()))), ",".join(sorted(labels))] += 1
        rows = queries.op12(spark, f"{tmp_path}/{number}").collect()
        assert Counter(tuple(r)[:7] for r in rows) == want
        assert all(0 <= r.score <= 1 and (r.score > 0) >= bool(r.base_labels) for r in rows)


def test_a_whole_notice_scores_more_than_its_key_phrases(spark):
    wording = licenses.TEMPLATES[1][1]
    texts = [wording, wording.replace("merge, publish", "merge, and at times publish"),
             "permission is hereby granted free of charge " + "x " * 16 + "to deal in the software without restriction", "to deal in the software without restriction permission is hereby granted free of charge"]
    found = {r.doc_id: r.finds for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[0][0].share == pytest.approx(1) and found[0][0].begin == 0 and found[1][0].share > 0.9
    assert 0 < found[2][0].share < 0.6 and not found[3]


def _brute_importance(docs, target, longest, buckets):
    def features(text):
        words = PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    held, wanted = Counter(), Counter()
    for _, text in docs:
        held.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    total_held, total_wanted, rows = sum(held.values()), sum(wanted.values()), []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (total_held + buckets) / ((held[b] + 1) * (total_wanted + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return rows


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 97)])
def test_importance(spark, made, longest, buckets):
    target = spark.createDataFrame([("a b a b the MIT license",), (None,), ("same words",)], "text string")
    for docs in _tables(spark, made):
        want = _brute_importance(_pairs(docs), [r.text for r in target.collect()], longest, buckets)
        got = importance.resample(docs, target, longest, buckets).collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(want)
        last = 1 << 62
        enough = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], last if r[0] is None else r[0]))
        drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
        assert [r.rank for r in drawn] == list(range(1, len(enough) * 10 // 100 + 1))
        assert [tuple(r)[:5] for r in drawn] == enough[:len(drawn)]


def test_importance_of_one_row_repeated(spark):
    """A row that makes up most of the table is dealt over partitions, and each of its copies has a rank of its own."""
    text = " ".join(str(i) for i in range(25))
    docs = spark.range(20_000).selectExpr("if(id % 10 = 0, id, 7) as doc_id", f"'{text}' as text")
    weighed = importance.weigh(docs, [1] * 10, 1)
    drawn = importance.draw(weighed, percent=90)
    assert sorted(r.rank for r in drawn.where("rank is not null").collect()) == list(range(1, 18_001)) and drawn.count() == 20_000
