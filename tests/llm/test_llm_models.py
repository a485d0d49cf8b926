"""The learned operators on held-out rows and against definitions, and the pipeline stage by stage."""

import os
import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from ripplework.llm import classifier, toxicity

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(2)
    terms = ["idiot", "scum", "worthless", "vequ*", "lostra*", "pathetic", "moronic"]
    automaton = toxicity.Automaton(terms)
    words = ["".join(rng.choice("abdiotlmsu") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for term in terms:
        for _ in range(60):
            letters = list(term.rstrip("*") + ("".join(rng.choice("aeit") for _ in range(3)) if term.endswith("*") else ""))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(letters))
                letters[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            words.append("".join(letters))
    for word in words:
        best = -1
        for term in terms:
            stem, letters = term.endswith("*"), term.rstrip("*")
            edits = toxicity.allowed_edits(len(letters), stem)
            found = min(_distance(letters, word[:n]) for n in range(len(word) + 1)) if stem else _distance(letters, word)
            if found <= edits and (best < 0 or found < best):
                best = found
        assert automaton.edits(word) == best, word


def test_quotation_is_told_from_abuse():
    automaton = toxicity.Automaton(["idiot"])
    abuse = toxicity.features("you are an idiot and everybody knows", automaton)
    quoted = toxicity.features('the speaker "never was an idiot" in the record', automaton)
    misspelled = toxicity.features("you are an idiott and everybody knows", automaton)
    at = dict(zip(toxicity.FEATURES, range(len(toxicity.FEATURES))))
    assert abuse[at["plain"]] > 0 and abuse[at["aimed"]] > 0 and abuse[at["quoted"]] == 0
    assert quoted[at["quoted"]] > 0 and quoted[at["plain"]] == 0
    assert misspelled[at["misspelled"]] > 0 and misspelled[at["plain"]] == 0
    score = lambda x: toxicity.PRIOR_WEIGHTS[0] + toxicity.PRIOR_WEIGHTS[1:] @ np.array(x)
    assert score(abuse) > score(misspelled) > score(toxicity.features("nothing here", automaton)) and score(abuse) > score(quoted)
    assert toxicity.features("", automaton) == [0.0] * len(toxicity.FEATURES)


def test_machine_against_all_pairs():
    rng = np.random.default_rng(1)
    machine = classifier.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)) * 0.3)
    inputs, values = np.array([1, 4, 7, 19]), np.array([0.5, -1.0, 2.0, 0.25])
    total = machine.bias + machine.weights[inputs] @ values
    for i in range(4):
        for j in range(i):
            total += machine.vectors[inputs[i]] @ machine.vectors[inputs[j]] * values[i] * values[j]
    assert abs(machine.score(inputs, values) - 1 / (1 + np.exp(-total))) < 1e-12


AWKWARD = [(1, None), (2, ""), (2, ""), (None, "you idiot"), (4, "word " * 50_000), (5, "ok\n" * 3)]


def test_models_without_labels_and_on_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    for labels in ([], [(1, None, None), (None, 1, 1)], [(2, 0, 1), (5, 1, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for rows in (toxicity.score_toxicity(docs, toxicity.train(docs, known)), classifier.score_quality(docs, classifier.train(docs, known))):
            got = rows.collect()
            assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
            assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert toxicity.score_toxicity(docs.limit(0), toxicity.Model([], frozenset(), toxicity.PRIOR_WEIGHTS)).count() == 0


def test_an_id_on_many_rows_teaches_by_one_text(spark):
    rows = [(0, "a"), (1, "b")] * 2000 + [(0, f"text {i}") for i in range(2000)] + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(0, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled(docs, known, "toxic", 10).collect()
    assert sorted(r.label for r in got) == [0, 1]
    assert sorted(got) == sorted(toxicity.labelled(docs.repartition(7), known, "toxic", 10).collect())


def test_short_terms_may_be_misspelled():
    automaton = toxicity.Automaton(["scum", "bad"], ["scam"])
    assert [automaton.edits(w) for w in ("scum", "scumm", "skum", "bad", "scam", "bat", "sccumm")] == [0, 1, 1, 0, -1, -1, -1]


@needs_data
@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.85), ("op10_factorisation_machine", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in __spark_entry__.queries()[name](spark, FOLDER).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    assert len(rows) > 50 and right >= least


def test_pipeline_stage_by_stage(spark):
    words = [f"w{i}x" for i in range(400)]
    rng = random.Random(4)
    clean = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = clean(70), clean(300)
    copy = base.split()
    texts = [base, base, " ".join(copy[:299] + ["z"]), clean(100) + "\n" + passage, passage + "\n" + clean(100), "too short", "same same same " * 40, None, ""]
    texts += [clean(120) for _ in range(20)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "extra", 1) for i, t in enumerate(texts)] + [(0, base, "en", "src0", 1, "extra", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node_source string, near_fp long")
    kept = corpus_pipeline.quality(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, 0, 1, 2, 3, 4, *range(9, 29)]) and kept.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    ids = sorted(r.doc_id for r in single.collect())
    assert ids == [0, 3, 4, *range(9, 29)] or ids == [0, 2, 3, 4, *range(9, 29)]
    assert single.columns == docs.columns
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, single, "").collect()}
    assert passage in cut[3].text and "w" in cut[4].text and passage not in cut[4].text
    assert len(cut[4].text.split()) == 100 and cut[4].n_chars == len(cut[4].text) and cut[9].text == texts[9]
    frame = corpus_pipeline.repeated_passages(spark, single, "")
    mixed = corpus_pipeline.mixture(spark, frame, "")
    chosen = mixed.collect()
    total = sum(len(r.text.split()) for r in cut.values())
    assert mixed.columns == docs.columns and 0 < sum(len(r.text.split()) for r in chosen) <= 0.6 * total
    pieces = corpus_pipeline.packed(spark, mixed, "").collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in chosen}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


@needs_data
def test_pipeline_runs(spark):
    assert __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_documents_are_judged_in_arrow_one_text_at_a_time():
    """A batch of texts is judged without a table of Python objects; nulls fail, as the measures say."""
    import pyarrow as pa

    from ripplework.llm import quality_rules

    texts = [None, b"", b"a b c", b" ".join(b"w%d" % n for n in range(60)), b"x y z " * 40]
    assert quality_rules._passes(pa.array(texts, pa.binary())).to_pylist() == [False, False, False, True, False]
