"""Toxicity by a learned lexicon, matched through Levenshtein automata, and scored in context windows.

The lexicon is learned from labelled rows: words, and stems of four to seven letters that take many endings, which stand
out in toxic documents. Support counts distinct openings of documents' vocabularies (a minimum hash), so that copies of
one document are one witness. A stem is kept only where no longer one, or word, carries most of its support.

The lexicon is a trie. The automaton that accepts everything within a term's edit distance is intersected with it: a
state is the set of (trie node, edits) that the letters read so far can have reached, made when first needed and
remembered. A word outside the language dies after a few letters. Terms under four letters must match exactly, those
under nine allow one edit, others two; stems allow one from five letters on, and any ending.

A word within the edits of a term is no misspelling of it if labelled clean documents use that very word: such words are
learned along with the terms, as exceptions.

Each hit is judged within its context window: between quotation marks or beside reporting words it counts as quoted,
beside second-person words as aimed. Counts and densities of plain and misspelled hits, quoted hits, aimed hits and the
densest window are weighed by a logistic regression with a Gaussian prior on weights that are sensible by themselves, so a
kind of hit that the labels never show keeps its meaning.

Lexicon and weights are fitted on at most ``SAMPLE_ROWS`` labelled rows, drawn by hash, with at most ``CANDIDATES``
terms considered; that bounds what is broadcast and what reaches the driver. Texts are scored where they are read.

Edge cases: a null or empty text has no hits and gets the score of none; without usable labels the lexicon is empty;
labels that are null, or of null ids, teach nothing; repeated rows are scored alike; other columns are ignored; an
empty table gives no rows. Of several labels for a document the highest counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import held_out, slices
from ripplework.session import cut_lineage

SAMPLE_ROWS, CANDIDATES, TERMS, EXCEPTIONS = 20_000, 50_000, 2_000, 100_000
STEM_LENGTHS = (4, 5, 6, 7)
LEAST_SUPPORT, SUPPORT_SHARE, LEAST_LOG_ODDS, EXCEPTION_LOG_ODDS, CARRIED = 3, 0.01, 4.0, 2.0, 0.8
WINDOW_WORDS = 12
THRESHOLD = 0.7
MEMO_WORDS, MEMO_STEPS = 120_000, 200_000

_WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
_QUOTES = "\"“”„«»‹›"
#: Fixed word lists: reporting words, and words that address somebody.
REPORTING = frozenset(("said", "says", "quote", "quoted", "quotes", "called", "wrote", "word", "term", "reported", "dit", "mot", "sagte", "wort", "dijo", "palabra"))
ADDRESSING = frozenset(("you", "your", "youre", "yours", "u", "ur", "du", "dich", "dein", "ihr", "tu", "toi", "ton", "vous", "tú", "ti", "usted"))
FEATURES = ("plain", "plain_density", "misspelled", "misspelled_density", "quoted", "aimed", "densest")
PRIOR_WEIGHTS = np.array([-4.0, 3.0, 1.0, 1.5, 1.0, 0.5, 0.5, 1.0])
PRIOR_SPREAD = 2.0


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def allowed_edits(length: int, stem: bool) -> int:
    if stem:
        return int(length >= 5)
    return 0 if length < 4 else 1 if length < 9 else 2


class Automaton:
    """The lexicon trie intersected with Levenshtein automata, made deterministic state by state."""

    def __init__(self, terms: Iterable[str], exceptions: Iterable[str] = ()):
        self.exceptions = frozenset(exceptions)
        self.children: list[dict[str, int]] = [{}]
        self.word_edits, self.stem_edits, self.reach = [-1], [-1], [-1]
        for term in sorted(terms):
            stem = term.endswith("*")
            letters = term.rstrip("*")
            edits, node = allowed_edits(len(letters), stem), 0
            self.reach[0] = max(self.reach[0], edits)
            for letter in letters:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    for table in (self.word_edits, self.stem_edits, self.reach):
                        table.append(-1)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], edits)
            (self.stem_edits if stem else self.word_edits)[node] = edits
        self._restart()
        self.memo: dict[str, int] = {}

    def _restart(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.accepts: list[int] = []
        self.stems: list[int] = []
        self.steps: list[dict[str, int]] = []
        self.made = 0
        self._number({0: 0})

    def _number(self, reached: dict[int, int]) -> int:
        """The state of least edits by node, closed under letters that the word may lack. -1 is the dead state."""
        queue = sorted(reached)
        while queue:
            node = queue.pop()
            if reached[node] < self.reach[node]:
                for child in self.children[node].values():
                    edits = reached[node] + 1
                    if edits <= self.reach[child] and edits < reached.get(child, 99):
                        reached[child] = edits
                        queue.append(child)
        if not reached:
            return -1
        key = frozenset(reached.items())
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.accepts.append(min((e for n, e in reached.items() if e <= self.word_edits[n]), default=-1))
            self.stems.append(min((e for n, e in reached.items() if e <= self.stem_edits[n]), default=-1))
        return found

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.states[state]:
            if edits < self.reach[node] and edits + 1 < reached.get(node, 99):
                reached[node] = edits + 1  # a letter too many
            for other, child in self.children[node].items():
                cost = edits + (other != letter)
                if cost <= self.reach[child] and cost < reached.get(child, 99):
                    reached[child] = cost
        found = self.steps[state][letter] = self._number(reached)
        self.made += 1
        return found

    def edits(self, word: str) -> int:
        """The least edits to a term of the lexicon, or -1."""
        found = self.memo.get(word)
        if found is not None:
            return found
        if self.made > MEMO_STEPS:
            self._restart()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        state, best = 0, 99
        for letter in word:
            following = self.steps[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state < 0:
                break
            if 0 <= self.stems[state] < best:
                best = self.stems[state]
        else:
            if state >= 0 and 0 <= self.accepts[state] < best:
                best = self.accepts[state]
        found = self.memo[word] = -1 if best == 99 or best and word in self.exceptions else best
        return found


def features(text: str, automaton: Automaton) -> list[float]:
    """What the score is made of; all zero without hits."""
    words = words_of(text)
    edits = automaton.edits
    if not any(edits(word) >= 0 for word in set(words)):
        return [0.0] * len(FEATURES)
    lower = text.lower()
    spans = [match.span() for match in _WORD.finditer(lower)]
    hits = [i for i, word in enumerate(words) if edits(word) >= 0]
    plain = misspelled = quoted = aimed = 0
    for i in hits:
        window = range(max(0, i - WINDOW_WORDS), min(len(words), i + WINDOW_WORDS + 1))
        begin, end = spans[i]
        before = lower[spans[window[0]][0]:begin].rpartition("\n")[2]
        after = lower[end:spans[window[-1]][1]].partition("\n")[0]
        marked = sum(before.count(x) for x in _QUOTES) % 2 == 1 and any(x in after for x in _QUOTES)
        near = {words[j] for j in range(max(0, i - 3), min(len(words), i + 4))}
        if marked or near & REPORTING:
            quoted += 1
        elif edits(words[i]):
            misspelled += 1
        else:
            plain += 1
        aimed += bool(near & ADDRESSING)
    densest, low = 0, 0
    for high, i in enumerate(hits):
        while i - hits[low] > 2 * WINDOW_WORDS:
            low += 1
        densest = max(densest, high - low + 1)
    share = 100 / len(words)
    return [math.log1p(plain), math.log1p(share * plain), math.log1p(misspelled), math.log1p(share * misspelled), math.log1p(quoted), math.log1p(aimed), math.log1p(densest)]


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        terms, openings = [], []
        for text in batch.column("text").to_pylist():
            found = set(words_of(text or ""))
            opening = min((xxh64_intdigest(x) >> 1 for x in found if len(x) > 6), default=0)
            found |= {x[:n] + "*" for x in found for n in STEM_LENGTHS if len(x) > n}
            terms += found
            openings += [opening] * len(found)
        yield pa.record_batch({"term": pa.array(terms, pa.string()), "opening": pa.array(openings, pa.int64())})


def _clean_counts(wanted: frozenset[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = set(words_of(text or ""))
                found |= {x[:n] + "*" for x in found for n in STEM_LENGTHS if len(x) > n}
                for term in found & wanted:
                    counts[term] = counts.get(term, 0) + 1
        yield pa.record_batch({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return each


def choose_terms(support: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, terms: int = TERMS) -> list[str]:
    """Terms whose log odds stand out, without those that a better one makes needless."""
    strong = {}
    for term, n in support.items():
        odds = math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(term, 0) + 0.5) / (n_clean + 1))
        if n >= max(LEAST_SUPPORT, SUPPORT_SHARE * n_toxic) and odds >= LEAST_LOG_ODDS:
            strong[term] = n
    # A stem gives way to a longer stem or word that has most of its support.
    best: dict[str, int] = {}
    for term, n in strong.items():
        letters = term.rstrip("*")
        for length in STEM_LENGTHS:
            if length < len(letters) or length == len(letters) and not term.endswith("*"):
                best[letters[:length] + "*"] = max(best.get(letters[:length] + "*", 0), n)
    kept = {term: n for term, n in strong.items() if not term.endswith("*") or best.get(term, 0) < CARRIED * n}
    # What a kept stem covers needs no entry of its own.
    out = [term for term in kept if not any(length < len(term.rstrip("*")) + (not term.endswith("*")) and term[:length] + "*" in kept for length in STEM_LENGTHS)]
    return sorted(out, key=lambda term: (-kept[term], term))[:terms]


def _near_terms(terms: list[str]):
    """(word, n, n_toxic): documents with each misspelling."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for word in set(words_of(text or "")):
                    if automaton.edits(word) > 0:
                        both = counts.setdefault(word, [0, 0])
                        both[0] += 1
                        both[1] += label == 1
        yield pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array([x for x, _ in counts.values()], pa.int64()),
                               "n_toxic": pa.array([x for _, x in counts.values()], pa.int64())})

    return each


def fit_weights(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression at the maximum of its posterior, by Newton steps; hits of no kind may count against."""
    design = np.concatenate((np.ones((len(rows), 1)), rows), axis=1)
    weights = PRIOR_WEIGHTS.copy()
    precision = np.eye(len(weights)) / PRIOR_SPREAD ** 2
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (labels - chance) - precision @ (weights - PRIOR_WEIGHTS)
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + precision
        weights = weights + np.linalg.solve(curve, slope)
    weights[1:] = np.maximum(weights[1:], 0)
    return weights


@dataclass
class Model:
    terms: list[str]
    exceptions: frozenset[str]
    weights: np.ndarray


def _features_of(terms: list[str], exceptions: frozenset[str]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms, exceptions)
        for batch in (part for whole in batches for part in slices(whole)):
            found = np.array([features(text or "", automaton) for text in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("toxic"), *(pa.array(found[:, j]) for j in range(len(FEATURES)))], names=["toxic", *FEATURES])

    return each


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most *rows* labelled documents that may be learned from, written to the shared folder."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    drawn = usable.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    found = texts.join(F.broadcast(drawn), "id")  # at most *rows* pairs of numbers
    # An id on many rows teaches by one of its texts, chosen by hash, so the bound holds for rows as well.
    one = found.groupBy("id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("one"))
    return cut_lineage(one.select("one.text", "one.label"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled(docs, labels, "toxic", rows)
    toxic, clean = sample.where("label = 1"), sample.where("label = 0")
    pairs = cut_lineage(toxic.select("text").mapInArrow(_toxic_terms, "term string, opening long").distinct())
    n_toxic, n_clean = pairs.select("opening").distinct().count(), clean.count()
    least = max(LEAST_SUPPORT, SUPPORT_SHARE * n_toxic)
    support = pairs.groupBy("term").count().where(F.col("count") >= least).orderBy(F.col("count").desc(), "term").limit(CANDIDATES)
    supported = {row["term"]: row["count"] for row in support.collect()}
    counted = clean.select("text").mapInArrow(_clean_counts(frozenset(supported)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    terms = choose_terms(supported, {row["term"]: row["n"] for row in counted.collect()}, n_toxic, n_clean)
    near = sample.mapInArrow(_near_terms(terms), "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    # Used by two clean documents, and not much oftener by toxic ones.
    odds = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") - F.col("n_toxic") + 0.5) / (n_clean + 1))
    used = near.where((F.col("n") - F.col("n_toxic") >= 2) & (odds < EXCEPTION_LOG_ODDS)).orderBy(F.col("n").desc(), "word").limit(EXCEPTIONS)
    exceptions = frozenset(row["word"] for row in used.collect())
    schema = "toxic int, " + ", ".join(f"{name} double" for name in FEATURES)
    found = sample.select("text", F.col("label").alias("toxic")).mapInArrow(_features_of(terms, exceptions), schema).groupBy("toxic", *FEATURES).count().collect()
    design = np.array([[row[name] for name in FEATURES] for row in found]).reshape(-1, len(FEATURES))
    times = np.array([row["count"] for row in found], int)
    return Model(terms, exceptions, fit_weights(np.repeat(design, times, axis=0), np.repeat(np.array([row["toxic"] for row in found], float), times)))


def _scores(model: Model):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms, model.exceptions)
        for batch in (part for whole in batches for part in slices(whole)):
            found = np.array([features(text or "", automaton) for text in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(model.weights[0] + found @ model.weights[1:], -30, 30)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(score)})

    return each


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of *docs* (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scores(model), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
