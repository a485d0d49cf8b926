"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ripplework.llm import classifier, importance, licenses, mixing, packing, periodic, quality_rules, simhash, substring, suffix_index, tokens, topk, toxicity
from ripplework.llm.common import slices, table
from ripplework.plans.registry import Query

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


# 1: toxicity

@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))


# 2: mixing

MIX_EPOCHS = 2


def _mix_sql() -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"when {level} = '{k}' then {v}" for k, v in mixing.WEIGHTS[level].items())
        return f"case {cases} else 1 end"

    path, steps = ["domain", "lang", "source"], []
    for depth, name in enumerate(path):
        keys, up = ", ".join(path[:depth + 1]), path[:depth]
        group = f"partition by {', '.join(up)}" if up else ""
        budget = f"(select floor(sum(tokens) * {mixing.SHARE})::hugeint from leaves)" if not up else "p.budget"
        parent = "" if not up else f" join l{depth - 1} p on " + " and ".join(f"c.{x} is not distinct from p.{x}" for x in up)
        steps.append(f"""
c{depth} as (select {', '.join('c.' + x for x in path[:depth + 1])}, c.cap, c.weight, {budget} as budget
  from (select {keys}, sum(tokens * {MIX_EPOCHS})::hugeint as cap, ({weight(name)})::hugeint as weight from leaves group by {keys}) c{parent}),
s{depth} as (select *, budget - sum(cap) over upto + cap as left_budget, sum(weight) over whole - sum(weight) over upto + weight as left_weight
  from c{depth} window whole as ({group}), upto as ({group} order by cap::double / weight::double, {name} nulls first rows unbounded preceding)),
f{depth} as (select *, cap * left_weight <= left_budget * weight as is_full from s{depth}),
o{depth} as (select *, budget - sum(case when is_full then cap else 0 end) over whole as open_budget,
  sum(case when is_full then 0 else weight end) over whole as open_weight from f{depth} window whole as ({group})),
l{depth} as (select {keys}, (case when is_full then cap else (open_budget * weight)::hugeint // open_weight::hugeint end)::hugeint as budget from o{depth})""")
    same = " and ".join(f"a.{x} is not distinct from b.{x}" for x in path)
    return f"""
with rows as (select doc_id, case when regexp_matches(source, '[0-9]{{1,9}}$') then 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4)::varchar end as domain,
    lang, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens from documents),
leaves as (select domain, lang, source, sum(tokens)::hugeint as tokens from rows group by all),{','.join(steps)},
plan as (select a.*, case when a.tokens > 0 then b.budget // a.tokens else 0 end as full_epochs, case when a.tokens > 0 then b.budget % a.tokens else 0 end as rest
  from leaves a join l2 b on {same}),
keyed as (select a.*, b.full_epochs, b.rest, b.tokens as leaf_tokens, md5('{mixing.SEED}' || '|' || b.full_epochs::bigint::varchar || '|' || coalesce(a.doc_id::varchar, 'null')) as key
  from rows a join plan b on {same}),
summed as (select *, sum(tokens) over (partition by domain, lang, source order by key range unbounded preceding) as running from keyed)
select doc_id, domain, lang, source, tokens as n_tokens,
  (full_epochs + case when running <= rest and leaf_tokens > 0 then 1 else 0 end)::bigint as copies from summed"""


@query("op2_mixing", _mix_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = mixing.source_tree()
    mixed = mixing.mix(table(spark, folder, "documents"), path, mixing.WEIGHTS, mixing.SHARE, MIX_EPOCHS, mixing.SEED)
    return mixed.select("doc_id", path["domain"].alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


# 3: quality rules

_RULES_SQL = """
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select r, unnest(range(1, len(w) - 1)) as i, w from d),
k as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from g),
again as (select r, i from k qualify count(*) over (partition by r, a, b, c) > 1),
covered as (select r, count(distinct i + j.j) as n from again, (select unnest([0, 1, 2]) as j) j group by r),
lines as (select r, unnest(string_split(text, chr(10))) as line from d),
dup as (select r, sum(n - 1) as n from (select r, line, count(*) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r, line) group by r),
m as (select d.r, doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
  from d left join dup using (r) left join covered using (r)),
f as (select *, n_words < 50 as short, 100 * n_repeat_words > 50 * n_words as repetitive, 10 * n_symbols > n_words as symbols,
  word_chars < 2 * n_words or word_chars > 20 * n_words as word_length, 20 * n_dup_lines > n_words as lines from m),
long as (select source, rule, failed::int as failed from f unpivot (failed for rule in (short, repetitive, symbols, word_length, lines)) where source is not null),
rates as (select source, rule, sum(failed) as failed, count(*) as n from long group by all),
prior as (select rule, avg(failed / n) as mean, coalesce(var_samp(failed / n), 0) as variance from rates group by rule),
strength as (select rule, mean, case when variance > 0 then least(greatest(mean * (1 - mean) / variance - 1, 2.0), 10000.0) else 2.0 end as strength from prior),
bad as (select distinct source from rates join strength using (rule) where (failed + mean * strength) / (n + strength) >= 0.9)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repetitive as base_failed, bad.source is not null as host_rejected,
  not (short or repetitive) and bad.source is null as kept from f left join bad on f.source = bad.source"""


@query("op3_host_rules", _RULES_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


# 4: substring dedup

_WINDOWS_SQL = """
with d as (select row_number() over () as r, coalesce(doc_id, 9223372036854775807) as rank, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select r, rank, unnest(range(1, len(w) - 11)) as i, w from d),
k as (select r, rank, i, array_to_string(w[i:i + 12], ' ') as window_text from p),
again as (select r, i from k qualify min(rank) over (partition by window_text) < rank),
covered as (select distinct r, i + j.j as i from again, (select unnest(range(0, 13)) as j) j),
words as (select d.r, d.doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
marked as (select words.*, covered.i is not null as gone from words left join covered on words.r = covered.r and words.i = covered.i),
kept as (select r, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from marked group by r)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (r)"""


def _word_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for data, is_copy, starts, counts in zip(*(batch.column(x).to_pylist() for x in ("data", "is_copy", "starts", "counts")), strict=True):
            words = (data or b"").split()
            spans = substring.removed_words(len(words), is_copy, starts, counts)
            out.append((len(words), sum(b - a for a, b in spans), hashlib.sha256(b" ".join(substring.kept_words(words, spans))).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()),
                               "kept_sha256": pa.array(columns[2], pa.string())})


@query("op4_substring_dedup", _WINDOWS_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.with_factors(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "data", "is_copy", "starts", "counts").mapInArrow(
        _word_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


# 5: near duplicates

@query("op5_simhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


# 6: token counts

TOKEN_LIMIT = 2048


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


# 7: exact top-k

_TOP_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score from v q join v c on c.r <> q.r and len(c.x) = len(q.x) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 5"""


@query("op7_top_k", _TOP_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


# 8: suffix-array dedup

def _byte_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for data, is_copy, starts, ends in zip(*(batch.column(x).to_pylist() for x in ("data", "is_copy", "starts", "ends")), strict=True):
            data = data or b""
            spans = suffix_index.removed_bytes(len(data), is_copy, starts, ends)
            digest, at = hashlib.sha256(), 0
            for begin, end in spans:
                digest.update(data[at:begin])
                at = end
            digest.update(data[at:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()),
                               "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})


@query("op8_suffix_array")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_index.with_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "data", "is_copy", "starts", "ends").mapInArrow(
        _byte_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


# 9: packing

@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


# 10: quality classifier

@query("op10_factorisation_machine")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return classifier.score_quality(docs, classifier.train(docs, table(spark, folder, "labels")))


# 11: periodic runs

def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: in one document of ten, those from some word on repeat a stretch that begins there."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    stretch = words[begin:begin + period]
    return words[:begin] + (stretch * (-(-(n - begin) // period)))[:n - begin]


def _more_periods(best: F.Column, run: F.Column) -> F.Column:
    """Whether *run* comes before *best*, by exact ratio of length to period. The runs are in order of start and period."""
    return best["length"] * run["period"] < run["length"] * best["period"]


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.with_runs(table(spark, folder, "documents"), prepare=planted)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda held, run: F.when(_more_periods(held, run), run).otherwise(held))
    lines = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# 12: licences

@query("op12_license_scan")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(x)["label"] for x in columns)))), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base")["place"]).alias("first_word"),
        F.array_max(F.col("base")["place"]).alias("last_word"), labels("base").alias("base_labels"), labels("base", "finds").alias("labels"),
        F.coalesce(F.array_max(F.col("finds")["share"]), F.lit(0.0)).alias("score"))


# 13: resampling towards a target distribution

_IMPORTANCE_SQL = f"""
with crc_table as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from (select unnest(range(256)) as i))),
both_texts as (select true as mine, row_number() over () as r, doc_id, text from documents union all select false, row_number() over (), null, text from benchmark),
split as (select mine, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from both_texts),
words as (select mine, r, unnest(w) as word from split),
coded as (select word, hex(encode(word)) as digits from (select distinct word from words)),
hashed as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(digits) // 2), lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::bigint)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % {importance.BUCKETS} as bucket from coded, crc_table),
counted as (select mine, r, bucket, count(*) as n from words join hashed using (word) group by all),
totals as (select coalesce(sum(n) filter (mine), 0)::bigint as s, coalesce(sum(n) filter (not mine), 0)::bigint as t from counted),
gains as (select bucket, floor(1000 * ln(((coalesce(sum(n) filter (not mine), 0) + 1)::double * (s + {importance.BUCKETS})) / ((coalesce(sum(n) filter (mine), 0) + 1)::double * (t + {importance.BUCKETS}))))::bigint as gain
    from counted, totals group by bucket, s, t),
weights as (select r, sum(n * gain)::bigint as weight from counted join gains using (bucket) where mine group by r),
scored as (select r, doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from split left join weights using (r) where mine),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, r) as place, count(*) over () as n from scored where n_features >= {importance.LEAST_WORDS})
select doc_id, n_features, weight, score, case when place <= {importance.PERCENT} * n // 100 then place end as rank from scored left join ranked using (r)"""


@query("op13_importance_resampling", _IMPORTANCE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# all stages

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
