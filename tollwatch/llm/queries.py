"""One query per operator, with production parameters over whole tables, and SQL where it can say it."""

import hashlib

import pyspark.sql.functions as F

from tollwatch.llm import (
    attention, conversations, darts, licenses, mixing, periods, pseudonyms, rules, samples,
    substrings, templates, tokens, trees_of_sets, urls,
)

#: Shares of characters by source; the first source holds a third of all rows.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.1}
OTHER = 0.5

#: Key of the check query; a real run gives its own secret.
PSEUDONYM_KEY = "check-key"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), TARGETS, OTHER)


def op6_token_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path()))


def op2_near_duplicates(spark, sf_dir):
    return darts.classes(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return templates.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.fit_urls(pages))


def op5_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit_rules(docs, _table(spark, sf_dir, "labels")))


def op7_pseudonyms(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.aggregate(
        F.map_values("pii"), F.lit(0), lambda a, b: a + b).alias("n_replaced"))


def op8_substring_dedup(spark, sf_dir):
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"), keep_text=False)


def op9_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = attention.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = attention.score_quality(docs, model)
    return scored.withColumn("held_out", samples.fold(F.col("doc_id")) == 2)


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def periodic_rows(docs):
    """``docs`` where every tenth, by a hash of its id, repeats its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # the words up to a, then those of one period again and again
    repeats = F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")),
                             F.ceil((n - a) / p).cast("int"))
    again = F.concat(F.slice(words, F.lit(1), a.cast("int")),
                     F.slice(F.flatten(repeats), F.lit(1), (n - a).cast("int")))
    changed = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(changed, F.concat_ws(" ", again)).otherwise(
        F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = periods.periodic_runs(periodic_rows(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    spans = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r.start, r.length, r.period)), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(spans, F.lit("\n"))).otherwise(""), 256)
        .alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged_rows(rows):
    """``rows`` of conversations without nulls, some of them damaged by a hash of their place."""
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(
        known("text"))
    times = F.array_repeat(F.lit(0), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(known("role")).alias("role"),
                       text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    found = conversations.summarize_repairs(damaged_rows(rows)).withColumnRenamed("conv_id", "own")
    every = rows.select("conv_id").distinct().join(
        found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op13_ngram_join(spark, sf_dir):
    return trees_of_sets.jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_near_duplicates, op3_decontamination, op4_url_filter, op5_quality_rules,
    op6_token_files, op7_pseudonyms, op8_substring_dedup, op9_quality_classifier,
    op10_license_scan, op11_periodic_runs, op12_conversation_repair,
    op13_ngram_join)}

OP1_SQL = """
with recursive target(source, weight) as (
  values ('src0', 0.2::double), ('src1', 0.1), ('src2', 0.1), ('src3', 0.1)),
doc as (
  select d.*, coalesce(t.source, '') as grp, coalesce(t.weight, 0.5) as weight,
    coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) as id
  from documents d left join target t using (source)),
mass as (
  select grp, any_value(weight) as weight,
    cast(sum(length(coalesce(text, '')) + 1) as double) as m
  from doc group by grp),
rate as (select grp, weight / 1.0 * sum(m) over () / m as mean from mass),
part as (select grp, cast(greatest(ceil(mean / 16), 1) as int) as draws,
    mean / greatest(ceil(mean / 16), 1) as one from rate),
term as (
  select grp, draws, one, 0 as k, exp(-one) as p, exp(-one) as c from part
  union all
  select grp, draws, one, k + 1, p * one / (k + 1), c + p * one / (k + 1) from term
  where k < ceil(one + 12 * sqrt(one) + 24)),
cdf as (select grp, draws, list(c order by k) as c from term group by grp, draws),
counted as (
  select doc.*, list_sum([len(list_filter(cdf.c, lambda x: x <=
      ('0x' || substr(md5('mix/' || id || '/' || j), 1, 13))::bigint::double / 4503599627370496))
    for j in range(1, draws + 1)]) as n
  from doc join cdf using (grp))
select doc_id, text, lang, source, n_chars, cast(r.copy as int) as copy,
  md5('mix/order/' || id || '/' || r.copy) as shuffle_key
from counted, lateral (select unnest(range(1, cast(n as bigint) + 1)) as copy) r
"""

OP8_SQL = r"""
with doc as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') as w, row_number() over () as r from documents),
win as (
  select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h
  from doc, lateral (select unnest(range(1, len(w) - 33)) as i)),
dup as (select h from win group by h having count(*) > 1),
gone as (
  select distinct r, i + j as p from win semi join dup using (h), range(0, 35) t(j)),
lost as (select r, list(p) as p from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words,
  cast(coalesce(len(p), 0) as bigint) as n_removed,
  sha256(array_to_string(case when p is null then w else
    [w[k] for k in range(1, len(w) + 1) if not list_contains(p, k)] end, ' ')) as kept_sha256
from doc left join lost using (r)
"""

OP13_SQL = r"""
with recursive doc as (
  select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(
    regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda w: w <> '') as w
  from documents),
shingle as (
  select distinct r, array_to_string(w[i:i + 3], ' ') as s
  from doc, lateral (select unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i)
  where len(w) > 0),
size as (select r, count(*) as n from shingle group by r),
meet as (
  select a.r as a, b.r as b, count(*) as c from shingle a join shingle b on a.s = b.s and a.r <> b.r
  group by all),
link as (
  select a, b from meet join size x on x.r = a join size y on y.r = b
  where 100 * c >= 85 * (x.n + y.n - c)),
reach as (
  select r as a, r as b from doc union select reach.a, link.b from reach join link on reach.b = link.a)
select d.doc_id, coalesce(any_value(size.n), 0) as n_shingles, min(e.doc_id) as component_id
from doc d join reach on d.r = reach.a join doc e on e.r = reach.b left join size on size.r = d.r
group by d.r, d.doc_id
"""

ORACLES = {"op1_mix_sources": OP1_SQL, "op8_substring_dedup": OP8_SQL,
           "op13_ngram_join": OP13_SQL}
