"""Quality rules with thresholds that adapt to each language and source.

Method: every signal of every document goes into a mergeable quantile sketch
(counts in buckets of bounded relative width, so sketches merge by addition and
do not depend on how rows are split). Sketches exist per language and source
and, merged, per language and overall. Each is pooled with its parent's, which
counts as PRIOR documents: a large source is judged by its own quartiles, a
sparse one leans on its language, without a size at which that changes. The
quartiles give fences, and documents are filtered by joining the fences back.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import store, text

#: The symbols counted as noise.
SYMBOLS = "[#*$%&|<>]"
#: Buckets for each doubling of a value: a quantile is off by 1/32 of its value at most.
STEPS = 32
#: A language's sorted counts, up to STEPS * 64 of them in a row, are broadcast up to so many rows.
WIDE_ROWS = 2000
#: Documents that the parent's sketch counts as beside a sketch's own.
PRIOR = 100


@dataclass(frozen=True)
class Rule:
    """An adaptive rule: a document fails outside [q1 - reach * spread, q3 + reach * spread]."""

    signal: str
    #: Least spread, in the signal's unit, so that a uniform source does not reject small deviations.
    least_spread: int
    two_sided: bool = False


RULES = (
    Rule("word_length", 60, two_sided=True),  # code points of 100 words
    Rule("symbol_share", 150),  # of 10,000 code points in words
    Rule("dup_line_share", 2000),  # of 10,000 lines
    Rule("repeat_share", 1000),  # of 10,000 words
)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    Windows are hashed with their positions, sorted, and compared with their
    neighbours; the positions found are then merged as intervals.
    """
    size = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))

    def starts(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    return F.when(size < 3, F.lit(0)).otherwise(text.let(F.array_sort(hashed), lambda o: covered(F.array_sort(starts(o)))))


def signals(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add the counts of each whole text and the signals made of them."""
    whole = F.coalesce(F.col(column), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: text.squeezed(x) != "")
    counted = docs.withColumn(
        "_c",
        text.let(
            F.struct(text.words(whole).alias("w"), lines.alias("l"), F.length(text.squeezed(whole)).alias("c")),
            lambda x: F.struct(
                F.size(x["w"]).cast("long").alias("n_words"),
                x["c"].cast("long").alias("word_chars"),
                F.size(x["l"]).cast("long").alias("n_lines"),
                (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
                text.let(x["w"], repeated_words).cast("long").alias("n_repeat_words"),
            ),
        ),
    ).withColumn("n_symbols", (F.length(whole) - F.length(F.translate(whole, SYMBOLS[1:-1], ""))).cast("long"))
    got = counted.select(*[c for c in counted.columns if c != "_c"], "_c.*")
    of = lambda a, b, unit: F.expr(f"coalesce(({a} * {unit}) div nullif({b}, 0), 0)")
    return got.withColumns({
        "word_length": of("word_chars", "n_words", 100),
        "symbol_share": of("n_symbols", "word_chars", 10000),
        "dup_line_share": of("n_dup_lines", "n_lines", 10000),
        "repeat_share": of("n_repeat_words", "n_words", 10000),
    })


def bucket(value: Column) -> Column:
    """The sketch bucket of a whole number from 0: exact below STEPS, then STEPS for each doubling."""
    e = F.length(F.bin(value)) - 1
    return F.when(value < STEPS, value).otherwise(STEPS * (e - 4) + F.floor(value / F.pow(F.lit(2.0), e - 5)) - STEPS).cast("int")


def bucket_low(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.floor(b / STEPS) - 1
    return F.when(b < STEPS, b).otherwise((b % STEPS + STEPS) * F.pow(F.lit(2.0), e)).cast("long")


def sketch(rows: DataFrame, keys: list[str], rules=RULES) -> DataFrame:
    """Quantile sketches of all signals by ``keys``: one row for each non-empty bucket."""
    each = F.explode(F.array(*[F.struct(F.lit(r.signal).alias("signal"), bucket(F.col(r.signal)).alias("bucket")) for r in rules]))
    return rows.select(*keys, each.alias("s")).groupBy(*keys, "s.signal", "s.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to coarser keys by adding their buckets."""
    return sketches.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def cumulated(sketches: DataFrame, grid: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``grid`` (keys, signal, bucket, ...) with the sketch's counts up to each bucket (``name``) and in all (``n_<name>``)."""
    own = sketches.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "signal", "bucket")], "n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "signal", "bucket")]
    met = grid.join(own, same, "left").drop(*[f"_{k}" for k in (*keys, "signal", "bucket")]).withColumn("n", F.coalesce("n", F.lit(0)))
    group = Window.partitionBy(*keys, "signal")
    return met.withColumn(name, F.sum("n").over(group.orderBy("bucket"))).withColumn(f"n_{name}", F.sum("n").over(group)).drop("n")


def priors(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """What a source leans on: for every language and signal, the documents up to each bucket of its sketch pooled with that of all, as ``prior`` documents in the end.

    A sketch has at most STEPS buckets for each bit of a 64-bit number, so the
    buckets of all documents, a few thousand, are broadcast to every language.
    """
    every = store.table(merge(sketches, []), "overall")
    whole = cumulated(every, every.select("signal", "bucket"), [], "c_all")
    grid = sketches.select("lang", "signal").distinct().join(F.broadcast(whole), "signal")
    k = F.lit(float(prior))
    of_lang = F.col("c_lang") + k * F.col("c_all") / F.col("n_c_all")
    return cumulated(merge(sketches, ["lang"]), grid, ["lang"], "c_lang").select("lang", "signal", "bucket", (k * of_lang / (F.col("n_c_lang") + k)).alias("lean"))


def first_where(items: Column, holds) -> Column:
    """The first item for which ``holds`` in an array where it holds from some item on, by halving; null if for none."""
    ends = F.struct(F.lit(0).alias("low"), F.size(items).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        there = F.coalesce(holds(F.get(items, mid)), F.lit(True))
        return F.when(s["low"] >= s["high"], s).when(there, F.struct(s["low"].alias("low"), mid.alias("high"))).otherwise(F.struct((mid + 1).alias("low"), s["high"].alias("high")))

    return F.get(items, F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(items)))), ends, halve, lambda s: s["low"]))


def quartiles(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Quartiles of the sketch of every language and source pooled with ``priors``: lang, source, signal, n_docs, q1, q3.

    One row for each group holds its own buckets alone. Between two of them only
    the language's counts rise, so a quartile lies at the first own bucket that
    reaches its share, or before it where the language's sorted counts do.
    """
    leans = store.table(priors(sketches, prior), "leans").select(F.col("lang").alias("_lang"), F.col("signal").alias("_signal"), F.col("bucket").alias("_bucket"), "lean")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("signal") == F.col("_signal"))
    met = store.join_small(sketches, leans, same & (F.col("bucket") == F.col("_bucket")), "inner")
    own = met.groupBy("lang", "source", "signal").agg(F.sum("n").alias("n_docs"), F.array_sort(F.collect_list(F.struct("bucket", "n", "lean"))).alias("own"))
    rising = leans.groupBy("_lang", "_signal").agg(F.array_sort(F.collect_list(F.struct(F.col("_bucket").alias("bucket"), "lean"))).alias("rising"))
    rows = store.join_small(own, store.table(rising, "rising"), same, "inner", limit=WIDE_ROWS)

    def quartile(part: int) -> Column:
        reached = lambda n, lean: (n + lean) * 4 >= (F.col("n_docs") + float(prior)) * (part - 1e-9)
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("int").alias("hit"))

        def step(s: Column, x: Column) -> Column:
            upto = s["before"] + x["n"]
            there = reached(upto, x["lean"])
            return F.when(s["hit"].isNotNull(), s).otherwise(F.struct(F.when(there, s["before"]).otherwise(upto).alias("before"), F.when(there, x["bucket"]).alias("hit")))

        return text.let(F.aggregate("own", start, step), lambda s: F.least(s["hit"], first_where(F.col("rising"), lambda x: reached(s["before"], x["lean"]))["bucket"]))

    at = rows.select("lang", "source", "signal", "n_docs", quartile(1).alias("b1"), quartile(3).alias("b3"))
    return at.select("lang", "source", "signal", "n_docs", bucket_low(F.col("b1")).alias("q1"), bucket_low(F.col("b3")).alias("q3"))


def fences(sketches: DataFrame, reach: int, rules=RULES, prior: int = PRIOR) -> DataFrame:
    """The fences that the quartiles of every pooled sketch imply: lang, source, n_docs, and lo_/hi_ for each signal."""
    quart = quartiles(sketches, prior)
    at = lambda c, r: F.max(F.when(F.col("signal") == r.signal, F.col(c)))
    wide = [F.max("n_docs").alias("n_docs")]
    for r in rules:
        spread = F.greatest(at("q3", r) - at("q1", r), F.lit(r.least_spread).cast("long")) * reach
        wide += [(at("q3", r) + spread).alias(f"hi_{r.signal}"), (at("q1", r) - spread if r.two_sided else F.lit(0).cast("long")).alias(f"lo_{r.signal}")]
    return quart.groupBy("lang", "source").agg(*wide)


def apply_rules(docs: DataFrame, reach: int = 3, rules=RULES, prior: int = PRIOR) -> DataFrame:
    """Judge every document by the base rules and the fences of its language and source.

    Takes doc_id, text, lang, source; returns doc_id, the counts, base_failed,
    kept and n_group, the documents of its language and source. Null languages
    and sources are groups of their own. A null or empty text has no words and
    fails the base rules; very long texts are read whole. Repeated rows are
    judged alike and tied values share a bucket; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    rows = store.table(signals(docs.select("doc_id", "lang", "source", "text")).drop("text"), "signals")
    fine = store.table(sketch(rows, ["lang", "source"], rules), "sketch")
    cuts = fences(fine, reach, rules, prior)
    table = store.table(cuts.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*[c for c in cuts.columns if c not in ("lang", "source")]).alias("cut")), "cuts")
    on = rows["lang"].eqNullSafe(table["_lang"]) & rows["source"].eqNullSafe(table["_source"])
    inside = F.lit(True)
    for r in rules:
        inside = inside & F.col(r.signal).between(F.col(f"cut.lo_{r.signal}"), F.col(f"cut.hi_{r.signal}"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return store.join_small(rows, table, on).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.coalesce(inside, F.lit(False))).alias("kept"), F.col("cut.n_docs").alias("n_group")
    )


#: The same in DuckDB's SQL.
ORACLE = r"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (select doc_id, i, w[i] as a, w[i+1] as b, w[i+2] as c from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from w)),
d as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as n from g) where n > 1),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i+1, i+2]) as p from d) group by 1),
s as (
  select w.doc_id, lang, source, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
         len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from w left join r on w.doc_id = r.doc_id),
m as (
  select *, coalesce(word_chars * 100 // nullif(n_words, 0), 0) as word_length, coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0) as symbol_share,
         coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) as dup_line_share, coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) as repeat_share
  from s),
v as (unpivot (select doc_id, lang, source, word_length, symbol_share, dup_line_share, repeat_share from m) on word_length, symbol_share, dup_line_share, repeat_share into name signal value v),
b as (select lang, source, signal, case when v < 32 then v else 32 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 6)) - 32 end as bucket from v),
k as (select lang, source, signal, bucket, count(*) as n from b group by all),
kl as (select lang, signal, bucket, sum(n) as n from k group by all),
ka as (select signal, bucket, sum(n) as n from k group by all),
a as (select signal, bucket, sum(n) over (partition by signal order by bucket) as ca, sum(n) over (partition by signal) as na from ka),
l as (select g.lang, a.signal, a.bucket, ca, na, sum(coalesce(kl.n, 0)) over (partition by g.lang, a.signal order by a.bucket) as cl, sum(coalesce(kl.n, 0)) over (partition by g.lang, a.signal) as nl
      from (select distinct lang from k) g cross join a left join kl on kl.lang is not distinct from g.lang and kl.signal = a.signal and kl.bucket = a.bucket),
u as (select l.lang, g.source, l.signal, l.bucket, ca, na, cl, nl, sum(coalesce(k.n, 0)) over (partition by l.lang, g.source, l.signal order by l.bucket) as co, sum(coalesce(k.n, 0)) over (partition by l.lang, g.source, l.signal) as no
      from (select distinct lang, source from k) g join l on l.lang is not distinct from g.lang
      left join k on k.lang is not distinct from g.lang and k.source is not distinct from g.source and k.signal = l.signal and k.bucket = l.bucket),
p as (select lang, source, signal, bucket, no, co::double + 100.0::double * (cl::double + 100.0::double * ca::double / na::double) / (nl::double + 100.0::double) as upto, no::double + 100.0::double as total from u),
q0 as (select lang, source, signal, max(no) as no, min(case when upto * 4 >= total * (1 - 1e-9)::double then bucket end) as b1, min(case when upto * 4 >= total * (3 - 1e-9)::double then bucket end) as b3 from p group by all),
q as (select *, case when b1 < 32 then b1 else (b1 % 32 + 32) << (b1 // 32 - 1) end as q1, case when b3 < 32 then b3 else (b3 % 32 + 32) << (b3 // 32 - 1) end as q3 from q0),
f as (
  select lang, source, signal, no, q3 + 3 * greatest(q3 - q1, case signal when 'word_length' then 60 when 'symbol_share' then 150 when 'dup_line_share' then 2000 else 1000 end) as hi,
         case when signal = 'word_length' then q1 - 3 * greatest(q3 - q1, 60) else 0 end as lo from q),
i as (select v.doc_id, bool_and(v.v between f.lo and f.hi) as inside, max(f.no) as n_group
      from v join f on f.signal = v.signal and f.lang is not distinct from v.lang and f.source is not distinct from v.source group by 1)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and inside) as kept, n_group::bigint as n_group
from m join i on m.doc_id = i.doc_id
"""
