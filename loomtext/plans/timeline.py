"""Queries over timed events and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import columns as c
from loomtext.operators import edges
from loomtext.operators import frames as f
from loomtext.plans.registry import query

SEC = "epoch_us(ts) / 1000000.0"


def events(t):
    """Events with ``t``, seconds since 1970."""
    return t.events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)


@query("""with s as (select event_id, (event_id * 37) % 9000 as s from events),
x as (select event_id, case when s >= 3600 then (s // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') end as text, s from s)
select event_id, text, s as seconds from x""")
def duration_format(t):
    text = c.duration_text(F.col("event_id") * 37 % 9000)
    return t.events.select("event_id", text.alias("text")).withColumn("seconds", c.duration_seconds(F.col("text")))


@query(f"""with g as (select event_id, user_id, case when {SEC} - lag({SEC}) over (partition by user_id order by ts, event_id) >= 21600 then 1 else 0 end as new, ts from events)
select event_id, user_id, 1 + sum(new) over (partition by user_id order by ts, event_id) as session from g""")
def gap_sessions(t):
    return f.gap_sessions(events(t), ["user_id"], F.col("t"), ["t", "event_id"], 21600.0).select("event_id", "user_id", "session")


@query(f"""select event_id, round(coalesce(lead({SEC}) over (partition by user_id order by ts, event_id), {SEC} + 1) - {SEC}, 3) as length from events""")
def close_ranges(t):
    return f.close_ranges(events(t), ["user_id"], "t", "event_id").select("event_id", F.round(F.col("end") - F.col("t"), 3).alias("length"))


@query("""select event_id, coalesce(sum(round(value * 100)::bigint) over w, 0)::bigint as start_at, coalesce((sum(round(value * 100)::bigint) over w)::bigint * 1000 // count(*) over w, 100000) as mean_before from events
window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)""")
def offset_accumulate(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    cents = t.events.withColumn("c", F.round(F.col("value") * 100).cast("long"))
    run = cents.withColumn("s", F.sum("c").over(w)).withColumn("n", F.nullif(F.count("*").over(w), F.lit(0)))
    return run.select("event_id", F.coalesce("s", F.lit(0)).alias("start_at"), F.expr("coalesce((s * 1000) div n, 100000)").alias("mean_before"))


@query(f"""with i as (select user_id, {SEC} as lo, {SEC} + value * 60 as hi from events where event_type = 'error'), p as (select event_id as pid, user_id, {SEC} as t from events where event_type = 'purchase')
select pid, round(coalesce(max(hi - lo), 0), 3) as longest from p left join i on p.user_id = i.user_id and t between lo - 60 and hi + 60 group by 1""")
def interval_longest_hit(t):
    e = events(t)
    spans = e.where("event_type = 'error'").select("user_id", F.col("t").alias("lo"), (F.col("t") + F.col("value") * 60).alias("hi"))
    points = e.where("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", "t")
    return f.interval_hit(points, spans, ["user_id"], 3600.0, 60.0).select("pid", F.round("longest", 3).alias("longest"))


@query(f"""with p as (select event_id, user_id, {SEC} as t from events where event_type = 'purchase'), k as (select event_id as rid, user_id, {SEC} as t from events where event_type = 'click'),
r as (select p.event_id as lid, k.rid, abs(p.t - k.t) as gap, row_number() over (partition by p.event_id order by abs(p.t - k.t), k.t, k.rid) as n from p left join k on p.user_id = k.user_id)
select lid, rid, round(gap, 3) as gap from r where n = 1""")
def nearest_event(t):
    e = events(t)
    left = e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("lid"))
    right = e.where("event_type = 'click'").select("user_id", "t", F.col("event_id").alias("rid"))
    return f.nearest(left, right, ["user_id"]).select("lid", "rid", F.round("gap", 3).alias("gap"))


@query("""select l.event_id as lid, r.event_id as signup from (select * from events where event_type <> 'signup') l
asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'signup' group by all) r on l.user_id = r.user_id and l.ts >= r.ts""")
def backward_asof(t):
    e = events(t)
    left = e.where("event_type <> 'signup'").select("user_id", "t", F.col("event_id").alias("lid"))
    return f.backward_asof(left, e.where("event_type = 'signup'").select("user_id", "t", F.col("event_id").alias("signup")), ["user_id"], "signup")


@query("select event_type, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def band_percentiles(t):
    p = lambda q, n: F.round(F.percentile("value", F.lit(q)), 6).alias(n)
    return t.events.groupBy("event_type").agg(p(0.05, "p5"), p(0.5, "p50"), p(0.95, "p95"))


@query("select event_id, coalesce(v < 10, false) or coalesce(n > 95, false) as flagged from (select event_id, nullif(value, round(value)) as v, nullif(value, 96) as n from events)")
def low_confidence(t):
    v = F.nullif(F.col("value"), F.round("value"))
    return t.events.select("event_id", (F.coalesce(v < 10, F.lit(False)) | F.coalesce(F.nullif(F.col("value"), F.lit(96.0)) > 95, F.lit(False))).alias("flagged"))


@query(f"with b as (select min({SEC}) + 86400 as s, min({SEC}) + 172800 as e from events) select user_id, count(*) as n from events, b where {SEC} >= s and {SEC} < e group by 1")
def time_slice(t):
    e = events(t)
    first = F.broadcast(e.agg(F.min("t").alias("first")))
    return e.join(first).where((F.col("t") >= F.col("first") + 86400) & (F.col("t") < F.col("first") + 172800)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""with v as (select event_id, user_id, {SEC} as s, {SEC} + 3600 as e from events where event_type = 'purchase'), k as (select user_id, event_id, {SEC} as t from events where event_type = 'view')
select v.event_id, string_agg(k.event_id::varchar, ' ' order by t, k.event_id) as views from v join k on v.user_id = k.user_id and t >= s and t < e group by 1""")
def window_pairing(t):
    e = events(t)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("k"), F.col("t").alias("at"))
    spans = e.where("event_type = 'purchase'").select("user_id", "event_id", "t").withColumn("hour", F.explode(F.sequence(F.floor(F.col("t") / 3600), F.floor(F.col("t") / 3600) + 1)))
    met = spans.join(views.withColumn("hour", F.floor(F.col("at") / 3600)), ["user_id", "hour"]).where("at >= t and at < t + 3600")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "k"))), lambda x: x["k"].cast("string"))
    return met.groupBy("event_id").agg(F.array_join(ordered, " ").alias("views"))


@query(f"""with b as (select user_id, min({SEC}) as s, max({SEC}) as e from events group by 1 having count(*) > 4), c as (select user_id, i, s + (e - s) * i / 4 as target, s, e from b, (select unnest([1, 2, 3]) as i)),
n as (select c.user_id, i, {SEC} as t, row_number() over (partition by c.user_id, i order by abs({SEC} - target), ts) as k from c join events on c.user_id = events.user_id where {SEC} > s and {SEC} < e)
select distinct user_id, round(t, 3) as cut from n where k = 1""")
def snapped_windows(t):
    e = events(t)
    bounds = e.groupBy("user_id").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n")).where("n > 4")
    cuts = bounds.select("user_id", "s", "e", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i")).withColumn("target", F.col("s") + (F.col("e") - F.col("s")) * F.col("i") / 4)
    met = cuts.join(e.select("user_id", "t"), "user_id").where("t > s and t < e")
    return met.groupBy("user_id", "i").agg(F.min_by("t", F.struct(F.abs(F.col("t") - F.col("target")), "t")).alias("t")).select("user_id", F.round("t", 3).alias("cut")).distinct()


@query("""with g as (select *, value > 50 as hit, row_number() over (partition by user_id order by ts, event_id) - sum((value > 50)::int) over (partition by user_id order by ts, event_id) as i from events),
n as (select user_id, i, count(*) filter (where hit) as n from g group by all) select user_id, max(n) as longest from n group by 1""")
def longest_run(t):
    return f.longest_run(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@query("""with m as (select event_id, (round_even(value * 1000, 0))::bigint as ms from events)
select event_id, lpad((ms // 3600000)::varchar, 2, '0') || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || ',' || lpad((ms % 1000)::varchar, 3, '0') as stamp from m""")
def timestamp_text(t):
    return t.events.select("event_id", c.srt_timestamp(F.col("value")).alias("stamp"))


@query("""select event_id, case when value = 0 then null else round(event_id / value, 6) end as rate, concat_ws('_', event_type, case when user_id % 2 = 0 then 'new' end, nullif(floor(value)::bigint, 0)::varchar) as name from events""")
def rate_and_name(t):
    name = c.option_name(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, F.lit("new")), F.nullif(F.floor("value"), F.lit(0)))
    return t.events.select("event_id", F.round(c.frame_rate(F.col("event_id"), F.col("value")), 6).alias("rate"), name.alias("name"))


@query("select event_id, user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as batch from events")
def micro_batches(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", "user_id", F.floor((k - 1) / 10).alias("batch"))


@query("select event_id, try_cast(props->>'$.k' as bigint) as k, coalesce(try_cast(props->>'$.missing' as double), -1) as missing from events")
def props_extract(t):
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "double"), F.lit(-1.0)).alias("missing"))


def with_vector_before(t):
    """Vectors with ``p``, the one before in the same label, by blocks of ids."""
    return f.previous(t.embeddings, ["label"], f.id_block(F.col("vec_id")), "vec_id", "embedding", "p")


@query("""with v as (select vec_id, label, embedding::double[] as e, lag(embedding::double[]) over (partition by label order by vec_id) as p from embeddings)
select vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * p[i])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(p, lambda x: x * x)))), 4) as similarity from v where p is not null""")
def adjacent_similarity(t):
    return with_vector_before(t).where("p is not null").select("vec_id", F.round(c.cosine(F.col("embedding"), F.col("p")), 4).alias("similarity"))


@query("""with v as (select vec_id, embedding::double[] as e, lag(embedding::double[]) over (partition by label order by vec_id) as p from embeddings)
select vec_id, len(list_filter(range(1, len(e) + 1), lambda i: e[i] > 0.1 and p[i] <= 0.1)) as grown, len(list_filter(range(1, len(e) + 1), lambda i: e[i] > 0.1 and p[i] > 0.1)) as kept from v where p is not null""")
def vector_growth(t):
    pairs = with_vector_before(t).where("p is not null").select("vec_id", F.arrays_zip("embedding", "p").alias("z"))
    on = lambda x: x.cast("double") > 0.1
    return pairs.select("vec_id", F.size(F.filter("z", lambda x: on(x["embedding"]) & ~on(x["p"]))).cast("long").alias("grown"), F.size(F.filter("z", lambda x: on(x["embedding"]) & on(x["p"]))).cast("long").alias("kept"))


def near_sql(cells):
    """SQL for whether cell i (from 1) of a picture of eight columns, or one that touches it, is set."""
    return "(" + " or ".join(f"((i - 1) % 8 + {c} between 0 and 7 and i + {8 * r + c} >= 1 and coalesce({cells}[i + {8 * r + c}], false))" for r in (-1, 0, 1) for c in (-1, 0, 1)) + ")"


@query(f"""with v as materialized (select vec_id, label, embedding::double[] as e, lag(embedding::double[]) over (partition by label order by vec_id) as p from embeddings),
c as (select label, i, avg((abs(e[i] - p[i]) > 0.2)::int) >= 0.36 as restless from v, (select unnest(range(1, 65)) as i) where p is not null group by all),
r as (select label, list(restless order by i) as r from c group by 1), g as (select label, list_transform(range(1, 65), lambda i: not {near_sql("r")}) as m from r),
m as materialized (select label, case when len(list_filter(m, lambda x: x)) >= 0.25 * 64 then m end as m from g),
s as materialized (select vec_id, list_transform(range(1, 65), lambda i: e[i] > 0.1 and coalesce(m[i], m is null)) as a, list_transform(range(1, 65), lambda i: p[i] > 0.1 and coalesce(m[i], m is null)) as b, m is not null as masked from v left join m on v.label is not distinct from m.label where p is not null),
x as (select *, list_filter(range(1, 65), lambda i: a[i] and not {near_sql("b")}) as new, len(list_filter(range(1, 65), lambda i: b[i] and {near_sql("a")})) as still from s),
q as (select vec_id, round(quantile_cont((i - 1) // 8, 0.05) / 8.0, 6) as low, round(quantile_cont((i - 1) // 8, 0.95) / 8.0, 6) as high from (select vec_id, unnest(new) as i from x) group by 1)
select vec_id, masked, len(new) as new, round(len(new) / greatest(1, len(list_filter(a, lambda y: y))), 6) as share, round(still / greatest(1, len(list_filter(b, lambda y: y))), 6) as kept, coalesce(low, 0.0)::double as low, coalesce(high, 0.0)::double as high from x left join q using (vec_id)""")
def masked_growth(t):
    """Vectors of a label as pictures of eight rows: what grew from one to the next outside the cells that never rest."""
    pairs = with_vector_before(t).where("p is not null")
    masks = edges.restless(pairs, "label", "p", "embedding", 8, 0.2, 0.36, 0.25)
    met = f.same_block(pairs, masks, ["label"])
    on = lambda v: F.when(F.col("mask").isNull(), F.transform(v, lambda x: x.cast("double") > 0.1)).otherwise(F.zip_with(v, "mask", lambda x, m: (x.cast("double") > 0.1) & m))
    g = met.select("vec_id", F.col("mask").isNotNull().alias("masked"), edges.growth(on(F.col("p")), on(F.col("embedding")), 8).alias("g"))
    return g.select("vec_id", "masked", "g.new", F.round("g.share", 6).alias("share"), F.round("g.kept", 6).alias("kept"), F.round("g.low", 6).alias("low"), F.round("g.high", 6).alias("high"))
