"""Queries over a feed of items (orders), their groups and memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import columns as c
from loomtext.operators import frames as f
from loomtext.plans.registry import query

FEED = "n as (select *, row_number() over (order by o_orderdate desc, o_orderkey desc) - 1 as pos, count(*) over () as total from orders), feed as (select *, pos - total + (total * 9) // 10 + 1 as number from n)"


def feed(t):
    return f.newest_first(t.orders).withColumn("number", f.display_number(F.col("pos"), F.col("total"), F.expr("(total * 9) div 10")))


@query(f"with {FEED} select o_orderkey, pos, number, number <= 0 as is_new from feed")
def feed_display_numbers(t):
    return feed(t).select("o_orderkey", "pos", "number", (F.col("number") <= 0).alias("is_new"))


@query("select o_orderkey from orders where o_orderdate > (select max(o_orderdate) - interval 60 day from orders)")
def feed_new_head(t):
    last = t.orders.agg(F.max("o_orderdate").alias("last"))
    return t.orders.join(F.broadcast(last)).where(F.col("o_orderdate") > F.col("last") - F.expr("interval 60 days")).select("o_orderkey")


@query(f"with {FEED} select o_orderkey, c_mktsegment, row_number() over (partition by c_mktsegment order by pos) as in_group from feed join customer on o_custkey = c_custkey")
def group_numbering(t):
    """Segments are few and large: each is numbered by days and blocks of keys."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_mktsegment")
    return f.numbered(rows, **f.newest_days(rows), keys=("c_mktsegment",)).select("o_orderkey", "c_mktsegment", (F.col("pos") + 1).alias("in_group"))


@query(f"""with {FEED}
select c_mktsegment, count(*) as items, sum(cast(floor(o_totalprice / 100) as bigint)) as minutes, min(number) as first_number, max(number) as last_number,
       round(sum(cast(floor(o_totalprice / 100) as bigint)) * 0.006 * 2, 2) as cost
from feed join customer on o_custkey = c_custkey where not (o_orderdate < timestamp '1995-01-01' and o_orderstatus = 'F') group by 1 order by 1""")
def summary_by_group(t):
    rows = feed(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    kept = rows.where(~((F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F")))
    minutes = F.sum(F.floor(F.col("o_totalprice") / 100).cast("long"))
    grouped = kept.groupBy("c_mktsegment").agg(F.count("*").alias("items"), minutes.alias("minutes"), F.min("number").alias("first_number"), F.max("number").alias("last_number"))
    return grouped.withColumn("cost", F.round(c.cost_usd(F.col("minutes") * 60, F.lit(0.006), F.lit(2)), 2)).orderBy("c_mktsegment")


@query(f"with {FEED} select o_orderkey, number from feed where number between 100 and 100 + 50 - 1")
def range_slice(t):
    return feed(t).where(F.col("number").between(100, 149)).select("o_orderkey", "number")


@query("""with s as (select l_orderkey, l_suppkey, sum(l_quantity) as q, count(*) as n, min(l_linenumber) as first from lineitem group by all),
z as (select l_suppkey, count(*) as size from lineitem group by 1),
r as (select s.*, z.size, row_number() over (partition by l_orderkey order by q desc, n desc, size, first, s.l_suppkey) as k from s join z on s.l_suppkey = z.l_suppkey)
select l_orderkey, l_suppkey from r where k = 1""")
def best_membership(t):
    pairs = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.min("l_linenumber").alias("first"))
    sizes = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("size"))
    return f.best(pairs.join(sizes, "l_suppkey"), ["l_orderkey"], "l_suppkey", -F.col("q"), -F.col("n"), F.col("size"), F.col("first"))


@query("""select p_partkey as id, lower(p_name) as name, true as only_member from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)
union all select distinct l_partkey, null, false from lineitem where l_quantity > 45""")
def membership_only(t):
    known = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()
    only = t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name")).join(known, "id", "left_anti").withColumn("only_member", F.lit(True))
    return only.unionByName(known.withColumn("name", F.lit(None).cast("string")).withColumn("only_member", F.lit(False)))


@query("""with a as (select distinct o_custkey as id from orders where o_orderdate < timestamp '1996-01-01'), b as (select distinct o_custkey as id from orders where o_orderdate >= timestamp '1996-01-01')
select id, 'added' as change from b where id not in (select id from a) union all select id, 'removed' from a where id not in (select id from b)""")
def set_diff_two_snapshots(t):
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    ids = t.orders.select(F.col("o_custkey").alias("id"), "o_orderdate")
    return f.diff_by_key(ids.where(F.col("o_orderdate") < cut), ids.where(F.col("o_orderdate") >= cut), "id")


@query("select p_partkey, case when p_size > 40 then 'hand' else p_brand end as owner from part")
def override_merge(t):
    base = t.part.select("p_partkey", F.col("p_brand").alias("owner"))
    return f.override(base, t.part.where("p_size > 40").select("p_partkey", F.lit("hand").alias("owner")), "p_partkey")


@query("""with n as (select p_brand, l_suppkey, count(*) as n from lineitem join part on l_partkey = p_partkey group by all),
r as (select *, row_number() over (partition by p_brand order by n desc, l_suppkey) as k from n) select p_brand, l_suppkey, n from r where k = 1""")
def group_argmax(t):
    counts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.count("*").alias("n"))
    return counts.groupBy("p_brand").agg(F.max_by(F.struct("l_suppkey", "n"), F.struct("n", -F.col("l_suppkey"))).alias("m")).select("p_brand", "m.l_suppkey", "m.n")


@query("""select o_orderpriority, count(*) as length_curr, count(*) filter (where o_orderdate < timestamp '1997-01-01') as length_old from orders group by 1""")
def lengths_current_baseline(t):
    now = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("length_curr"))
    old = t.orders.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).groupBy("o_orderpriority").agg(F.count("*").alias("length_old"))
    return now.join(old, "o_orderpriority", "left").withColumn("length_old", F.coalesce("length_old", F.lit(0).cast("long")))


@query("""select coalesce(c_mktsegment, '(none)') as bucket, count(*) as n from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey group by 1""")
def unknown_bucket(t):
    known = t.customer.where("c_acctbal > 0")
    return t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.coalesce("c_mktsegment", F.lit("(none)")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""select n_nationkey, '#' || case when n >= 702 then chr((65 + (n - 702) // 676)::int) else '' end || case when n >= 26 then chr((65 + (n // 26 - 1) % 26)::int) else '' end || chr((65 + n % 26)::int) as alias from (select n_nationkey, n_nationkey * 300 as n from nation)""")
def alias_letters(t):
    return t.nation.select("n_nationkey", c.excel_alias(F.col("n_nationkey") * 300).alias("alias"))


@query("""with m as (select p_partkey, p_name, case when p_name = q then 1 when starts_with(p_name, q) then 2 end as tier, q from part, (select min(p_name)[1:5] as q from part)),
b as (select min(tier) as best from m) select p_partkey, tier, count(*) over () = 1 as is_unique from m, b where tier = best""")
def title_match_tiers(t):
    q = t.part.agg(F.substring(F.min("p_name"), 1, 5).alias("q"))
    tier = F.when(F.col("p_name") == F.col("q"), 1).when(F.col("p_name").startswith(F.col("q")), 2)
    met = t.part.join(F.broadcast(q)).withColumn("tier", tier).where("tier is not null")
    found = met.join(F.broadcast(met.agg(F.min("tier").alias("best"), F.count("*").alias("n"))))
    counts = met.groupBy("tier").agg(F.count("*").alias("same"))
    return found.where("tier = best").join(counts, "tier").select("p_partkey", "tier", (F.col("same") == 1).alias("is_unique"))


@query("""with q as (select conv_id, turn + 1 as slot from conversations where role = 'user'), a as (select conv_id, turn as slot from conversations where role = 'assistant')
select coalesce(q.conv_id, a.conv_id) as conv_id, coalesce(q.slot, a.slot) as slot, case when a.slot is null then 'no answer' else 'no request' end as problem from q full outer join a on q.conv_id = a.conv_id and q.slot = a.slot where q.slot is null or a.slot is null""")
def slot_bijection(t):
    """Requests and answers must meet one to one: the slots where a side is missing."""
    asked = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("slot"), F.lit(True).alias("asked"))
    given = t.conversations.where("role = 'assistant'").select("conv_id", F.col("turn").alias("slot"), F.lit(True).alias("given"))
    met = asked.join(given, ["conv_id", "slot"], "full_outer").where("asked is null or given is null")
    return met.select("conv_id", "slot", F.when(F.col("given").isNull(), "no answer").otherwise("no request").alias("problem"))


@query("""select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag in ('N', 'R') group by 1 having count(distinct l_returnflag) = 2)""")
def pending_inputs(t):
    done = t.lineitem.where(F.col("l_returnflag").isin("N", "R")).groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("kinds")).where("kinds = 2")
    return t.orders.select("o_orderkey").join(done.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""select n_name, case when r_regionkey is null then 'unknown' else 'missing' end as problem from (select n_name, n_regionkey from nation) n
left join (select * from region where r_regionkey < 3) r on n_regionkey = r_regionkey where r_regionkey is null
union all select n_name, 'missing' from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9000)""")
def folder_check(t):
    known = t.region.where("r_regionkey < 3")
    unknown = t.nation.join(known, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").select("n_name", F.lit("unknown").alias("problem"))
    used = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return unknown.unionByName(t.nation.join(used, "n_nationkey", "left_anti").select("n_name", F.lit("missing").alias("problem")))


@query("""select o_orderkey, o_orderpriority || ' | ' || c_name || ' : ' || o_orderstatus as title, count(*) over (partition by c_mktsegment) - count(*) filter (where o_totalprice >= 1000) over (partition by c_mktsegment) as excluded
from orders join customer on o_custkey = c_custkey""")
def entry_projection(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    dropped = rows.groupBy("c_mktsegment").agg(F.count_if(F.col("o_totalprice") < 1000).alias("excluded"))
    return rows.join(dropped, "c_mktsegment").select("o_orderkey", F.concat(c.display_title(F.col("o_orderpriority"), F.col("c_name")), F.lit(" : "), "o_orderstatus").alias("title"), "excluded")


@query("""select l_orderkey, coalesce(max(p_type) filter (where l_linenumber = 1), 'content') as role, coalesce(max(l_linenumber) filter (where l_linenumber > 5), 0) as reveals from orders
left join lineitem on o_orderkey = l_orderkey left join part on l_partkey = p_partkey and p_size < 25 where l_orderkey is not null group by 1""")
def scene_reveal_join(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part.where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy("l_orderkey").agg(
        F.coalesce(F.max(F.when(F.col("l_linenumber") == 1, F.col("p_type"))), F.lit("content")).alias("role"),
        F.coalesce(F.max(F.when(F.col("l_linenumber") > 5, F.col("l_linenumber"))), F.lit(0)).alias("reveals"),
    )


@query("""select l_orderkey, case when bool_or(l_returnflag = 'R') then null else max(l_linenumber) end as done from lineitem group by 1""")
def progress_dominates(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.when(~F.bool_or(F.col("l_returnflag") == "R"), F.max("l_linenumber")).alias("done"))


@query("""select c_mktsegment, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by rollup (c_mktsegment, o_orderstatus)""")
def stats_rollup(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with s as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as k from lineitem),
n as (select l_suppkey, l_returnflag, count(*) as n, min(k) as first from s where k <= 5 group by all),
r as (select *, row_number() over (partition by l_suppkey order by n desc, first) as p from n) select l_suppkey, l_returnflag from r where p = 1""")
def sample_majority(t):
    five = f.top(t.lineitem, ["l_suppkey"], 5, "l_orderkey", "l_linenumber")
    counts = five.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return counts.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("n", -F.col("first"))).alias("l_returnflag"))


@query("""with c as (select o_custkey, count(*) as now, count(*) filter (where o_orderdate < timestamp '1997-06-01' and o_orderkey % 11 <> 0) as old, max(o_orderdate) filter (where o_orderdate < timestamp '1997-06-01') as was, max(o_orderkey % 13) = 12 as token,
max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as head, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) filter (where o_orderdate < timestamp '1997-06-01' and o_orderkey % 11 <> 0) as known from orders group by 1)
select o_custkey, case when old = 0 then 'full' when token then 'extend' when head = known and was >= timestamp '1996-06-01' then 'reuse' when head = known and now < old + 1 then 'touch' when head = known then 'emergency' when now < old then 'unchanged' when now - old > 5 then 'emergency' else 'prepend' end as state from c""")
def refresh_state(t):
    """What to do with each customer's cached list: its rows before a day, but for some that are lost, against the live one."""
    before = F.col("o_orderdate") < F.lit("1997-06-01").cast("timestamp_ntz")
    cached = before & (F.col("o_orderkey") % 11 != 0)
    head = F.struct("o_orderdate", "o_orderkey")
    seen = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("now"), F.count_if(cached).alias("old"), F.max(F.when(before, F.col("o_orderdate"))).alias("was"), (F.max(F.col("o_orderkey") % 13) == 12).alias("token"),
        F.max(head).alias("head"), F.max(F.when(cached, head)).alias("known"),
    )
    return seen.select("o_custkey", c.refresh_action(F.col("old"), F.col("token"), F.col("head") == F.col("known"), F.col("was") >= F.lit("1996-06-01").cast("timestamp_ntz"), F.col("now") == F.col("old"), F.col("now") - F.col("old"), 5).alias("state"))


@query(f"""with {FEED}, b as (select o_orderkey as old_key, row_number() over (order by o_orderdate desc, o_orderkey desc) - 1 as p from orders where o_orderkey % 100 <> 0)
select pos, o_orderkey = old_key as same, o_orderdate < timestamp '1998-01-01' - interval 24 hour as stale from feed join b on pos = p where pos < 50""")
def cache_match(t):
    live = f.newest_first(t.orders).where("pos < 50")
    cached = f.newest_first(t.orders.where("o_orderkey % 100 <> 0")).where("pos < 50").select("pos", F.col("o_orderkey").alias("old_key"))
    stale = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz") - F.expr("interval 24 hours")
    return live.join(cached, "pos").select("pos", (F.col("o_orderkey") == F.col("old_key")).alias("same"), stale.alias("stale"))


@query("""with d as (select o_orderkey, o_orderkey % 3 as u, case o_orderkey % 3 when 0 then date '2024-03-31' - (o_orderkey % 20)::int when 1 then date '2024-03-31' - 7 * (o_orderkey % 20)::int else date '2024-03-01' - to_months((o_orderkey % 20)::int) end::date as d from orders)
select o_orderkey, case when u = 2 then strftime(d, '%Y-%m') else strftime(d, '%Y-%m-%d') end as age from d""")
def relative_dates(t):
    unit = F.element_at(F.array(F.lit("days"), F.lit("weeks"), F.lit("months")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat_ws(" ", (F.col("o_orderkey") % 20).cast("string"), unit, F.lit("ago"))
    return t.orders.select("o_orderkey", c.relative_date(text, F.lit("2024-03-31").cast("date")).alias("age"))
