"""Queries over names, titles and small lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import columns as c
from loomtext.operators import frames as f
from loomtext.operators import naming
from loomtext.plans.registry import query


@query(r"""with s as (select p_partkey, rtrim(trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '_', 'g'), '_')[1:60], '_') as slug from part),
r as (select *, row_number() over (partition by slug order by p_partkey) as k from s) select p_partkey, slug || case when k > 1 then '_' || k else '' end as folder from r""")
def slug_names(t):
    slugs = t.part.select("p_partkey", c.slug(F.col("p_name")).alias("slug"))
    k = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return slugs.withColumn("k", k).select("p_partkey", F.when(F.col("k") > 1, F.concat_ws("_", "slug", "k")).otherwise(F.col("slug")).alias("folder"))


@query("""select p_partkey, case when p_partkey % 3 <> 0 then lpad((p_partkey % 99)::varchar, 2, '0') || '_' || p_name when p_size < 10 then '0' || p_size || '. ' || p_name else p_size || '. ' || p_name end as name from part""")
def zero_pad_names(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", c.zero_padded(name, F.col("p_partkey") % 99).alias("name"))


@query("select p_brand, bool_and(p_name = lower(p_name)) as generated, count(*) as n from part group by 1")
def all_generated_titles(t):
    return t.part.groupBy("p_brand").agg(F.bool_and(F.col("p_name") == F.lower("p_name")).alias("generated"), F.count("*").alias("n"))


@query("select p_brand, count(*) >= 2 and avg(regexp_matches(p_size || '. ' || p_name, '^[0-9]{2}[.] ')::int) >= 0.5 as course from part group by 1")
def numbered_share(t):
    marked = F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_name").rlike(r"^\d{2}\. ")
    return t.part.groupBy("p_brand").agg(((F.count("*") >= 2) & (F.avg(marked.cast("int")) >= 0.5)).alias("course"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'an') order by lower(p_name), p_partkey")
def title_substring(t):
    return t.part.where(F.lower("p_name").contains("an")).select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_partkey")


@query("select s_suppkey, coalesce(case when s_suppkey % 5 = 0 then 'command' end, case when s_acctbal > 5000 then 'settings' end, case when s_nationkey < 5 then 'script' end, 'fallback') as value from supplier")
def value_precedence(t):
    when = lambda x, v: F.when(F.expr(x), F.lit(v))
    return t.supplier.select("s_suppkey", F.coalesce(when("s_suppkey % 5 = 0", "command"), when("s_acctbal > 5000", "settings"), when("s_nationkey < 5", "script"), F.lit("fallback")).alias("value"))


@query("select c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::bigint as marked, count(o_orderkey) as n from customer left join orders on o_custkey = regexp_extract(c_name, '([0-9]+)$', 1)::bigint group by all")
def marker_join(t):
    marked = t.customer.withColumn("marked", F.regexp_extract("c_name", r"(\d+)$", 1).cast("long"))
    return marked.join(t.orders, F.col("o_custkey") == F.col("marked"), "left").groupBy("c_custkey", "marked").agg(F.count("o_orderkey").alias("n"))


@query("select max(length(p_partkey::varchar)) as key_width, max(length(p_name)) as name_width, max(length(p_brand || ' ' || p_size)) as brand_width from part")
def column_widths(t):
    width = lambda x: F.max(F.length(x))
    return t.part.agg(width(F.col("p_partkey").cast("string")).alias("key_width"), width("p_name").alias("name_width"), width(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))).alias("brand_width"))


@query("with l as (select unnest(range(1, (select max(length(n_name)) + 1 from nation))) as n), p as (select n, count(distinct n_name[1:n]) as d, count(distinct n_name) as all_names from nation, l group by 1) select min(n)::bigint as length from p where d = all_names")
def shortest_unique_prefix(t):
    cut = t.nation.join(F.broadcast(t.nation.agg(F.max(F.length("n_name")).alias("_longest")))).select("n_name", F.explode(F.sequence(F.lit(1), F.col("_longest"))).alias("n")).withColumn("head", F.substr("n_name", F.lit(1), F.col("n")))
    return cut.groupBy("n").agg(F.count_distinct("head").alias("d"), F.count_distinct("n_name").alias("all_names")).where("d = all_names").agg(F.min("n").cast("long").alias("length"))


@query("select n_name from nation where n_regionkey = 1 intersect select n_name from nation where n_nationkey < 10")
def forbidden_overlap(t):
    return t.nation.where("n_regionkey = 1").select("n_name").intersect(t.nation.where("n_nationkey < 10").select("n_name"))


@query("select p_partkey, strftime(date '2022-02-24' + (p_size * 120 - 1)::int, '%Y-%m-%d') as day from part where p_size * 120 between 1 and 5000")
def day_number_date(t):
    title = F.concat(F.lit("Day "), (F.col("p_size") * 120).cast("string"))
    return t.part.withColumn("day", F.date_format(c.numbered_day(title), "yyyy-MM-dd")).where("day is not null").select("p_partkey", "day")


BASES = "select doc_id, case when n_chars % 4 = 0 then source || '_' || (n_chars % 7 + 1) else source end as base from documents"


@query(f"""with recursive d as (select doc_id, base, row_number() over (order by doc_id) as r from ({BASES})),
u as (select 0::bigint as r, null::bigint as doc_id, null::varchar as name, []::varchar[] as used
union all select r, doc_id, name, list_append(used, name) from (
  select d.r, d.doc_id, u.used, list_filter(list_transform(range(1, len(u.used) + 2), lambda k: case when k = 1 then d.base else d.base[:60 - length('_' || k)] || '_' || k end), lambda x: not list_contains(u.used, x))[1] as name
  from u join d on d.r = u.r + 1))
select doc_id, name from u where r > 0""")
def unique_names(t):
    """A name for each document from its source, with a number where it is taken, also where the number is part of another's base."""
    base = F.when(F.col("n_chars") % 4 == 0, F.concat_ws("_", "source", (F.col("n_chars") % 7 + 1).cast("string"))).otherwise(F.col("source"))
    return naming.unique_names(t.documents.select("doc_id", base.alias("base")), "base", "doc_id", f.id_block(F.col("doc_id"))).select("doc_id", "name")
