"""Queries over raw web pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import columns as c
from loomtext.operators import frames as f
from loomtext.operators import rendering
from loomtext.plans.registry import query


@query(r"""select page_id, n, regexp_extract(a, 'href="([^"]*)"', 1) as href, regexp_extract(a, '>([^<]*)<', 1) as label from (select page_id, unnest(range(1, len(l) + 1)) as n, unnest(l) as a from (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*<') as l from pages))""")
def page_links(t):
    found = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">[^<]*<'), F.lit(0))
    each = t.pages.select("page_id", F.posexplode(found).alias("k", "a"))
    return each.select("page_id", (F.col("k") + 1).alias("n"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("label"))


TAGS = r"""g as (select page_id, unnest(range(len(l))) as k, unnest(l) as tag from (select page_id, regexp_extract_all(html, '</?[a-z][a-z0-9]*') as l from pages))"""


@query(f"""with {TAGS}, s as (select page_id, k, starts_with(tag, '</') as closing, sum(case when starts_with(tag, '</') then -1 else 1 end) over (partition by page_id order by k) as s from g),
d as (select *, s - least(0, min(s) over (partition by page_id order by k)) as depth from s)
select page_id, count(*) filter (where not closing) as opened, count(*) filter (where closing) as closed, max(depth)::bigint as deepest, max_by(depth, k)::bigint as left_open from d group by 1""")
def page_tags(t):
    each = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?[a-z][a-z0-9]*"), F.lit(0))).alias("k", "tag"))
    w = Window.partitionBy("page_id").orderBy("k")
    closing = F.col("tag").startswith("</")
    s = each.withColumn("closing", closing).withColumn("s", F.sum(F.when(closing, -1).otherwise(1)).over(w))
    d = s.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(w)))
    return d.groupBy("page_id").agg(F.count_if(~F.col("closing")).alias("opened"), F.count_if("closing").alias("closed"), F.max("depth").alias("deepest"), F.max_by("depth", "k").alias("left_open"))


@query(r"select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') as ident, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') as page from pages")
def url_ids(t):
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), part("/([0-9]+)(?:[?#]|$)").alias("ident"), part("[?&]page=([0-9]+)").alias("page"))


@query(r"""with i as (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) as l, regexp_matches(html, '<h1>') as headed from pages)
select page_id, len(l) as items, len(list_filter(l, lambda x: regexp_matches(x, '<a '))) as known, len(list_filter(l, lambda x: regexp_matches(x, '<a '))) >= 2 and 2 * len(list_filter(l, lambda x: regexp_matches(x, '<a '))) >= len(l) as explanatory, headed from i""")
def label_bullets(t):
    items = t.pages.select("page_id", F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1)).alias("l"), F.col("html").contains("<h1>").alias("headed"))
    known = F.size(F.filter("l", lambda x: x.contains("<a ")))
    return items.select("page_id", F.size("l").alias("items"), known.alias("known"), ((known >= 2) & (2 * known >= F.size("l"))).alias("explanatory"), "headed")


@query(r"""with p as (select page_id, string_split(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', ''), '/') as parts from pages), s as (select page_id, array_to_string(parts[i:], '/') as suffix from (select page_id, parts, unnest(range(1, len(parts) + 1)) as i from p)),
k as (select suffix from s group by 1 having count(distinct page_id) > 1), m as (select s.page_id, s.suffix, row_number() over (partition by s.page_id order by length(s.suffix) desc) as r from s join k on s.suffix = k.suffix) select page_id, suffix from m where r = 1""")
def longest_suffix_match(t):
    path = F.split(F.regexp_replace(F.regexp_replace(F.lower("url"), "^https?://", ""), "[?#].*$", ""), "/")
    parts = t.pages.select("page_id", path.alias("parts"))
    s = parts.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))).alias("suffix"))
    known = s.groupBy("suffix").agg(F.min("page_id").alias("a"), F.max("page_id").alias("z")).where("a < z").select("suffix")  # on another page too
    return s.join(known, "suffix", "left_semi").groupBy("page_id").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))


@query(r"""select page_id, regexp_replace(regexp_replace(translate(lower(title), 'ąćęłńóśźż', 'acelnoszz'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as anchor, regexp_replace(regexp_replace(translate(lower(title), 'ąćęłńóśźż', 'acelnoszz'), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') as any_anchor, case regexp_extract(html, 'lang="([a-z]+)"', 1) when 'en' then 'Contents' when 'fr' then 'Sommaire' when 'de' then 'Inhalt' when 'es' then 'Índice' else 'Contents' end as heading from (select *, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)""")
def anchors_and_headings(t):
    names = F.create_map(*map(F.lit, ("en", "Contents", "fr", "Sommaire", "de", "Inhalt", "es", "Índice")))
    heading = F.coalesce(F.try_element_at(names, F.regexp_extract("html", 'lang="([a-z]+)"', 1)), F.lit("Contents"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select("page_id", c.anchor(title).alias("anchor"), c.anchor(title, any_script=True).alias("any_anchor"), heading.alias("heading"))


@query(r"""select page_id, try_cast(regexp_replace(regexp_extract(url, '[0-9]+', 0), '[^0-9]', '', 'g') as bigint) as number, case when length(html) < 1024 then length(html) || ' B' when length(html) < 1048576 then printf('%.1f KB', length(html) / 1024.0) when length(html) < 1073741824 then printf('%.1f MB', length(html) / 1048576.0) else printf('%.1f GB', length(html) / 1073741824.0) end as size, try_cast(regexp_extract(url, 'page=([a-z0-9]+)', 1) as double) as page from pages""")
def count_and_size_text(t):
    return t.pages.select("page_id", c.count_text(F.regexp_extract("url", "[0-9]+", 0)).alias("number"), c.human_size(F.length("html").cast("double")).alias("size"), F.regexp_extract("url", "page=([a-z0-9]+)", 1).try_cast("double").alias("page"))


@query("select conv_id, turn, '[' || row_number() over (partition by conv_id order by turn) || '/' || count(*) over (partition by conv_id) || '] ' || upper(role) as header from conversations")
def chat_numbering(t):
    w = Window.partitionBy("conv_id")
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("["), F.row_number().over(w.orderBy("turn")).cast("string"), F.lit("/"), F.count("*").over(w).cast("string"), F.lit("] "), F.upper("role")).alias("header"))


@query("select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by 1")
def chat_ordered_text(t):
    return f.ordered_text(t.conversations, ["conv_id"], "turn", "text", "\n")


@query("""with b as (select conv_id, turn, role, text, row_number() over (partition by conv_id, role order by turn) as r from conversations)
select conv_id, turn, role, case when conv_id % 3 = 0 and role = 'user' then 'new ' || conv_id else text end as text from b where not (conv_id % 3 = 0 and role = 'user' and r > 1)""")
def keyed_replace(t):
    fresh = t.conversations.where("conv_id % 3 = 0 and role = 'user'").select("conv_id", "role").distinct().withColumn("text", F.concat(F.lit("new "), F.col("conv_id").cast("string")))
    return f.keyed_replace(t.conversations, fresh, ["conv_id", "role"], "turn", "text").select("conv_id", "turn", "role", "text")


@query("""with b as (select conv_id, role, min(turn) as first, string_agg(text, ' ' order by turn) as text from conversations group by all)
select conv_id, string_agg(role || ': ' || text, chr(10) order by first) as text from b group by 1""")
def first_seen_concat(t):
    pieces = F.array_sort(F.collect_list(F.struct("turn", "text")))
    blocks = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first"), F.array_join(F.transform(pieces, lambda x: x["text"]), " ").alias("text"))
    return f.ordered_text(blocks.withColumn("text", F.concat_ws(": ", "role", "text")), ["conv_id"], "first", "text", "\n")


NESTED = r"""
k as (select page_id, unnest(range(len(l))) as k, unnest(l) as t from (select page_id, list_filter(string_split(regexp_replace(html, '(</?[A-Za-z_][\w.:-]*(?:\s[^<>]*?)?/?>)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from pages)),
m as (select *, case when not regexp_matches(t, '^</?[A-Za-z_][\w.:-]*(?:\s[^<>]*?)?/?>$') then 0 when starts_with(t, '</') then -1 when ends_with(t, '/>') then 0 else 1 end as d from k),
s as (select *, sum(d) over (partition by page_id order by k) as s from m),
n as (select page_id, k, t, (s - least(0, min(s) over (partition by page_id order by k)) - greatest(d, 0))::int as depth from s)"""


@query(f"with {NESTED} select page_id, count(*) as tokens, max(depth) as deepest, sha256(string_agg(depth || ' ' || t, chr(10) order by k)) as nested_sha256 from n group by 1")
def page_nesting(t):
    """The tags and texts of each page at their depth, which a stray closing tag never takes below zero."""
    each = t.pages.select("page_id", rendering.nested(F.col("html")).alias("x")).where(F.size("x") > 0)
    lines = F.array_join(F.transform("x", lambda x: F.concat(x["depth"].cast("string"), F.lit(" "), x["token"])), "\n")
    return each.select("page_id", F.size("x").cast("long").alias("tokens"), F.array_max(F.transform("x", lambda x: x["depth"])).alias("deepest"), F.sha2(lines, 256).alias("nested_sha256"))


@query(r"""with recursive
e as (select conv_id, turn, role, text, row_number() over o as number, count(*) over (partition by conv_id) as total from conversations window o as (partition by conv_id order by turn)),
l as materialized (select conv_id, turn, unnest(range(len(q))) as i, regexp_replace(unnest(q), '[\x20\x09-\x0D]+$', '') as line from (select conv_id, turn, string_split(replace(coalesce(text, ''), chr(9), '    '), chr(10)) as q from e)),
w as (
  select conv_id, turn, i, 1 as k, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws, '' as line, '' as out from l where length(line) > 80
  union all
  select conv_id, turn, i, k + 1, ws, case when line = '' or length(line) + 1 + length(ws[k]) > 80 then ws[k] else line || ' ' || ws[k] end,
         case when line <> '' and length(line) + 1 + length(ws[k]) > 80 then out || line || chr(10) else out end from w where k <= len(ws)),
f as (select conv_id, turn, i, out || line as line from w where k = len(ws) + 1 union all select conv_id, turn, i, line from l where length(line) <= 80),
m as (select conv_id, turn, string_agg(line, chr(10) order by i) as body from f group by all),
r as (select e.*, body, repeat(case when upper(role) = 'USER' then '=' else '-' end, 80) as rule from e join m on m.conv_id = e.conv_id and m.turn = e.turn)
select conv_id, turn, number::int as number, printf('%04d_', number) || role as name,
       sha256(rule || chr(10) || '[' || number || '/' || total || '] ' || upper(role) || chr(10) || rule || chr(10) || chr(10) || body || chr(10)) as rendered_sha256 from r""")
def chat_rendered(t):
    """Each turn laid out for reading: heading, rules, lines wrapped to the width."""
    got = rendering.events(t.conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")
    return got.select("conv_id", "turn", "number", "name", F.sha2("rendered", 256).alias("rendered_sha256"))


@query(r"""with c as (select page_id, list_transform(string_split(html, ''), lambda x: {'c': x, 'q': '', 'out': ''}) as c from pages where html <> ''),
r as (select page_id, list_reduce(c, lambda a, x: case when a.q <> '' then {'c': '', 'q': case when x.c = a.q then '' else a.q end, 'out': a.out || x.c} when x.c in ('"', '''') then {'c': '', 'q': x.c, 'out': a.out || x.c}
  when x.c = '|' then {'c': '', 'q': '', 'out': a.out || chr(1) || x.c} when x.c = ';' then {'c': '', 'q': '', 'out': a.out || x.c || chr(1)} else {'c': '', 'q': '', 'out': a.out || x.c} end, {'c': '', 'q': '', 'out': ''}).out as out from c),
s as (select page_id, list_filter(list_transform(string_split(out, chr(1)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') as s from r)
select page_id, len(s) as pieces, sha256(array_to_string(s, chr(10))) as pieces_sha256 from s""")
def quoted_pieces(t):
    """Each page's source cut at the semicolons and pipes outside its quotes."""
    cut = t.pages.where("html <> ''").select("page_id", rendering.command_pieces(F.col("html")).alias("s"))
    return cut.select("page_id", F.size("s").cast("long").alias("pieces"), F.sha2(F.array_join("s", "\n"), 256).alias("pieces_sha256"))
