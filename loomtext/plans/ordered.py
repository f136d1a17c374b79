"""Queries of order-dependent rules; their SQL folds lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.functions import columns as c
from loomtext.operators import announcements
from loomtext.operators import passes as p
from loomtext.plans.registry import query

S = r"[\x20\x09-\x0D]"
STRIP = rf"regexp_replace({{}}, '^{S}+|{S}+$', '', 'g')"
UNITS = (
    "u as (select doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l: list_transform(list_filter(string_split(regexp_replace(" + STRIP.format("l")
    + rf", '([.!?…]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x, k: {{'t': x, 'first': k = 1}}))) as u from documents)"
)
WORD_LIST = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
NUMBERED = "select doc_id, unnest(range(len(out))) as {0}, unnest(out) as {1} from (select doc_id, case when n > 0 then list_append(out, n) else out end as out from (select doc_id, unnest(r) from r))"


def groups_of(t, items, starts, measure):
    """doc_id, number from 0 and measure of the groups of each document's items."""
    rows = t.documents.select("doc_id", items(F.col("text")).alias("items"))
    return rows.select("doc_id", F.posexplode(p.parted(F.col("items"), starts(F.col("items"))))).select("doc_id", "pos", measure(F.col("col")).alias("m"))


def total(field):
    return lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x[field])


@query(f"""with {UNITS}, r as (select doc_id, list_reduce(list_transform(u, lambda x: {{'n': length(x.t) + 1, 'first': x.first, 'out': []::bigint[]}}),
lambda a, x: case when a.n > 0 and a.n + x.n > 2000 and (x.first or a.n >= 2000) then {{'n': x.n, 'first': false, 'out': list_append(a.out, a.n)}} else {{'n': a.n + x.n, 'first': false, 'out': a.out}} end, {{'n': 0::bigint, 'first': false, 'out': []::bigint[]}}) as r from u) {NUMBERED.format("request", "chars")}""")
def pack_requests(t):
    """Requests of each document: their number and the characters they hold."""
    sized = lambda text: F.transform(p.units(text), lambda u: F.struct(F.length(u["t"]).alias("n"), u["first"].alias("first")))
    cost = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"] + 1)
    return groups_of(t, sized, lambda xs: p.request_starts(xs, 2000), cost).toDF("doc_id", "request", "chars")


@query(f"""with {UNITS}, k as (select doc_id, list_transform(u, lambda x, i: {{'n': len({WORD_LIST.format("x.t")}), 'ends': regexp_matches(x.t, '[.!?…]["»)\\]]*$'), 'pause': case when i = 1 then 0 else length(u[i - 1].t) % 9 * 0.2e0 end, 'out': []::bigint[]}}) as k from u),
r as (select doc_id, list_reduce(k, lambda a, x: case when a.n > 0 and x.pause >= case when a.ends then case when a.n < 45 then 1e300 when a.n >= 130 then 0 else 0.8e0 - (0.8e0 - 0.35e0) / 85 * (a.n - 45) end when a.n >= 200 then greatest(0, 0.35e0 * (1 - (a.n - 200) / 60.0e0)) else 1e300 end
then {{'n': x.n, 'ends': x.ends, 'pause': 0e0, 'out': list_append(a.out, a.n)}} else {{'n': a.n + x.n, 'ends': x.ends, 'pause': 0e0, 'out': a.out}} end, {{'n': 0::bigint, 'ends': false, 'pause': 0e0, 'out': []::bigint[]}}) as r from k) {NUMBERED.format("paragraph", "words")}""")
def pause_paragraphs(t):
    """Paragraphs by pauses; the pause after a sentence comes from its length, as texts have no times."""

    def timed(text):
        measured = lambda us: F.transform(us, lambda u, k: F.struct(p.n_words(u["t"]).alias("n"), p.ends_sentence(u["t"]).alias("ends"), F.when(k == 0, 0.0).otherwise(F.length(F.get(us, k - 1)["t"]) % 9 * 0.2).alias("pause")))
        return p.once(p.units(text), measured)

    return groups_of(t, timed, p.pause_starts, total("n")).toDF("doc_id", "paragraph", "words")


@query(f"""with {UNITS}, k as (select doc_id, list_transform(u, lambda x, i: {{'s': (i - 1) * 4.0e0, 'e': (i - 1) * 4.0e0 + 2.4e0 + length(x.t) % 3 * 0.6e0, 'n': length(x.t) + 1, 'tail': right(x.t, 1), 'out': []::bigint[]}}) as k from u),
r as (select doc_id, list_reduce(k, lambda a, x: case when a.n > 0 and (x.s - a.e >= 1.5e0 or (a.n >= 200 and a.tail in ('.', '!', '?'))) then {{'s': 0e0, 'e': x.e, 'n': x.n, 'tail': x.tail, 'out': list_append(a.out, a.n)}} else {{'s': 0e0, 'e': x.e, 'n': a.n + x.n, 'tail': x.tail, 'out': a.out}} end,
{{'s': 0e0, 'e': 0e0, 'n': 0::bigint, 'tail': '', 'out': []::bigint[]}}) as r from k) {NUMBERED.format("paragraph", "chars")}""")
def gap_paragraphs(t):
    """Paragraphs by silences and length; the times of sentences come from their place and length."""
    timed = lambda text: F.transform(p.units(text), lambda u, k: F.struct((k * 4.0).alias("start"), (k * 4.0 + 2.4 + F.length(u["t"]) % 3 * 0.6).alias("end"), u["t"].alias("text")))
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]) + 1)
    return groups_of(t, timed, lambda xs: p.gap_starts(xs, most=200), size).toDF("doc_id", "paragraph", "chars")


@query(rf"""with l as (select doc_id, unnest(range(len(x))) as line_no, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
r as (select doc_id, line_no, list_reduce(list_transform({WORD_LIST.format("line")}, lambda w: {{'line': w, 'out': []::varchar[]}}), lambda a, x: case when a.line = '' then {{'line': x.line, 'out': a.out}} when length(a.line) + 1 + length(x.line) > 80 then {{'line': x.line, 'out': list_append(a.out, a.line)}} else {{'line': a.line || ' ' || x.line, 'out': a.out}} end, {{'line': '', 'out': []::varchar[]}}) as r from l),
o as (select doc_id, line_no, unnest(range(len(out))) as row_no, unnest(out) as row, len(out) as n from (select doc_id, line_no, case when r.line = '' then r.out else list_append(r.out, r.line) end as out from r)),
g as (select *, string_split(row, ' ') as w, len(string_split(row, ' ')) - 1 as gaps, 80 - length(row) as spare from o)
select doc_id, line_no, row_no, case when row_no = n - 1 or gaps < 1 or spare < 0 then row else array_to_string(list_transform(w, lambda x, k: x || case when k <= gaps then repeat(' ', (1 + spare // gaps + (k <= spare % gaps)::int)::int) else '' end), '') end as padded,
case when row_no = n - 1 or gaps < 1 or spare <= 0 or spare > gaps then row else array_to_string(list_transform(w, lambda x, k: x || case when k > gaps then '' when list_contains(list_transform(range(spare), lambda i: floor((i + 0.5e0) * gaps / spare)::bigint), k - 1) then '  ' else ' ' end), '') end as doubled from g""")
def wrap_justify(t):
    """Every line of a text wrapped and filled in both ways."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.select("doc_id", "line_no", p.wrapped(F.col("line"), 80).alias("rows")).select("doc_id", "line_no", F.size("rows").alias("n"), F.posexplode("rows").alias("row_no", "row"))
    filled = lambda fill: F.when(F.col("row_no") == F.col("n") - 1, F.col("row")).otherwise(fill(F.col("row"), 80))
    return rows.select("doc_id", "line_no", "row_no", filled(p.padded).alias("padded"), filled(p.doubled).alias("doubled"))


@query(rf"""with w as (select item_id, {WORD_LIST.format("text")} as w from benchmark), r as (select item_id, w, list_reduce(list_transform(w, lambda x: {{'c': len(regexp_extract_all(x, '[Ѐ-ӿ]')), 'o': length(x) - len(regexp_extract_all(x, '[Ѐ-ӿ]')), 'k': 0::bigint, 'open': true}}),
lambda a, x: {{'c': a.c + x.c, 'o': a.o + x.o + 2, 'k': a.k + (a.open and floor((a.c + x.c) / 2.5e0 + (a.o + x.o + 2) / 4.0e0) + 1 <= 60)::bigint, 'open': a.open and floor((a.c + x.c) / 2.5e0 + (a.o + x.o + 2) / 4.0e0) + 1 <= 60}}, {{'c': 0::bigint, 'o': -1::bigint, 'k': 0::bigint, 'open': true}}) as r from w)
select item_id, array_to_string(w[1:r.k], ', ') as terms from r""")
def budgeted_terms(t):
    words = t.benchmark.select("item_id", c.spaced_words(F.col("text")).alias("w"))
    return words.select("item_id", F.array_join(F.slice("w", F.lit(1), p.prompt_terms(F.col("w"), 60)), ", ").alias("terms"))


@query(rf"""with l as (select doc_id, string_split(text, chr(10)) as x from documents), r as (select doc_id, list_reduce(list_transform(x, lambda v: {{'cur': {STRIP.format("v")}, 'out': []::varchar[], 'any': true}}),
lambda a, v: case when not a.any then {{'cur': v.cur, 'out': a.out, 'any': true}} when regexp_matches(a.cur, '\p{{L}}-$') then {{'cur': a.cur[1:-2] || v.cur, 'out': a.out, 'any': true}} when a.cur = '' or regexp_matches(a.cur, '[.!?…»"”'']$') then {{'cur': v.cur, 'out': list_append(a.out, a.cur), 'any': true}} else {{'cur': a.cur || ' ' || v.cur, 'out': a.out, 'any': true}} end, {{'cur': '', 'out': []::varchar[], 'any': false}}) as r from l)
select doc_id, len(r.out) + 1 as paragraphs, sha256(array_to_string(list_append(r.out, r.cur), chr(10))) as joined_sha256 from r""")
def page_break_join(t):
    """Lines as pages: a paragraph that goes on is joined across the break, without the hyphen of a cut word."""
    state = {"cur": F.lit(None).cast("string"), "out": F.array().cast("array<string>")}

    def step(s, x, at):
        line = p.stripped(x)
        cut, ended = s["cur"].rlike(r"\p{L}-$"), (s["cur"] == "") | s["cur"].rlike("[.!?…»\"”']$")
        cur = F.when(s["cur"].isNull() | (~cut & ended), line).when(cut, F.concat(F.left(s["cur"], F.length(s["cur"]) - 1), line)).otherwise(F.concat(s["cur"], F.lit(" "), line))
        return {"cur": cur, "out": F.when(s["cur"].isNotNull() & ~cut & ended, F.array_append(s["out"], s["cur"])).otherwise(s["out"])}

    both = t.documents.where("text is not null").select("doc_id", p.scan(F.split("text", "\n"), state, step).alias("s")).select("doc_id", F.array_append("s.out", F.col("s.cur")).alias("all"))
    return both.select("doc_id", F.size("all").cast("long").alias("paragraphs"), F.sha2(F.array_join("all", "\n"), 256).alias("joined_sha256"))


def by_key(df, key, order, start, schema):
    """Rows of each key in order through a function with state, batch by batch: a key of any size needs only its state in memory.

    ``start()`` gives a function of one row (a tuple of the columns) for each key; it gives the output row. A null key is a key.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    out = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def run(batches):
        now, go = object(), None
        for b in batches:
            rows = []
            for row in zip(*(column.to_pylist() for column in b.columns)):
                if row[0] != now:
                    now, go = row[0], start()
                rows.append(go(row))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(out)], schema=out)

    placed = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *order)
    return placed.mapInArrow(run, schema)


@query("""with h as (select user_id, list(event_id order by ts, event_id) as ids, list({'v': value, 'last': null::double, 'out': []::varchar[]} order by ts, event_id) as vs from events group by 1),
r as (select user_id, ids, list_reduce(vs, lambda a, x: case when a.last is null or abs(x.v - a.last) >= 0.5e0 * greatest(1, abs(a.last)) then {'v': 0e0, 'last': x.v, 'out': list_append(a.out, case when a.last is null or x.v >= 0.75e0 * a.last then 'added' else 'replaced' end)} else {'v': 0e0, 'last': a.last, 'out': list_append(a.out, null)} end, {'v': 0e0, 'last': null::double, 'out': []::varchar[]}).out as out from h)
select user_id, unnest(ids) as event_id, unnest(out) as change from r""")
def state_changes(t):
    """Each user's values against the last accepted one."""

    def start():
        last = None

        def go(row):
            nonlocal last
            user, _, event, value = row
            kind = None
            if last is None or abs(value - last) >= p.CHANGE_SHARE * max(1.0, abs(last)):
                kind = "added" if last is None or value >= p.KEPT_SHARE * last else "replaced"
                last = value
            return user, event, kind

        return go

    return by_key(t.events.select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], start, "user_id long, event_id long, change string")


@query("""with recursive e as (select label, vec_id, embedding::double[] as v, row_number() over (partition by label order by vec_id) as r from embeddings),
m as (select label, vec_id, r, v as kept, 1::bigint as grp from e where r = 1
union all select label, vec_id, r, case when near then kept else v end, grp + case when near then 0 else 1 end
from (select e.label, e.vec_id, e.r, e.v, m.kept, m.grp, coalesce(list_dot_product(e.v, m.kept) / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(m.kept, m.kept)), 0) >= 0.9, false) as near
from m join e on e.label is not distinct from m.label and e.r = m.r + 1))
select label, vec_id, grp from m""")
def merge_similar(t):
    """Groups of consecutive vectors of a label that are similar to the first of their group."""

    def start():
        kept, size, group = None, 0.0, 0

        def go(row):
            nonlocal kept, size, group
            v = [float(x) for x in row[2]]
            own = sum(x * x for x in v) ** 0.5
            if kept is None or not size * own or sum(a * b for a, b in zip(v, kept)) / (size * own) < 0.9:
                kept, size, group = v, own, group + 1
            return row[0], row[1], group

        return go

    return by_key(t.embeddings.select("label", "vec_id", "embedding"), "label", ["vec_id"], start, "label int, vec_id long, grp long")


@query()
def portion_cut(t):
    """Half of each text by sections (lines) and sentences; a text no cut fits says so."""
    sections = F.filter(F.transform(F.split("text", "\n"), lambda x: F.transform(p.units(x), lambda u: F.struct(F.length(u["t"]).alias("n"), u["first"].alias("first")))), lambda us: F.size(us) > 0)
    cut = t.documents.select("doc_id", p.portion(sections, 50.0).alias("x")).select("doc_id", F.explode_outer("x.out").alias("o"), F.col("x.problem").alias("problem"))
    return cut.select("doc_id", "o.section", "o.units", "problem")


@query(r"""with w as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda w: case lower(w) when 'the' then 'ye' when 'und' then 'vnd' when 'que' then 'qve' end) as new, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') as w from documents)
select doc_id, sha256(array_to_string(list_transform(w, lambda x, k: case when new[k] is null then x when x = upper(x) and length(x) > 1 then upper(new[k]) when x[1] = upper(x[1]) then upper(new[k][1]) || new[k][2:] else new[k] end), '')) as respelled_sha256 from w""")
def respell(t):
    return t.documents.select("doc_id", F.sha2(c.respelled(F.col("text"), {"the": "ye", "und": "vnd", "que": "qve"}), 256).alias("respelled_sha256"))


TIMED = r"""
w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, w, list_transform(range(0, (len(w) - 1) // 8 + 1), lambda k: {'s': k * 5.0e0, 'e': k * 5.0e0 + 4.0e0, 't': array_to_string(w[k * 8 + 1:k * 8 + 8], ' ')}) as g from w where len(w) > 0),
x as (select doc_id, unnest(range(1, len(g) + 1)) as k, unnest(g) as x from g),
y as (select doc_id, k, x, string_split(regexp_replace(x.t, '([.!?…]+["»)\]]*\s+)(["«(\[–—A-ZА-ЯЁ])', '\1' || chr(1) || '\2', 'g'), chr(1)) as p from x),
z as (select doc_id, k, x, p, unnest(range(1, len(p) + 1)) as i from y),
f as (select doc_id, k, i, x.s + (x.e - x.s) * least(1.0e0, length(array_to_string(p[1:i - 1], '')) / greatest(1, length(x.t))) as s, regexp_replace(p[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as t from z),
b as (select *, coalesce(lag(regexp_matches(t, '[.!?…]["»)\]]*$')) over o, true) as b from f where t <> '' window o as (partition by doc_id order by k, i)),
n as (select *, sum(b::int) over (partition by doc_id order by k, i) as n from b),
s as (select doc_id, n, min_by(s, (k, i)) as s, string_agg(t, ' ' order by k, i) as t from n group by all)"""


def timed_documents(t):
    """doc_id, words and each text as segments (start, end, text) of eight words in five seconds."""
    words = t.documents.select("doc_id", c.spaced_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    segments = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8)), lambda k: F.struct((k * 5.0).alias("start"), (k * 5.0 + 4.0).alias("end"), F.array_join(F.slice("w", (k * 8 + 1).cast("int"), 8), " ").alias("text")))
    return words.select("doc_id", "w", segments.alias("g"))


@query(f"with {TIMED} select doc_id, (n - 1)::int as sentence, s as start, sha256(t) as text_sha256 from s")
def timed_sentences(t):
    """Sentences with the time of their first word; those torn between segments are glued."""
    each = timed_documents(t).select("doc_id", F.posexplode(announcements.timed_sentences(F.col("g"))).alias("sentence", "x"))
    return each.select("doc_id", "sentence", "x.start", F.sha2("x.text", 256).alias("text_sha256"))


@query(rf"""with recursive {TIMED},
h as materialized (select doc_id, unnest(range(0, (len(g) - 1) // 12 + 1)) as j, (len(g) - 1) // 12 + 1 as sections, len(g) * 5.0e0 as seconds, w from g),
hw as (select distinct doc_id, j, sections, unnest(regexp_extract_all(lower(array_to_string(w[j * 96 + 1:j * 96 + 8], ' ')), '[a-z]{{4,}}')) as word from h),
kw as (select * from hw where word not in ({", ".join(f"'{x}'" for x in announcements.COMMON)}) qualify count(*) over (partition by doc_id, word) <= greatest(1, sections // 3)),
wanted as (select h.doc_id, h.j, coalesce(list(word) filter (word is not null), []) as words from h left join kw on kw.doc_id = h.doc_id and kw.j = h.j group by h.doc_id, h.j),
sp as materialized (select doc_id, x.s + (x.e - x.s) * unnest(list_transform(range(1, len(q)), lambda i: length(array_to_string(q[1:i], ' ')))) / length(x.t) as spot from (select doc_id, x, string_split(regexp_replace(x.t, '([.!?…])[\x20\x09-\x0D]', '\1' || chr(1), 'g'), chr(1)) as q from x)
       union all select a.doc_id, z.x.s from x a join x z on z.doc_id = a.doc_id and z.k = a.k + 1 where regexp_matches(a.x.t, '[.!?…]["»)\]]*$')),
spots as (select h.doc_id, j, list(spot) as spots from h join sp on sp.doc_id = h.doc_id and spot between j * 60 - 20 and j * 60 + 12 group by all),
said as (select h.doc_id, j, list({{'s': s, 't': t, 'p': length(t) % 4 * 0.5e0}} order by n) as said from h join s on s.doc_id = h.doc_id and s between j * 60 - 23 and j * 60 + 15 group by all),
d as materialized (select h.doc_id, h.j, seconds, x.t as ahead, coalesce(spots, []) as spots, coalesce(said, []) as said, words from h join wanted on wanted.doc_id = h.doc_id and wanted.j = h.j
      left join x on x.doc_id = h.doc_id and x.k = 12 * h.j left join spots on spots.doc_id = h.doc_id and spots.j = h.j left join said on said.doc_id = h.doc_id and said.j = h.j),
r as (
  select doc_id, 0::bigint as j, 0.0e0 as start, 0.0e0 as change from h where j = 0
  union all
  select doc_id, j, coalesce(case when low < high and len(regexp_extract_all(l.t, '[^\x20\x09-\x0D]+')) <= 25
      and coalesce(list_max(list_transform(list_filter(said, lambda q: l.s between q.s - q.p - 0.7e0 and q.s + 0.7e0 and q.p > 0), lambda q: q.s - (q.s - q.p))), 0) >= 1.0e0
      and (regexp_matches(l.t, '(?i)(^|[^\p{{L}}\p{{N}}_])(слайд|this slide|next slide|last slide)') or len(list_filter([{", ".join("'" + x.replace("'", "''") + "'" for x in announcements.MOVING_ON)}], lambda m: contains(lower(l.t), m))) > 0
        or len(list_filter(regexp_extract_all(lower(array_to_string(list_transform(list_filter(said, lambda q: q.s >= l.s and q.s < b), lambda q: q.t), ' ')), '[\p{{L}}\p{{N}}_]+'), lambda y: len(list_filter(words, lambda m: starts_with(y, m))) > 0)) > 0)
      then l.s end, b) as start, change
  from (select *, list_filter(said, lambda q: q.s >= low and q.s < b - 0.05e0)[-1] as l
    from (select *, case when low < high and not regexp_matches(ahead, '[.!?…]["»)\]]*$')
          then coalesce(list_min(list_transform(list_filter(spots, lambda t: t between low and high), lambda t: {{'cost': case when t <= change then change - t else 1.5e0 * (t - change) end, 't': t}})).t, change) else change end as b
      from (select d.*, (r.j + 1) * 60.0e0 as change, greatest(r.start + 15, (r.j + 1) * 60.0e0 - 20) as low,
              least(least((r.j + 2) * 60.0e0, seconds) - 15, (r.j + 1) * 60.0e0 + 12) as high
        from r join d on d.doc_id = r.doc_id and d.j = r.j + 1))))
select doc_id, j::int as section, start, abs(start - change) >= 0.05e0 as moved from r""")
def announced_starts(t):
    """Sections of a minute over each text, headed by their first eight words: their starts, moved to sentence ends and announcements.

    Texts have no pauses, so the pause before a sentence comes from its length.
    """
    rows = timed_documents(t).withColumn("said", announcements.timed_sentences(F.col("g")))
    heading = lambda j: F.array_join(F.slice("w", (j * 96 + 1).cast("int"), 8), " ")
    sections = F.transform(F.sequence(F.lit(0), F.floor((F.size("g") - 1) / 12)), lambda j: F.struct((j * 60.0).alias("start"), F.least((j + 1) * 60.0, F.size("g") * 5.0).alias("end"), heading(j).alias("heading")))
    long = lambda s: F.length(s["text"]) % 4 * 0.5
    silences = F.filter(F.transform("said", lambda s: F.struct((s["start"] - long(s)).alias("start"), s["start"].alias("end"))), lambda q: q["end"] > q["start"])
    segments = F.col("g")
    moved = announcements.refined(sections, segments, segments, silences, F.col("said"))
    return rows.select("doc_id", F.posexplode(moved).alias("section", "x")).select("doc_id", "section", "x.start", "x.moved")


@query(rf"""with recursive {TIMED.split("y as (")[0].rstrip().rstrip(",")},
h as materialized (select doc_id, unnest(range(0, (len(g) - 1) // 12 + 1)) as j, len(g) * 5.0e0 as seconds from g),
sp as (select doc_id, x.s + (x.e - x.s) * unnest(list_transform(range(1, len(q)), lambda i: length(array_to_string(q[1:i], ' ')))) / length(x.t) as spot from (select doc_id, x, string_split(regexp_replace(x.t, '([.!?…])[\x20\x09-\x0D]', '\1' || chr(1), 'g'), chr(1)) as q from x)
       union all select a.doc_id, z.x.s from x a join x z on z.doc_id = a.doc_id and z.k = a.k + 1 where regexp_matches(a.x.t, '[.!?…]["»)\]]*$')),
near as (select h.doc_id, j, list(spot) as spots from h join sp on sp.doc_id = h.doc_id and spot between j * 60 - 20 and j * 60 + 12 group by all),
d as materialized (select h.*, regexp_matches(x.t, '[.!?…]["»)\]]*$') as whole, coalesce(spots, []) as spots from h left join x on x.doc_id = h.doc_id and x.k = 12 * h.j left join near on near.doc_id = h.doc_id and near.j = h.j),
r as (
  select doc_id, 0::bigint as j, 0.0e0 as start, 0.0e0 as change from h where j = 0
  union all
  select doc_id, j, case when low < high and not whole
         then coalesce(list_min(list_transform(list_filter(spots, lambda t: t between low and high), lambda t: {{'cost': case when t <= change then change - t else 1.5e0 * (t - change) end, 't': t}})).t, change) else change end as start, change
  from (select d.*, d.j * 60.0e0 as change, greatest(r.start + 15, d.j * 60.0e0 - 20) as low, least(least((d.j + 1) * 60.0e0, seconds) - 15, d.j * 60.0e0 + 12) as high from r join d on d.doc_id = r.doc_id and d.j = r.j + 1))
select doc_id, j::int as section, start, abs(start - change) >= 0.05e0 as moved from r""")
def boundary_refine(t):
    """Sections of a minute over each text, as segments of eight words in five seconds: their starts, moved to sentence ends."""
    sections = F.transform(F.sequence(F.lit(0), F.floor((F.size("g") - 1) / 12)), lambda j: F.struct((j * 60.0).alias("start"), F.least((j + 1) * 60.0, F.size("g") * 5.0).alias("end")))
    return timed_documents(t).select("doc_id", F.posexplode(p.refined(sections, F.col("g"))).alias("section", "x")).select("doc_id", "section", "x.start", "x.moved")


@query(r"""with recursive p as (select doc_id, source, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as p from documents),
s as (select *, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::bigint as n from p),
t as (select source, sum(n)::bigint as total from s group by 1),
b as materialized (select doc_id, p, case when total <= 20000 then n else floor(n * (20000.0e0 / total))::bigint end as budget from s join t on t.source is not distinct from s.source),
r as (select doc_id, p, budget, 0::bigint as k, 0::bigint as used from b
      union all select doc_id, p, budget, k + 1, used + length(p[k + 1]) from r where k < len(p) and (used = 0 or used + length(p[k + 1]) <= budget))
select doc_id, max(k) as kept, sha256(array_to_string(max_by(p, k)[1:max(k)], chr(10))) as kept_sha256 from r group by 1""")
def budgeted_beginnings(t):
    """The beginning of every document, so that those of a source share a budget of 20,000 characters by their length; whole paragraphs."""
    paragraphs = F.filter(F.split("text", "\n"), lambda x: p.stripped(x) != "")
    sized = t.documents.select("doc_id", "source", paragraphs.alias("p")).where("p is not null").withColumn("n", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    totals = sized.groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("total"))
    met = sized.join(totals, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.when(F.col("total") <= 20000, F.col("n")).otherwise(F.floor(F.col("n") * (F.lit(20000.0) / F.col("total"))))
    kept = met.select("doc_id", p.beginning(F.col("p"), budget).alias("k"))
    return kept.select("doc_id", F.size("k").cast("long").alias("kept"), F.sha2(F.array_join("k", "\n"), 256).alias("kept_sha256"))
