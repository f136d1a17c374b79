"""Audit of sources: how far the words of a source are from those of its language and of every other source.

Method: a byte-level tokenizer. The UTF-8 buffers of a chunk of documents are one
array of bytes; a lookup table marks the bytes of terms (bytes of 0x80 and more
are inside characters that belong to terms), so boundaries are where the mark
changes or a text ends. Slices are grouped by their xxhash and every slice is
compared with its group's first one byte by byte; what differs is hashed again
with another seed. A chunk's counts are a CSR matrix of groups and terms, summed
by ``reduceat``; Spark adds the chunks up.

Divergences are taken over CSR matrices too: the terms of a language are dealt to
blocks by hash, each block holds the rows (sources) of its terms, and blocks'
sums are added. Sums of absolute differences walk the stored entries only; terms
that a source lacks all have one value, and a sorted row with running sums
gives their part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import store

#: Documents of a language that a term must be in, ranks of terms, and the smoothing.
DOCUMENTS, TERMS, ADDED, UNIT = 30, 50, 5, 1_000_000_000
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Stored entries of a block of terms, about; more where a block has more pairs of sources than that, up to the second.
ENTRIES, MOST_ENTRIES = 20_000, 1_000_000
#: Documents that Spark hands over at once.
DOCS = 1_000
#: Letters, and all bytes outside ASCII, belong to terms; ASCII capitals are lowered.
IS_TERM = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: The five primes of 64-bit xxhash.
PRIMES = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
#: Slices up to this length are hashed together in numpy, longer ones one by one; both give the 64-bit xxhash.
TOGETHER = 31


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit xxhash of each slice of ``raw``, which has 8 spare bytes at its end."""
    p1, p2, p3, p4, p5 = PRIMES
    out = np.empty(len(starts), dtype=np.uint64)
    eights = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw.data, strides=(1,))
    fours = np.ndarray((len(raw) - 3,), dtype="<u4", buffer=raw.data, strides=(1,))
    order = np.argsort(sizes, kind="stable")
    cuts = np.searchsorted(sizes[order], np.arange(TOGETHER + 2))
    for n in range(1, TOGETHER + 1):
        some = order[cuts[n] : cuts[n + 1]]
        if not len(some):
            continue
        at = starts[some]
        h = np.full(len(some), (seed + int(p5) + n) % 2**64, dtype=np.uint64)
        for k in range(n // 8):
            h = turned(h ^ turned(eights[at + 8 * k] * p2, 31) * p1, 27) * p1 + p4
        done = n // 8 * 8
        if n - done >= 4:
            h = turned(h ^ fours[at + done].astype(np.uint64) * p1, 23) * p2 + p3
            done += 4
        for k in range(done, n):
            h = turned(h ^ raw[at + k].astype(np.uint64) * p5, 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[some] = h ^ (h >> np.uint64(32))
    view = memoryview(raw)
    for i in order[cuts[TOGETHER + 1] :].tolist():
        out[i] = xxhash.xxh64_intdigest(view[starts[i] : starts[i] + sizes[i]], seed=seed)
    return out


def differing(raw: np.ndarray, starts: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, first_sizes: np.ndarray) -> np.ndarray:
    """Whether each slice differs from the one that begins at ``firsts``, byte by byte; eight bytes are compared at once."""
    eights = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw.data, strides=(1,))
    out = sizes != first_sizes
    todo, done = np.flatnonzero(~out), 0
    while len(todo):
        rest = np.minimum(sizes[todo] - done, 8).astype(np.uint64)
        mask = np.where(rest == 8, np.uint64(2**64 - 1), (np.uint64(1) << (rest % np.uint64(8) * np.uint64(8))) - np.uint64(1))
        out[todo[((eights[starts[todo] + done] ^ eights[firsts[todo] + done]) & mask) != 0]] = True
        done += 8
        todo = todo[sizes[todo] > done]
    return out


def terms(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the terms in texts that end at ``ends`` of ``raw``, and the number of the text that holds each."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = IS_TERM[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a term begins where it is inside and the byte before isn't, or a text begins
    edge[0] = True
    edge[1:] = ~inside[:-1]
    edge[ends] = True
    starts = np.flatnonzero(inside & edge)
    edge[:-1] = ~inside[:-1]  # now: where a term may end
    edge[ends] = True
    edge[len(raw)] = True
    stops = np.flatnonzero(edge)
    sizes = stops[np.searchsorted(stops, starts, side="right")] - starts
    return starts, sizes, np.searchsorted(ends, starts, side="right")


def grouped(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashed=hashes) -> tuple[np.ndarray, np.ndarray]:
    """The group of equal slices of each slice, and for each group one of its slices."""
    group, firsts = np.empty(len(starts), dtype=np.int64), []
    todo, seed, known = np.arange(len(starts)), 0, 0
    while len(todo):
        h = hashed(raw, starts[todo], sizes[todo], seed)
        order = np.argsort(h)
        new = np.ones(len(todo), dtype=bool)
        new[1:] = h[order][1:] != h[order][:-1]
        first = todo[order[new]]
        own = np.empty(len(todo), dtype=np.int64)
        own[order] = np.cumsum(new) - 1
        odd = differing(raw, starts[todo], starts[first][own], sizes[todo], sizes[first][own])
        group[todo[~odd]] = own[~odd] + known
        firsts.append(first)
        todo, seed, known = todo[odd], seed + 1, known + len(first)
    return group, np.concatenate(firsts) if firsts else np.empty(0, dtype=np.int64)


def counted(texts: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The CSR matrix of a chunk: row, term, number of occurrences and of documents of each stored entry; ``owner`` is the row of each text."""
    buffers, at = texts.buffers(), texts.offset
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[at : at + len(texts) + 1].astype(np.int64)
    raw = np.zeros(offsets[-1] - offsets[0] + 8, dtype=np.uint8)
    if buffers[2] is not None:
        raw[:-8] = LOWER[np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    starts, sizes, holder = terms(raw[:-8], (offsets - offsets[0])[1:])
    if not len(starts):
        return np.empty(0, dtype=np.int64), [], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    group, firsts = grouped(raw, starts, sizes)
    cells = np.sort((owner[holder] * len(firsts) + group) * len(texts) + holder)  # by row, term and text
    texts_of = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))  # a document that holds the term
    entry = cells // len(texts)
    begins = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    times = np.add.reduceat(np.ones(len(cells), dtype=np.int64), begins)
    holders = np.diff(np.append(np.searchsorted(texts_of, begins), len(texts_of)))
    row, column = np.divmod(entry[begins], len(firsts))
    names = [raw[s : s + n].tobytes() for s, n in zip(starts[firsts].tolist(), sizes[firsts].tolist())]
    return row, [names[c] for c in column.tolist()], times, holders


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it), a stored row for each group and term."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(b.column("size").to_numpy())
            done = 0
            while done < b.num_rows:
                upto = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + CHUNK)))
                yield b.slice(done, upto - done)
                done = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            pairs = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()))
            rows = sorted(set(pairs))
            number = {p: i for i, p in enumerate(rows)}
            row, names, times, holders = counted(b.column("text"), np.array([number[p] for p in pairs], dtype=np.int64))
            lang, source = (pa.array([p[k] for p in rows]).take(pa.array(row)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, pa.array(names, pa.binary()).cast(pa.string()), pa.array(times), pa.array(holders)], ["lang", "source", "term", "n", "docs"])

    some = docs.select("lang", "source", "text", F.octet_length("text").cast("bigint").alias("size"))
    each = some.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    with store.batches_of(docs.sparkSession, DOCS):
        return store.table(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def smoothed(count: np.ndarray, n, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / (n + ADDED * v)), exactly, in longs: the division goes in two steps."""
    below = n + ADDED * v
    first, rest = np.divmod((count + ADDED) * 31_250, below)
    return 1 + first * (UNIT // 31_250) + rest * (UNIT // 31_250) // below


def differences(row_start: np.ndarray, column: np.ndarray, value: np.ndarray, empty: np.ndarray, width: int) -> np.ndarray:
    """Sums over ``width`` columns of the absolute differences of all rows of a CSR matrix to each other.

    Row i holds ``value`` at its stored columns and ``empty[i]`` at all others.
    """
    rows = len(empty)
    out = np.zeros((rows, rows), dtype=np.int64)
    filled = np.flatnonzero(np.diff(row_start))
    at = np.repeat(np.arange(rows), np.diff(row_start))
    for i in range(rows):
        mine = np.full(width, empty[i], dtype=np.int64)
        stored = slice(row_start[i], row_start[i + 1])
        mine[column[stored]] = value[stored]
        line = np.sort(mine)
        upto = np.concatenate([[0], np.cumsum(line)])
        k = np.searchsorted(line, empty)
        out[i] = empty * k - upto[k] + (upto[-1] - upto[k]) - empty * (width - k)
        if len(column):
            other = mine[column]
            more = np.abs(value - other) - np.abs(empty[at] - other)
            out[i][filled] += np.add.reduceat(more, row_start[filled])
    return out


def block_divergences(group: pa.Table) -> pa.Table:
    """Of one block of terms of a language: the sums for each pair of sources, and each source's first TERMS terms.

    ``group`` has a row for each source and term (lang, source, term, n, total: the source's words, terms: of the
    language) and for each source one without term.
    """
    group = group.combine_chunks()
    bare = group.filter(pa.compute.is_null(group["term"])).sort_by("source")
    sources, totals = bare["source"].to_pylist(), bare["total"].to_numpy()
    vocabulary = int(bare["terms"][0].as_py())
    full = group.filter(pa.compute.is_valid(group["term"])).sort_by([("source", "ascending"), ("term", "ascending")])
    number = {s: i for i, s in enumerate(sources)}
    row = np.array([number[s] for s in full["source"].to_pylist()], dtype=np.int64)
    coded = full["term"].combine_chunks().dictionary_encode()
    names, column = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    starts = np.searchsorted(row, np.arange(len(sources) + 1))
    times = full["n"].to_numpy()
    out = {"source": [], "part": [], "item": [], "value": []}
    if vocabulary:
        p = smoothed(times, totals[row], vocabulary)
        empty = smoothed(np.zeros(len(sources), dtype=np.int64), totals, vocabulary)
        apart = differences(starts, column, p, empty, len(names))
        by_term = np.zeros(len(names), dtype=np.int64)
        if len(names):
            order = np.argsort(column, kind="stable")
            by_term = np.add.reduceat(times[order], np.searchsorted(column[order], np.arange(len(names))))
        over = p - smoothed(by_term, int(totals.sum()), vocabulary)[column] if len(names) else p
    else:
        apart, over = np.zeros((len(sources),) * 2, dtype=np.int64), np.empty(0, dtype=np.int64)
    for i, s in enumerate(sources):
        stored = slice(starts[i], starts[i + 1])
        mine = sorted((-int(f), names[c]) for f, c in zip(over[stored], column[stored]) if f > 0)[:TERMS]
        for what, pairs in (("pair", [(t, int(apart[i, j])) for j, t in enumerate(sources) if j != i]), ("term", [(t, -f) for f, t in mine])):
            out["source"] += [s] * len(pairs)
            out["part"] += [what] * len(pairs)
            out["item"] += [x[0] for x in pairs]
            out["value"] += [x[1] for x in pairs]
    lang = pa.array([bare["lang"][0].as_py()] * len(out["item"]), pa.string())
    return pa.table([lang, *[pa.array(out[c], pa.string()) for c in ("source", "part", "item")], pa.array(out["value"], pa.int64())], names=["lang", *out])


def audit(documents: DataFrame) -> DataFrame:
    """Divergences of each source of each language from the language's other sources, and its most over-used terms.

    Returns lang, source, part, item, value, rank. Part ``pair`` has each other
    source of the language and the sum of the differences over all kept terms;
    part ``term`` the TERMS terms that the source uses most beyond its language.
    A null text, lang or source is ''. A row is a document, so repeated rows count
    as often as they occur and doc_id isn't read. Ties go to the item that is
    first by its UTF-8 bytes. A group without terms has its pairs, and value 0
    where its language keeps no term. Very long texts are read whole. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    Exact up to 2.9e14 occurrences in a language.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(blank("lang"), blank("source"), blank("text"))
    each = counts(docs)
    kept = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= DOCUMENTS).select("lang", "term")
    kept = store.table(each.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept")
    sources = F.count_distinct("source")
    vocabulary = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.ceil(F.count("*") / F.greatest(F.lit(ENTRIES), F.least(F.lit(MOST_ENTRIES), sources * sources))).alias("blocks"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = store.table(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("blocks", F.lit(1)).alias("blocks")), "groups")
    full = store.join_small(kept, groups, ["lang", "source"], "inner").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    bare = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), "total", "terms", F.col("block").cast("bigint").alias("block"))
    rows = full.select(*bare.columns).unionByName(bare)
    some = rows.groupBy("lang", "block").applyInArrow(block_divergences, "lang string, source string, part string, item string, value bigint")
    added = some.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = added.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TERMS))


#: The same in DuckDB's SQL.
ORACLE = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
k as (select lang, term from (select lang, unnest(list_distinct(t)) as term from d) group by all having count(*) >= 30),
c as (select lang, source, term, count(*) as n from (select lang, source, unnest(t) as term from d) semi join k using (lang, term) group by all),
v as (select lang, count(*) as v from k group by all),
g as (select lang, source, coalesce(n, 0) as total from (select distinct lang, source from d) left join (select lang, source, sum(n) as n from c group by all) using (lang, source)),
p as (select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) as p
      from g join k using (lang) join v using (lang) left join c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000 * (sum(n) + 5)) // (total + 5 * v) as q
      from p join v using (lang) join (select lang, sum(total) as total from g group by all) using (lang) group by lang, term, total, v),
f as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, p - q from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from f qualify part = 'pair' or rank <= 50
"""
