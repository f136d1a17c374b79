"""Substring deduplication over whole corpora, by suffix automata of reference shards.

A window is WINDOW consecutive words of one document. A word goes if a window
that covers it also starts earlier, in a smaller doc_id or before in the same
document.

Method: suffix automata of reference text are streamed for matching statistics,
and maximal spans over the threshold are removed. Broadcasting automata of the
whole corpus to the whole corpus costs their product, so shards are routed
instead: every window has one anchor, its least 8-word gram, equal windows have
equal anchors, and the windows of an anchor form one span. Spans whose anchor
occurs once cannot repeat. The others meet by anchor, in shards: there each
distinct span is streamed through the automaton of the earlier ones and then
added to it. Spans travel and meet as the words themselves in the automata; equal
spans are told by a 64-bit hash of their words beside their anchor's. Equal spans are merged before they meet, so a passage that a
third of all documents share reaches its shard once. A shard that holds more
than MOST_SPANS distinct spans is split by the next least gram of each window,
and again, until every shard is small; equal windows have equal grams in every
rank, so they stay together. Copies of whole documents are told by a 128-bit
hash of their words. Automata of a fixed reference of bounded size are
broadcast, in ``remove_reference``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import repeats, store, text

WINDOW = 20
GRAM = 8
#: Words of a broadcast reference shard at most; a larger reference takes several shards, each in a pass of its own.
SHARD_WORDS = 200_000
#: Words of a broadcast reference at most; a larger one is an error.
MOST_REFERENCE = 4_000_000
#: Distinct spans of a shard, at most; a wider one is split by the next gram, as long as windows have one.
MOST_SPANS = 500


class SuffixAutomaton:
    """The substrings of a growing set of sequences; symbols are hashable."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for the shorter strings of q that p reaches by c."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        """Add a sequence; no substring crosses from one sequence to another."""
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def matching(self, sequence) -> Iterator[int]:
        """For each place, the length of the longest match that ends there."""
        at, n = 0, 0
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.next[at]:
                at, n = self.next[at][c], n + 1
            yield n


def anchors(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 8-word grams, and for each window the place of its least gram, the first of equal ones."""
    if len(w) < WINDOW:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    grams = repeats.gram_hashes(w, GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    return grams, np.arange(len(view)) + view.argmin(axis=1)


def anchor_keys(raw: bytes | None) -> repeats.Found:
    words = (raw or b"").split()
    grams, at = anchors(repeats.word_hashes(words)) if len(words) >= WINDOW else anchors(np.empty(0, dtype=np.uint64))
    places = np.unique(at)
    return repeats.Found(len(words), len(places), xxhash.xxh3_128_digest(b" ".join(words)), grams[places], places.astype("<i4"))


SPANS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("count", pa.int32()), ("words", pa.binary())])
SPANS_SQL = "anchor bigint, doc_id bigint, lo int, count int, words binary"


def cut_spans(doc: int, at_lo: int, words: list[bytes], keys: np.ndarray, at: np.ndarray, out: list[tuple]) -> None:
    """Add the spans of consecutive windows with one place ``at``: (key of the place, doc, first window, windows, words)."""
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, dtype=np.int64)
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
        out.append((int(keys[at[x] : at[x] + 1].view(np.int64)[0]), doc, at_lo + x, y - x, b" ".join(words[x : y + WINDOW - 1])))


def span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SPANS)], schema=SPANS)


def spans_of(marked: DataFrame) -> DataFrame:
    """The spans (anchor, doc_id, lo, count, words) of documents (doc_id, text, refs) at the anchors in refs.

    A span holds the words of the ``count`` windows that start at lo and after it and share an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, raw, refs in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("refs").to_pylist()):
                words = (raw or b"").split()
                grams, at = anchors(repeats.word_hashes(words))
                wanted = np.unique(np.frombuffer(b"".join(refs), dtype="<i4"))
                lo, hi = np.searchsorted(at, wanted), np.searchsorted(at, wanted, side="right")
                keys = grams[wanted[wanted < len(grams)]].view(np.int64).tolist()
                for key, x, y in zip(keys, lo.tolist(), hi.tolist()):
                    if x < y:
                        out.append((key, doc, x, y - x, b" ".join(words[x : y + WINDOW - 1])))
                if len(out) > 20_000:
                    yield span_batch(out)
                    out = []
            yield span_batch(out)

    return marked.select("doc_id", "text", "refs").mapInArrow(run, SPANS_SQL)


def split_by_gram(spans: DataFrame, rank: int) -> DataFrame:
    """The spans cut where the gram of the given rank (0: the least of a window) changes; it joins the anchor in the new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, doc, lo, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "lo", "words"))):
                words = raw.split(b" ")
                grams = repeats.gram_hashes(repeats.word_hashes(words), GRAM)
                view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
                at = np.arange(len(view)) + np.argsort(view, axis=1, kind="stable")[:, rank]
                cut_spans(doc, lo, words, repeats.finish(grams + np.uint64(key * int(repeats.MIX[2]) % 2**64)), at, out)
            yield span_batch(out)

    return spans.select("anchor", "doc_id", "lo", "words").mapInArrow(run, SPANS_SQL)


def stream(spans: DataFrame) -> DataFrame:
    """Windows of distinct spans that occur in earlier ones: (doc_id, lo, count, mask), mask a bit for each window.

    Takes (anchor, doc_id, lo, words), the first occurrence of each distinct span,
    with the spans of an anchor together and in order.
    """
    found = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("count", pa.int32()), ("mask", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held, automaton = None, None, None
        for b in batches:
            out: list[tuple] = []
            for key, doc, lo, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "lo", "words"))):
                if key != anchor:
                    anchor, held, automaton = key, raw, None
                    continue
                words = raw.split(b" ")
                if automaton is None:  # most anchors have one distinct span and need none
                    automaton = SuffixAutomaton()
                    automaton.add(held.split(b" "))
                hit = np.array([n >= WINDOW for n in automaton.matching(words)][WINDOW - 1 :])
                if hit.any():
                    out.append((doc, lo, len(hit), np.packbits(hit).tobytes()))
                automaton.add(words)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(found)], schema=found)

    return spans.select("anchor", "doc_id", "lo", "words").mapInArrow(run, "doc_id bigint, lo int, count int, mask binary")


def repeated_spans(spans: DataFrame, rank: int = 0) -> DataFrame:
    """What repeats of spans (anchor, doc_id, lo, count, words): (doc_id, lo, count, mask; no mask: all ``count`` windows).

    Shards that are too wide go on, with what is distinct of them, to the next rank of grams.
    """
    n = store.partitions(spans.sparkSession)
    spans = spans.withColumn("key", F.xxhash64("words"))
    distinct = spans.groupBy("anchor", "words").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.max("count").alias("count"), F.count("*").alias("n"))
    distinct = store.table(distinct.select("anchor", "first.doc_id", "first.lo", "count", "words", F.xxhash64("words").alias("key"), "n"), "distinct")
    # A span that occurs again is repeated whole, wherever it is not its first occurrence.
    again = distinct.where("n > 1").select("anchor", "key", F.col("doc_id").alias("d0"), F.col("lo").alias("lo0"))
    wholly = spans.select("anchor", "key", "doc_id", "lo", "count").join(again, ["anchor", "key"]).where("doc_id > d0 or (doc_id = d0 and lo > lo0)")
    found = wholly.select("doc_id", "lo", "count", F.lit(None).cast("binary").alias("mask"))
    wide = distinct.groupBy("anchor").count().where(F.col("count") > (MOST_SPANS if rank < WINDOW - GRAM else 2**62)).select("anchor")
    wide = store.table(wide, "wide")
    met = store.join_small(distinct, wide, "anchor", "left_anti").repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "lo")
    found = found.unionByName(store.table(stream(met), "streamed"))
    if wide.isEmpty():
        return found
    finer = store.table(split_by_gram(store.join_small(distinct, wide, "anchor", "left_semi"), rank + 1), "finer")
    return found.unionByName(repeated_spans(finer, rank + 1))


def covered(n: int, spans: list[tuple[int, int, bytes | None]]) -> np.ndarray:
    """Which of n words lie in a repeated window, from spans (lo, windows, mask; no mask: all windows)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    for lo, count, mask in spans:
        at = lo + (np.arange(count) if mask is None else np.flatnonzero(np.unpackbits(np.frombuffer(mask, dtype=np.uint8))[:count]))
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + WINDOW, n), -1)
    return np.cumsum(edge[:n]) > 0


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, spans: array of (lo, count, mask)), and the doc_ids whose whole text is an earlier one's."""
    spark = docs.sparkSession
    found = repeats.find(docs, "text", anchor_keys, "anchors", with_refs=True)
    info = repeats.info(found).where(F.col("n") >= WINDOW)
    first = info.groupBy("identity").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    several = store.table(first.where("first < last").drop("last"), "copied")
    copied = store.table(store.join_small(info, several, "identity", "inner").where("doc_id > first").select("doc_id", "first").distinct(), "copies")
    copies = copied.select("doc_id").distinct()
    # Of the copies in a chunk only the first one read has hits; all go to the smallest doc_id of the copies, whose words are the same.
    marks = repeats.hits(found).join(copied, "doc_id", "left").select(F.coalesce("first", "doc_id").alias("doc_id"), "refs")
    marks = marks.groupBy("doc_id").agg(F.collect_set("refs").alias("refs"))  # copies that have hits in several chunks have the same ones
    marks = store.table(marks.join(copies, "doc_id", "left_anti"), "marks")
    spans = store.table(spans_of(docs.select("doc_id", "text").join(marks, "doc_id")), "spans")
    store.release(spark)
    out = store.table(repeated_spans(spans).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "count", "mask")).alias("spans")), "repeated")
    store.release(spark)
    return out, copies


def numbered_texts(docs: DataFrame) -> DataFrame:
    """docs with ``own``, the doc_id as it was; where rows of one doc_id have different texts, doc_id is a number for each of its texts instead.

    The numbers rise with the ids. Where no id is shared by different texts, ids stay.
    """
    docs = docs.select("doc_id", "text", F.col("doc_id").alias("own"), F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(-1)).alias("n")).alias("which"))
    named = docs.where("doc_id is not null")
    shared = named.groupBy("doc_id").agg(F.min("which").alias("a"), F.max("which").alias("z")).where("a <> z")
    if shared.isEmpty():
        return docs.drop("which")
    blocks = store.ordered_blocks(named.select("own", "which").distinct(), ["own", "which"], "texts")
    sizes = blocks.groupBy("blk").agg(F.count("*").alias("n"))  # a row for each block
    ahead = store.table(sizes.select("blk", (F.sum("n").over(Window.orderBy("blk")) - F.col("n")).alias("ahead")), "ahead")
    place = F.row_number().over(Window.partitionBy("blk").orderBy("own", "which"))
    numbers = store.join_small(blocks, ahead, "blk").select("own", "which", (F.col("ahead") + place).alias("doc_id"))
    return store.table(docs.drop("doc_id").join(numbers, ["own", "which"], "left").drop("which"), "numbered")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove repeated windows: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Null and empty texts have no words; very long texts are read whole. Equal rows
    that share a doc_id are one document and lose the same words; rows of one
    doc_id with different texts are documents that follow one another. A null
    doc_id keeps all its words and removes none of others'. Ids are whole numbers
    (any integer type, returned as bigint). Of tied windows in one document the
    first stays. Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    docs = numbered_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    lost, copies = repeated_windows(docs.where("doc_id is not null"))
    marks = lost.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", F.lit(None).cast(lost.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy")))
    joined = docs.join(marks, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, kept = [], [], []
            for raw, spans, copy in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), b.column("copy").to_pylist()):
                words = (raw or b"").split()
                if copy:
                    left = []
                elif spans:
                    bad = covered(len(words), [(s["lo"], min(s["count"], len(words) - WINDOW + 1 - s["lo"]), s["mask"]) for s in spans])
                    left = [w for w, x in zip(words, bad.tolist()) if not x]
                else:
                    left = words
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("own", "text", "spans", "copy").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def remove_reference(docs: DataFrame, reference: DataFrame, least: int = WINDOW) -> DataFrame:
    """Remove spans of at least ``least`` words that occur in a fixed reference (text): doc_id, n_words, n_removed, kept.

    The reference has MOST_REFERENCE words at most, else this is an error. It is cut into shards of SHARD_WORDS words;
    each shard's automaton is broadcast and documents are streamed through it. A longer text of the reference makes a
    shard of its own. Null texts have no words.
    """
    size = reference.agg(F.sum(text.count_words(F.col("text")))).first()[0] or 0
    if size > MOST_REFERENCE:
        raise ValueError(f"the reference has {size} words, more than the {MOST_REFERENCE} that may be broadcast")
    shards: list[list[list[bytes]]] = [[]]
    for row in reference.select("text").collect():  # its size was checked
        words = (row["text"] or "").encode().split()
        if shards[-1] and sum(map(len, shards[-1])) + len(words) > SHARD_WORDS:
            shards.append([])
        shards[-1].append(words)
    sent = [docs.sparkSession.sparkContext.broadcast(s) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for s in sent:
            made.append(SuffixAutomaton())
            for words in s.value:
                made[-1].add(words)
        for b in batches:
            sizes, gone, kept = [], [], []
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                for automaton in made:
                    for end, n in enumerate(automaton.matching(words), 1):
                        if n >= least:
                            edge[end - n] += 1
                            edge[end] -= 1
                left = [w for w, x in zip(words, np.cumsum(edge[:-1]).tolist()) if not x]
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


#: The same in DuckDB's SQL.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, md5(array_to_string(w[i:i+19], ' ')) as h from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d)),
e as (select doc_id, i, row_number() over (partition by h order by doc_id, i) as k from s),
c as (select distinct doc_id, unnest(generate_series(i, i + 19)) as p from e where k > 1),
p as (select doc_id, w, unnest(generate_series(1, len(w))) as p from d where len(w) > 0),
k as (select p.doc_id, count(c.p) as gone, string_agg(p.w[p.p], ' ' order by p.p) filter (where c.p is null) as kept
      from p left join c on p.doc_id = c.doc_id and p.p = c.p group by p.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.gone, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
