"""Texts that share rare word runs: hashes of their n-grams meet, packed by the million, so that a gram costs some 8 bytes of shuffle instead of a row.

A task sorts the hashes of its texts and cuts them by their leading bits; each
piece travels as one row to the task of its bucket, where equal hashes meet.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import frames

#: Words that a task packs at once, texts among them at most (their numbers take two bytes), and words of a bucket.
PACK_WORDS, PACK_TEXTS, BUCKET_WORDS = 1 << 22, 60_000, 1 << 21
#: Texts of one Arrow batch; ids that are sent to all tasks at most.
BATCH, SENT_IDS = 1000, 2_000_000
PACKED = "bucket int, n int, high binary, low binary, text binary, once binary, ids binary"
PAIR, COMMON, OWN = 0, 1, 2
SPREAD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashes(w: Column) -> Column:
    """A word array as 64-bit hashes."""
    return F.transform(w, lambda x: F.xxhash64(x))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of hashed words; none where there are fewer words."""
    words, m = words.view(np.uint64), max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= SPREAD
        out += words[k : k + m]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, and how many each row has; a null has none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), sizes


def split(column: pa.Array) -> list[np.ndarray]:
    """A column of arrays as an array for each row."""
    flat, sizes = lists(column)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of longs of one length as bytes, by differences; ``loosened`` gives them back."""
    return zlib.compress(b"".join(np.diff(x.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns), 1)


def loosened(data: bytes, columns: int) -> np.ndarray:
    each = np.frombuffer(zlib.decompress(data), np.uint8).reshape(columns, 8, -1)
    return np.cumsum(np.ascontiguousarray(each.transpose(0, 2, 1)).view(np.int64)[:, :, 0], axis=1)


def give_back() -> None:
    """A worker outlives its task: unused memory of Arrow and of the C library goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack(sid: np.ndarray, eid: np.ndarray, kind: np.ndarray, words: np.ndarray, sizes: np.ndarray, n: int, bits: int) -> Iterator[tuple]:
    """Rows of PACKED: the distinct grams of some texts by bucket, without those that a text only edited has twice; then how many grams each text that is both has once."""
    text, end = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    h = gram_hashes(words, n)
    text = text[: len(h)]
    whole = np.arange(len(h)) + n <= end[text]
    h, text = h[whole], text[whole].astype(np.uint16)
    order = np.argsort(h, kind="stable")
    h, text = h[order], text[order]
    again = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    first, once = np.append(True, ~again)[: len(h)], np.append(~again, True)[: len(h)]
    once &= first
    used = first & (once | (kind[text] & 1 > 0))
    h, text, once = h[used], text[used], once[used]
    edges = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64)) if bits else np.array([0, len(h)])
    for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if lo == hi:
            continue
        part = h[lo:hi]
        high = np.bincount((part >> np.uint64(48)).astype(np.int64) - (b << 16 - bits), minlength=1 << 16 - bits)
        low = np.ascontiguousarray(part.astype("<u8", copy=False).view(np.uint16).reshape(-1, 4)[:, :3])
        there, at = np.unique(text[lo:hi], return_inverse=True)
        yield b, int(hi - lo), zlib.compress(high.astype(np.uint32).tobytes(), 1), low.tobytes(), at.astype(np.uint16).tobytes(), np.packbits(once[lo:hi]).tobytes(), squeezed(sid[there], eid[there], kind[there])
    both = np.flatnonzero(kind == 3)
    if len(both):
        yield int(sid[both[0]] % (1 << bits)), -1, b"", b"", b"", b"", squeezed(sid[both], eid[both], np.bincount(text[once], minlength=len(sizes))[both])


def packer(n: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (sid, eid, h)."""
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    names = [x.split()[0] for x in PACKED.split(", ")]

    def out(held: list) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in pack(*[np.concatenate(x) for x in zip(*held, strict=True)], n, bits):
            rows.append(row)
            if len(rows) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, texts = [], 0, 0
        for batch in batches:
            sid, eid = batch.column(0), batch.column(1)
            flat, sizes = lists(batch.column(2))
            kind = sid.is_valid().to_numpy(zero_copy_only=False) * 1 + eid.is_valid().to_numpy(zero_copy_only=False) * 2
            if held and (words + len(flat) > PACK_WORDS or texts + len(sizes) > PACK_TEXTS):
                yield from out(held)
                held, words, texts = [], 0, 0
            held.append((sid.fill_null(0).to_numpy(), eid.fill_null(0).to_numpy(), kind, flat, sizes))
            words, texts = words + len(flat), texts + len(sizes)
        if held:
            yield from out(held)
        del held
        give_back()

    return run


def meeter(rare: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """For ``applyInArrow`` over the rows of PACKED of a bucket: the pairs that share a rare gram, the grams that too many sources have, and the counts of texts that are both."""

    def of(rows: pa.Table) -> pa.Table:
        parts, ids, own, texts = [], [], [], 0
        for r in rows.to_batches():
            for b, n, high, low, at, once, known in zip(*[c.to_pylist() for c in r.columns], strict=True):
                these = loosened(known, 3)
                if n < 0:
                    own.append(these)
                    continue
                h = np.zeros((n, 4), np.uint16)
                h[:, :3] = np.frombuffer(low, np.uint16).reshape(-1, 3)
                counts = np.frombuffer(zlib.decompress(high), np.uint32)
                h = h.view("<u8")[:, 0] | np.repeat(np.arange(len(counts), dtype=np.uint64) + np.uint64(b << 16 - bits) << np.uint64(48), counts)
                parts.append((h, np.frombuffer(at, np.uint16).astype(np.int64) + texts, np.unpackbits(np.frombuffer(once, np.uint8), count=n).astype(bool)))
                ids.append(these)
                texts += these.shape[1]
        found = [(np.full(x.shape[1], OWN), *x) for x in own]
        if parts:
            found += meet(*[np.concatenate(x) for x in zip(*parts, strict=True)], *np.concatenate(ids, axis=1), rare)
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4
        out = pa.table([pa.array(columns[0].astype(np.int32)), *[pa.array(x.astype(np.int64, copy=False)) for x in columns[1:]]], ["kind", "sid", "eid", "x"])
        del parts, ids, found, columns
        give_back()
        return out

    return of


def meet(h: np.ndarray, text: np.ndarray, once: np.ndarray, sid: np.ndarray, eid: np.ndarray, kind: np.ndarray, rare: int) -> list[tuple]:
    """(kind, sid, eid, x) in arrays: PAIR (sid, eid) of different texts, COMMON grams x of a source, with eid 1 where it has them once."""
    order = np.argsort(h, kind="stable")
    h, text, once = h[order], text[order], once[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size, source = np.diff(np.append(starts, len(h))), kind[text] & 1 > 0
    df = np.add.reduceat(source.astype(np.int64), starts)
    several = (df > 0) & (size > 1)
    rows = np.repeat(several, size)
    h, text, once, source = h[rows], text[rows], once[rows], source[rows]
    group, common = np.repeat(np.arange(several.sum()), size[several]), np.repeat(df[several] > rare, size[several])
    bad = common & source
    out = [(np.full(bad.sum(), COMMON), sid[text[bad]], once[bad].astype(np.int64), h[bad].view(np.int64))]
    known, spoken = np.flatnonzero(~common & source & once), np.flatnonzero(~common & once & (kind[text] & 2 > 0))
    of = group[known]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    pairs = []
    for k in range(rank.max() + 1 if len(rank) else 0):
        here = np.full(several.sum(), -1)
        here[of[rank == k]] = text[known[rank == k]]
        a, b = here[group[spoken]], text[spoken]
        pairs.append(np.unique((a * len(sid) + b)[(a >= 0) & (a != b)]))
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    return [*out, (np.full(len(pairs), PAIR), sid[pairs // len(sid)], eid[pairs % len(sid)], np.zeros(len(pairs), np.int64))]


def met(texts: DataFrame, words: Column, n: int, rare: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``texts`` (sid: null if it is no source, eid: null if it is not edited, text) those that share an n-gram that both have once and at most ``rare`` sources have.

    Gives pairs (sid, eid) of different rows, the hashes of common grams by source
    (sid, common), and the pairs (sid, eid) of rows that meet themselves.
    """
    spark = texts.sparkSession
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = min(16, max(0, (chars // 6 // BUCKET_WORDS).bit_length()))
    hashed = texts.select(F.col("sid").cast("long"), F.col("eid").cast("long"), hashes(words).alias("h")).where("sid is not null or eid is not null")
    packed = hashed.mapInArrow(packer(n, bits), PACKED)
    found = packed.groupBy("bucket").applyInArrow(meeter(rare, bits), "kind int, sid long, eid long, x long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        found = frames.written(found)
    finally:
        spark.conf.set(key, before)
    pairs = found.where(f"kind = {PAIR}").select("sid", "eid").distinct()
    common = found.where(f"kind = {COMMON}").groupBy("sid").agg(F.collect_list("x").alias("common"), F.sum("eid").alias("gone"))  # no more than a text has grams
    own = found.where(f"kind = {OWN}").join(common.select("sid", "gone"), "sid", "left").where(F.col("x") > F.coalesce("gone", F.lit(0))).select("sid", "eid")
    return pairs, common.drop("gone"), own


def sent(small: DataFrame, rows: DataFrame) -> DataFrame:
    """A side of a join with few narrow columns, sent to all tasks if ``rows``, as many as it has, are at most SENT_IDS."""
    return F.broadcast(small) if rows.count() <= SENT_IDS else small


def only(texts: DataFrame, pairs: DataFrame, ident: str) -> DataFrame:
    """The texts of some pair, left out before they travel if their ids are few enough to be sent to all."""
    ids = pairs.select(ident).distinct()
    few = sent(ids, ids)
    return texts.where(F.col(ident).isNotNull()) if few is ids else texts.join(few, ident, "left_semi")


def marked(texts: DataFrame, ids: DataFrame, ident: str, name: str) -> DataFrame:
    """Texts with their id once more (``name``) where ``ids`` has it, else null; few ids are sent to all tasks, so that texts stay where they are."""
    known = ids.select(ident).distinct().withColumn(name, F.col(ident))
    return texts.join(sent(known, known), ident, "left")
