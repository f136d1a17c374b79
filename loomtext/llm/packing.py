"""Mixture-controlled packing into fixed windows.

Method: deficit round-robin over source queues. A round is one window long. In
each round a source earns its target share of the window; it sends what it has
earned, cutting a document where its deficit ends, and the fraction of a token
left is carried over. A source that earns less than LEAST tokens saves up over
several rounds, so that pieces don't get too small. Token t of a source's queue
therefore leaves in the turn floor(t / quantum), which running sums give
without any state passing between windows or partitions: deficits carry across
both. The stream in order of rounds is cut every WINDOW tokens, so every window
holds the sources in their target proportions; the rest at the end is cut into
powers of two, so nothing is padded.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import store, workers

#: Tokens of a window and the id that ends a document.
WINDOW = 4096
END = 2
#: Tokens that a source sends at once, at least (where its document and queue have as many).
LEAST = 64
#: Words, and parts of words, whose ids a Python worker remembers; the rest are encoded as they come.
REMEMBERED = 200_000
#: Texts are tokenised in groups of about so many bytes.
GROUP = 4_000_000
#: Texts of an Arrow batch between the JVM and Python, held on both sides, outside the heap; rows that a worker turns into Python objects at once.
BATCH, SLICE = 1_000, 500

_known: dict[str, Words] = {}


def byte_letters() -> dict[int, int]:
    """How byte-level tokenizers write the bytes that have no printable character: 256 and up, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}


LETTERS = byte_letters()
#: A word of letters, then punctuation: two pre-tokens. No apostrophe (contractions) and no bracket (special tokens).
PLAIN = re.compile(rb"([A-Za-z]+)([.,!?;:|#$%&*\-]*)")
PARTS = r"\A(?P<a>[A-Za-z]+)(?P<b>[.,!?;:|#$%&*\-]*)\z"
SIMPLE = re.compile(r"([^\W\d_]+)([.,!?;:|#$%&*\-]*)")
#: What a tokenizer must encode alike by words and as a whole, and by the model's own parts, for the quick ways to be taken.
PROBE = "  Ab, ba!? déjà-Vu É. x1 2y ... a.b it's <|x|> [y] 'Zz' Straße; ñandú:\t\nﬁn ωμέγα #tag $5 k*%& e\u0301a ab "


class Words:
    """A tokenizer in one Python worker, with the ids of words and of their parts that it has met.

    Two quick ways depend on the tokenizer and are tried on PROBE first: ids of a
    text are those of its words in turn (``by_words``), and a word of Latin letters
    and punctuation is two pre-tokens in lower case that the model takes byte by
    byte (``by_parts``). Where one doesn't hold, the tokenizer itself is called.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.made.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        whole = self.raw(self.made.encode(PROBE, add_special_tokens=False).ids)
        split = PROBE.encode().split()
        self.by_words = whole == b"".join(self.raw(self.made.encode(w.decode(), add_special_tokens=False).ids) for w in split)
        self.by_parts = False
        if self.by_words:
            try:
                self.by_parts = True
                got = self.of_words(split)
                self.by_parts = whole == b"".join(got[w] for w in split)
            except Exception:  # noqa: BLE001  a model that can't take single parts
                self.by_parts = False
            if not self.by_parts:
                got = self.of_words(split)
                self.by_words = whole == b"".join(got[w] for w in split)
            self.parts.clear()

    def raw(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def part(self, s: bytes) -> bytes:
        """The ids of one pre-token (UTF-8, lower case)."""
        got = self.parts.get(s)
        if got is None:
            letters = s.decode() if s.isascii() else s.decode("latin-1").translate(LETTERS)
            got = self.raw([t.id for t in self.made.model.tokenize(letters)])
            if len(self.parts) < REMEMBERED:
                self.parts[s] = got
        return got

    def of_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of words; those that aren't simple go to the tokenizer together, as one text that offsets split again."""
        out: dict[bytes, bytes] = {}
        odd: list[bytes] = []
        part, known = self.part, self.parts
        for w in words if self.by_parts else ():
            m = PLAIN.fullmatch(w)
            if m:
                a, b = m.groups()
                a = a.lower()
                ids = known.get(a) or part(a)
                out[w] = ids + (known.get(b) or part(b)) if b else ids
                continue
            text = w.decode()
            m = SIMPLE.fullmatch(text)
            if m and max(m[1]) < "\u0100" and m[1].isalpha() and unicodedata.is_normalized("NFC", text):
                out[w] = part(m[1].lower().encode()) + (part(m[2].encode()) if m[2] else b"")
            else:
                odd.append(w)
        odd = odd if self.by_parts else list(words)
        for i in range(0, len(odd), 2000):
            some = [w.decode() for w in odd[i : i + 2000]]
            starts = np.cumsum([0] + [len(t) + 1 for t in some[:-1]])
            got = self.made.encode(" ".join(some), add_special_tokens=False)
            ids = self.raw(got.ids)
            owner = np.searchsorted(starts, np.array([a for a, _ in got.offsets], dtype=np.int64), side="right")
            cuts = (np.searchsorted(owner, np.arange(1, len(some) + 2)) * self.kind.itemsize).tolist()
            out.update((w, ids[cuts[k] : cuts[k + 1]]) for k, w in enumerate(odd[i : i + 2000]))
        return out

    def of_parts(self, parts: pa.Array) -> pa.Array:
        """The ids of pre-tokens (lower case), each distinct one looked up once."""
        d, known = parts.dictionary_encode(), self.parts
        ids = [known.get(p) or (self.part(p) if p else p) for p in d.dictionary.cast(pa.binary()).to_pylist()]
        return pa.array(ids, pa.binary()).take(d.indices)

    def of_distinct(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words in their order: plain ones by their two parts, the others as ``of_words`` has them."""
        found = pc.extract_regex(words, PARTS) if self.by_parts else pa.nulls(len(words), pa.struct([("a", pa.string()), ("b", pa.string())]))
        plain = pc.is_valid(found)
        a, b = found.filter(plain).flatten()
        by_parts = pc.binary_join_element_wise(self.of_parts(pc.ascii_lower(a)), self.of_parts(b), pa.scalar(b"", pa.binary()))
        rest, known = words.filter(pc.invert(plain)).cast(pa.binary()).to_pylist(), self.words
        new = self.of_words([w for w in rest if w and w not in known])
        others = [known.get(w) or (new[w] if w in new else b"") for w in rest]
        known.update(itertools.islice(new.items(), max(0, REMEMBERED - len(known))))
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        return pa.concat_arrays([by_parts, pa.array(others, pa.binary())]).take(pa.array(place))

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """The ids of each text of a column, END added, as little-endian bytes of the id type.

        A distinct word is looked up once for all the texts.
        """
        texts, end = texts.fill_null(""), self.raw([END])
        if not self.by_words or not len(texts):
            return pa.array([self.raw(self.made.encode(t, add_special_tokens=False).ids) + end for t in texts.to_pylist()], pa.binary())
        split = pc.ascii_split_whitespace(texts)
        coded, at = split.flatten().dictionary_encode(), split.offsets.to_numpy() - split.offsets[0].as_py()
        ids = pa.concat_arrays([self.of_distinct(coded.dictionary), pa.array([end], pa.binary())])
        joined = ids.take(pa.array(np.insert(coded.indices.to_numpy(), at[1:], len(coded.dictionary))))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int32)[at + np.arange(len(at))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), joined.buffers()[2]])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (UTF-8), as ``encode_column`` has them."""
        return self.encode_column(pa.array(texts, pa.binary()).view(pa.string())).to_pylist()


def tokenizer(path: str) -> Words:
    """The tokenizer of a file, once per Python worker."""
    if path not in _known:
        _known[path] = Words(path)
    return _known[path]


def in_file_order(docs: DataFrame, name: str = "_place") -> DataFrame:
    """Add ``name``, which numbers the rows of a DataFrame read from Parquet by file name, then by place in the file.

    What was written range-sorted has that order in its files, but Spark reads large files first. A column that has the
    name already is replaced; the others stay as they are, whatever their names.
    """
    files = store.table(docs.select(F.col("_metadata.file_path").alias("file")).distinct(), "files")  # a row for each file
    numbers = store.table(files.withColumn("part", F.row_number().over(Window.orderBy("file")) - 1), "numbers")
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != name]
    named = docs.select(F.struct(*own).alias("own"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    joined = store.join_small(named, numbers, "file", "inner")
    return joined.select("own.*", (F.shiftleft(F.col("part").cast("long"), 33) + F.col("row")).alias(name))


def tokenize(docs: DataFrame, path: str, source: str = "source", order: str | None = None) -> DataFrame:
    """A stored row for each document: uid (the column ``order`` of docs, else by read order), part, doc_id, source, n (tokens with END) and ids."""
    own = ["uid"] if order else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(path)
        width = made.kind.itemsize
        for b in batches:
            texts, done = b.column("text").cast(pa.string()), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
            while done < len(texts):
                upto = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + GROUP)))
                ids = made.encode_column(texts.slice(done, upto - done))
                some = b.slice(done, len(ids))
                n = pc.cast(pc.divide(pc.binary_length(ids), width), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("source"), n, ids, *[some.column(c) for c in own]], ["doc_id", "source", "n", "ids", *own])
                done += len(ids)
                del ids
                pa.default_memory_pool().release_unused()  # groups take memory in other sizes than those before

    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, source string, n bigint, ids binary" + ", uid bigint" * len(own)
    rows = docs.select("doc_id", F.col(source).cast("string").alias("source"), "text", *[F.col(order).alias(c) for c in own]).mapInArrow(workers.tidy(run), kinds)
    uid = F.col("uid") if own else F.monotonically_increasing_id()
    with store.batches_of(docs.sparkSession, BATCH):
        return store.table(rows.withColumn("uid", uid).withColumn("part", F.shiftright("uid", 33).cast("int")), "tokens")


def schedule(tokens: DataFrame, shares: dict[str, float] | None = None, window: int = WINDOW, least: int = LEAST) -> tuple[DataFrame, int]:
    """Where the pieces of each document begin in the packed stream, (uid, pieces: array of (at, n, begin)), and the stream's length.

    ``shares`` are target proportions by source; a source not named gets, as all
    do by default, its own share of the tokens, and all are scaled to a sum of 1.
    Queues keep the order of uid; a source whose queue has ended leaves its place
    to the others.
    """
    narrow = tokens.select("uid", "part", "source", "n")
    parts = store.table(narrow.groupBy("source", "part").agg(F.sum("n").alias("sum")), "parts")
    total = parts.agg(F.sum("sum")).first()[0] or 0
    own = F.sum("sum").over(Window.partitionBy("source")) / max(1, total)
    if shares:
        named = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
        own = F.coalesce(F.try_element_at(named, F.col("source")), own)
        own = own / parts.select("source", own.alias("share")).distinct().agg(F.sum("share")).first()[0] if total else own
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("part")) - F.col("sum")
    known = parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), before.alias("before"), (own * window).alias("earned"))
    known = known.withColumn("every", F.ceil(least / F.col("earned"))).withColumn("quantum", F.col("earned") * F.col("every"))
    known = store.table(known.withColumn("phase", F.pmod(F.xxhash64("_s"), F.col("every"))).drop("earned"), "queues")
    queued = store.join_small(narrow, known, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    end = F.col("before") + F.sum("n").over(Window.partitionBy("part", "source").orderBy("uid"))
    queued = queued.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    turn = lambda t: F.floor(t / F.col("quantum"))
    turns = queued.withColumns({"first": turn(F.col("start")), "last": turn(F.col("end") - 1)}).withColumn("turn", F.explode(F.sequence("first", "last")))
    edge = lambda k: F.ceil(k * F.col("quantum"))
    frm = F.when(F.col("turn") == F.col("first"), F.col("start")).otherwise(edge(F.col("turn")))
    to = F.when(F.col("turn") == F.col("last"), F.col("end")).otherwise(edge(F.col("turn") + 1))
    cut = turns.select("uid", "source", (F.col("turn") * F.col("every") + F.col("phase")).alias("round"), frm.alias("from"), (frm - F.col("start")).alias("at"), (to - frm).alias("n")).where("n > 0")
    order = ["round", F.col("source").asc_nulls_last(), "from"]
    blocks = store.ordered_blocks(cut, [F.col(x) if isinstance(x, str) else x for x in order], "rounds")
    sums = store.table(blocks.groupBy("blk").agg(F.sum("n").alias("sum")), "blocks")  # a row for each block
    offsets = store.table(sums.select("blk", (F.sum("sum").over(Window.orderBy("blk")) - F.col("sum")).alias("offset")), "offsets")
    inner = F.sum("n").over(Window.partitionBy("blk").orderBy(*order)) - F.col("n")
    placed = store.join_small(blocks.withColumn("inner", inner), offsets, "blk").select("uid", F.struct("at", "n", (F.col("offset") + F.col("inner")).alias("begin")).alias("p"))
    return placed.groupBy("uid").agg(F.array_sort(F.collect_list("p")).alias("pieces")), int(total)  # the pieces of one document


def boundaries(total: int, window: int = WINDOW) -> np.ndarray:
    """Ends of the sequences after the last full window: the rest as falling powers of two."""
    rest, ends, at = total % window, [], total - total % window
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, dtype=np.int64)


def cut(begin: int, n: int, full: int, tail: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """The parts (start, length, sequence, offset) of a piece of n tokens at ``begin`` of the stream."""
    out, at, end = [], begin, begin + n
    while at < end:
        if at < full:
            seq, first, last = at // window, at // window * window, (at // window + 1) * window
        else:
            k = int(np.searchsorted(tail, at, side="right"))
            seq, first, last = full // window + k, int(tail[k - 1]) if k else full, int(tail[k])
        stop = min(end, last)
        out.append((at - begin, stop - at, seq, at - first))
        at = stop
    return out


def pack(docs: DataFrame, path: str, shares: dict[str, float] | None = None, source: str = "source", window: int = WINDOW, order: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens; a row for each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.
    Queues keep the order of the column ``order`` (as ``in_file_order`` gives), else that of reading.
    A null or empty text is the one token END; a very long text is cut over as
    many windows as its source's share needs; null sources are a queue of their
    own, the last; repeated rows are documents of their own, as are rows that
    share a doc_id; other columns are ignored, whatever their names; an empty
    table gives an empty result. ``window`` is a power of two.
    """
    tokens = tokenize(docs, path, source, order)
    begins, total = schedule(tokens, shares, window)
    full, tail = total - total % window, boundaries(total, window)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _known.clear()  # a worker that has tokenised before needs its memory of words no longer
        workers.give_back()
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            cols: list[list] = [[] for _ in range(7)]
            rows: list[int] = []
            ids, ns, pieces = b.column("ids"), b.column("n").to_pylist(), b.column("pieces")
            for i, n in enumerate(ns):
                raw = ids[i].as_buffer()
                whole = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                ps = pieces[i].values
                joined: list[list[int]] = []  # pieces that follow one another in the stream too are one
                for at, m, begin in zip(*(ps.field(c).to_pylist() for c in ("at", "n", "begin"))):
                    if joined and joined[-1][2] + joined[-1][1] == begin:
                        joined[-1][1] += m
                    else:
                        joined.append([at, m, begin])
                for at, m, begin in joined:
                    for start, length, seq, offset in cut(begin, m, full, tail, window):
                        rows.append(i)
                        for c, v in zip(cols, (at + start, length, zlib.crc32(whole[at + start : at + start + length].tobytes()), n, seq, offset)):
                            c.append(v)
            picked = b.select(["doc_id", "source"]).take(pa.array(rows, pa.int32()))  # not the ids: each piece would copy those of its whole document
            yield pa.RecordBatch.from_arrays([picked.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:6]], picked.column("source")], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    placed = tokens.select("uid", "doc_id", "source", "n", "ids").join(begins, "uid").select("doc_id", "source", "n", "ids", "pieces")
    return placed.mapInArrow(workers.tidy(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string")
