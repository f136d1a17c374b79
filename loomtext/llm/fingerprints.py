"""Document fingerprints: threshold-scaled sketches of word shingles.

Method: a document keeps every shingle hash below a fixed fraction of the hash
range, so the sketch grows with the document, sketches of any two documents
are directly comparable, and the sketch of a union is the union of sketches.
Containment and resemblance follow from counting shared hashes. The least hash
of a document is always kept, so that no document with words has an empty
sketch; it counts only where a side has no hash below the threshold.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import store, text

#: Words of a shingle, and the fixed fraction of hashes kept: one in SCALE.
SHINGLE = 5
SCALE = 8


def threshold(scale: int = SCALE) -> int:
    """Signed hashes below this number are kept: one in ``scale``."""
    return -(2**63) + 2**64 // scale


def sketch(column: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the text's shingles below the threshold, and the least of all.

    A text with fewer words than a shingle has its whole word sequence as its
    one shingle; one without words (or null) has an empty sketch.
    """

    def of(w: Column) -> Column:
        size = F.size(w)
        hashes = F.when(size == 0, F.array().cast("array<bigint>")).when(size < shingle, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(
            F.transform(F.sequence(F.lit(0), size - shingle), lambda i: F.xxhash64(*[w[i + k] for k in range(shingle)]))
        )
        return text.let(hashes, lambda h: F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < F.lit(threshold(scale))), F.when(size > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))))))

    return text.let(text.words(column), of)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two documents, from their sketches alone."""
    both = F.array_sort(F.array_union(a, b))
    return text.let(both, lambda u: F.filter(u, lambda x, k: (k == 0) | (x < F.lit(threshold(scale)))))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the smaller document's shingles found in the other, 0 to 1.

    Two documents without words: 1; one of them without: 0. Where a side has no
    hash below the threshold, the least hash stands for it.
    """

    def of(x: Column) -> Column:
        kept = lambda s: F.filter(s, lambda h: h < F.lit(threshold(scale)))
        return text.let(
            F.struct(kept(x["a"]).alias("a"), kept(x["b"]).alias("b")),
            lambda k: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), ((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0)).cast("double"))
            .when((F.size(k["a"]) == 0) & (F.size(k["b"]) == 0), (x["a"] == x["b"]).cast("double"))
            .when(F.size(k["a"]) == 0, F.array_contains(x["b"], x["a"][0]).cast("double"))
            .when(F.size(k["b"]) == 0, F.array_contains(x["a"], x["b"][0]).cast("double"))
            .otherwise(F.size(F.array_intersect(k["a"], k["b"])) / F.least(F.size(k["a"]), F.size(k["b"]))),
        )

    return text.let(F.struct(a.alias("a"), b.alias("b")), of)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents' shingle sets."""
    return F.coalesce(F.expr("1.0D") * F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(1.0))


def as_string(s: Column) -> Column:
    """The sketch as text: 16 lowercase hex digits for each hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def next_of(docs: DataFrame) -> DataFrame:
    """For each doc_id: the next one in descending order (after the last: the first).

    Blocks of a range partition give the order, so no task sees all ids. A
    repeated doc_id counts once. Null ids are left out.
    """
    ids = store.ordered_blocks(docs.select("doc_id").where("doc_id is not null").distinct(), [F.col("doc_id").desc()], "ids")
    inner = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("blk").orderBy(F.desc("doc_id"))))
    heads = store.table(ids.groupBy("blk").agg(F.max("doc_id").alias("head")), "heads")  # a row for each block
    order = Window.orderBy("blk")
    following = heads.select("blk", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    return store.join_small(inner, store.table(following, "heads"), "blk").select("doc_id", F.coalesce("next_id", "head").alias("next_id"))


def fingerprint_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprint every document, its edited text and the document after it.

    The edited text is the document's with its last third (code points, rounded
    down) replaced by the first as many code points, or all, of the next
    document in descending doc_id. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. Rows that share a doc_id each give a row; as somebody's
    next document the least of their texts stands for them. A null doc_id has no
    next document: its next text is empty. Texts without words have the empty
    fingerprint, and equal texts equal ones. Very long texts are read whole.
    Extra columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    n = store.partitions(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = docs.where("doc_id is not null").repartition(n, "doc_id")  # one exchange, used by both joins
    follows = store.table(next_of(docs), "next")
    ends = docs.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).alias("cut"))
    asked = store.table(follows.join(ends, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asker"), "cut"), "asked")
    given = base.join(asked, "doc_id").select("asker", F.struct(F.substring(F.col("text"), F.lit(1), F.col("cut").cast("int")).alias("part"), sketch(F.col("text"), scale).alias("s")).alias("g"))
    given = given.groupBy("asker").agg(F.min("g").alias("g")).withColumnRenamed("asker", "doc_id")
    nameless = docs.where("doc_id is null").withColumn("g", F.lit(None).cast(given.schema["g"].dataType))
    both = base.join(given, "doc_id", "left").unionByName(nameless).withColumn("n_chars", F.length("text").cast("long"))
    keep = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    part = F.substring(F.coalesce(F.col("g.part"), F.lit("")), F.lit(1), F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), keep.cast("int")), part)
    got = both.select("doc_id", "n_chars", text.let(F.struct(F.col("text").alias("t"), edited.alias("e"), F.coalesce("g.s", F.array().cast("array<bigint>")).alias("n")), lambda x: F.struct(
        F.sha2(x["e"], 256).alias("sha"), sketch(x["t"], scale).alias("s"), sketch(x["e"], scale).alias("se"), x["n"].alias("sn"))).alias("f"))
    out = text.let(F.col("f"), lambda f: F.struct(
        f["sha"].alias("edited_sha256"), as_string(f["s"]).alias("fingerprint"), as_string(f["se"]).alias("edited_fingerprint"),
        containment(f["s"], f["se"], scale).alias("near_edited"), containment(f["s"], f["sn"], scale).alias("near_next")))
    return got.select("doc_id", "n_chars", out.alias("o")).select("doc_id", "n_chars", "o.*")
