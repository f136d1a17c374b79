"""Line deduplication by distinct-site spread.

Method: a HyperLogLog sketch of sites for each line hash, made from the lines
themselves and merged by aggregation (map-side first, so a line that a third of
all documents hold reaches its merge once per task). The sketch decides the
lines whose estimate is far from the threshold; only lines in the band around
it have their distinct sites counted exactly. A line on enough sites is
boilerplate and stays only in the document with the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import store, text

#: Log2 of the sketch's registers: a standard error of 1.04 / sqrt(2 ** 12), 1.6 %.
REGISTERS = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors.
BAND = 0.1
#: A line is boilerplate from this many sites.
SITES = 10


def line_hash(line: Column) -> list[Column]:
    """128 bits that stand for a line, as two columns."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(1)).alias("h2")]


KEY = ["h", "h2"]


def site_counts(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Lines (hash ``h``, ``h2``) on at least ``sites`` distinct sites, from rows (h, h2, site, doc_id): h, h2, first_doc.

    Lines on one site need no sketch: their least and greatest site are equal.
    """
    spread = lines.groupBy(*KEY).agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("doc_id").alias("first_doc"))
    wide = store.table(spread.where("lo <> hi").select(*KEY, "first_doc"), "wide")
    met = store.join_small(lines, wide.select(*KEY), KEY, "left_semi")
    estimate = met.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("est"))
    estimate = store.table(estimate.where(F.col("est") >= sites * (1 - BAND)), "estimates")
    near = store.table(estimate.where(F.col("est") <= sites * (1 + BAND)).select(*KEY), "near")
    exact = store.join_small(lines, near, KEY, "left_semi").groupBy(*KEY, "site").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.count("*").alias("exact"))
    chosen = estimate.where(F.col("est") > sites * (1 + BAND)).select(*KEY).unionByName(exact.where(F.col("exact") >= sites).select(*KEY))
    return wide.join(chosen, KEY)


def removals(docs: DataFrame, sites: int = SITES, site: str = "source", least_chars: int = 10) -> DataFrame:
    """(doc_id, drop: array of line positions) of documents that lose lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    each = docs.select("doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(lines).alias("at", "line"))
    each = each.where(F.length(text.squeezed(F.col("line"))) >= least_chars)
    hashed = store.table(each.select("doc_id", "site", "at", *line_hash(F.col("line"))), "lines")
    common = store.table(site_counts(hashed.select(*KEY, "site", "doc_id"), sites), "boilerplate")
    hits = store.join_small(hashed, common, KEY, "inner")
    # In its first document a line keeps its first place.
    firsts = hits.where("doc_id = first_doc").groupBy(*KEY).agg(F.min("at").alias("first_at"))
    kept = store.join_small(hits, store.table(firsts, "firsts"), KEY, "left")
    lost = kept.where(~((F.col("doc_id") == F.col("first_doc")) & (F.col("at") == F.coalesce("first_at", F.lit(-1)))))
    return lost.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("drop"))  # the lines of one document


def without(lines: Column, drop: Column) -> Column:
    return F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(drop, i)), "\n")


def remove_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """Remove cross-site boilerplate lines: the documents' columns with new text, n_lines and n_removed.

    Lines are compared whole, split at \\n; those with fewer than ten characters
    in words are left alone. Null sites count as one site (that of the empty
    name), null texts are empty and stay null, a null doc_id never loses lines.
    Rows that share a doc_id are treated as one document. Very long texts are
    taken whole. Every row is kept, even if no line is left; of the caller's
    columns only ``n_lines`` and ``n_removed`` are replaced, others with any name
    stay as they are; an empty table gives an empty result.
    """
    joined, kept, counts = stripped(docs, sites, site)
    own = [(kept if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*own, *counts)


def stripped(docs: DataFrame, sites: int, site: str) -> tuple[DataFrame, Column, list[Column]]:
    """Rows with ``_row`` (all columns of docs), the text that is left of each, and the numbers of its lines and of those removed."""
    lost = removals(docs.select("doc_id", "text", site), sites, site).select(F.col("doc_id").alias("_id"), F.col("drop").alias("_drop"))
    joined = docs.select(F.struct("*").alias("_row")).join(lost, F.col("_row.doc_id") == F.col("_id"), "left")
    lines, drop = F.split(F.col("_row.text"), "\n"), F.col("_drop")
    removed = F.coalesce(F.size(F.array_intersect(drop, F.sequence(F.lit(0), F.size(lines) - 1))), F.lit(0)).cast("long")
    return joined, F.when(drop.isNull(), F.col("_row.text")).otherwise(without(lines, drop)), [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_removed")]


def kept_documents(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """The documents without boilerplate, with the columns they have (``n_chars`` counted anew); those that lose all their words to it go."""
    joined, kept, _ = stripped(docs, sites, site)
    rows = joined.select("_row", "_drop", kept.alias("_text")).where(F.col("_drop").isNull() | (text.squeezed(F.col("_text")) != ""))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left."""
    out = remove_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL, with exact counts of sites.
ORACLE = r"""
with l as (select doc_id, source, t, unnest(range(len(t))) as pos from (select doc_id, source, string_split(text, chr(10)) as t from documents)),
e as (select doc_id, source, pos, t[pos + 1] as line from l where length(regexp_replace(t[pos + 1], '[\x20\x09-\x0D]', '', 'g')) >= 10),
b as (select line, min(doc_id) as first_doc from e group by line having count(distinct source) >= 10),
f as (select e.line, first_doc, min(pos) as first_pos from e join b on e.line = b.line and e.doc_id = b.first_doc group by all),
x as (select distinct e.doc_id, e.pos from e join f on e.line = f.line where not (e.doc_id = f.first_doc and e.pos = f.first_pos)),
k as (select l.doc_id, string_agg(l.t[l.pos + 1], chr(10) order by l.pos) filter (where x.pos is null) as kept, count(*) as n, count(x.pos) as r
      from l left join x on l.doc_id = x.doc_id and l.pos = x.pos group by l.doc_id)
select doc_id, n as n_lines, r as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from k
"""
