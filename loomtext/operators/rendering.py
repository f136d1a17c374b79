"""Conversations, markup and commands laid out for reading, as JVM-side expressions.

Quotes are read by one pattern that takes a quoted run as a whole, nesting by a
pass over the tags with a depth that never falls below zero, lines by
``passes.wrapped``. Nothing leaves the row it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators import passes as p

#: Columns of a page and of a command, the least room for words, and the indent of a level.
WIDTH, COMMAND_WIDTH, ROOM, INDENT = 80, 100, 24, "  "
#: Fixed value: a tag, with its name right after its bracket.
TAG = r"</?[A-Za-z_][\w.:-]*(?:\s[^<>]*?)?/?>"
#: A piece of a command: a pipe opens it, a semicolon ends it, quoted runs count as other characters do. Possessive, so long runs need no stack.
PIECE = r"""\|?(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^"'|;]++)*+;?"""
LINES = "array<string>"


def command_pieces(line: Column) -> Column:
    """A command line cut at the pipes and semicolons outside its quotes; an unclosed quote runs to the end."""
    found = F.regexp_extract_all(line, F.lit(PIECE), F.lit(0))
    return F.filter(F.transform(found, p.stripped), lambda x: x != "")


def indented(lines: Column, indent: Column) -> Column:
    return F.transform(lines, lambda x: F.concat(indent, x))


def wrapped(text: Column, indent: Column, width: int = WIDTH) -> Column:
    """A text in lines of whole words, each after its indent; at least ROOM characters are left for the words."""

    def step(s, w, at):
        over = (s["line"] != "") & (F.length(s["line"]) + 1 + F.length(w) > F.greatest(F.lit(width) - F.length(indent), F.lit(ROOM)))
        return {"lines": F.when(over, F.array_append(s["lines"], s["line"])).otherwise(s["lines"]), "line": F.when(over | (s["line"] == ""), w).otherwise(F.concat(s["line"], F.lit(" "), w))}

    done = p.scan(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), {"lines": F.array().cast(LINES), "line": F.lit("")}, step)
    return indented(p.once(done, lambda s: F.array_append(s["lines"], s["line"])), indent)


def text_lines(text: Column, indent: Column, width: int = WIDTH) -> Column:
    """A text as it is written, tabs as four spaces; lines too long for the width are wrapped, blank ones empty."""

    def laid(line: Column) -> Column:
        bare = F.regexp_replace(line, r"[\x20\x09-\x0D]+$", "")
        fits = F.length(indent) + F.length(bare) <= width
        return p.once(bare, lambda x: F.when(x == "", F.array(F.lit(""))).when(fits, F.array(F.concat(indent, x))).otherwise(wrapped(x, indent, width)))

    return F.flatten(F.transform(F.split(F.replace(text, F.lit("\t"), F.lit("    ")), "\n"), laid))


def command_lines(text: Column, indent: Column, width: int = COMMAND_WIDTH) -> Column:
    """A command's own lines; one that is too long goes on by as many pieces as fit, a piece too long by words."""

    def laid(line: Column) -> Column:
        bare = F.regexp_replace(line, r"[\x20\x09-\x0D]+$", "")

        def step(s, x, at):
            joined = F.when(s["line"] == "", x).otherwise(F.concat(s["line"], F.lit(" "), x))
            over = (s["line"] != "") & (F.length(indent) + F.length(joined) > width)
            return {"lines": F.when(over, F.array_append(s["lines"], s["line"])).otherwise(s["lines"]), "line": F.when(over, x).otherwise(joined)}

        groups = p.once(p.scan(command_pieces(bare), {"lines": F.array().cast(LINES), "line": F.lit("")}, step), lambda s: F.array_append(s["lines"], s["line"]))
        folded = F.flatten(F.transform(groups, lambda g: F.when(F.length(indent) + F.length(g) <= width, F.array(F.concat(indent, g))).otherwise(wrapped(g, indent, width))))
        return F.when(bare == "", F.array(F.lit(""))).when(F.length(indent) + F.length(bare) <= width, F.array(F.concat(indent, bare))).otherwise(folded)

    return F.flatten(F.transform(F.split(text, "\n"), laid))


def is_markup(text: Column) -> Column:
    """Whether some tag of a text is opened and closed in it."""
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    name = lambda x: F.regexp_extract(x, r"^</?([^\s>/]+)", 1)
    opened = F.transform(F.filter(tags, lambda x: ~x.startswith("</") & ~x.endswith("/>")), name)
    return F.arrays_overlap(opened, F.transform(F.filter(tags, lambda x: x.startswith("</")), name))


def nested(text: Column) -> Column:
    """The tags and texts of markup as structs (token, depth); a closing tag stands at its opening tag's depth, never below zero."""
    tokens = F.filter(F.split(F.regexp_replace(text, f"({TAG})", "\u0001$1\u0001"), "\u0001"), lambda x: p.stripped(x) != "")

    def step(s, x, at):
        tag = x.rlike(f"^{TAG}$")
        closing, opening = tag & x.startswith("</"), tag & ~x.startswith("</") & ~x.endswith("/>")
        depth = F.when(closing, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return {"depth": depth + opening.cast("int"), "out": F.array_append(s["out"], F.struct(x.alias("token"), depth.alias("depth")))}

    return p.scan(tokens, {"depth": F.lit(0), "out": F.array().cast("array<struct<token:string,depth:int>>")}, step)["out"]


def tag_lines(tag: Column, indent: Column, width: int = WIDTH) -> Column:
    """A tag on its line; if too long, its name, a line for each attribute one level deeper, and its end."""
    attributes = F.regexp_extract_all(tag, F.lit(r'[\w.:-]+\s*=\s*"[^"]*"'), F.lit(0))
    inner = F.flatten(F.transform(attributes, lambda x: wrapped(x, F.concat(indent, F.lit(INDENT)), width)))
    parts = F.concat(F.array(F.concat(indent, F.regexp_extract(tag, r"^</?[\w.:-]+", 0))), inner, F.array(F.concat(indent, F.regexp_extract(tag, "/?>$", 0))))
    return F.when(F.length(indent) + F.length(tag) <= width, F.array(F.concat(indent, tag))).when(F.size(attributes) == 0, wrapped(tag, indent, width)).otherwise(parts)


def markup_lines(text: Column, width: int = WIDTH) -> Column:
    """Markup with a tag a line, its nesting shown by the indent."""

    def laid(x: Column) -> Column:
        indent = F.repeat(F.lit(INDENT), x["depth"])
        own = F.regexp_replace(x["token"], r"^\n+|\n+$", "")
        return F.when(x["token"].rlike(f"^{TAG}$"), tag_lines(x["token"], indent, width)).otherwise(text_lines(own, indent, width))

    return F.flatten(F.transform(nested(text), laid))


def message_lines(text: Column, width: int = WIDTH) -> Column:
    """A message for reading: markup by its nesting, other text as it is written; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(is_markup(whole), markup_lines(whole, width)).otherwise(text_lines(whole, F.lit(""), width))


def events(turns: DataFrame, key: str, order: str, role: str, text: str, width: int = WIDTH) -> DataFrame:
    """``turns`` with ``number`` from 1, ``name`` (0001_role) and ``rendered``: a heading between rules, the message, an empty line.

    Rules of a user's turns are double. Nothing but the numbering shuffles, by conversation.
    """
    group = Window.partitionBy(key)
    who = F.coalesce(F.nullif(F.col(role), F.lit("")), F.lit("event"))
    got = turns.withColumn("number", F.row_number().over(group.orderBy(order))).withColumn("_total", F.count("*").over(group))
    rule = F.repeat(F.when(F.upper(who) == "USER", "=").otherwise("-"), F.lit(width))
    head = F.format_string("[%d/%d] %s", F.col("number"), F.col("_total"), F.upper(F.coalesce(F.nullif(F.col(role), F.lit("")), F.lit("?"))))
    lines = F.concat(F.array(rule, head, rule, F.lit("")), message_lines(F.col(text), width), F.array(F.lit("")))
    return got.withColumn("name", F.concat(F.format_string("%04d_", "number"), who)).withColumn("rendered", F.array_join(lines, "\n")).drop("_total")


def write_events(turns: DataFrame, path: str, key: str, order: str, role: str, text: str) -> None:
    """A folder for each conversation and in it one for each event, holding the event's row as one JSON line in one file."""
    fields = F.to_json(F.struct(*[F.col(f"`{x}`") for x in turns.columns]), {"ignoreNullFields": "false"})
    each = events(turns, key, order, role, text).select(F.col(key).alias("conversation"), F.col("name").alias("event"), fields.alias("value"))
    each.write.partitionBy("conversation", "event").text(path)
