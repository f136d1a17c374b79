"""Order-dependent rules over the array of one group's rows, as Spark expressions.

A pass is one ``aggregate`` over the array with a small state; it runs in the
JVM beside the other expressions of its row, without Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The defaults of the rules.
GAP, GAP_CHARS = 1.5, 1000
CALM_WORDS, READY_WORDS, FULL_WORDS, OVERFLOW_WORDS = 45, 130, 200, 260
LONG_PAUSE, SHORT_PAUSE = 0.8, 0.35
REQUEST_CHARS, TERM_TOKENS = 12_000, 224
BACK, AHEAD, AHEAD_WEIGHT, LEAST_SECTION, LEAST_MOVE = 20.0, 12.0, 1.5, 15.0, 0.05
CHANGE_SHARE, KEPT_SHARE = 0.5, 0.75
#: Fixed value: items of a run that a look into a long array passes over at once.
CHUNK = 32
SPACE = r"[\x20\x09-\x0D]"


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often a lambda in ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def units(text: Column) -> Column:
    """The sentences of a text, line by line, as structs: ``t`` and ``first`` (begins its line)."""
    pieces = lambda line: F.filter(F.split(F.regexp_replace(stripped(line), rf"([.!?…]){SPACE}+", "$1\u0001"), "\u0001"), lambda x: x != "")
    return F.flatten(F.transform(F.split(text, "\n"), lambda line: F.transform(pieces(line), lambda x, k: F.struct(x.alias("t"), (k == 0).alias("first")))))


def ends_sentence(text: Column) -> Column:
    return stripped(text).rlike(r"[.!?…][\"»)\]]*$")


def parted(items: Column, starts: Column) -> Column:
    """``items`` cut into arrays at the positions ``starts`` (from 0, ascending)."""
    both = F.struct(items.alias("x"), starts.alias("s"))
    end = lambda v, k: F.coalesce(F.get(v["s"], k + 1), F.size(v["x"]))
    return once(both, lambda v: F.transform(v["s"], lambda a, k: F.slice(v["x"], a + 1, end(v, k) - a)))


def scan(items: Column, state: dict[str, Column], step) -> Column:
    """The last state of a pass: ``step(state, item, position)`` gives new values by name, the rest stay."""
    first = F.struct(*[v.alias(k) for k, v in state.items()], F.lit(0).alias("_at"))

    def go(s, x):
        new = step(s, x, s["_at"])
        return F.struct(*[new.get(k, s[k]).alias(k) for k in state], (s["_at"] + 1).alias("_at"))

    return F.aggregate(items, first, go)


NONE_YET = "array<int>"


def starts_where(items: Column, state: dict[str, Column], step) -> Column:
    """Positions at which groups begin: ``step`` gives (whether a group begins here, state if it does, state if not)."""

    def go(s, x, at):
        begins, new, old = step(s, x, at)
        return {"starts": F.when(begins, F.array_append(s["starts"], at)).otherwise(s["starts"])} | {k: F.when(begins, new[k]).otherwise(old[k]) for k in new}

    return scan(items, {"starts": F.array().cast(NONE_YET)} | state, go)["starts"]


def request_starts(sizes: Column, limit: int = REQUEST_CHARS) -> Column:
    """Where requests begin among units (n: characters, first: begins a paragraph): when the next unit would overflow, at a paragraph; anywhere once full."""
    used = F.lit(0).cast("long")

    def step(s, x, at):
        cost = x["n"].cast("long") + 1
        full = (s["used"] > 0) & (s["used"] + cost > limit) & (x["first"] | (s["used"] >= limit))
        return (at == 0) | full, {"used": cost}, {"used": s["used"] + cost}

    return starts_where(sizes, {"used": used}, step)


def gap_starts(segments: Column, gap: float = GAP, most: int = GAP_CHARS) -> Column:
    """Where paragraphs begin among segments (start, end, text): after a silence, or after a sentence end beyond ``most`` characters.

    Blank segments add nothing but move the clock; a paragraph begins only where the one before holds text.
    """
    state = {"size": F.lit(0).cast("long"), "until": F.lit(0.0), "tail": F.lit("")}

    def step(s, x, at):
        text = stripped(x["text"])
        cost = F.when(text == "", 0).otherwise(F.length(text) + 1).cast("long")
        tail = F.when(text == "", s["tail"]).otherwise(F.right(text, F.lit(1)))
        quiet, long = x["start"] - s["until"] >= gap, (s["size"] >= most) & s["tail"].isin(".", "!", "?")
        begins = (at == 0) | ((s["size"] > 0) & (quiet | long))
        return begins, {"size": cost, "until": x["end"], "tail": F.when(text == "", F.lit("")).otherwise(tail)}, {"size": s["size"] + cost, "until": x["end"], "tail": tail}

    return starts_where(segments, state, step)


def patience(words: Column, sentence: Column) -> Column:
    """The pause that ends a paragraph of so many words: endless, then falling in a line to none; outside sentence ends only late."""
    slope = (LONG_PAUSE - SHORT_PAUSE) / (READY_WORDS - CALM_WORDS)
    inside = F.when(words < CALM_WORDS, float("inf")).when(words >= READY_WORDS, 0.0).otherwise(LONG_PAUSE - slope * (words - CALM_WORDS))
    late = F.greatest(F.lit(0.0), SHORT_PAUSE * (1 - (words - FULL_WORDS) / float(OVERFLOW_WORDS - FULL_WORDS)))
    return F.when(sentence, inside).when(words >= FULL_WORDS, late).otherwise(float("inf"))


def pause_starts(segments: Column) -> Column:
    """Where paragraphs begin among segments (n: words, ends: at a sentence end, pause: before this one), by ``patience``."""
    state = {"words": F.lit(0).cast("long"), "ends": F.lit(False)}

    def step(s, x, at):
        begins = (at == 0) | ((s["words"] > 0) & (x["pause"] >= patience(s["words"], s["ends"])))
        return begins, {"words": x["n"].cast("long"), "ends": x["ends"]}, {"words": s["words"] + x["n"], "ends": x["ends"]}

    return starts_where(segments, state, step)


def prompt_terms(terms: Column, limit: int = TERM_TOKENS) -> Column:
    """How many terms, from the first, fit a prompt "a, b, c." by its estimated tokens; the first that doesn't ends it."""
    state = {"n": F.lit(0), "open": F.lit(True), "cyr": F.lit(0).cast("long"), "other": F.lit(-1).cast("long")}  # a comma and a space for each term but one, a full stop

    def step(s, x, at):
        c = F.regexp_count(x, F.lit("[Ѐ-ӿ]"))
        cyr, other = s["cyr"] + c, s["other"] + F.length(x) - c + 2
        fits = s["open"] & (F.floor(cyr / 2.5 + other / 4.0) + 1 <= limit)
        return {"n": s["n"] + fits.cast("int"), "open": fits, "cyr": cyr.cast("long"), "other": other.cast("long")}

    return scan(terms, state, step)["n"]


def changes(values: Column, share: float = CHANGE_SHARE, kept: float = KEPT_SHARE) -> Column:
    """``added`` or ``replaced`` where a value differs from the last accepted one by ``share`` of it, else null; the first is accepted as added.

    A change that leaves at least ``kept`` of the old value is an addition.
    """
    state = {"last": F.lit(None).cast("double"), "out": F.array().cast("array<string>")}

    def step(s, x, at):
        far = s["last"].isNull() | (F.abs(x - s["last"]) >= share * F.greatest(F.lit(1.0), F.abs(s["last"])))
        kind = F.when(far, F.when(s["last"].isNull() | (x >= kept * s["last"]), "added").otherwise("replaced"))
        return {"last": F.when(far, x).otherwise(s["last"]), "out": F.array_append(s["out"], kind)}

    return scan(values, state, step)["out"]


def wrapped(text: Column, width: int) -> Column:
    """The lines of a text, each of as many words as fit the width: the longest stretch up to it that ends with a word, or one word that is longer."""
    spaced = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.regexp_extract_all(spaced, F.lit(r"(?s)[^ ].{0,%d}(?= |\z)|[^ ]+" % (width - 1)), F.lit(0))


def gaps_and_spare(line: Column, width: int) -> tuple[Column, Column]:
    """The gaps of a line whose words have one space between them, and the characters that it lacks to the width."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))), F.lit(width) - F.length(line)


def padded(line: Column, width: int) -> Column:
    """A line filled to the width: every gap alike, the rest from the left one by one."""
    gaps, spare = gaps_and_spare(line, width)
    each, more = F.floor(spare / gaps).cast("int") + 1, spare % gaps
    wide, narrow = F.repeat(F.lit(" "), each + 1), F.repeat(F.lit(" "), each)
    head = F.call_function("substring_index", line, F.lit(" "), more)  # as many words as there are wider gaps
    tail = F.substr(line, F.length(head) + 2)
    both = F.concat(F.replace(head, F.lit(" "), wide), wide, F.replace(tail, F.lit(" "), narrow))
    return F.when((gaps < 1) | (spare < 0), line).when(more == 0, F.replace(line, F.lit(" "), narrow)).otherwise(both)


def doubled(line: Column, width: int) -> Column:
    """A line filled to the width by doubling gaps at even distances; left ragged where that would not be enough."""
    gaps, spare = gaps_and_spare(line, width)

    def fill(v):  # the i-th of so many wide gaps lies at the middle of its equal share of the gaps; the words between two of them stay as they are
        end = lambda i: F.floor((i + 0.5) * v["gaps"] / v["spare"]).cast("int") + 1
        first = lambda i: F.when(i == 0, 0).otherwise(end(i - 1))
        piece = lambda i: F.array_join(F.slice(v["words"], first(i) + 1, F.when(i == v["spare"], v["gaps"] + 1).otherwise(end(i)) - first(i)), " ")
        return F.array_join(F.transform(F.sequence(F.lit(0), v["spare"]), piece), "  ")

    known = F.struct(F.split(line, " ").alias("words"), gaps.alias("gaps"), spare.alias("spare"))
    return F.when((gaps > 0) & (spare > 0) & (spare <= gaps), once(known, fill)).otherwise(line)


def justified(text: Column, width: int, fill=padded, least: float = 0.0) -> Column:
    """Wrapped lines, all but the last filled; a text shorter than ``least`` of the width stays as it is."""
    lines = once(wrapped(text, width), lambda x: F.transform(x, lambda line, k: F.when(k == F.size(x) - 1, line).otherwise(fill(line, width))))
    return F.when(F.length(text) < least * width, F.array(text)).otherwise(lines) if least else lines


def chunked(items: Column, first=lambda x: x, last=None) -> Column:
    """Items in runs of CHUNK (x) with the least ``first`` (lo) and the greatest ``last`` (hi), so that a look into a long array passes over runs."""
    run = lambda x: F.struct(x.alias("x"), F.array_min(F.transform(x, first)).alias("lo"), F.array_max(F.transform(x, last or first)).alias("hi"))
    runs = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: once(F.slice(v, k * CHUNK + 1, CHUNK), run))
    return once(items, runs)


def around(runs: Column, low: Column, high: Column) -> Column:
    """The items of all runs that may hold some between low and high, in order."""
    return F.flatten(F.transform(F.filter(runs, lambda c: (c["lo"] <= high) & (c["hi"] >= low)), lambda c: c["x"]))


def sentence_spots(segments: Column) -> Column:
    """Times at which a sentence ends in segments (start, end, text): inside one by its characters, else at the start of the next."""

    def of(all_: Column) -> Column:
        def inside(x: Column, k: Column) -> Column:
            text = stripped(x["text"])
            pieces = F.split(F.regexp_replace(text, rf"([.!?…]){SPACE}", "$1\u0001"), "\u0001")
            ends = once(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda _, i: F.length(F.array_join(F.slice(p, F.lit(1), i + 1), " "))))
            spots = F.transform(ends, lambda n: x["start"] + (x["end"] - x["start"]) * n / F.greatest(F.lit(1), F.length(text)))
            after = F.when(ends_sentence(x["text"]) & (k + 1 < F.size(all_)), F.array(F.get(all_, k + 1)["start"])).otherwise(F.array().cast("array<double>"))
            return F.concat(spots, after)

        return F.flatten(F.transform(all_, inside))

    return once(segments, of)


def refined(sections: Column, segments: Column, announced=None) -> Column:
    """Section starts moved off the middle of sentences: structs (start, moved) for sections (start, end).

    A boundary whose last segment before it ends no sentence goes to the cheapest
    spot between LEAST_SECTION after the section before (as moved) and
    LEAST_SECTION before its own end, BACK behind to AHEAD; ahead costs more.
    ``announced(section, low, boundary)``, if given, may name an earlier start.
    """
    both = F.struct(sections.alias("c"), chunked(segments, lambda g: g["start"]).alias("g"), chunked(sentence_spots(segments)).alias("spots"))

    def of(v: Column) -> Column:
        state = {"out": F.array().cast("array<struct<start:double,moved:boolean>>")}

        def step(s, x, at):
            change, before = x["start"], F.try_element_at(s["out"], F.lit(-1))["start"]
            reach = F.struct(F.greatest(before + LEAST_SECTION, change - BACK).alias("low"), F.least(x["end"] - LEAST_SECTION, change + AHEAD).alias("high"))

            def placed(r: Column) -> Column:
                low, high = r["low"], r["high"]
                run = F.try_element_at(F.filter(v["g"], lambda c: c["lo"] < change), F.lit(-1))["x"]
                last = F.try_element_at(F.filter(run, lambda g: g["start"] < change), F.lit(-1))
                cost = lambda t: F.when(t <= change, change - t).otherwise(AHEAD_WEIGHT * (t - change))
                best = F.array_min(F.transform(F.filter(around(v["spots"], low, high), lambda t: t.between(low, high)), lambda t: F.struct(cost(t).alias("cost"), t.alias("t"))))["t"]
                torn = (at > 0) & (low < high) & once(last, lambda g: g.isNotNull() & ~ends_sentence(g["text"]))
                start = F.when(torn, F.coalesce(best, change)).otherwise(change)
                return once(start, lambda b: F.when((at > 0) & (low < high), F.coalesce(announced(x, low, b), b)).otherwise(b)) if announced else start

            add = lambda start: F.array_append(s["out"], F.struct(start.alias("start"), (F.abs(start - change) >= LEAST_MOVE).alias("moved")))
            return {"out": once(once(reach, placed), add)}

        return scan(v["c"], state, step)["out"]

    return once(both, of)


def portion(sections: Column, percent: float, least: int = 5000, low: float = 0.8, high: float = 1.2) -> Column:
    """The next portion of sections (units: array of (n, first)): structs (section, units) and ``problem`` where no cut fits.

    All that is left if it fits; else whole sections while they fit, then the
    last cut within the window, at a paragraph if there is one.
    """
    size = lambda us: F.aggregate(us, F.lit(0).cast("long"), lambda a, u: a + u["n"] + 1)
    measured = F.transform(sections, lambda us: F.struct(us.alias("us"), size(us).alias("size")))

    def of(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x["size"])
        target = F.greatest(total * percent / 100, F.lit(float(least)))
        piece = "array<struct<section:int,units:int>>"
        state = {"taken": F.lit(0).cast("long"), "done": F.lit(False), "out": F.array().cast(piece), "problem": F.lit(None).cast("string")}

        def cuts(us, taken):  # the units before each cut with the characters up to it
            runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(us) - 1, F.lit(1))), lambda k: F.struct(k.alias("k"), (taken + size(F.slice(us, F.lit(1), k))).alias("run"), F.get(us, k)["first"].alias("first")))
            return F.filter(runs, lambda r: (r["k"] < F.size(us)) & r["run"].between(low * target, high * target))

        def step(s, x, at):
            whole = s["taken"] + x["size"] <= high * target
            taken = s["taken"] + x["size"]
            fit = cuts(x["us"], s["taken"])
            cut = F.coalesce(F.array_max(F.transform(F.filter(fit, lambda r: r["first"]), lambda r: r["k"])), F.array_max(F.transform(fit, lambda r: r["k"])))
            add = lambda n: F.array_append(s["out"], F.struct(at.alias("section"), n.cast("int").alias("units")))
            out = F.when(s["done"], s["out"]).when(whole, add(F.size(x["us"]))).when(cut.isNotNull(), add(cut)).otherwise(s["out"])
            done = s["done"] | ~whole | ((total > high * target) & (taken >= low * target))
            problem = F.when(~s["done"] & ~whole & cut.isNull(), "no cut fits the portion").otherwise(s["problem"])
            return {"taken": F.when(~s["done"] & whole, taken).otherwise(s["taken"]), "done": done, "out": out, "problem": problem}

        return scan(v, state, step)

    return once(measured, of)


def beginning(paragraphs: Column, budget: Column) -> Column:
    """The paragraphs from the first that fit a budget of characters; the first that would exceed it ends them, but one with text always stays."""
    state = {"used": F.lit(0).cast("long"), "open": F.lit(True), "n": F.lit(0)}

    def step(s, x, at):
        fits = s["open"] & ((s["used"] == 0) | (s["used"] + F.length(x) <= budget))
        return {"used": F.when(fits, s["used"] + F.length(x)).otherwise(s["used"]), "open": fits, "n": s["n"] + fits.cast("int")}

    return F.slice(paragraphs, F.lit(1), scan(paragraphs, state, step)["n"])
