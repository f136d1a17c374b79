"""Sections that begin where their speaker announces them, as passes over a recording's arrays.

A section's start is a moment somebody pressed a key; what they said just
before, after a pause, may already belong to it. Sentences get their times from
their segments, meet the boundaries in the same pass that moves those off the
middle of sentences, and a moved start narrows what the next one may reach.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.operators import passes as p

#: The defaults of the rules.
PAUSE, MOST_WORDS, EDGE, TOLERANCE = 1.0, 25, 0.05, 0.7
#: Words too common to say which section comes.
COMMON = (
    "test tests testing automation automated what which when your you our this that with from into "
    "will have they them their there than then about also such some more most other using used"
).split()
#: A slide that is spoken of, and phrases that move on.
MENTION = r"(?iu)(?<![\p{L}\p{N}_])(слайд|this slide|next slide|last slide)"
MOVING_ON = [
    "предлагаю перейти", "перейдём", "перейдем", "переходим", "перейти к", "давайте посмотрим", "следующий пункт", "следующая тема", "идём дальше",
    "поехали дальше", "двигаемся дальше", "поговорим о", "поговорим про", "и последнее", "теперь давайте", "let us look", "let's look", "let's move on", "next point", "moving on",
]
#: Fixed value: the end of a sentence with the white space before the next one.
BETWEEN = r"([.!?…]+[\"»)\]]*\s+)(?=[\"«(\[–—A-ZА-ЯЁ])"


def timed_sentences(segments: Column) -> Column:
    """The sentences of segments (start, end, text) as structs (start, text).

    A sentence torn between segments is one and keeps the time of its first
    word; a time inside a segment comes from its characters. Blank segments
    hold none.
    """

    def pieces(x: Column) -> Column:
        cut = F.split(F.regexp_replace(p.stripped(x["text"]), BETWEEN, "$1\u0001"), "\u0001")
        share = lambda n: F.least(F.lit(1.0), n / F.greatest(F.lit(1), F.length(x["text"])))
        at = lambda ps, i: F.length(F.array_join(F.slice(ps, F.lit(1), i), ""))
        timed = lambda ps: F.transform(ps, lambda t, i: F.struct((x["start"] + (x["end"] - x["start"]) * share(at(ps, i))).alias("start"), p.stripped(t).alias("text")))
        return p.once(cut, timed)

    every = F.filter(F.flatten(F.transform(segments, pieces)), lambda s: s["text"] != "")

    def glued(v: Column) -> Column:
        begins = F.filter(F.transform(v, lambda s, i: F.when((i == 0) | p.ends_sentence(F.get(v, i - 1)["text"]), i)), lambda i: i.isNotNull())
        whole = lambda s: F.struct(F.get(s, F.lit(0))["start"].alias("start"), F.array_join(F.transform(s, lambda x: x["text"]), " ").alias("text"))
        return F.transform(p.parted(v, begins), whole)

    return p.once(every, glued)


def own_words(headings: Column) -> Column:
    """For each heading its words of four Latin letters or more, without common ones, that at most a third of all headings use."""
    words = F.transform(headings, lambda h: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(h, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))), F.array(*map(F.lit, COMMON))))
    most = lambda v: F.greatest(F.lit(1), F.floor(F.size(v) / 3)).cast("int")
    # In order, a word of too many headings is met again that many places further on.
    common = lambda v: p.once(F.struct(F.array_sort(F.flatten(v)).alias("all"), most(v).alias("most")), lambda k: F.filter(k["all"], lambda w, i: w == F.get(k["all"], i + k["most"])))
    rare = lambda v: p.once(common(v), lambda often: F.transform(v, lambda ws: F.array_except(ws, often)))
    return p.once(words, rare)


def pause_at(silences: Column, moment: Column) -> Column:
    """Seconds of the longest silence (start, end) around a moment, give or take TOLERANCE; 0 for none."""
    around = F.filter(silences, lambda s: moment.between(s["start"] - TOLERANCE, s["end"] + TOLERANCE))
    return F.coalesce(F.array_max(F.transform(around, lambda s: s["end"] - s["start"])), F.lit(0.0))


def speaks_of(sentence: Column, english: Column, wanted: Column) -> Column:
    """Whether a sentence mentions a slide, moves on, or holds (in English) the beginning of a word that only the next section has."""
    lower = F.lower(sentence)
    moves = F.exists(F.array(*map(F.lit, MOVING_ON)), lambda m: F.contains(lower, m))
    heard = F.regexp_extract_all(F.lower(english), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return sentence.rlike(MENTION) | moves | p.once(heard, lambda ws: F.exists(wanted, lambda w: F.exists(ws, lambda x: F.startswith(x, w))))


def announced(sentences: Column, english: Column, silences: Column, low: Column, boundary: Column, wanted: Column) -> Column:
    """Where the last sentence that begins in [low, boundary - EDGE) begins, if it is short, follows a pause and speaks of what comes; else null.

    The three arrays come in runs (``passes.chunked``).
    """
    last = F.try_element_at(F.filter(p.around(sentences, low, boundary), lambda s: (s["start"] >= low) & (s["start"] < boundary - EDGE)), F.lit(-1))

    def judged(s: Column) -> Column:
        inside = F.array_join(F.transform(F.filter(p.around(english, s["start"], boundary), lambda e: (e["start"] >= s["start"]) & (e["start"] < boundary)), lambda e: e["text"]), " ")
        quiet = pause_at(p.around(silences, s["start"] - 2 * TOLERANCE, s["start"] + 2 * TOLERANCE), s["start"])
        fits = (p.n_words(s["text"]) <= MOST_WORDS) & (quiet >= PAUSE)
        return F.when(s.isNotNull() & fits & speaks_of(s["text"], inside, wanted), s["start"])

    return p.once(last, judged)


def refined(sections: Column, segments: Column, english: Column, silences: Column, said: Column | None = None) -> Column:
    """Starts (start, moved) of sections (start, end, heading) by ``passes.refined``, then moved to their announcements.

    ``english`` are the segments of the English track (the same column where the
    recording is English), ``said`` the sentences of the segments if they are
    known. Without silences nothing counts as announced.
    """
    wanted = own_words(F.transform(sections, lambda x: x["heading"]))
    marked = F.arrays_zip(F.transform(sections, lambda x: x["start"]).alias("start"), F.transform(sections, lambda x: x["end"]).alias("end"), wanted.alias("wanted"))
    runs = lambda sentences: p.chunked(sentences, lambda s: s["start"])
    own = runs(timed_sentences(segments) if said is None else said)
    other = [] if english is segments else [runs(timed_sentences(english)).alias("e")]
    known = F.struct(marked.alias("c"), segments.alias("g"), own.alias("s"), p.chunked(silences, lambda q: q["start"], lambda q: q["end"]).alias("q"), *other)
    return p.once(known, lambda v: p.refined(v["c"], v["g"], lambda x, low, boundary: announced(v["s"], v["e" if other else "s"], v["q"], low, boundary, x["wanted"])))
