"""Scalar column functions: Column in, Column out, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WAR_START, WAR_DAYS = "2022-02-24", 5000
ANNOTATION_LANGUAGES = ("en", "ru")
CYRILLIC_ONE = ("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")
CYRILLIC_MANY = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ё": "yo", "ъ": "", "ь": ""}


def duration_seconds(text: Column, bare: bool = False) -> Column:
    """``h:mm:ss`` or ``m:ss`` as seconds, else null; with ``bare`` also a number of seconds."""
    t = F.trim(text)
    part = lambda i: F.element_at(F.split(t, ":"), i).try_cast("long")
    got = F.when(t.rlike(r"^\d+:\d{1,2}:\d{1,2}$"), part(1) * 3600 + part(2) * 60 + part(3)).when(t.rlike(r"^\d+:\d{1,2}$"), part(1) * 60 + part(2))
    return got.when(t.rlike(r"^\d+(\.\d+)?$"), F.floor(t.try_cast("double"))) if bare else got


def duration_text(seconds: Column, zero: str | None = "0:00") -> Column:
    """Seconds as ``h:mm:ss`` or ``m:ss``; null for null; ``zero`` for 0."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.expr("1L") * F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))
    return F.when(s == 0, F.lit(zero)).otherwise(text) if zero != "0:00" else F.when(s.isNotNull(), text)


def srt_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``, milliseconds rounded half to even."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def relative_date(text: Column, today: Column) -> Column:
    """"3 weeks ago" as a date, months and years as ``YYYY-MM``, anything else ``????-??-??``."""
    n = F.regexp_extract(text, r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(text, r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago", 2))
    day = lambda d: F.date_format(F.date_sub(today, d), "yyyy-MM-dd")
    month = lambda m: F.date_format(F.add_months(F.trunc(today, "month"), -m), "yyyy-MM")
    return (
        F.when(unit.isin("second", "minute", "hour"), day(F.lit(0))).when(unit == "day", day(n)).when(unit == "week", day(n * 7))
        .when(unit == "month", month(n)).when(unit == "year", month(n * 12)).otherwise("????-??-??")
    )


def numbered_day(title: Column) -> Column:
    """The date of a numbered day in a title ("День 5", "day 5"), counted from the fixed first day."""
    n = F.regexp_extract(title, r"(?iu)(?:день|day)\s*(\d+)", 1).try_cast("int")
    return F.when(n.between(1, WAR_DAYS), F.date_add(F.lit(WAR_START).cast("date"), n - 1))


def partial_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM`` (its first day) as a date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date")).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")).try_cast("date"))


def video_id(ref: Column) -> Column:
    """The eleven-character id in a watch or short URL, a ``[id]`` marker, or by itself."""
    forms = [r"[?&]v=([\w-]{11})", r"youtu\.be/([\w-]{11})", r"/(?:shorts|live|embed)/([\w-]{11})", r"\[([\w-]{11})\](?:\.\w+)?$", r"^([\w-]{11})$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(ref, f, 1), F.lit("")) for f in forms])


def normalize_handle(value: Column) -> Column:
    """A handle with one leading @, from a URL or a bare name."""
    name = F.coalesce(F.nullif(F.regexp_extract(value, r"@([^/@?#\s]+)", 1), F.lit("")), F.regexp_extract(F.trim(value), r"(?:.*/)?([^/@?#]+)", 1))
    return F.when(name != "", F.concat(F.lit("@"), name))


#: Patterns that tell what a sharp sign means, names that are spelled out, and the fallback name.
MUSIC = r"(?iuU)\bmusic|guitar|piano|\bchord|melody|\bsong|violin|\bvocal|singing|songwrit|\bkeys\b|музык|гитар|фортепиан|пианин|аккорд|мелоди|скрипк|вокал|тональност|\bдиез|бемол|сольфедж"
CODE = (
    r"(?iuU)\.net|dotnet|program|coding|\bcode\b|developer|development|software|\bapi\b|\basp\b|\bsql\b|database|linux|docker|kubernetes|python|java|script|unity|framework|backend|frontend|"
    r"microservice|algorithm|\bweb\b|\bcloud\b|\baws\b|\bazure\b|machine learning|разработ|программ|фреймворк|бэкенд|фронтенд|тестирован|отладк|\bкод\b|компилят|нейросет"
)
ALONE = r"(?i)(?<![0-9A-Za-z#+.]){}(?![0-9A-Za-z#+])"
UNNAMED = "unnamed_playlist"


def spelled_out(title: Column, context: Column | None = None) -> Column:
    """C#, F#, J# and C++ standing alone are written out, unless title and context speak more of music than of code."""
    about = title if context is None else F.concat_ws(" ", title, context)
    music, code = F.regexp_count(about, F.lit(MUSIC)), F.regexp_count(about, F.lit(CODE))
    named = F.regexp_replace(F.regexp_replace(title, ALONE.format("([cfj])#"), "$1_sharp"), ALONE.format(r"(c)\+\+"), "$1pp")
    return F.when((music > 0) & (code < music), title).otherwise(named)


def slug(title: Column, longest: int = 60, context: Column | None = None) -> Column:
    """Lower case, Cyrillic in Latin letters, letters of other scripts kept, other runs as ``_``, at most ``longest`` characters."""
    t = F.lower(spelled_out(title, context))
    for a, b in CYRILLIC_MANY.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, *CYRILLIC_ONE)
    t = F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    t = F.regexp_replace(F.substring(t, 1, longest), "_+$", "")
    return F.when(t == "", UNNAMED).otherwise(t)


def safe_name(name: Column, longest: int = 120) -> Column:
    """A name without characters that paths forbid, spaces squeezed, cut to ``longest``."""
    t = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " ")
    return F.rtrim(F.substring(F.trim(t), 1, longest))


def stem(index: Column, title: Column, ident: Column, longest: int = 120) -> Column:
    """``NN_title [id]`` within ``longest`` characters."""
    return F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("_"), safe_name(title, longest - 17), F.lit(" ["), ident, F.lit("]"))


def display_title(title: Column, channel: Column) -> Column:
    return F.when(F.coalesce(channel, F.lit("")) == "", title).otherwise(F.concat_ws(" | ", title, channel))


def zero_padded(name: Column, index: Column) -> Column:
    """Pad a leading order marker to two digits, or put ``NN_`` before the name."""
    marked = r"^(#?)(\d)([.\s)_-].*)$"
    one, many = name.rlike(marked), name.rlike(r"^#?\d{2,}[.\s)_-]")
    return F.when(one, F.regexp_replace(name, marked, "$10$2$3")).when(many, name).otherwise(F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("_"), name))


def clean_paragraph(text: Column) -> Column:
    """Without soft hyphens, spaces squeezed, ``x- y`` joined."""
    t = F.regexp_replace(F.regexp_replace(text, "­", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(t, r"(\p{L})- (\p{Ll})", "$1$2"))


def preview(text: Column, longest: int = 60) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.rtrim(F.substring(text, 1, longest)), F.lit("…"))).otherwise(text)


def sentences(text: Column) -> Column:
    """Split after . ! ? … and white space; empty pieces are left out."""
    marked = F.regexp_replace(text, r"([.!?…])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: x != "")


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def script(word: Column) -> Column:
    """``ascii``, ``other`` or ``mixed`` by the letters of a word."""
    a, o = word.rlike("[A-Za-z]"), word.rlike("[^\\x00-\\x7F]")
    return F.when(a & o, "mixed").when(o, "other").otherwise("ascii")


def estimated_tokens(text: Column, per_token: Column) -> Column:
    return F.ceil(F.length(text) / per_token).cast("long")


def script_tokens(text: Column) -> Column:
    """Cyrillic at 2.5 characters a token, others at 4, plus one."""
    cyrillic = F.regexp_count(text, F.lit(r"[Ѐ-ӿ]"))
    return (F.floor(cyrillic / 2.5 + (F.length(text) - cyrillic) / 4.0) + 1).cast("long")


def vision_tokens(width: Column, height: Column) -> Column:
    """85 plus 170 for each 512-pixel tile, after fitting into 2048 and scaling the short side to 768."""
    fit = F.least(F.lit(1.0), 2048 / F.greatest(width, height))
    scale = fit * F.least(F.lit(1.0), 768 / (F.least(width, height) * fit))
    return (85 + 170 * F.ceil(width * scale / 512) * F.ceil(height * scale / 512)).cast("int")


def cost_usd(seconds: Column, per_minute: Column, passes: Column) -> Column:
    return seconds / 60.0 * per_minute * passes


def cost_text(usd: Column) -> Column:
    return F.when(usd.isNull(), "$?").otherwise(F.format_string("$%.2f", usd))


POLISH = ("ąćęłńóśźż", "acelnoszz")


def anchor(title: Column, any_script: bool = False) -> Column:
    """A Markdown anchor: marks and spaces become hyphens, Polish letters lose their marks; with ``any_script`` letters beyond ASCII stay."""
    t = F.translate(F.lower(title), *POLISH)
    return F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_]+" if any_script else "[^a-z0-9]+", "-"), "^-+|-+$", "")


def same_title(a: Column, b: Column, least: int = 20) -> Column:
    """Titles alike but for marks, or one beginning with the first ``least`` characters of the other."""
    x, y = (F.regexp_replace(F.translate(F.lower(c), "łó", "lo"), "[^a-z0-9]+", "") for c in (a, b))
    return (x != "") & (y != "") & ((x == y) | x.startswith(F.left(y, F.lit(least))) | y.startswith(F.left(x, F.lit(least))))


#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = "np itd itp tzw tj ok r w ul dr prof mgr godz str nr cd m in por gen płk św ww jw".split()


def sentences_by_capital(text: Column) -> Column:
    """Sentences that end before a capital, quote or bracket."""
    marked = F.regexp_replace(text, r"([.!?…]+[\"»)\]]*)\s+(?=[\"«(\[–—A-ZА-ЯЁ])", "$1\u0001")
    pieces = F.transform(F.split(marked, "\u0001"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


def any_case(word: str) -> str:
    """A pattern of a lower-case word in either case of each letter; the Kelvin sign is a capital k too."""
    return "".join(f"[{x}{x.upper()}{'\u212a' if x == 'k' else ''}]" for x in word)


def sentences_by_abbreviation(text: Column, abbreviations: list[str] = ABBREVIATIONS) -> Column:
    """Sentences that end at . ! ? … and white space, whatever follows, but not after an abbreviation or a lone letter.

    Quotes and brackets that close a sentence are left out with the white space after it. Whether
    one ends is seen from the word before the gap alone, so gaps after abbreviations are marked
    first, then the others are cut: each text is read a fixed number of times.
    """
    gap = r"[\"»”')\]]*\s"
    short = "|".join(any_case(x) for x in abbreviations)
    ahead = rf"(?=\S{{0,{max(map(len, abbreviations))}}}?[.!?…])"  # few words begin so; the others are passed by at once
    kept = rf"(?<![^\s(«„\"]){ahead}((?:{short}|[^\s(«„\"İ]|)\.*+)(?<=[.!?…])(?={gap})"
    marked = F.regexp_replace(F.regexp_replace(text, kept, "$1\u0002"), rf"(?<=[.!?…]){gap}+", "\u0001")
    pieces = F.transform(F.split(F.translate(marked, "\u0002", ""), "\u0001"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    full = F.transform(F.array(F.filter(pieces, lambda x: x != "")), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(""))))  # the pieces are worked out once
    return F.when(text.isNotNull(), F.get(full, F.lit(0)))


def respelled(text: Column, spelling: dict[str, str]) -> Column:
    """Words of a dictionary respelled, capitals kept."""
    known = F.create_map(*[F.lit(x) for kv in spelling.items() for x in kv])

    def one(w: Column) -> Column:
        new = F.try_element_at(known, F.lower(w))
        first = F.left(w, F.lit(1))
        return F.when(new.isNull(), w).when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).when(first == F.upper(first), F.concat(F.upper(F.left(new, F.lit(1))), F.substring(new, 2, 1 << 20))).otherwise(new)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0)), one), "")


def count_text(text: Column) -> Column:
    """The first number of "1,234 videos"; null without digits."""
    return F.regexp_replace(F.regexp_extract(text, r"\d[\d,.\s]*", 0), r"\D", "").try_cast("long")


def human_size(size: Column) -> Column:
    """Bytes with their unit; a tenth between two goes to the even one, where Java's own format would go up."""
    tenths = lambda power: F.bround(size / F.lit(1024.0**power), 1)
    out = F.format_string("%.1f GB", tenths(3))
    for unit, power in (("MB", 2), ("KB", 1)):
        out = F.when(size < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", tenths(power))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).otherwise(out)


def language_code(text: Column) -> Column:
    """A two- or three-letter code in lower case; anything else is an error."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^[a-z]{2,3}$"), t).otherwise(F.raise_error(F.concat(F.lit("not a language code: "), F.coalesce(text, F.lit("null")))))


def same_path(a: Column, b: Column) -> Column:
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+$", ""))
    return plain(a) == plain(b)


def frame_rate(frames: Column, seconds: Column) -> Column:
    return F.try_divide(frames, F.nullif(seconds, F.lit(0)))


def option_name(*parts: Column) -> Column:
    """The parts that are set, joined by ``_``."""
    return F.concat_ws("_", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def excel_alias(position: Column) -> Column:
    """``#A`` … ``#Z``, ``#AA`` … for positions from 0, as many letters as a 64-bit number takes."""

    def step(s, _):
        more = s["n"] >= 0
        return F.struct(F.when(more, F.floor(s["n"] / 26) - 1).otherwise(s["n"]).cast("long").alias("n"), F.when(more, F.concat(F.char(65 + F.pmod(s["n"], F.lit(26))), s["out"])).otherwise(s["out"]).alias("out"))

    start = F.struct(position.cast("long").alias("n"), F.lit("").alias("out"))
    return F.concat(F.lit("#"), F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"]))


def links(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))


def is_stream(title: Column, seconds: Column | None = None) -> Column:
    """By its title; or by a length of an hour with one of the fixed names, or of two with a numbered day."""
    hinted = title.rlike(r"(?iu)\b(stream|live)\b|стрим|эфир")
    if seconds is None:
        return hinted
    guest = title.rlike("(?iu)в гостях|Плющев и Наки|Плющева и Наки|Плющева с Наки")
    return hinted | F.coalesce((seconds >= 3600) & guest, F.lit(False)) | F.coalesce((seconds >= 7200) & numbered_day(title).isNotNull(), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def refresh_action(cached: Column, token: Column, same_head: Column, fresh: Column, same_list: Column, new: Column, most_new: int) -> Column:
    """What a refresh does: full (nothing cached), extend (a scan was cut off), reuse (same head, fresh), touch (same head and list),
    emergency (the list shrank, differs behind the head, or its new head is too long to match), unchanged (too few live rows) or prepend."""
    stale = F.when(same_list, "touch").otherwise("emergency")
    head = F.when(new < 0, "unchanged").when(new > most_new, "emergency").otherwise("prepend")
    return F.when(cached == 0, "full").when(token, "extend").when(same_head & fresh, "reuse").when(same_head, stale).otherwise(head)
