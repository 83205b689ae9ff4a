"""Text functions of cue tracks as Column expressions: all run inside code generation or as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whatever is no letter, digit or underscore, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"
NON_ALNUM = r"[^\p{L}\p{N}]+"
#: Replies of an audience that make no subtitle of their own.
REPLIES = ("네", "네네", "예", "예예", "넵")
SINO_DIGITS = "영일이삼사오육칠팔구"
#: Limits of reading: characters a second, characters of a cue, milliseconds of a cue.
TOO_FAST, TOO_LONG, SHORTEST_MS, LONGEST_MS = 17, 36, 350, 7050


def let(value: Column, f) -> Column:
    """f(value), with value worked out once a row, even where f uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_filled(*columns: Column | str) -> Column:
    """The first text that isn't empty; blanks count as text. The last one is taken as it is."""
    *first, last = (F.col(c) if isinstance(c, str) else c for c in columns)
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in first), last)


def work_text() -> Column:
    return stripped(first_filled("text_final", "text_llm", "text_stt"))


def machine_text() -> Column:
    return first_filled("text_llm", "text_stt")


def words_only(c: Column) -> Column:
    return F.regexp_replace(c, NON_WORD, "")


def compact(c: Column) -> Column:
    return F.lower(words_only(c))


def reply_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\W_]+", "")


def alnum_only(c: Column) -> Column:
    return F.regexp_replace(c, NON_ALNUM, "")


def is_reply(c: Column) -> Column:
    return reply_key(c).isin(*REPLIES)


def without_speaker_marks(c: Column) -> Column:
    return collapsed(F.regexp_replace(c, r"(?U)(^|\s)>>?(\s|$)", " "))


def duration_ms() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def solid_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def is_too_fast(text: Column, limit: int = TOO_FAST) -> Column:
    """Whether characters without white space a second exceed limit; at least 100 ms are counted. Whole numbers only."""
    return solid_length(text) * 1000 > F.greatest(duration_ms(), F.lit(100)) * limit


def char_budget(ms: Column) -> Column:
    """Characters that a cue's duration allows, ten at least."""
    return F.greatest(F.lit(10), F.floor(F.greatest(ms, F.lit(500)) * TOO_FAST / 1000).cast("int"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def content_hash(n: int, *parts: Column) -> Column:
    """The first n hex digits of the SHA-256 of the parts, set apart by a unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, n)


def video_id(url: Column) -> Column:
    """The 11 characters that name a video in the known forms of its address, or null."""
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|shorts/|live/|embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def safe_name(c: Column) -> Column:
    """A title as a file name of 80 characters at most."""
    clean = F.regexp_replace(stripped(F.regexp_replace(c, r'[\\/:*?"<>|]', "")), r"\.+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, 80), F.lit("")), F.lit("untitled"))


def srt_time(ms: Column) -> Column:
    part = lambda unit, size: F.lpad((F.floor(ms / unit) % size).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def clock(ms: Column) -> Column:
    """m:ss.s"""
    tenths = F.floor(ms / 100)
    return F.concat((F.floor(tenths / 600)).cast("string"), F.lit(":"), F.lpad((F.floor(tenths / 10) % 60).cast("string"), 2, "0"), F.lit("."), (tenths % 10).cast("string"))


def clock_ms(c: Column) -> Column:
    """Milliseconds of `m:ss.s`, `ss.s` or `h:mm:ss`, or null."""
    valid = c.rlike(r"^\s*(\d+:)?(\d+:)?\d+(\.\d+)?\s*$")
    parts = F.split(F.trim(c), ":")
    seconds = F.aggregate(F.transform(parts, lambda p: F.try_to_number(p, F.lit("9999999.999")).cast("decimal(18,3)")), F.lit(0).cast("decimal(18,3)"), lambda acc, p: (acc * 60 + p).cast("decimal(18,3)"))
    return F.when(valid, (seconds * 1000).cast("long"))


def age_label(days: Column) -> Column:
    number = lambda unit: F.floor(days / unit).cast("string")
    return F.when(days <= 0, "오늘").when(days == 1, "어제").when(days < 30, F.concat(days.cast("string"), F.lit("일"))).when(days < 365, F.concat(number(30), F.lit("달"))).otherwise(F.concat(number(365), F.lit("년")))


def find_count(c: Column, what: Column) -> Column:
    """Times that what occurs in c, without overlaps; an empty string occurs nowhere."""
    return F.when(F.length(what) > 0, F.floor((F.length(c) - F.length(F.replace(c, what, F.lit("")))) / F.length(what))).otherwise(0).cast("long")


def sino(n: Column) -> Column:
    """A number below 10,000 in Sino-Korean words."""
    digit = lambda unit: F.floor(n / unit) % 10
    word = lambda d: F.substring(F.lit(SINO_DIGITS), 1, 10).substr(d.cast("int") + 1, F.lit(1))
    part = lambda unit, name: F.when(digit(unit) == 0, "").when(digit(unit) == 1, name).otherwise(F.concat(word(digit(unit)), F.lit(name)))
    return F.when(n == 0, "영").otherwise(F.concat(part(1000, "천"), part(100, "백"), part(10, "십"), F.when(digit(1) == 0, "").otherwise(word(digit(1)))))


def numbers_spelled(c: Column) -> Column:
    """Every run of digits in Sino-Korean words, four digits at a time."""
    found = F.regexp_extract_all(c, F.lit(r"\d{1,4}"), F.lit(0))
    between = F.split(c, r"\d{1,4}", -1)
    spelled = F.transform(found, lambda d: sino(d.cast("int")))
    return F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(found)), spelled, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))


def echo_key(c: Column) -> Column:
    return words_only(numbers_spelled(c))


def suspects(work: Column, second: Column, low: Column, most: int = 6) -> Column:
    """Tokens of the work text that the second source lacks, or the low-confidence words where there is no second source."""
    found = let(F.transform(tokens(second), words_only), lambda keys: F.array_distinct(F.filter(tokens(work), lambda t: (F.length(words_only(t)) >= 2) & ~F.array_contains(keys, words_only(t)))))
    return F.when(stripped(work) == "", "").when(stripped(second) != "", F.array_join(F.slice(found, 1, most), ", ")).otherwise(low)


def join_without_overlap(a: Column, b: Column) -> Column:
    """a and b joined once: the longest run of tokens, else 2 to 30 characters, that ends a and begins b stands once; else a blank between."""
    def joined(t: Column) -> Column:
        left, right, at, bt = t["l"], t["r"], t["lt"], t["rt"]
        least = F.least(F.size(at), F.size(bt))
        # A run that ends a begins with the first token of b.
        same = lambda k: (k == 0) | ((F.get(at, F.size(at) - k) == F.get(bt, F.lit(0))) & (F.slice(at, F.size(at) - k + 1, k) == F.slice(bt, F.lit(1), k)))
        shared = F.array_max(F.filter(F.sequence(F.lit(0), least), same))
        chars = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(left), F.length(right), F.lit(30))), lambda k: (k != 1) & ((k == 0) | (F.right(left, k) == F.left(right, k)))))
        by_token = lambda n: F.array_join(F.concat(at, F.slice(bt, n + 1, F.size(bt))), " ")
        by_char = F.concat(left, right.substr(chars + 1, F.length(right)))
        return F.when(left == "", right).when(right == "", left).otherwise(let(shared, lambda n: F.when(n > 0, by_token(n)).when(chars > 0, by_char).otherwise(F.concat_ws(" ", left, right))))

    ends = F.struct(stripped(a).alias("l"), stripped(b).alias("r"))
    return let(ends, lambda e: let(F.struct(e["l"].alias("l"), e["r"].alias("r"), tokens(e["l"]).alias("lt"), tokens(e["r"]).alias("rt")), joined))


def wrapped(c: Column, width: int, most: int = 2) -> Column:
    """Lines of up to width characters, filled word by word; where there are more than `most`, filled anew to about equal length, one more at most."""

    def fill(words: Column, size: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            longer = F.concat_ws(" ", acc["line"], w)
            fits = acc["line"].isNull() | (F.length(longer) <= size)
            return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, longer).otherwise(w).alias("line"))

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))
        return F.aggregate(words, start, step, lambda acc: F.when(acc["line"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))

    def lay(words: Column) -> Column:
        even = let(F.floor(F.length(F.array_join(words, " ")) / most) + 1, lambda size: F.slice(fill(words, size), 1, most + 1))
        return let(fill(words, F.lit(width)), lambda lines: F.array_join(F.when(F.size(lines) > most, even).otherwise(lines), "\n"))

    return let(tokens(c), lay)
