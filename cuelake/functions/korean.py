"""Rules for Korean correction pairs and annotations as Column expressions, and their small dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.text import let, words_only

#: Pronouns and demonstratives, whose meaning hangs on the context, and the particles that may follow them, in the order they are tried.
REFERENCE_STEMS = (
    "그", "이", "저", "그것", "이것", "저것", "그거", "이거", "저거", "그녀", "그분", "이분", "저분", "그사람", "이사람", "저사람",
    "그여자", "이여자", "저여자", "그여인", "이여인", "저여인", "그남자", "이남자", "저남자", "그아이", "이아이", "저아이", "그애", "이애", "저애", "나",
    "너", "우리", "당신", "자기",
)
PARTICLES = (
    "에게서는", "한테서는", "께서는", "이라는", "라는", "이라고", "라고", "처럼", "보다", "에게", "한테", "께서", "께", "에서", "으로", "부터",
    "까지", "밖에", "마저", "조차", "마다", "만큼", "은", "는", "이", "가", "을", "를", "의", "도", "만", "에",
    "와", "과", "로", "나", "야",
)
#: Ends of words in dialect.
DIALECT_TAIL = "(해가|아가|어가|가꼬|아이가|니더|임더|데이|맞나)$"


def clean_pair_text(c: Column) -> Column:
    """Without punctuation and blanks at the ends."""
    return F.regexp_replace(c, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def is_reference(c: Column) -> Column:
    """Whether a phrase is a pronoun or demonstrative with up to four particles: the first particle in the list's order that leaves two characters or more goes each time."""
    stems = F.array(*map(F.lit, REFERENCE_STEMS))
    particles = F.array(*map(F.lit, PARTICLES))

    def shorter(word: Column) -> Column:
        fitting = F.filter(particles, lambda p: F.endswith(word, p) & (F.length(word) > F.length(p) + 1))
        return F.when(F.array_contains(stems, word) | (F.size(fitting) == 0), word).otherwise(F.left(word, F.length(word) - F.length(F.get(fitting, F.lit(0)))))

    return F.array_contains(stems, F.aggregate(F.sequence(F.lit(1), F.lit(4)), words_only(clean_pair_text(c)), lambda word, _: shorter(word)))


def kills_dialect(wrong: Column, right: Column) -> Column:
    """Whether a pair turns a dialect ending, which was spoken, into the standard one."""
    w, r = words_only(wrong), words_only(right)
    return (w != "") & (r != "") & w.rlike(DIALECT_TAIL) & ~r.rlike(DIALECT_TAIL)


def is_safe_pair(wrong: Column, right: Column) -> Column:
    """Whether a correction may be learned and applied elsewhere."""
    w, r = clean_pair_text(wrong), clean_pair_text(right)
    return let(F.struct(w.alias("w"), r.alias("r")), lambda p: (p["w"] != "") & (p["r"] != "") & (p["w"] != p["r"]) & ~is_reference(p["w"]) & ~is_reference(p["r"]) & ~kills_dialect(p["w"], p["r"]))


#: One glyph with its gloss, as in `얼굴 안(顔) 자`, and a word with its spelling, as in `해탈(解脫)`.
GLYPH = r"([가-힣]+) ([가-힣])\(([一-鿿])\) 자"
SPELLED = r"(?<![가-힣])([가-힣]{2,10})\(([一-鿿]{1,10})\)"


def annotations(c: Column) -> Column:
    """Distinct (gloss, reading, hanja) that a text spells out; where a glyph's form stands, the word's form isn't looked for."""
    part = lambda pattern, n: F.regexp_extract_all(c if pattern == GLYPH else F.regexp_replace(c, GLYPH, " "), F.lit(pattern), F.lit(n))
    glyphs = F.transform(F.arrays_zip(part(GLYPH, 1).alias("g"), part(GLYPH, 2).alias("r"), part(GLYPH, 3).alias("h")), lambda x: F.struct(x["g"].alias("gloss"), x["r"].alias("reading"), x["h"].alias("hanja")))
    words = F.transform(F.arrays_zip(part(SPELLED, 1).alias("r"), part(SPELLED, 2).alias("h")), lambda x: F.struct(F.lit("").alias("gloss"), x["r"].alias("reading"), x["h"].alias("hanja")))
    return F.array_distinct(F.concat(glyphs, words))


def replaced_whole(c: Column, wrong: Column, right: Column) -> Column:
    """c with wrong replaced where neither a word character stands before it nor after it."""
    # The literal comes first, so what stands before it is looked at where it was found only.
    quoted = F.concat(F.lit(r"(?U)\Q"), wrong, F.lit(r"\E(?<![\w가-힣]\Q"), wrong, F.lit(r"\E)(?![\w가-힣])"))
    literal = F.replace(F.replace(right, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(F.contains(c, wrong), F.regexp_replace(c, quoted, literal)).otherwise(c)
