"""Column expressions over cue text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markup in cue text, and the code blocks counted as wide.
TAGS = r"<[^>]+>|\{\\[^}]*\}"
WIDE = "ᄀ-ᇿ⺀-⻿　-〿぀-ゟ゠-ヿ㈀-㋿㌀-㏿㐀-䶿一-鿿가-힯︰-﹏"


#: What ``\\s`` fits in Unicode patterns.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def marked(text: Column) -> Column:
    """Whether a text may hold markup."""
    return F.contains(text, F.lit("<")) | F.contains(text, F.lit("{"))


def strip_tags(text: Column) -> Column:
    return F.when(marked(text), F.regexp_replace(text, TAGS, "")).otherwise(text)


def weighted_chars(text: Column, wide: float | Column = 1.0, other: float | Column = 1.0) -> Column:
    """Length without markup and line breaks, wide characters and others by weight.

    Steps are bound in lambdas, so that a text is looked through once for each pattern wherever the result is used;
    a text without an opening mark holds no markup.
    """
    wide, other = (w if isinstance(w, Column) else F.lit(float(w)) for w in (wide, other))
    plain = F.translate(strip_tags(text), "\r\n", "")
    # Wide characters lie above all others that are frequent, so a class that begins with that limit is left early.
    sizes = F.transform(F.array(plain), lambda p: F.struct(F.length(p).alias("all"), F.when(F.octet_length(p) == F.length(p), F.length(p)).otherwise(F.length(F.regexp_replace(p, rf"[\u1100-\uFFFF&&[{WIDE}]]+", ""))).alias("other")))
    mixed = F.transform(sizes, lambda n: (n["all"] - n["other"]) * wide + n["other"] * other)[0]
    narrow = F.length(F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))) * other
    return F.when(~marked(text) & (F.octet_length(text) == F.length(text)), narrow).otherwise(mixed)


def chars_per_second(text: Column, duration_ms: Column, wide: float | Column = 1.0, other: float | Column = 1.0) -> Column:
    """Infinite where there is no time."""
    return F.when(duration_ms <= 0, F.lit(float("inf"))).otherwise(weighted_chars(text, wide, other) / (duration_ms / 1000.0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def short_number(n: Column) -> Column:
    """Like the %g of C for halves and whole numbers."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def excerpt(text: Column, line_no: Column, limit: int = 60) -> Column:
    """The named line, or the whole cue on one line, cut to ``limit``."""
    lines = F.split(text, "\n", -1)
    said = trimmed(F.when(line_no.between(1, F.size(lines)), F.element_at(lines, F.greatest(line_no, F.lit(1)))).otherwise(F.replace(text, F.lit("\n"), F.lit(" / "))))
    return F.when(F.length(said) <= limit, said).otherwise(F.concat(F.substring(said, 1, limit - 1), F.lit("…")))


def final_consonant(word: Column) -> Column:
    """Index of the last syllable's final consonant (0: none); null where the last character is no Hangul syllable."""
    last = F.right(word, F.lit(1))
    return F.when(last.between("가", "힣"), (F.ascii(last) - 44032) % 28)


def topic_particle(word: Column) -> Column:
    jong = final_consonant(word)
    return F.when(jong.isNull(), "은(는)").when(jong > 0, "은").otherwise("는")


def particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    return F.when(F.coalesce(final_consonant(word), F.lit(0)) > 0, after_consonant).otherwise(after_vowel)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([0-9a-z가-힣]+)"), F.lit(1))


#: A stage mark or label is markup, the rest of a line is dialogue.
SPEAKER_HEAD = r"(?U)^\s*-?\s*\[([^\]]+)\]\s*(.*)$"
#: Sentence ends by level of politeness.
FORMAL_ENDS = r"(니다|니까|십시오|십시다)$"
POLITE_ENDS = r"(요|죠)$"


def formality_level(text: Column) -> Column:
    """Level of the last dialogue line's ending, or null where the ending does not settle it."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: trimmed(F.regexp_replace(strip_tags(x), r"[\[(][^)\]]*[\])]|\{[^}]*\}|♪", ""))), lambda x: x != "")
    last = F.regexp_replace(F.get(lines, F.size(lines) - 1), r"""[\s.,!?…~"'”’)\-]+$""", "")
    before = F.substring(last, F.length(last) - 2, F.lit(1))
    bieup = before.between("가", "힣") & ((F.ascii(before) - 44032) % 28 == 17)
    formal = (last.rlike("(니다|니까)$") & bieup) | last.rlike("(십시오|십시다)$")
    return F.when(formal, "합니다체").when(last.rlike(POLITE_ENDS), "해요체")


def one_decimal(x: Column) -> Column:
    """One decimal of a number that is not negative, by its binary value (10.35 lies below the half and gives 10.3); halves to even.

    Tenfold the number is the sum of two exact products, so its distance from the half has the right sign.
    """
    head = F.floor(x * 1048576.0) / 1048576.0
    n = F.floor(x * 10)
    off = (head * 10 - n - 0.5) + (x - head) * 10
    n = n + F.when(off > 0, 1).when(off < 0, 0).otherwise(n % 2)
    return F.when(x == float("inf"), "inf").otherwise(F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string")))


def quoted(x: Column) -> Column:
    """In single quotes, or in double ones where the text holds a single one and no double one; backslashes doubled."""
    body = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
