"""Scalar functions as Column expressions: heat texts, normalisers, near-equality, scores, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YI, WAN = "亿", "万"  # fixed values: hundred million, ten thousand


def parse_heat(text: Column) -> Column:
    """The leading number times its unit, as a whole number; 0 where there is none."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double")
    rest = F.regexp_replace(t, r"^[0-9.]+", "")
    unit = F.when(F.contains(rest, F.lit(YI)), 1e8).when(F.contains(rest, F.lit(WAN)), 1e4).otherwise(1.0)
    return F.coalesce((number * unit).cast("bigint"), F.lit(0).cast("bigint"))


def format_heat(value: Column, unit: str = "", wan_rounds: bool = False, gap: bool = True) -> Column:
    """Heat for display, ties rounded to even. ``wan_rounds``: ten thousands are rounded, else cut off; ``gap``: a space before the unit."""
    s = " " if gap else ""
    yi = F.when(value >= 1_000_000_000, F.format_string(f"%.0f{s}{YI}{unit}", F.bround(value / 1e8, 0))).otherwise(F.format_string(f"%.1f{s}{YI}{unit}", F.bround(value / 1e8, 1)))
    wan = F.format_string(f"%.0f{s}{WAN}{unit}", F.bround(value / 1e4, 0)) if wan_rounds else F.format_string(f"%d{s}{WAN}{unit}", F.floor(value / 10000))
    return F.when(value >= 100_000_000, yi).when(value >= 10_000, wan).otherwise(F.concat(value.cast("string"), F.lit(f"{s}{unit}" if unit else "")))


def squeeze(text: Column) -> Column:
    """Without any white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def squeeze_ascii(text: Column) -> Column:
    """Without ASCII white space; only A-Z in lower case."""
    return F.translate(F.regexp_replace(text, r"[ \t\r\n]+", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def nearly_equal(a: Column, b: Column) -> Column:
    """Equal, one within the other, or one edit apart (code points)."""
    filled = (F.length(a) > 0) & (F.length(b) > 0)
    return filled & ((a == b) | F.contains(a, b) | F.contains(b, a) | (F.levenshtein(a, b, 1) >= 0))


def fingerprint(title: Column) -> Column:
    """Sixteen hexadecimal digits of the letters and digits of a title, regardless of case."""
    return F.substring(F.sha1(F.lower(F.regexp_replace(title, r"[^\p{L}\p{Nd}]", ""))), 1, 16)


def excerpt(text: Column, width: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(mark))).otherwise(text)


def cut_at_word(title: Column, width: int = 25, mark: str = "…") -> Column:
    """At most ``width`` characters, ending with a whole word where there is one."""
    head = F.substring(title, 1, width)
    words = F.regexp_replace(head, r"(?U)\s+\S*$", "")
    whole = F.when(F.substring(title, width + 1, 1).rlike(r"(?U)^\s?$"), head).when(words != "", words).otherwise(head)
    return F.when(F.length(title) > width, F.concat(F.rtrim(whole), F.lit(mark))).otherwise(title)


def article_score(heat: Column, prev: Column, default: int = 10_000) -> Column:
    """Heat plus its rise; a default without heat."""
    return F.when(heat > 0, heat + F.greatest(heat - prev, F.lit(0))).otherwise(F.lit(default)).cast("bigint")


def diversity_boost(base: Column, sources: Column) -> Column:
    """Twice the score with two sources, four times with more."""
    return F.when((base <= 0) | (sources <= 1), base).when(sources == 2, base * 2).otherwise(base * 4)


def momentum(delta: Column, new: Column) -> Column:
    return F.when((delta > 0) & (new > 0), "up").when(delta < 0, "down").otherwise("flat")


def momentum_order(m: Column) -> Column:
    return F.when(m == "up", 0).when(m == "flat", 1).otherwise(2)


def time_proximity(a: Column, b: Column) -> Column:
    """Falling in steps with the hours between two times; one half where one is unknown."""
    hours = F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9
    out = F.when(hours.isNull(), 0.5)
    for most, score in ((1, 1.0), (3, 0.8), (6, 0.6), (12, 0.4), (24, 0.2)):
        out = out.when(hours <= most, score)
    return out.otherwise(0.05)


def overlap_ratio(shared: Column, saturate: int) -> Column:
    return F.least(F.size(shared) / F.lit(float(saturate)), F.lit(1.0))


def weighted_overlap(shared: Column, saturate: float = 2.0) -> Column:
    """Shared terms weigh by length: 1, 1.5, 2, 2.5 for up to 2, 3, 4 and more characters."""
    weight = F.aggregate(shared, F.lit(0.0), lambda s, x: s + F.when(F.length(x) <= 2, 1.0).when(F.length(x) == 3, 1.5).when(F.length(x) == 4, 2.0).otherwise(2.5))
    return F.least(weight / saturate, F.lit(1.0))


def near_duplicate_title(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """Equal but for spaces and punctuation, or sharing at least two and three quarters of the fewer words."""
    bare = [F.lower(F.regexp_replace(x, r"[\p{Z}\s\p{P}\p{S}]", "")) for x in (a, b)]
    both = F.size(F.array_intersect(words_a, words_b))
    fewer = F.least(F.size(F.array_distinct(words_a)), F.size(F.array_distinct(words_b)))
    return (bare[0] == bare[1]) | ((both >= 2) & (both * 4 >= fewer * 3))


def han_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{IsHan}]", ""))


def is_pure_han(x: Column) -> Column:
    return x.rlike(r"^\p{IsHan}+$")


def other_between_han(x: Column) -> Column:
    return x.rlike(r"\p{IsHan}[^\p{IsHan}]+\p{IsHan}")


def is_digits(x: Column) -> Column:
    return x.rlike(r"^\p{Nd}+$")


def has_upper(x: Column) -> Column:
    return x.rlike("[A-Z]")


def is_all_upper(x: Column) -> Column:
    return x.rlike("^[A-Z]+$")


def has_letter(x: Column) -> Column:
    return x.rlike("[A-Za-z]")


def has_han_or_letter(x: Column) -> Column:
    return x.rlike(r"[\p{IsHan}\p{L}]")


# fixed values: units of measure after numbers, and large-number characters
MEASURE_UNITS = "元块万亿千百年月日号天时分秒岁人名次个条件家例米吨度倍%％"


def is_numeric_measure(x: Column) -> Column:
    """Half digits or more with a unit, or a large-number character before a unit."""
    digits = F.length(F.regexp_replace(x, r"[^\p{Nd}]", ""))
    return ((digits * 2 >= F.length(x)) & (digits > 0) & x.rlike(f"[{MEASURE_UNITS}]")) | x.rlike(f"^[0-9.]*[万亿千百兆]+[{MEASURE_UNITS}]$")


def contains_word(text: Column, word: Column) -> Column:
    """ASCII word-boundary containment of a lower-case word in lower-case text."""
    padded = F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" "))
    quoted = F.concat(F.lit(" "), F.trim(F.regexp_replace(word, "[^a-z0-9]+", " ")), F.lit(" "))
    return F.contains(padded, quoted) & F.contains(text, word)


def needs_boundary(alias: Column, most: int = 3) -> Column:
    """Short ASCII aliases only count as whole words."""
    return alias.rlike(f"^[a-z0-9]{{1,{most}}}$")


def term_weight(title: Column, content: Column, term: Column) -> Column:
    """Three for the title and one for the text."""
    t, c, w = F.lower(title), F.lower(content), F.lower(term)

    def found(x: Column) -> Column:
        return F.when(needs_boundary(w), contains_word(x, w)).otherwise(F.contains(x, w))

    return F.when(found(t), 3).otherwise(0) + F.when(found(c), 1).otherwise(0)


def search_url(base: str, word: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(word))


def mask_email(x: Column) -> Column:
    """The first letter of the name and the domain."""
    return F.when(F.instr(x, "@") > 1, F.regexp_replace(x, r"^(.)[^@]*@", "$1***@")).otherwise(F.lit("***"))


def relative_time(ts: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 6e7)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d ago")))
