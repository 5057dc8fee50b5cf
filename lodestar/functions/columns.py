"""Column functions: cleaning, parsing, labels, vectors. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Unicode white space, spelled out so that every regular-expression engine agrees.
SPACE = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def flatten_list(c: Column) -> Column:
    """Members joined by '. ' after trimming, null and empty ones left out; null list gives ''."""
    kept = F.filter(F.transform(c, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(F.array_join(kept, ". "), F.lit(""))


def key(c: Column) -> Column:
    """Trimmed key, blank as null."""
    t = F.trim(c)
    return F.when(t != "", t)


def to_number(c: Column) -> Column:
    """Coercing cast: anything unparsable, and NaN, becomes null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def parse_price(c: Column) -> Column:
    """First decimal number of the text after commas are dropped, else null."""
    return to_number(F.regexp_extract(F.regexp_replace(c.cast("string"), ",", ""), r"[0-9]+(\.[0-9]+)?", 0))


def feature_price(c: Column) -> Column:
    """Number after '$' and ',' are dropped; negative, NaN and unparsable become null."""
    v = to_number(F.regexp_replace(c.cast("string"), "[$,]", ""))
    return F.when(v >= 0, v)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def parts(c: Column) -> Column:
    """Non-empty trimmed pieces of a '.'-joined string (null: none)."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\."), lambda v: F.trim(v)), lambda v: v != "")


def leaf_category(c: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(c), F.lit(-1)), F.lit("Unknown"))


def category_path(c: Column) -> Column:
    return F.array_join(parts(c), " > ")


def tokens(c: Column) -> Column:
    """White-space tokens; '' and null give an empty array."""
    return F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda v: v != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def richness(c: Column) -> Column:
    """Different lower-cased tokens over tokens; 0 without tokens."""
    return let(tokens(F.lower(c)), lambda t: F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(F.lit(0.0)))


def keyword_frequency(c: Column, keywords: list[str]) -> Column:
    """Sum over keywords of non-overlapping occurrences as plain substrings of the lower-cased text."""
    hits = lambda t, k: ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)).cast("int")
    return let(F.lower(F.coalesce(c, F.lit(""))), lambda t: F.aggregate(F.lit(keywords), F.lit(0), lambda total, k: total + hits(t, k)))


def helpful_weight(c: Column) -> Column:
    return F.greatest(F.coalesce(to_number(c), F.lit(0.0)), F.lit(1.0))


def log_count(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(to_number(c), F.lit(0.0)), F.lit(0.0)))


def sentiment_label(c: Column) -> Column:
    return F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").when(c.isNotNull(), "neutral")


def graded_label(rating: Column, binary: bool = False) -> Column:
    """Rating rounded half to even, 1 when missing; or 1 for every positive."""
    return F.lit(1) if binary else F.coalesce(F.rint(rating).cast("int"), F.lit(1))


def period(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM")


def trajectory_code(c: Column) -> Column:
    return F.when(c == "rising", 1.0).when(c == "controversial", 0.25).when(c == "declining", 0.0).otherwise(0.5)


def critic_style(mean_rating: Column) -> Column:
    return F.when(mean_rating <= 2.5, "harsh").when(mean_rating >= 4, "generous").when(mean_rating.isNotNull(), "balanced")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; null if either vector is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector in double; norms up to 1e-9 leave the vector as it is."""
    scaled = lambda v, n: F.when(n > 1e-9, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return let(a, lambda v: let(norm(v), lambda n: scaled(v, n)))


def scaled_sum(*terms: tuple[Column, Column]) -> Column:
    """Sum of weight * vector over (weight, vector) pairs, in double."""
    first, *rest = terms
    total = F.transform(first[1], lambda x: x.cast("double") * first[0])
    def plus(left: Column, w: Column, v: Column) -> Column:
        return F.zip_with(left, v, lambda x, y: x + y.cast("double") * w)

    for w, v in rest:
        total = plus(total, w, v)
    return total


def usable_vector(v: Column, dimension: int) -> Column:
    """The vector if it has ``dimension`` values without null or NaN, else null."""
    return F.when((F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), v)


def percent_rank_average(value: Column, *keys: str) -> Column:
    """Rank with average ties inside ``keys`` over the non-null values, divided by their number; null for null."""
    group = Window.partitionBy(*keys)
    rank = F.rank().over(group.orderBy(value.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), (rank + (ties - 1) / 2) / F.count(value).over(group))
