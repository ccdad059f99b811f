"""Column expressions: times, buckets, identities and hashes. All are built-in functions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Buckets of the hour and their order.
DAY_PARTS = {"morning": (5, 11), "afternoon": (12, 16), "evening": (17, 21)}
TIME_BUCKETS = [f"{day}:{part}" for day in ("weekday", "weekend") for part in ("morning", "afternoon", "evening", "night")]

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}:?\d{2})$"
_TEXT = r"^[A-Za-z]{3} [A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$"


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def parse_timestamp(column: Column) -> Column:
    """ISO-8601 with an offset or Z, or "Tue Apr 03 18:00:09 +0000 2012"; without an offset, or of another form: null."""
    text = F.trim(column)
    iso = F.when(text.rlike(_ISO), text).try_cast("timestamp")
    plain = F.when(text.rlike(_TEXT), F.substring(text, 5, 100))
    return F.coalesce(iso, F.try_to_timestamp(plain, F.lit("MMM dd HH:mm:ss Z yyyy")))


def day_type(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def time_bucket(ts: Column) -> Column:
    part = F.lit("night")
    for name, (first, last) in DAY_PARTS.items():
        part = F.when(F.hour(ts).between(first, last), name).otherwise(part)
    return F.concat(day_type(ts), F.lit(":"), part)


def canonical_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def sample_id(dataset: Column, protocol: Column, user: Column, session: Column, ts: Column, poi: Column) -> Column:
    """SHA-256 of the six fields; null if one is missing or blank."""
    fields = [dataset, protocol, user, session, canonical_timestamp(ts), poi]
    whole = F.lit(True)
    for field in fields:
        whole = whole & F.coalesce(F.trim(field) != "", F.lit(False))
    return F.when(whole, F.sha2(F.concat_ws("|", *fields), 256))


def event_identity() -> Column:
    return F.sha2(F.concat_ws("|", "dataset", "raw_user_id", canonical_timestamp(F.col("timestamp_utc")), "raw_poi_id"), 256)


def session_identity() -> Column:
    return F.sha2(F.concat_ws("|", "dataset", "raw_user_id", "session_id"), 256)


def bucketed(value: Column, edges: list[tuple[int, str]], rest: str) -> Column:
    """The label of the first edge that value doesn't exceed."""
    out = F.lit(rest)
    for most, label in reversed(edges):
        out = F.when(value <= most, label).otherwise(out)
    return out


# The buckets of evaluation slices and of monitoring differ.
def evaluation_history_bucket(n: Column) -> Column:
    return bucketed(n, [(1, "1"), (4, "2-4"), (9, "5-9")], "10+")


def monitoring_history_bucket(n: Column) -> Column:
    return bucketed(n, [(0, "0"), (1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100")], "101+")


HISTORY_BUCKETS = ["0", "1", "2-5", "6-10", "11-20", "21-50", "51-100", "101+"]


def small_count_bucket(n: Column) -> Column:
    return bucketed(n, [(0, "0"), (1, "1"), (5, "2-5")], "6+")


def candidate_count_bucket(n: Column) -> Column:
    return bucketed(n, [(0, "0"), (10, "1-10"), (25, "11-25"), (50, "26-50"), (100, "51-100")], "101+")


def rarity(train_count: Column, rare_most: int = 1) -> Column:
    n = F.coalesce(train_count, F.lit(0))
    return F.when(n == 0, "unseen").when(n <= rare_most, "rare").otherwise("frequent")


def category_key(category: Column) -> Column:
    """An opaque key of a category."""
    return F.concat(F.lit("category_"), F.substring(F.sha2(category, 256), 1, 16))


def request_id(*parts: Column) -> Column:
    return F.concat(F.lit("smoke-"), F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 24))


def rounded(value: Column, digits: int) -> Column:
    """round() of doubles of 0 to 1,000, and no more than 12 digits: the same doubles, but without decimals, unless value is so close to
    the middle of two that only its decimals tell."""
    scaled = value * F.lit(10.0**digits)
    middle = F.abs(scaled - F.floor(scaled) - F.lit(0.5)) < F.lit(0.2)
    return F.when(middle, F.round(value, digits)).otherwise(F.floor(scaled + F.lit(0.5)) / F.lit(10.0**digits))


def softmax_entropy(scores: Column) -> Column:
    """Entropy (natural logarithm) of the softmax of an array of scores; 0 for fewer than two."""
    weights = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    terms = F.transform(weights, lambda w: F.when(w > 0, -(w / total) * F.ln(w / total)).otherwise(0.0))
    return F.when(F.size(scores) < 2, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))


def parse_history_lines(text: Column) -> Column:
    """Lines "POI | category | time" as an array of (poi_id, category_name, timestamp, valid); blank lines are skipped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def row(line: Column) -> Column:
        parts = F.transform(F.split(line, r"\|", -1), lambda x: F.trim(x))
        whole = F.size(parts) == 3
        at = lambda k: F.when(whole, F.get(parts, k))
        ts = parse_timestamp(at(2))
        valid = whole & (at(0) != "") & (at(1) != "") & ts.isNotNull()
        return F.struct(at(0).alias("poi_id"), at(1).alias("category_name"), ts.alias("timestamp"), F.coalesce(valid, F.lit(False)).alias("valid"))

    return F.transform(lines, row)
