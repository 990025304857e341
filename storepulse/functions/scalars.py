"""Column-level functions (§2.3 projections/parsing, §2.10 scalars).

Every function returns a ``Column`` built from Spark SQL built-ins, so it stays inside
whole-stage codegen; none is a Python UDF. ANSI mode is on, so every text→number conversion
goes through ``try_cast`` and a failed parse becomes null instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
DOMESTIC_COUNTRIES = ["US", "CA", "GB", "AU"]
LOW_STOCK_THRESHOLD = 5
FRAUD_BLOCK_CUT = 55
REVIEW_CUT = 31
ORDER_ID_PREFIX = "WOO-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text -------------------------------------------------------------------------------

def short(c, n: int) -> Column:
    """First ``n`` characters (Python ``s[:n]``)."""
    return F.substring(_c(c), 1, n)


def concat_text(*parts) -> Column:
    return F.concat(*[_c(p) if not isinstance(p, str) or p.startswith("`") else F.lit(p) for p in parts])


def replace_all(c, mapping: list[tuple[str, str]]) -> Column:
    """Apply literal replacements in order (``str.replace`` chain)."""
    out = _c(c)
    for old, new in mapping:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_review_text(c) -> Column:
    """Cut to 200, drop quotes/backslash, newline→space, CR dropped, drop backtick/$/;, & → and."""
    out = short(c, 200)
    return replace_all(out, [("'", ""), ('"', ""), ("\\", ""), ("\n", " "), ("\r", ""),
                             ("`", ""), ("$", ""), (";", ""), ("&", "and")])


def clean_search_prefix(c) -> Column:
    """Cut to 35, drop quotes/backslash, & → and, drop ;."""
    return replace_all(short(c, 35), [("'", ""), ('"', ""), ("\\", ""), ("&", "and"), (";", "")])


def contains_ci(c, q) -> Column:
    """F8: literal substring test ignoring case."""
    return F.contains(F.lower(_c(c)), F.lower(_c(q)))


def is_int_text(c) -> Column:
    """Python ``s.lstrip('-').isdigit()`` on the trimmed text (leading minus signs allowed)."""
    return F.coalesce(_c(c).rlike("^-*[0-9]+$"), F.lit(False))


def numeric_order_id(c) -> Column:
    """strip the ``WOO-`` prefix and surrounding blanks."""
    return F.trim(F.replace(_c(c).cast("string"), F.lit(ORDER_ID_PREFIX), F.lit("")))


def py_float_text(c) -> Column:
    """Render a double the way Python's ``str(float)`` does for everyday magnitudes."""
    c = _c(c)
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return F.when(whole, F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def currency(c) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(_c(c), 2))


# ---- numbers ----------------------------------------------------------------------------

def try_num(c, dtype: str = "double") -> Column:
    """text → number, null when the text does not parse (the caller filters nulls)."""
    return F.trim(_c(c).cast("string")).try_cast(dtype)


def clamp(c, lo=None, hi=None) -> Column:
    out = _c(c)
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return out


def parse_price(c) -> Column:
    """P5: strip ``$`` and ``,``, trim; empty (or missing) → 0.0; otherwise-bad → null (row dropped by caller)."""
    x = F.trim(F.translate(_c(c).cast("string"), "$,", ""))
    return F.when(_c(c).isNull() | (x == ""), F.lit(0.0)).otherwise(x.try_cast("double"))


def parse_stock(c, clamp_zero: bool = True) -> Column:
    """Integer text → int (non-integer text → 0); ``--5`` passes the text test but fails the
    conversion, which yields null (the caller drops the row, as the reference's bare except does)."""
    t = F.trim(_c(c).cast("string"))
    v = F.when(is_int_text(t), t.try_cast("int")).otherwise(F.lit(0))
    # greatest() skips nulls, so keep a failed conversion null explicitly
    return F.when(v.isNotNull(), F.greatest(F.lit(0), v)) if clamp_zero else v


def time_of_day_seconds(ts) -> Column:
    """hour of day × 3600."""
    return F.hour(_c(ts)) * F.lit(3600)


def seconds_between(later, earlier) -> Column:
    """elapsed seconds as a double, exact to the microsecond."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(1_000_000.0)


def date_text(ts, fmt: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """ISO (default) or long date text."""
    return F.date_format(_c(ts), fmt)


# ---- labels and decisions ----------------------------------------------------------------

def stock_status(level, threshold: int = LOW_STOCK_THRESHOLD) -> Column:
    """0 → OUT_OF_STOCK, ≤ threshold → LOW_STOCK, else IN_STOCK (negative is LOW, as on the dashboard path)."""
    level = _c(level)
    return (F.when(level == 0, F.lit("OUT_OF_STOCK"))
             .when(level <= threshold, F.lit("LOW_STOCK"))
             .otherwise(F.lit("IN_STOCK")))


def final_score(rule, ml) -> Column:
    """max(rule, trunc(0.8·rule + 0.2·ml))."""
    rule, ml = _c(rule), _c(ml)
    return F.greatest(rule, (rule * F.lit(0.8) + ml * F.lit(0.2)).cast("int"))


def fraud_decision(final, rule) -> Column:
    """Final ≥ 55 or rule ≥ 55 → FRAUD_BLOCKED; final ≥ 31 → REVIEW_NEEDED; else APPROVED."""
    final, rule = _c(final), _c(rule)
    return (F.when((final >= FRAUD_BLOCK_CUT) | (rule >= FRAUD_BLOCK_CUT), F.lit("FRAUD_BLOCKED"))
             .when(final >= REVIEW_CUT, F.lit("REVIEW_NEEDED"))
             .otherwise(F.lit("APPROVED")))


def dashboard_decision(score) -> Column:
    """P10: same cuts on the dashboard score; labels FRAUD / REVIEW / APPROVED."""
    score = _c(score)
    return (F.when(score >= FRAUD_BLOCK_CUT, F.lit("FRAUD"))
             .when(score >= REVIEW_CUT, F.lit("REVIEW"))
             .otherwise(F.lit("APPROVED")))


def first_score_label(c) -> Column:
    """P11 first scorer: > 0.1 POSITIVE, < −0.1 NEGATIVE (strict), else NEUTRAL."""
    c = _c(c)
    return F.when(c > 0.1, F.lit("POSITIVE")).when(c < -0.1, F.lit("NEGATIVE")).otherwise(F.lit("NEUTRAL"))


def second_score_label(c) -> Column:
    """P11 second scorer: ≥ 0.05 POSITIVE, ≤ −0.05 NEGATIVE (inclusive), else NEUTRAL."""
    c = _c(c)
    return F.when(c >= 0.05, F.lit("POSITIVE")).when(c <= -0.05, F.lit("NEGATIVE")).otherwise(F.lit("NEUTRAL"))


def final_sentiment(first_label, second_label) -> Column:
    """Equal → that label, else the second label (so always the second label)."""
    a, b = _c(first_label), _c(second_label)
    return F.when(a == b, a).otherwise(b)


def export_rating(c) -> Column:
    """Falsy (null or 0) → 3, then truncate to int, then clamp to 1..5."""
    c = _c(c).cast("double")
    return clamp(F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(3.0)).cast("int"), 1, 5)


def feed_rating(c) -> Column:
    """Rating missing or empty on the store feed → 5, then ``int(float(x))``."""
    t = F.trim(_c(c).cast("string"))
    t = F.when(t.isNull() | (t == "") | (t == "0"), F.lit("5")).otherwise(t)
    return t.try_cast("double").try_cast("int")


def match_band(c) -> Column:
    """Similarity > 50 high, > 20 medium, else low."""
    c = _c(c)
    return F.when(c > 50, F.lit("high")).when(c > 20, F.lit("medium")).otherwise(F.lit("low"))


def risk_band(c) -> Column:
    """Gauge bands [0,31) low, [31,55) review, [55, ∞) fraud."""
    c = _c(c)
    return F.when(c >= 55, F.lit("fraud")).when(c >= 31, F.lit("review")).otherwise(F.lit("low"))


def is_international(c) -> Column:
    """Country not in {US, CA, GB, AU}; an explicit null counts as foreign."""
    return ~F.coalesce(_c(c).isin(DOMESTIC_COUNTRIES), F.lit(False))
