"""Salaries in text, their display, their annual value in US dollars, and posting quality."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.patterns import ascii_borders

# Exchange rates, periods, symbols, patterns, reliability and weights.
FX = {"USD": 1.0, "CAD": 0.74, "AUD": 0.66, "NZD": 0.62, "SGD": 0.74, "EUR": 1.08, "GBP": 1.26, "CHF": 1.1, "SEK": 0.094, "NOK": 0.094, "DKK": 0.145, "PLN": 0.25, "INR": 0.012, "JPY": 0.0066, "CNY": 0.14, "HKD": 0.128, "ILS": 0.27, "AED": 0.272, "ZAR": 0.054, "BRL": 0.20, "MXN": 0.058}
PERIODS = {"annual": 1.0, "year": 1.0, "yearly": 1.0, "monthly": 12.0, "month": 12.0, "weekly": 52.0, "week": 52.0, "biweek": 26.0, "biweekly": 26.0, "daily": 260.0, "day": 260.0, "hourly": 2080.0, "hour": 2080.0}
SYMBOLS = {"USD": "$", "CAD": "$", "AUD": "$", "NZD": "$", "SGD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥", "CHF": "CHF "}
CODES = "USD|EUR|GBP|CAD|AUD|INR|SGD|JPY|CHF|NZD"
AMOUNT = r"(\d[\d,]*)\s*(k)?"
BETWEEN = r"\s*(?:[-–]+|\bto\b)\s*"
#: What every range holds: an amount's end, what stands between, an amount's start. It goes over a text once and never back over blanks.
RANGE_LIKE = r"(?i)[\d,]\s*+k?+\s*+(?:[-–]++|to)\s*+[$£€₹]?+\s*+\d"
PERIOD_WORDS = [("hourly", ["/hour", "per hour", "hourly", "/hr"]), ("monthly", ["/month", "per month", "monthly", "/mo"]), ("weekly", ["/week", "per week", "weekly"]), ("daily", ["/day", "per day", "daily"])]
PERIOD_SUFFIX = {"hourly": "/hr", "monthly": "/mo", "weekly": "/wk", "daily": "/day"}
RELIABILITY = {"greenhouse": 1.0, "lever": 1.0, "ashby": 1.0, "workday": 0.95, "smartrecruiters": 0.85, "recruitee": 0.85, "workable": 0.8, "usajobs": 0.95, "jobbank_canada": 0.95}
#: Weights of salary, freshness, description length and source reliability.
WEIGHTS = {
    "tech": (0.30, 0.30, 0.25, 0.15), "healthcare": (0.20, 0.30, 0.30, 0.20), "retail": (0.05, 0.35, 0.40, 0.20), "food_service": (0.05, 0.35, 0.40, 0.20),
    "trades": (0.10, 0.30, 0.35, 0.25), "government": (0.25, 0.25, 0.25, 0.25), "education": (0.20, 0.30, 0.30, 0.20), "finance": (0.30, 0.30, 0.25, 0.15),
    "manufacturing": (0.15, 0.30, 0.35, 0.20), "logistics": (0.15, 0.35, 0.30, 0.20), "legal": (0.30, 0.30, 0.25, 0.15), "nonprofit": (0.10, 0.30, 0.40, 0.20),
    "media": (0.15, 0.35, 0.30, 0.20), "science": (0.20, 0.30, 0.30, 0.20), "other": (0.15, 0.30, 0.35, 0.20),
}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def salary_period(text: Column) -> Column:
    low, out = F.lower(text), F
    for period, words in PERIOD_WORDS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = out.when(hit, period)
    return out.otherwise("annual")


def _range_in(text: Column, pattern: str, low: int, currency: Callable[[Column], Column]) -> Column:
    """struct(min, max, currency, period) of the first match if it is plausible, else null."""

    def told(match: Column) -> Column:
        """Of the match alone, which is short; it is its own first match, as nothing in a pattern looks beyond it but for borders at its ends."""
        part = lambda g: F.regexp_extract(match, f"(?i){pattern}", g)
        value = lambda g: F.replace(part(g), F.lit(","), F.lit("")).try_cast("bigint") * F.when(F.lower(part(g + 1)) == "k", 1000).otherwise(1)
        a, b = value(low), value(low + 2)
        small = (a < 1000) & (b < 1000)
        valid = (a > 0) & (b > 0) & (a <= b) & F.when(small, (a >= 5) & (b <= 2000)).otherwise(b <= 10_000_000)
        return F.when(valid, F.struct(a.cast("double").alias("min"), b.cast("double").alias("max"), currency(match).alias("currency")))

    found = F.transform(F.array(F.regexp_extract(text, f"(?i){pattern}", 0)), told)[0]
    return F.transform(F.array(found), lambda x: F.when(x.isNotNull(), F.struct(x["min"], x["max"], x["currency"], salary_period(text).alias("period"))))[0]


def parse_salary(*texts: Column) -> Column:
    """The first salary range that any of the texts holds, in order: symbols, then a code before, then a code behind."""
    found = []
    for text in texts:
        here = []
        for code, sign in (("USD", r"\$"), ("GBP", "£"), ("EUR", "€"), ("INR", "₹")):
            here.append(F.when(text.contains(sign[-1]), _range_in(text, rf"{sign}\s*{AMOUNT}{BETWEEN}{sign}?\s*{AMOUNT}", 1, lambda _, code=code: F.lit(code))))
        before = ascii_borders(rf"\b({CODES})\s*{AMOUNT}{BETWEEN}{AMOUNT}")
        coded = lambda pattern, g: lambda match: F.upper(F.regexp_extract(match, f"(?i){pattern}", g))
        codes = [_range_in(text, before, 2, coded(before, 1))]
        behind = ascii_borders(rf"\$?\s*{AMOUNT}{BETWEEN}\$?\s*{AMOUNT}\s*({CODES})\b")
        codes.append(_range_in(text, behind, 1, coded(behind, 5)))
        here.append(F.when(text.rlike(f"(?i){CODES}"), F.coalesce(*codes)))
        found.append(F.when(text.rlike(RANGE_LIKE), F.coalesce(*here)))
    return F.coalesce(*found)


def _short(n: Column) -> Column:
    whole = n.cast("bigint")
    return F.when((whole >= 10_000) & (whole % 1000 == 0), F.concat(F.format_number(F.floor(whole / 1000), 0), F.lit("k"))).otherwise(F.format_number(whole, 0))


def format_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    sign = F.coalesce(lookup(SYMBOLS, F.upper(currency)), F.lit(""))
    end = F.concat(F.lit(" "), currency, F.coalesce(lookup(PERIOD_SUFFIX, period), F.lit("")))
    return F.when((high > 0) & (currency != ""), F.concat(sign, _short(low), F.lit(" – "), sign, _short(high), end))


#: Of thousandths that end in 50, those whose nearest double lies above them; 750 is a tie and goes to the even tenth.
_ROUND_UP = [r for r in range(50, 1000, 100) if Fraction(r / 1000) > Fraction(r, 1000)] + [750]


def _thousands(n: Column) -> Column:
    """``$110k``, ``$110.5k`` or ``$900``; tenths are those of the double nearest to n / 1000, ties go to the even one."""
    whole = n.cast("bigint")
    part, double = whole % 1000, whole / F.lit(1000.0)
    above = double - F.floor(double) - part / F.lit(1000.0)
    up = F.when(whole % 100 != 50, whole % 100 > 50).when(above != 0, above > 0).otherwise(part.isin(_ROUND_UP))
    tenths = F.floor(whole / 100) + up.cast("bigint")
    short = F.concat(F.lit("$"), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))
    return F.when(whole == 0, "0").when(whole < 1000, F.concat(F.lit("$"), whole.cast("string"))).when(part == 0, F.concat(F.lit("$"), F.floor(whole / 1000).cast("string"), F.lit("k"))).otherwise(short)


def format_salary_range(low: Column, high: Column, currency: Column) -> Column:
    """The style of feeds that state pay as numbers: ``$110k – $140.5k USD``, ``from …`` or ``up to …`` where one end is missing or 0, null without both."""
    low, high = F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))
    told = lambda *parts: F.concat(*parts, F.lit(" "), currency)
    return (
        F.when((low == 0) & (high == 0), None).when(low == 0, told(F.lit("up to "), _thousands(high))).when(high == 0, told(F.lit("from "), _thousands(low)))
        .otherwise(told(_thousands(low), F.lit(" – "), _thousands(high)))
    )


def to_usd_annual(amount: Column, currency: Column, period: Column) -> Column:
    rate = F.coalesce(lookup(FX, F.upper(F.coalesce(currency, F.lit("USD")))), F.lit(1.0))
    times = F.coalesce(lookup(PERIODS, F.coalesce(period, F.lit("annual"))), F.lit(1.0))
    return F.floor(amount * times * rate + 0.5).cast("bigint")


def salary_overlaps(low: Column, high: Column, currency: Column, period: Column, least: float | None, most: float | None) -> Column:
    """Whether the range in annual US dollars meets [least, most]; without a salary it does not, unless no bound is given."""
    if least is None and most is None:
        return F.lit(True)
    ok = F.coalesce(high != 0, F.lit(False))
    if least is not None:
        ok = ok & (to_usd_annual(high, currency, period) >= least)
    if most is not None:
        ok = ok & (to_usd_annual(F.coalesce(low, high), currency, period) <= most)
    return F.coalesce(ok, F.lit(False))


def _two(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def with_quality(df: DataFrame, as_of: str) -> DataFrame:
    """``df`` with quality and quality_breakdown at the time ``as_of``."""
    salary = F.when(F.col("salary_max") > 0, 1.0).otherwise(0.0)
    stamp = F.coalesce("scraped_at", "posted_at")
    days = F.coalesce((F.lit(as_of).cast("timestamp").cast("double") - stamp.cast("timestamp").cast("double")) / 86400.0, F.lit(999.0))
    fresh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / 60))
    length = 1 / (1 + F.exp(-(F.coalesce(F.length("description"), F.lit(0)) - 400) / 400.0))
    reliable = F.coalesce(lookup(RELIABILITY, F.col("source")), F.lit(0.7))
    weights = [F.coalesce(lookup({k: w[i] for k, w in WEIGHTS.items()}, F.col("industry")), F.lit(WEIGHTS["tech"][i])) for i in range(4)]
    parts = [salary, fresh, length, reliable]
    total = weights[0] * parts[0] + weights[1] * parts[1] + weights[2] * parts[2] + weights[3] * parts[3]
    names = ["salary_disclosed", "freshness", "description_length", "source_reliability"]
    return df.withColumn("quality", _two(total)).withColumn("quality_breakdown", F.struct(*[_two(p).alias(n) for n, p in zip(names, parts)]))


def freshness_pill(stamp: Column, as_of: str) -> Column:
    days = (F.lit(as_of).cast("timestamp").cast("double") - stamp.cast("timestamp").cast("double")) / 86400.0
    return F.when(days < 7, "fresh").when(days > 45, "stale")


def quality_tier(q: Column) -> Column:
    return F.when(q >= 0.65, "high").when(q >= 0.40, "med").otherwise("low")


def match_strength(score: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.struct(F.floor(s * 100 + 0.5).cast("int").alias("percent"), (s >= 0.6).alias("strong"))
