"""Pay in texts against the rule in plain Python: the first match of each pattern in whole texts."""

import random
import re

from pyspark.sql import functions as F

from hirelake.functions import pay


def plain(text):
    def told(m, low, currency):
        value = lambda g: int(m[g].replace(",", "") or 0) * (1000 if (m[g + 1] or "").lower() == "k" else 1)
        a, b = value(low), value(low + 2)
        if a > 0 and b > 0 and a <= b and (5 <= a and b <= 2000 if a < 1000 and b < 1000 else b <= 10_000_000):
            return a, b, currency

    flags = re.IGNORECASE | re.ASCII
    for code, sign in (("USD", r"\$"), ("GBP", "£"), ("EUR", "€"), ("INR", "₹")):
        m = re.search(rf"{sign}\s*{pay.AMOUNT}{pay.BETWEEN}{sign}?\s*{pay.AMOUNT}", text, flags)
        if m and told(m, 1, code):
            return told(m, 1, code)
    m = re.search(rf"\b({pay.CODES})\s*{pay.AMOUNT}{pay.BETWEEN}{pay.AMOUNT}", text, flags)
    if m and told(m, 2, m[1].upper()):
        return told(m, 2, m[1].upper())
    m = re.search(rf"\$?\s*{pay.AMOUNT}{pay.BETWEEN}\$?\s*{pay.AMOUNT}\s*({pay.CODES})\b", text, flags)
    return told(m, 1, m[5].upper()) if m else None


def test_pay_equals_the_plain_rule(spark):
    rng = random.Random(8)
    words = ["$", "£", "€", "USD", "eur", "Gbp", "5", "45", "120", "60,000", "90", "7,", "k", "K", "-", "–", "--", " to ", "to", "TO", " ", " ", "  ", "\n", "x", "_", ".", "é"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(4, 14))) for _ in range(6_000)] + ["$5 - $3, $120k - $150k", "USD 50k - 40k, 30k-40k eur", "1 to 2 USDx", "xUSD 50k-60k", "$ 7,-,8"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pay.parse_salary(F.col("t")).alias("s")).collect()
    want = [plain(t) for t in texts]
    assert sum(w is not None for w in want) > 40
    assert [(texts[r.i], w) for r, w in zip(sorted(got, key=lambda r: r.i), want) if (tuple(r.s)[:3] if r.s else None) != w] == []


def test_texts_without_ranges_are_looked_at_once(spark):
    """Long runs of blanks and numbers are gone over once, not once for each place and field."""
    import time

    df = spark.range(4).select(F.concat(F.repeat(F.lit(" "), 60_000), F.col("id").cast("string"), F.lit(" USD"), F.repeat(F.lit(" "), 60_000)).alias("t"))
    start = time.time()
    assert df.select(pay.parse_salary(F.col("t")).alias("s")).filter("s is not null").count() == 0
    assert time.time() - start < 15
