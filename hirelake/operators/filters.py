"""Search filters over postings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import location, pay, rules
from hirelake.operators.tables import kept

#: Fixed value: postings older than this many days are hidden by default.
STALE_DAYS = 45
ACTIVE_EVENTS = ["login", "register", "profile_save", "profile_blob_save"]


def per_distinct(df: DataFrame, keys: list[str], columns: dict[str, Column], of: DataFrame | None = None, store: bool = True) -> DataFrame:
    """``df`` with ``columns``, which depend on ``keys`` alone, computed once for each distinct combination and joined back.

    Locations, titles and texts of postings repeat across feeds and places, and rules cost more than a join. A hot value is combined before it is
    shuffled; the join reads both sides from exchanges, so adaptive execution can broadcast a small side or split a hot key. ``of``: a stored table that
    holds all combinations. What is told of it is stored at once, so its size is known to the join: few combinations are broadcast and ``df`` stays
    where it is, many are shuffled. Without ``store`` it is told when the result is read, and the join goes by the size of ``of``.
    """
    told = (df if of is None else of).select(*keys).distinct()
    told = told.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[v.alias(n) for n, v in columns.items()])
    told = kept(told, "told") if of is not None and store else told
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(told[f"_key{i}"])
    own = [df[x] for x in df.columns if x not in columns]
    return df.join(told, same).select(*own, *[told[n] for n in columns])


def live_country() -> Column:
    """The country that the location tells, else the stored one."""
    return F.coalesce(location.classify_country(F.col("location")), F.nullif(F.col("country"), F.lit("")))


def enriched(df: DataFrame) -> DataFrame:
    """``df`` with country, industry, job_family, experience_level and remote_status. Country and level are classified anew, the stored value
    stays where that tells nothing; the others are filled in where they are absent."""
    c = F.col
    if "country" not in df.columns:
        df = df.withColumn("country", F.lit(None).cast("string"))
    df = df.withColumn("country", live_country())
    fresh = {
        "remote_status": location.classify_remote(c("location"), c("description")),
        "industry": rules.classify_industry(c("title"), c("description")), "job_family": rules.classify_job_family(c("title"), c("description")),
    }
    for name, column in fresh.items():
        df = df.withColumn(name, F.coalesce(F.nullif(c(name), F.lit("")), column) if name in df.columns else column)
    level = rules.classify_title_or_body(c("title"), c("description"), c("industry"))
    return df.withColumn("experience_level", F.coalesce(level, F.nullif(c("experience_level"), F.lit(""))) if "experience_level" in df.columns else level)


@dataclass
class SearchFilter:
    """Empty lists and None do not filter. Stored columns are compared first, so they reach the scan.

    A country is compared twice: the stored one, where there is one, then the one that the location tells. ``country_is_live`` says that the
    column holds the latter already, as after :func:`enriched`, so that it is not told again."""

    remote_status: list[str] = field(default_factory=list)
    experience_level: list[str] = field(default_factory=list)
    industry: list[str] = field(default_factory=list)
    job_family: list[str] = field(default_factory=list)
    source: list[str] = field(default_factory=list)
    country: list[str] = field(default_factory=list)
    location: str = ""
    company: str = ""
    salary_min_usd: float | None = None
    salary_max_usd: float | None = None
    require_salary: bool = False
    max_age_days: int | None = None
    country_is_live: bool = False

    def apply(self, df: DataFrame, as_of: str) -> DataFrame:
        c = F.col
        df = df.filter(F.coalesce(c("is_active"), F.lit(True)))
        if self.country:
            df = df.filter(c("country").isin(*self.country) if self.country_is_live else F.coalesce(c("country"), F.lit("")).isin("", *self.country))
        for name in ("source", "remote_status", "industry", "job_family", "experience_level"):
            wanted = getattr(self, name)
            if wanted:
                df = df.filter(c(name).isin(*wanted))
        if self.location.strip():
            df = df.filter(F.lower("location").contains(self.location.strip().lower()))
        if self.company.strip():
            df = df.filter(F.lower("company").contains(self.company.strip().lower()))
        if self.max_age_days is not None:
            df = df.filter(F.coalesce("scraped_at", "posted_at") >= F.expr(f"timestamp_ntz '{as_of}' - interval {self.max_age_days} days"))
        if self.require_salary:
            df = df.filter(c("salary_max") != 0)
        if self.salary_min_usd is not None or self.salary_max_usd is not None:
            df = df.filter(pay.salary_overlaps(c("salary_min"), c("salary_max"), c("salary_currency"), c("salary_period"), self.salary_min_usd, self.salary_max_usd))
        if self.country and not self.country_is_live:
            df = df.filter(live_country().isin(*self.country))  # last, as it costs most
        return df


PRESETS = {
    "remote": SearchFilter(remote_status=["remote"]), "new-grad": SearchFilter(experience_level=["intern", "junior"]),
    "senior+": SearchFilter(experience_level=["senior", "staff", "principal"]), "tech": SearchFilter(industry=["tech"]),
    "canada": SearchFilter(country=["CA"]), "us": SearchFilter(country=["US"]), "100k": SearchFilter(salary_min_usd=100_000),
    "fresh": SearchFilter(max_age_days=STALE_DAYS),
}


def active_user_events(events: DataFrame, event: str = "event", uid: str = "uid") -> DataFrame:
    return events.filter(F.col(event).isin(*ACTIVE_EVENTS) & F.col(uid).isNotNull())
