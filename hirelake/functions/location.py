"""Country and remote status from free text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.patterns import ascii_borders

# Country names, cities, state, province and country codes.
COUNTRY_NAMES = {
    "US": "united states of america|united states|u.s.a.|u.s.|usa|america",
    "GB": "united kingdom|u.k.|great britain|britain|england|scotland|wales|northern ireland",
    "CA": "canada", "DE": "germany|deutschland", "FR": "france", "NL": "netherlands|the netherlands|holland", "IE": "ireland",
    "ES": "spain|españa", "IT": "italy|italia", "PT": "portugal", "PL": "poland", "SE": "sweden", "FI": "finland", "DK": "denmark",
    "NO": "norway", "CH": "switzerland", "AT": "austria", "BE": "belgium", "CZ": "czech republic|czechia", "RO": "romania",
    "GR": "greece", "TR": "turkey", "IN": "india", "SG": "singapore", "JP": "japan", "KR": "south korea|korea", "TW": "taiwan",
    "HK": "hong kong", "CN": "china", "ID": "indonesia", "MY": "malaysia", "PH": "philippines", "TH": "thailand", "VN": "vietnam",
    "AU": "australia", "NZ": "new zealand", "BR": "brazil|brasil", "MX": "mexico", "AR": "argentina", "CL": "chile", "CO": "colombia",
    "PE": "peru", "IL": "israel", "AE": "united arab emirates|uae", "SA": "saudi arabia", "ZA": "south africa", "NG": "nigeria",
    "EG": "egypt", "KE": "kenya", "UA": "ukraine", "BY": "belarus", "RU": "russia|russian federation", "HU": "hungary",
    "BG": "bulgaria", "SK": "slovakia", "SI": "slovenia", "HR": "croatia", "RS": "serbia", "IS": "iceland", "EE": "estonia",
    "LV": "latvia", "LT": "lithuania", "LU": "luxembourg", "MT": "malta", "CY": "cyprus",
}
CITIES = {
    "US": "san francisco|new york|seattle|austin|los angeles|boston|chicago|denver|atlanta|washington|san diego|san jose|palo alto|"
    "mountain view|menlo park|cupertino|sunnyvale|redwood city|oakland|portland|miami|dallas|houston|philadelphia|minneapolis|"
    "salt lake city|sf bay area|bay area|nyc|brooklyn|manhattan",
    "CA": "toronto|vancouver|montreal|ottawa|calgary|waterloo",
    "GB": "london|manchester|edinburgh|glasgow|cambridge|oxford|bristol",
    "IE": "dublin", "DE": "berlin|munich|münchen|hamburg|frankfurt|köln|cologne", "FR": "paris|lyon", "NL": "amsterdam|rotterdam|utrecht",
    "ES": "madrid|barcelona", "IT": "milan|rome", "SE": "stockholm|gothenburg", "DK": "copenhagen", "NO": "oslo", "FI": "helsinki",
    "CH": "zurich|zürich|geneva", "AT": "vienna", "PL": "warsaw|krakow", "CZ": "prague", "BE": "brussels",
    "IN": "bangalore|bengaluru|mumbai|delhi|hyderabad|pune|chennai|noida|gurgaon", "JP": "tokyo|osaka", "AU": "sydney|melbourne",
    "KR": "seoul", "TW": "taipei", "CN": "shanghai|beijing", "HK": "hong kong", "BR": "são paulo|sao paulo|rio de janeiro",
    "MX": "mexico city|ciudad de méxico", "AR": "buenos aires", "CL": "santiago", "IL": "tel aviv", "AE": "dubai",
    "ZA": "cape town|johannesburg", "UA": "kyiv|kiev|lviv|kharkiv", "BY": "minsk", "HU": "budapest", "RU": "moscow|saint petersburg",
    "IS": "reykjavik", "EE": "tallinn", "LV": "riga", "LT": "vilnius",
}
US_STATES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc"
CA_PROVINCES = "on qc bc ab mb sk ns nb nl pe yt nt nu"
COUNTRY_CODES = (
    "us uk gb ca de fr nl ie es it pt pl se fi dk no ch at be in sg jp kr tw hk cn id my ph th vn au nz br mx ar cl co il ae za ng "
    "ua by ru hu bg sk si hr rs is ee lv lt lu mt cy"
)
#: Codes of a US state that are country codes as well.
AMBIGUOUS = "ca co de in"
REMOTE_FALSE = r"(?i)remote\s+(office|location|site|monitoring|sensing|control|access|server|host|team\s+management)"
REMOTE_LOCATION = r"(?i)\bremote\b"
REMOTE_DESCRIPTION = r"(?i)(fully\s+remote|100%\s+remote|work\s+from\s+home|\bwfh\b|work\s+from\s+anywhere|remote[\s-]+first|remote[\s-]+only)"
HYBRID = r"(?i)\bhybrid\b"


def _names(table: dict[str, str]) -> dict[str, str]:
    return {name: code for code, names in table.items() for name in names.split("|")}


def _longest_first(names) -> str:
    """An alternation that matches any of the names as a whole word; the lookup below takes the longest."""
    return "(?<![a-z0-9])(" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + ")(?![a-z0-9])"


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _longest_hit(text: Column, table: dict[str, str]) -> Column:
    """Code of the longest name found anywhere in lowered ``text``; null if none."""
    found = F.regexp_extract_all(text, F.lit(_longest_first(table)), F.lit(1))
    best = F.reduce(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.try_element_at(_literal_map(table), best)


def classify_country(location: Column) -> Column:
    """ISO country code of a location text: a country's name, else its last telling token, else a known city."""
    low = F.lower(location)
    cities = _names(CITIES)
    parts = F.filter(F.transform(F.split(low, r"[,·|/]|\s-\s"), lambda p: F.trim(p)), lambda p: p != "")
    plain = {c: c.upper() for c in COUNTRY_CODES.split()} | {"uk": "GB"} | {p: "CA" for p in CA_PROVINCES.split()} | {s: "US" for s in US_STATES.split()}
    known = F.array(*[F.lit(x) for x in plain])
    # Position of the last token that is a code.
    told = F.reduce(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), F.lit(0), lambda a, i: F.when(F.array_contains(known, F.try_element_at(parts, i)), i).otherwise(a))
    token = F.try_element_at(parts, F.when(told > 0, told))
    leading = F.array_join(F.slice(parts, 1, F.greatest(told - 1, F.lit(0))), " ")
    city = _longest_hit(leading, cities)
    ambiguous = token.isin(*AMBIGUOUS.split())
    return F.coalesce(
        _longest_hit(low, _names(COUNTRY_NAMES)),
        F.when(ambiguous & (city != "US"), city).when(ambiguous, F.lit("US")).when(told > 0, F.try_element_at(_literal_map(plain), token)),
        _longest_hit(low, cities),
    )


def classify_remote(location: Column, description: Column) -> Column:
    loc, desc = F.coalesce(location, F.lit("")), F.coalesce(description, F.lit(""))
    return (
        F.when(F.regexp_replace(loc, REMOTE_FALSE, "").rlike(ascii_borders(REMOTE_LOCATION)) | desc.rlike(ascii_borders(REMOTE_DESCRIPTION)), "remote")
        .when(loc.rlike(ascii_borders(HYBRID)) | desc.rlike(ascii_borders(HYBRID)), "hybrid")
        .when(loc != "", "onsite")
        .otherwise("unknown")
    )


#: Structured remote keywords.
REMOTE_KEYWORDS = {"remote": "remote", "hybrid": "hybrid", "on-site": "onsite", "onsite": "onsite", "office": "onsite"}
TEAMTAILOR_REMOTE = {"fully": "remote", "hybrid": "hybrid", "temporary": "hybrid", "none": "onsite"}


def remote_from_keyword(keyword: Column, vocabulary: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(vocabulary or REMOTE_KEYWORDS), F.lower(F.trim(keyword))), F.lit("unknown"))
