"""A small labelled table of URLs (``url``, ``blocked``) for :mod:`tablemend.llm.url_filter`.

Every stem comes in every form, and the domains, subdomains and paths go round over both
lists, so that neither of them, nor a form, tells the verdict: the stem does.  No name is
that of a host of the test data, although the kinds of unwanted hosts (betting, pills,
adverts, link farms, adult sites) are the usual ones and occur there too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Stems of hosts by verdict, written by hand.
BLOCKED = (
    "casino", "poker", "jackpot", "roulette", "slots", "betting", "bets", "lottery", "gamble", "wager",
    "pills", "viagra", "cialis", "steroids", "xanax", "weightloss", "miracle-cure", "dietpills",
    "ads", "adserver", "banner-ads", "popads", "clickbait", "clicktrack", "adtracker", "tracking", "telemetry", "pixeltrack",
    "spam", "linkfarm", "seo-links", "mailspam", "fakenews", "phishing", "scam", "getrich", "quickcash", "payday-loans",
    "crypto-pump", "winprize", "win-big", "prizes", "replica-watches", "porn", "xxx", "adult", "sexcam", "hotgirls", "escorts",
    "nude", "warez", "torrents", "cracked-keys", "malware", "freemoney",
)
ALLOWED = (
    "library", "museum", "university", "school", "college", "academy", "institute", "archive", "journal", "gazette",
    "herald", "tribune", "courier", "newsroom", "weather", "science", "physics", "biology", "history", "geology",
    "medicine", "hospital", "clinic", "nursing", "theatre", "orchestra", "music", "painting", "poetry", "novels",
    "garden", "farming", "forestry", "fishing", "sailing", "hiking", "cycling", "railway", "harbour", "airport",
    "bakery", "recipes", "kitchen", "vineyard", "carpentry", "pottery", "weaving", "knitting", "architecture", "engineering",
    "software", "compiler", "database", "hardware", "robotics", "astronomy", "telescope", "chemistry", "mathematics", "statistics",
    "parliament", "council", "ministry", "embassy", "court", "justice", "charity", "volunteers", "community", "parish",
    "holidays", "travel", "mountains", "islands", "rivers", "wildlife", "birds", "insects", "oceans", "climate",
    "chess", "football", "athletics", "tennis", "marathon", "theory", "thesis", "southern", "northern", "weekly",
    "mother", "brother", "nation", "station", "fashion", "furniture", "together", "whether", "thousand", "hundreds",
    "translation", "dictionary", "grammar", "teachers", "students", "wedding", "children", "family", "nursery", "playground",
)
FORMS = ("{}", "my-{}", "{}-online", "top{}", "{}hub", "{}-now", "the{}")
DOMAINS = ("com", "example.org", "net", "example.net", "org", "example.com", "info", "co.uk", "de", "fr", "es")
BEFORE = ("", "www.", "m.", "", "blog.")
PATHS = ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/about", "/news/{}", "/index.html")


def rows() -> list[tuple[str, bool]]:
    found = []
    for stems, blocked in ((BLOCKED, True), (ALLOWED, False)):
        names = [form.format(stem) for stem in stems for form in FORMS]
        for k, name in enumerate(names):
            path = PATHS[k % len(PATHS)].format(k * 37 % 9973)
            found.append((f"https://{BEFORE[k % len(BEFORE)]}{name}.{DOMAINS[k % len(DOMAINS)]}{path}", blocked))
    return found


def labelled(spark: SparkSession) -> DataFrame:
    url, blocked = zip(*rows(), strict=True)
    return spark.createDataFrame(pa.table({"url": pa.array(url), "blocked": pa.array(blocked)}))
