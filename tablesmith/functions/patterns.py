"""Recognition patterns, keyword lists and lookup tables (all fixed values)."""

from __future__ import annotations

# Patterns that recognise a kind of value.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"(?i)^https?://[^\s]+$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
BOOLEAN = r"(?i)^(true|false|yes|no|1|0|y|n)$"
PERCENTAGE = r"^[-+]?\s*\d+(?:\.\d+)?\s*%$"
CURRENCY = (
    r"^[-+]?\s*(?:[€£$¥]\s*\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?)\s*[€£$¥]?$"
)
PHONE = r"^(\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}$"
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
GENDER = r"(?i)^(male|female|m|f|other|prefer not to say)$"

# Substrings of lower-cased column names that select columns for a rule.
NAME_WORDS = ("name", "first", "last", "full_name")
GENDER_WORDS = ("gender", "sex")
COUNTRY_WORDS = ("country", "nation")
EMAIL_WORDS = ("email",)
DATE_WORDS = ("date", "time", "dob", "birth", "signup", "created")
PHONE_WORDS = ("phone", "mobile", "tel")
ADDRESS_WORDS = ("address", "street", "addr", "location")
URL_WORDS = ("url", "website", "link", "homepage")
NEGATIVE_WORDS = ("price", "amount", "qty", "quantity", "age", "count")
VALIDITY_WORDS = ("age", "price", "amount", "qty", "quantity", "count", "salary")
INTEGRITY_WORDS = ("id", "identifier", "key", "code")

# Category spellings and their standard form.
GENDERS = {
    "m": "Male", "male": "Male", "man": "Male", "boy": "Male",
    "f": "Female", "female": "Female", "woman": "Female", "girl": "Female",
    "other": "Other", "non-binary": "Non-Binary", "nonbinary": "Non-Binary",
    "prefer not to say": "Prefer Not To Say",
}
COUNTRIES = {
    "usa": "United States", "us": "United States", "u.s.": "United States",
    "u.s.a.": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "britain": "United Kingdom",
    "great britain": "United Kingdom", "england": "United Kingdom",
    "india": "India", "bharat": "India", "germany": "Germany", "deutschland": "Germany",
    "france": "France", "canada": "Canada", "australia": "Australia", "japan": "Japan",
    "china": "China", "brazil": "Brazil",
}

# Street words and their long form; US state codes.
STREETS = {
    "st": "Street", "str": "Street", "ave": "Avenue", "av": "Avenue",
    "blvd": "Boulevard", "blv": "Boulevard", "rd": "Road", "dr": "Drive",
    "ln": "Lane", "ct": "Court", "pl": "Place", "cir": "Circle", "way": "Way",
    "pkwy": "Parkway", "hwy": "Highway", "sq": "Square", "apt": "Apt", "ste": "Ste",
    "fl": "Floor", "rm": "Room",
}
# State codes.
STATE_CODES = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky",
    "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd",
    "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
]

# Country and state names known to the semantic type detector.
COUNTRY_NAMES = [
    "afghanistan", "albania", "algeria", "argentina", "australia", "austria", "bangladesh",
    "belgium", "brazil", "bulgaria", "canada", "chile", "china", "colombia", "croatia",
    "czech republic", "denmark", "egypt", "estonia", "ethiopia", "finland", "france",
    "germany", "ghana", "greece", "hong kong", "hungary", "india", "indonesia", "iran",
    "iraq", "ireland", "israel", "italy", "japan", "jordan", "kenya", "kuwait", "latvia",
    "lebanon", "lithuania", "malaysia", "mexico", "morocco", "nepal", "netherlands",
    "new zealand", "nigeria", "norway", "pakistan", "peru", "philippines", "poland",
    "portugal", "qatar", "romania", "russia", "saudi arabia", "serbia", "singapore",
    "slovakia", "slovenia", "south africa", "south korea", "spain", "sri lanka", "sweden",
    "switzerland", "taiwan", "thailand", "turkey", "ukraine", "united arab emirates",
    "united kingdom", "united states", "usa", "us", "uk", "uae", "vietnam",
]
STATE_NAMES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa",
    "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire",
    "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota",
    "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia",
    "wisconsin", "wyoming",
]
