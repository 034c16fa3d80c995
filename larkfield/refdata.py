"""Word lists and tables that the rules read. All are fixed values."""

from __future__ import annotations

import unicodedata

# Legal forms: carry nothing that tells businesses apart.
LEGAL_FORMS = (
    "gmbh", "mbh", "ug", "ag", "kg", "ohg", "gbr", "ev", "eg", "ek", "kgaa", "haftungsbeschraenkt", "co", "cie",
    "ltd", "limited", "llc", "inc", "incorporated", "plc", "corp", "corporation", "bv", "nv", "sarl", "sa", "srl", "spa", "oy", "ab", "as",
)

# Words too common in names to carry a match alone.
GENERIC_WORDS = (
    "der", "die", "das", "den", "dem", "des", "und", "oder", "von", "vom", "zum", "zur", "am", "im", "in", "an", "auf", "bei", "fuer", "mit",
    "the", "and", "of", "at", "for", "a", "salon", "studio", "shop", "store", "haus", "house", "center", "centre", "zentrum", "service",
    "services", "company", "group", "gruppe", "team", "restaurant", "cafe", "bar", "praxis", "atelier", "werkstatt", "markt", "barbershop",
    "barber", "friseur", "friseursalon", "coiffeur", "hair",
)

# Whole words of a street key and what they are shortened to.
STREET_WORDS = (("strasse", "str"), ("strase", "str"), ("platz", "pl"), ("street", "str"), ("road", "rd"), ("avenue", "ave"))

# Country -> (calling code, trunk prefix, least and most digits of the national number without the trunk prefix).
PHONE_RULES = {"DE": ("49", "0", 6, 12), "AT": ("43", "0", 6, 12), "CH": ("41", "0", 9, 9), "GB": ("44", "0", 9, 10), "US": ("1", "1", 10, 10), "FR": ("33", "0", 9, 9)}

# Public suffixes of two labels.
TWO_LEVEL_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.nz", "com.br", "co.jp")

SOCIAL_HOSTS = (
    "facebook.com", "fb.com", "instagram.com", "x.com", "twitter.com", "linkedin.com", "tiktok.com", "youtube.com", "youtu.be", "pinterest.com",
    "snapchat.com", "threads.net", "xing.com", "t.me", "wa.me", "whatsapp.com",
)

# Listings and portals: never a business's own site.
DIRECTORY_HOSTS = (
    "google.com", "google.de", "business.site", "goo.gl", "maps.app.goo.gl", "yelp.com", "yelp.de", "tripadvisor.com", "tripadvisor.de",
    "opentable.com", "gelbeseiten.de", "dasoertliche.de", "11880.com", "meinestadt.de", "cylex.de", "werkenntdenbesten.de", "golocal.de",
    "branchenbuch.de", "firmenwissen.de", "wikipedia.org", "apple.com", "amazon.de", "amazon.com", "ebay.de", "treatwell.de", "booksy.com",
    "planity.com", "shore.com", "salonkee.de", "lieferando.de", "ubereats.com", "wolt.com", "doordash.com", "thefork.de", "jameda.de",
    "doctolib.de", "sanego.de", "kununu.com", "indeed.com", "stepstone.de",
)
DIRECTORY_SUBDOMAINS = (".google.com", ".business.site")
SHORTENERS = ("bit.ly", "tinyurl.com", "ow.ly", "t.co", "rb.gy", "cutt.ly")
LINK_PAGE_HOSTS = (
    "linktr.ee", "linktree.com", "beacons.ai", "bio.link", "taplink.cc", "lnk.bio", "solo.to", "campsite.bio", "komi.io", "msha.ke",
    "allmylinks.com", "linkin.bio", "many.link", "withkoji.com", "shorby.com", "pillar.io",
)

# Texts of parked and of unfinished pages, as normalised text.
PARKED_TEXTS = (
    "domain is for sale", "this domain is parked", "buy this domain", "domain kaufen", "diese domain steht zum verkauf", "parked domain",
    "domain parking", "future home of something quite cool", "index of", "default web page", "apache2 ubuntu default page", "welcome to nginx",
    "diese domain wurde registriert",
)
UNFINISHED_TEXTS = ("website coming soon", "coming soon", "under construction", "im aufbau", "demnaechst verfuegbar", "baustelle", "wir sind bald fuer sie da")

PLATFORMS = {
    "facebook.com": "facebook", "fb.com": "facebook", "fb.me": "facebook", "instagram.com": "instagram", "tiktok.com": "tiktok",
    "linkedin.com": "linkedin", "x.com": "x", "twitter.com": "x", "youtube.com": "youtube", "youtu.be": "youtube",
}
# Path parts after which no account name follows, and those that stand before one.
CONTENT_PARTS = (
    "p", "reel", "reels", "posts", "post", "photo", "photos", "videos", "video", "watch", "story", "stories", "explore", "groups", "events",
    "marketplace", "profile.php", "people", "share", "permalink", "media", "tv", "shorts", "sharer", "search", "hashtag", "login", "help",
    "legal", "privacy",
)
NAME_PREFIXES = ("pages", "company", "in", "c", "user", "channel", "school")

# Top-level domains that count in free text, and endings that are file names.
TEXT_TLDS = ("de", "com", "net", "org", "eu", "at", "ch", "info", "shop", "online", "studio", "salon", "bar", "cafe")
FILE_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "pdf", "mp4")

# Named entities.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü",
    "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ndash": "–", "mdash": "—", "amp": "&",
}

# Day words -> weekday, Sunday is 0.
DAY_WORDS = {
    "su": 0, "so": 0, "sun": 0, "sunday": 0, "sonntag": 0, "mo": 1, "mon": 1, "monday": 1, "montag": 1, "tu": 2, "di": 2, "tue": 2, "tues": 2,
    "tuesday": 2, "dienstag": 2, "we": 3, "mi": 3, "wed": 3, "wednesday": 3, "mittwoch": 3, "th": 4, "do": 4, "thu": 4, "thur": 4,
    "thursday": 4, "donnerstag": 4, "fr": 5, "fri": 5, "friday": 5, "freitag": 5, "sa": 6, "sat": 6, "saturday": 6, "samstag": 6,
}
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
# Words of rules that are kept as they are.
UNREAD_RULE_WORDS = ("ph", "sh", "easter", "week", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "sunrise", "sunset")

# key, sort order, terminal, callable.
LEAD_STATUSES = (
    ("new", 10, False, True), ("ready_to_call", 20, False, True), ("called", 30, False, True), ("no_answer", 40, False, True),
    ("callback", 50, False, True), ("interested", 60, False, True), ("meeting", 70, False, True), ("converted", 80, True, False),
    ("not_interested", 90, True, False), ("wrong_number", 100, True, False), ("already_has_site", 110, True, False), ("do_not_contact", 120, True, False),
)
OUTCOME_STATUS = {
    "no_answer": "no_answer", "reached": "called", "callback": "callback", "interested": "interested", "not_interested": "not_interested",
    "wrong_number": "wrong_number", "has_website": "already_has_site", "do_not_contact": "do_not_contact",
}

# Our own categories: key, source tags, synonyms (normalised); the first that fits wins.
CATEGORIES = (
    ("hairdresser", ("shop=hairdresser", "shop=beauty"), ("friseur", "barber", "hair salon", "beauty")),
    ("restaurant", ("amenity=restaurant", "amenity=cafe"), ("restaurant", "cafe", "bistro", "pizzeria")),
    ("crafts", ("craft=plumber", "craft=electrician"), ("plumber", "electrician", "handwerk", "widget")),
    ("retail", ("shop=florist", "shop=clothes"), ("florist", "boutique", "gadget", "ring")),
)

# What texts count as a street compound, a house number, a postal code, a telephone number, a link or an
# opening-hours rule. Results depend on each of these patterns bit for bit.
STREET_COMPOUND = r"(\w{3,}?)(strasse|str)\b"
NUMBER_LAST = r"^(.*?)[\s,]+(\d+\s*[-/]?\s*\d*\s*[a-zA-Z]?)$"
NUMBER_FIRST = r"^(\d+\s*[a-zA-Z]?)[\s,]+(.+)$"
POSTAL_DIGITS = r"\b(\d{4,5})\b"
POSTAL_BRITISH = r"(?i)\b([A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2})\b"
PHONE_RUN = r"((?:\+|00)?[\d][\d\s()/.\-]{5,24}\d)"
LINK_TARGET = r"""(?i)<a\b[^>]*href=["']([^"']+)["']"""
TELEPHONE_LINK = r"""(?i)href=["']tel:([^"']+)["']"""
JSON_LD_BLOCK = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
HOURS_RULE = r"(?i)^([A-Za-zÀ-ÿ,\-. ]+?)\s*(off|closed|geschlossen|[\d:.,\- ]+)$"
DOMAIN_BEFORE_ENDING = r"(?i)\b((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:{endings}))\b"

# Points of an identity and of a website candidate.
POINTS = {"phone": 35, "full_address": 30, "partial_address": 15, "coordinates": 10, "distinctive_name": 8, "category": 4, "corroboration": 15}
WEIGHTS = {
    "phone_match": 45, "postal_match": 20, "street_match": 15, "city_match": 8, "name_match": 20, "name_match_partial": 10, "structured_match": 12,
    "domain_overlap": 8, "declared_link": 20, "phone_conflict": -40, "postal_conflict": -20, "name_absent": -15,
}


def accent_table() -> tuple[str, str]:
    """Lower-case letters with accents and the base letters they have; marks that combine have none and stand last."""
    pairs = {"ø": "o", "ł": "l"}
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if chr(code).islower() and len(base) > 1 and base[0].isascii():
            pairs[chr(code)] = base[0]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())
