"""Names shared by every job: facts, features, phrases, areas, weights.

Fixed values: the word lists, patterns, weights, thresholds and texts in this file decide results
and therefore stay exactly as the data model defines them.
"""

from __future__ import annotations

# Requested feature -> fact column, in model order.
FEATURE_FACTS = {
    "food": "servesFood",
    "outdoorSeating": "hasOutdoorSeating",
    "sports": "showsSports",
    "liveMusic": "hasLiveMusic",
    "dj": "hasDj",
    "events": "hostsEvents",
    "dogFriendly": "dogFriendly",
    "wheelchairAccess": "wheelchairAccessible",
    "reservations": "acceptsReservations",
    "groups": "suitableForGroups",
    "happyHour": "hasHappyHour",
    "sundayRoast": "servesSundayRoast",
    "veganOptions": "hasVeganOptions",
    "quizNight": "hostsQuiz",
    "accessibleToilet": "hasAccessibleToilet",
}
FEATURES = tuple(FEATURE_FACTS)
FACTS = tuple(FEATURE_FACTS.values())
FACT_FEATURES = {fact: feature for feature, fact in FEATURE_FACTS.items()}
NOISE_FEATURES = {"quietAtmosphere": "quiet", "livelyAtmosphere": "lively"}

# Explanation text of a known-true feature.
FEATURE_REASONS = {
    "food": "Serves food",
    "outdoorSeating": "Has outdoor seating",
    "sports": "Shows sports",
    "liveMusic": "Has live music",
    "dj": "Has DJ events",
    "events": "Hosts events",
    "dogFriendly": "Dog friendly",
    "wheelchairAccess": "Has verified wheelchair access",
    "reservations": "Accepts table bookings",
    "groups": "Supports group bookings or private hire",
    "happyHour": "Has a happy hour",
    "sundayRoast": "Serves a Sunday roast",
    "veganOptions": "Has vegan or vegetarian options",
    "quizNight": "Hosts a quiz night",
    "accessibleToilet": "Has an accessible toilet",
}

# Areas and their centres (latitude, longitude).
AREA_CENTRES = {
    "Waterloo": (51.5033, -0.1147),
    "London Bridge": (51.5055, -0.0865),
    "Shoreditch": (51.5255, -0.0776),
    "Brixton": (51.4613, -0.1156),
    "Camden": (51.5390, -0.1426),
    "Westminster": (51.5010, -0.1300),
}
AREAS = tuple(AREA_CENTRES)
PRICE_LEVELS = ("cheap", "moderate", "expensive")
NOISE_LEVELS = ("quiet", "lively")

# Ranking weights.
WEIGHTS = {
    "location": 0.25,
    "price": 0.15,
    "features": 0.20,
    "groupSuitability": 0.10,
    "rating": 0.20,
    "popularity": 0.10,
}
AREA_RADIUS_KM = 8.0

# Phrases that name a feature in a request.
FEATURE_PHRASES = {
    "food": ("food", "lunch", "dinner", "menu", "meal", "meals", "gastropub", "kitchen"),
    "outdoorSeating": (
        "outdoor seating", "outdoor pub seating", "beer garden", "drinks outside", "pub terrace",
        "outside tables", "pub garden", "pub patio", "outdoor area", "sit outside",
        "open-air pub tables",
    ),
    "sports": (
        "sports", "sport", "football", "watch the match", "rugby", "sky sports", "tv screens",
        "screening the big game", "premier league",
    ),
    "liveMusic": (
        "live music", "live band", "bands playing", "acoustic music", "music nights",
        "rock music", "hosting musicians", "music performance", "live performers",
    ),
    "dj": ("dj night", "dj nights", "dj set", "dj sets", "djs", "dj"),
    "events": ("events", "event nights", "what's on", "whats on", "regular events"),
    "dogFriendly": (
        "dog friendly", "dog-friendly", "dogs welcome", "dog is welcome", "bring a dog",
        "pub for dogs", "my puppy", "our puppy", "pet-friendly", "dogs come",
        "four-legged friends", "dogs are allowed",
    ),
    "wheelchairAccess": (
        "wheelchair accessible", "wheelchair access", "step free", "step-free",
        "accessible pub entrance", "suitable for a wheelchair", "without entrance steps",
        "wheelchair-friendly", "disabled access",
    ),
    "reservations": (
        "book a table", "table booking", "table bookings", "reservations", "reservation",
        "bookable", "reserve a table", "accepting bookings", "booked table",
        "book a pub space", "reserve seats",
    ),
    "groups": (
        "group", "groups", "large birthday group", "private hire", "group booking",
        "private party", "space for a celebration", "large gathering", "pub room hire",
        "office party", "birthday gathering", "private space", "accommodates groups",
        "large group",
    ),
    "happyHour": (
        "happy hour", "happy-hour", "discounted drinks", "two for one drinks",
        "2 for 1 cocktails",
    ),
    "sundayRoast": ("sunday roast", "sunday roasts", "roast dinner", "roast dinners"),
    "veganOptions": (
        "vegan options", "vegan food", "vegan menu", "vegan dishes", "vegetarian options",
        "vegetarian menu",
    ),
    "quizNight": ("quiz night", "quiz nights", "pub quiz", "weekly quiz", "trivia night"),
    "accessibleToilet": (
        "accessible toilet", "accessible toilets", "accessible loo", "disabled toilet",
        "wheelchair accessible toilet",
    ),
}

# Words in front of a phrase that reject or soften it.
NEGATIVE_PREFIXES = ("no", "not", "without", "avoid")
SOFT_PREFIXES = ("prefer", "preferably", "ideally", "nice to have")
NEGATIVE_LEAD = (
    r"\b(?:no|not|without|avoid)\s+(?:(?:be|have|show|serve|allow|offer|host)\s+)?"
    r"(?:in\s+)?(?:a\s+|an\s+|the\s+)?"
)
SOFT_LEAD = r"\b(?:prefer|preferably|ideally|nice to have)\s+(?:a\s+|an\s+|the\s+)?"

# Request patterns.
GROUP_SIZE = (
    r"\b(?:(?:for|party of|group of)\s+(\d{1,2})(?:\s+(?:people|persons|friends|guests))?"
    r"|(\d{1,2})\s+(?:people|persons|friends|guests))\b"
)
FULL_POSTCODE = r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
OUTWARD_POSTCODE = r"(?i)\b([A-Z]{1,2}\d[A-Z]?)\b"
MAX_GROUP = 50

# Words a request may contain without meaning anything.
FILLER_WORDS = (
    "a", "an", "and", "at", "bar", "but", "can", "find", "for", "have", "in", "like", "me",
    "must", "near", "of", "our", "please", "pub", "pubs", "somewhere", "that", "the", "to",
    "want", "we", "where", "with", "would",
)

# Words ignored when request and evidence are compared.
RETRIEVAL_STOP_WORDS = (
    "a", "an", "and", "can", "for", "in", "my", "near", "of", "our", "place", "pub",
    "somewhere", "the", "to", "we", "where", "with",
)
DENSE_WEIGHT = 0.9
LEXICAL_BONUS = 0.25
EVIDENCE_LIMIT = 3

# Pair scoring.
NAME_WEIGHT = 0.40
DISTANCE_WEIGHT = 0.30
POSTCODE_WEIGHT = 0.15
DOMAIN_WEIGHT = 0.10
PHONE_WEIGHT = 0.05
CANDIDATE_METRES = 500.0
SCORE_METRES = 200.0
DEFINITE = 0.90
LIKELY = 0.78
REVIEW = 0.60

# Columns an override may correct.
OVERRIDABLE = ("name", "address", "postcode", "website", "phone", *FACTS)
OFFICIAL_SOURCE = "Official venue website"

# Evidence sentence of a known fact, true and false form.
FACT_SENTENCES = {
    "servesFood": ("serves food.", "does not serve food."),
    "hasOutdoorSeating": (
        "has outdoor seating or a beer garden.",
        "does not have outdoor seating or a beer garden.",
    ),
    "showsSports": ("shows live sport and football.", "does not show live sport."),
    "hasLiveMusic": ("hosts live music.", "does not host live music."),
    "hasDj": ("hosts DJ events.", "does not host DJ events."),
    "hostsEvents": ("hosts events.", "does not host events."),
    "dogFriendly": ("welcomes dogs and is dog friendly.", "does not allow dogs."),
    "wheelchairAccessible": (
        "has verified wheelchair access.",
        "does not have verified wheelchair access.",
    ),
    "acceptsReservations": (
        "accepts table bookings and reservations.",
        "does not accept table bookings or reservations.",
    ),
    "suitableForGroups": (
        "supports groups, group bookings, or private hire.",
        "is not verified as suitable for groups or private hire.",
    ),
    "hasHappyHour": ("has a happy hour.", "does not have a happy hour."),
    "servesSundayRoast": ("serves a Sunday roast.", "does not serve a Sunday roast."),
    "hasVeganOptions": (
        "has vegan or vegetarian food options.",
        "does not have verified vegan or vegetarian options.",
    ),
    "hostsQuiz": ("hosts a quiz night.", "does not host a quiz night."),
    "hasAccessibleToilet": (
        "has an accessible toilet.",
        "does not have an accessible toilet.",
    ),
}

# Week days.
DAY_CODES = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Affirmative tag values of the map source.
TAG_TRUE_VALUES = (
    "yes", "only", "limited", "seasonal", "parklet", "pedestrian_zone", "street", "sidewalk",
    "patio", "terrace", "balcony", "veranda", "roof", "garden", "courtyard",
)

# Hosts.
SOCIAL_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "tiktok.com", "twitter.com", "x.com",
    "youtube.com",
)
BOOKING_HOSTS = (
    "bookatable.co.uk", "designmynight.com", "opentable.com", "opentable.co.uk",
    "quandoo.co.uk", "quandoo.com", "resdiary.com", "sevenrooms.com", "thefork.co.uk",
    "thefork.com",
)
BLOCKED_HOSTS = (
    "beerintheevening.com", "facebook.com", "instagram.com", "pubs.com", "royalexchange.co.uk",
    "tripadvisor.co.uk", "tripadvisor.com", "cubitthouse.wpengine.com",
)
GENERIC_NAME_WORDS = (
    "and", "bar", "hotel", "london", "of", "pub", "public", "restaurant", "the",
)

# Link words visited first.
PRIORITY_LINK_TERMS = (
    "access", "book", "dog", "event", "food", "hire", "happy", "menu", "music", "sport",
    "quiz", "roast", "vegan", "whatson",
)
MENU_LINK_TERMS = ("drink", "menu", "bar", "pdf")

# Page passages worth keeping, and page noise.
RELEVANT_PASSAGE = (
    r"(?i)\b(?:accessible|atmosphere|bar|beer|book|breakfast|brunch|cocktail|cosy|cozy|"
    r"dining|dinner|dj|dog|drink|event|family|food|football|garden|group|heritage|"
    r"historic|lively|lunch|menu|music|party|private hire|pub|quiet|reservation|"
    r"roast|rugby|seasonal|sport|sunday|terrace|traditional|view|wheelchair)\b"
)
PASSAGE_NOISE = (
    r"\b(?:accept|manage|reject) (?:all )?cookies?\b",
    r"\bprivacy (?:policy|preferences?)\b",
    r"\ball rights reserved\b",
    r"\bsign up (?:to|for) (?:our )?newsletter\b",
    r"\bsign up (?:to|for) (?:our )?mailing list\b",
    r"\bskip to (?:main )?content\b",
    r"\bdownload (?:the|our) .{0,30}\bapp\b",
    r"\b(?:offers and discounts|terms and conditions|up for grabs)\b",
    r"\b(?:spin the wheel|skip the queue|gift cards?)\b",
    r"\b(?:highly recommend|tripadvisor|customer reviews?)\b",
    r"\b(?:five|[1-5])[- ]stars?\b",
    r"\b(?:we|i) (?:stumbled|visited|came here|went there|had a brilliant time)\b",
    r"\bwish i could\b",
)
PASSAGE_MIN = 40
PASSAGE_MAX = 700

# Phrases on a page that claim a fact.
FACT_PATTERNS = {
    "servesFood": (
        r"\b(?:food|main|lunch|dinner|sunday|seasonal) menus?\b",
        r"\b(?:food|dining) (?:and|&) drinks?\b",
    ),
    "showsSports": (
        r"\blive sports?\b",
        r"\b(?:sky|tnt) sports?\b",
        r"\bwatch (?:the )?(?:football|rugby|sport)\b",
    ),
    "hasLiveMusic": (r"\blive music\b",),
    "hasDj": (r"\b(?:live )?dj(?:s| nights?| sets?)?\b",),
    "hostsEvents": (
        r"\b(?:upcoming|regular|weekly|one[- ]off) events?\b",
        r"\bhosts? gigs?\b",
        r"\bgigs? most nights?\b",
        r"\bwhat['’]?s on (?:calendar|listings?)\b",
    ),
    "dogFriendly": (r"\bdog[- ]friendly\b", r"\bdogs (?:are )?welcome\b"),
    "wheelchairAccessible": (
        r"\bwheelchair (?:access|accessible)\b",
        r"\bstep[- ]free access\b",
    ),
    "acceptsReservations": (
        r"\bbook a table\b",
        r"\breserve a table\b",
        r"\btable bookings?\b",
    ),
    "suitableForGroups": (r"\bgroup bookings?\b", r"\bprivate hire\b"),
    "hasHappyHour": (
        r"\bhappy[- ]hour\b",
        r"\b(?:two|2)[- ]for[- ](?:one|1) (?:drinks?|cocktails?)\b",
    ),
    "servesSundayRoast": (r"\bsunday roasts?\b", r"\broast dinners?\b"),
    "hasVeganOptions": (
        r"\bvegan (?:options?|menu|dishes?|food)\b",
        r"\bplant[- ]based (?:options?|menu|dishes?|food)\b",
    ),
    "hostsQuiz": (
        r"\b(?:pub |weekly )?quiz nights?\b",
        r"\bweekly pub quiz\b",
        r"\btrivia nights?\b",
    ),
    "hasAccessibleToilet": (
        r"\baccessible toilets?\b",
        r"\bdisabled toilets?\b",
        r"\bwheelchair[- ]accessible toilets?\b",
    ),
}
NEGATED_BEFORE = (
    r"(?i)(?:\b(?:cannot|can't|do not|don't|does not|doesn't|never)\b(?:\s+\w+){0,7}"
    r"|\b(?:no|not)\b(?:\s+\w+){0,2})\s*$"
)

# Menu price evidence.
PRICED_ITEM = "Pint of draught Guinness"
ITEM_NAME = "guinness"
ITEM_LEAD, ITEM_TAIL = 50, 65
ITEM_WINDOW = rf"(?i).{{0,{ITEM_LEAD}}}\b{ITEM_NAME}\b.{{0,{ITEM_TAIL}}}"
ITEM_WORD = r"(?i)\bguinness\b"
ITEM_SPELLINGS = ("guinness", "guiness")
PINT_SIGNAL = r"(?i)\b(?:pint|pt|568\s*ml|draught|draft)\b"
OTHER_SERVING = (
    r"(?i)(?:\b(?:half|1/2|2/3|bottle|can|250\s*ml|284\s*ml|330\s*ml|440\s*ml|0\.0)\b|[½⅔])"
)
POUND_PRICE = r"£\s*(\d{1,2}(?:\.\d{1,2})?)"
PRICE_MIN = 2.0
PRICE_MAX = 15.0

# Readiness of a training set.
MIN_LABELS = 100
MIN_POSITIVES = 20
MIN_NEGATIVES = 20
MIN_GROUPS = 10

# Label list of the client, needle -> label.
CLIENT_LABELS = (
    ("live music", "Live music"), ("music", "Music"), ("live sport", "Live sport"),
    ("sports", "Sports"), ("outdoor seating", "Outdoor seating"), ("terrace", "Terrace"),
    ("courtyard", "Courtyard"), ("garden", "Garden"), ("historic", "Historic"),
    ("sunday roast", "Sunday roast"), ("roast", "Roast dinners"), ("food", "Food"),
    ("dog", "Dog friendly"), ("quiz", "Quiz nights"), ("groups", "Good for groups"),
    ("quiet", "Quiet"), ("craft beer", "Craft beer"), ("real ale", "Real ale"),
    ("wine", "Wine"), ("cocktails", "Cocktails"), ("pizza", "Pizza"), ("burgers", "Burgers"),
    ("whisky", "Whisky"), ("fireside", "Fireside"), ("riverside", "Riverside"),
    ("canal", "Canal side"), ("dj", "DJ nights"), ("games", "Games"),
)

# Clause handling of free-text requests.
CLAUSE_BREAK = (
    r"(?i)\s*(?:,|;|\b(?:and|but|although|even though|though|despite|plus|with|where|while|"
    r"alongside|before|after|for|to|at|on|from)\b)\s*"
)
CLAUSE_NEGATIVE = (
    r"(?i)\b(?:no|not|never|without|avoid|avoids|avoiding|omit\w*|exclude|excluding|"
    r"doesn't|doesnt|don't|dont|do not|cannot|can't|cant|unavailable|refused|refusing|away from|"
    r"free of|nothing|zero|leave out|walk-ins?(?:[- ]only)?)\b|"
    r"\b(?:canine|pet|dog)[- ]free\b|"
    r"\bstairs?\s+(?:(?:are|being)\s+)?(?:required|mandatory)\b|"
    r"\brequir\w*\s+stairs?\b|\bmust\s+be\s+inside\b"
)
POSITIVE_ACCESS = (
    r"(?i)\b(?:no|zero)[- ]+(?:stairs?|steps?)\b|"
    r"\bwithout\s+(?:using\s+)?(?:entrance\s+)?(?:steps?|stairs?)\b|"
    r"\b(?:step|stair|barrier)[- ](?:free|less)\b|"
    r"\bno\s+(?:change\s+of\s+level|raised\s+(?:step|threshold))\b"
)
NEGATED_ACCESS = r"(?i)\b(?:no|not|without)\s+(?:a\s+)?(?:step|stair|barrier)[- ]free\b"
SOFT_CLAUSE = r"(?i)\b(?:prefer|preferably|ideally|optional|nice to have|would like)\b"
GLOBAL_NEGATIVE = (
    r"(?i)^\s*(?:no|avoid|omit|exclude|leave out|do not|don't|dont|keep us (?:away from|inside))\b|"
    r"\b(?:nothing|away from)\b"
)
CONTRAST = r"(?i)\b(?:but|although|even though|though|yet|despite)\b"
INDOOR = r"(?i)\b(?:indoors?|indoor-only)\b"
PAST_INDOOR = r"(?i)\b(?:beyond|past)\s+the\s+interior\b"
MODEL_NEGATIVE = (
    r"(?i)\b(?:no|not|never|without|avoid|omit|exclude|forbid\w*|refus\w*|"
    r"do not|don't|dont|cannot|can't|cant|walk-in-only)\b"
)
MODEL_CONTRAST = r"(?i)\b(?:but|although|though|while|yet|despite|even though)\b"

# Lowest similarity at which a clause means the feature.
INTENT_MINIMUM = {
    "sports": 0.64, "food": 0.60, "outdoorSeating": 0.55, "liveMusic": 0.67, "dj": 0.50,
    "dogFriendly": 0.63, "wheelchairAccess": 0.52, "reservations": 0.69, "groups": 0.56,
    "happyHour": 0.62, "sundayRoast": 0.62, "veganOptions": 0.62, "quizNight": 0.62,
    "accessibleToilet": 0.62,
}
INTENT_MARGIN = 0.04
INTENT_FEATURES = tuple(INTENT_MINIMUM)

# Words that anchor a clause to a feature.
INTENT_ANCHORS = {
    "sports": (
        r"(?i)\b(?:sport|match|game|contest|footie|football|soccer|rugby|cricket|boxing|tennis|"
        r"league|tournament|fixture|formula|six nations|cup final|broadcast|televis|telly|"
        r"screen)\w*\b"
    ),
    "food": (
        r"(?i)\b(?:food|eat|feed|meal|lunch|dinner|supper|roast|bite|kitchen|menu|burger|"
        r"snack|dish|chef|grub|dining|edible|cook|plate|fare|cuisine)\w*\b"
    ),
    "outdoorSeating": (
        r"(?i)\b(?:outdoor|outside|exterior|external|garden|courtyard|terrace|patio|yard|rooftop|"
        r"alfresco|open[- ]air|sunshine|fresh air|under the sky|interior|indoors?|indoor-only)\b"
    ),
    "liveMusic": (
        r"(?i)\b(?:music|band|gig|acoustic|jazz|folk|musician|instrumental|act|singer|concert|"
        r"perform|stage|open mic)\w*\b"
    ),
    "dj": (
        r"(?i)\b(?:dj|disc jockey|selector|record selector|guest selector|record mixer|"
        r"vinyl spinner|decks|turntables?|mixing records|spinning records|dj booth)\b|d\.j\."
    ),
    "dogFriendly": (
        r"(?i)\b(?:dog|pet|pupp(?:y|ies)|pooch|hound|canine|spaniel|labrador|terrier|"
        r"four[- ]legged|companion animal|whippet|dachshund)\w*\b"
    ),
    "wheelchairAccess": (
        r"(?i)\b(?:wheelchair|access route|disabled access|step|stair|level entry|"
        r"level-access|flat[- ]entry|mobility|adapted entrance|flat route|flat path|"
        r"barrier|threshold|chair user)\w*\b"
    ),
    "reservations": (
        r"(?i)\b(?:reservation|booking|prebook|book ahead|book a table|reserve|hold a table|"
        r"table held|arrange a table|schedule a table|secure seats|guarantee.+table|"
        r"pre-arranged table|save.+seats|advance seat|table.+waiting|keeps? tables?|"
        r"planned seating|places? kept|kept ahead|allocat.+tables?|walk-ins?)\w*\b"
    ),
    "groups": (
        r"(?i)\b(?:groups?|crowds?|large crowds?|big crowds?|teams?|corporate|company|department|"
        r"function room|private hire|private party|large part(?:y|ies)|hen party|twenty|"
        r"many guests|reunion|work social|room hire|function[- ]room|hire.+room|"
        r"family gathering|work leaving do|sizeable party|large birthday party|"
        r"accommodat.+party|collective|attendees?|colleagues?|coworkers?|organisation)\b"
    ),
    "happyHour": r"(?i)\b(?:happy[- ]hour|discounted drinks?|two[- ]for[- ]one|2[- ]for[- ]1)\b",
    "sundayRoast": r"(?i)\b(?:sunday roasts?|roast dinners?|roast lunch)\b",
    "veganOptions": r"(?i)\b(?:vegan|vegetarian|plant[- ]based)\b",
    "quizNight": r"(?i)\b(?:quiz nights?|pub quiz|weekly quiz|trivia nights?)\b",
    "accessibleToilet": (
        r"(?i)\b(?:accessible|disabled|wheelchair[- ]accessible) (?:toilets?|loos?|washrooms?)\b"
    ),
}
