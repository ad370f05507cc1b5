"""Fixed values of business-name and address normalisation.

Lower case, without accents and punctuation, as they are applied to cleaned tokens. They decide results, so they are
stated as they are, each table in its natural order.
"""

# Country labels -> country code.
COUNTRIES = {
    "us": "us", "usa": "us", "u s": "us", "u s a": "us", "united states": "us", "united states of america": "us", "america": "us",
    "in": "in", "ind": "in", "india": "in", "bharat": "in",
    "fr": "fr", "fra": "fr", "france": "fr", "republique francaise": "fr",
}

# Legal-form tokens by country.
LEGAL = {
    "common": ["ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "plc", "llp", "lp", "pllc", "pc", "gmbh", "bv", "ag"],
    "in": ["pvt", "private", "p", "opc", "pvtltd"],
    "fr": ["sarl", "sas", "sasu", "sa", "eurl", "snc", "sci", "scop", "selarl", "scp", "societe", "ste", "ets", "etablissements", "etablissement", "cie", "compagnie"],
}

# Canonical legal words.
LEGAL_CANON = {
    "pvt": "private", "p": "private", "pvtltd": "private limited", "ltd": "limited", "inc": "incorporated", "corp": "corporation",
    "co": "company", "cie": "compagnie", "ets": "etablissements", "ste": "societe",
}

# Name abbreviations of all countries.
NAME_COMMON = {
    "intl": "international", "natl": "national", "mfg": "manufacturing", "mfr": "manufacturer", "mfrs": "manufacturers",
    "svc": "service", "svcs": "services", "assoc": "associates", "assn": "association", "bros": "brothers", "ent": "enterprises",
    "ents": "enterprises", "entp": "enterprises", "inds": "industries", "indus": "industries", "mgmt": "management",
    "mktg": "marketing", "dept": "department", "ctr": "center", "centre": "center", "hosp": "hospital", "govt": "government",
    "univ": "university", "inst": "institute", "tech": "technology", "techs": "technologies", "sys": "systems",
    "engg": "engineering", "engrs": "engineers", "constr": "construction", "devt": "development", "grp": "group",
    "hldgs": "holdings", "hldg": "holding", "med": "medical", "labs": "laboratories", "lab": "laboratory", "coop": "cooperative",
    "trdrs": "traders", "agncy": "agency", "agy": "agency", "jewelers": "jewellers", "colour": "color",
    "praivet": "private", "piraivet": "private", "prayivet": "private", "limitet": "limited", "limited": "limited",
    "elelapi": "llp", "elelpi": "llp", "kampani": "company", "kampni": "company", "kompani": "company",
}
NAME_FR = {"st": "saint", "gd": "grand", "gde": "grande"}

# Abbreviations of names written in an Indic script, after transliteration.
NAME_INDIC = {
    "pra": "private", "li": "limited", "lim": "limited", "limitad": "limited", "praivet": "private", "prayivet": "private",
    "piraivet": "private", "elelpi": "llp", "elelapi": "llp", "kampani": "company", "kampni": "company",
}

# Name stopwords and the marks between a legal and a trade name.
NAME_STOPWORDS = ["the", "and", "of", "a", "an", "le", "la", "les", "l", "de", "du", "des", "d", "et", "en", "au", "aux", "ms", "m/s"]
DBA = r"\b(?:d\s*/\s*b\s*/\s*a|dba|t\s*/\s*a|trading as|a\s*/\s*k\s*/\s*a|aka|formerly)\b"

# Address abbreviations.
ADDRESS_COMMON = {"bldg": "building", "blg": "building", "apt": "apartment", "apts": "apartments", "rm": "room", "flr": "floor"}
ADDRESS_US = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "rd": "road", "dr": "drive", "ln": "lane",
    "ct": "court", "cir": "circle", "hwy": "highway", "pkwy": "parkway", "pky": "parkway", "pl": "place", "sq": "square",
    "ter": "terrace", "terr": "terrace", "trl": "trail", "ste": "suite", "fl": "floor", "n": "north", "s": "south", "e": "east",
    "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "mt": "mount", "ft": "fort",
    "rte": "route", "expy": "expressway", "fwy": "freeway", "plz": "plaza", "ctr": "center", "hts": "heights", "jct": "junction",
    "xing": "crossing",
}
ADDRESS_IN = {
    "rd": "road", "st": "street", "nr": "near", "opp": "opposite", "opps": "opposite", "fl": "floor", "ngr": "nagar",
    "clny": "colony", "col": "colony", "sec": "sector", "sect": "sector", "ph": "phase", "indl": "industrial", "ind": "industrial",
    "estt": "estate", "soc": "society", "mkt": "market", "stn": "station", "jn": "junction", "jnc": "junction", "jct": "junction",
    "bazar": "bazaar", "extn": "extension", "ext": "extension", "blk": "block", "distt": "district", "dist": "district",
    "tq": "taluk", "tal": "taluk", "marg": "marg", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata",
    "bangalore": "bengaluru", "gurgaon": "gurugram", "poona": "pune", "baroda": "vadodara", "orissa": "odisha",
    "pondicherry": "puducherry",
}
ADDRESS_FR = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard", "boul": "boulevard",
    "pl": "place", "rte": "route", "ch": "chemin", "chem": "chemin", "imp": "impasse", "all": "allee", "sq": "square",
    "fg": "faubourg", "fbg": "faubourg", "qu": "quai", "crs": "cours", "pas": "passage", "psg": "passage", "res": "residence",
    "resid": "residence", "bat": "batiment", "bt": "batiment", "st": "saint", "ste": "sainte", "etg": "etage", "esc": "escalier",
}

# US states; the order matters to phrase replacement.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in",
    "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}

# Indian states, names and short forms -> one token; the order matters to phrase replacement.
IN_STATES = {
    "andhra pradesh": "andhrapradesh", "arunachal pradesh": "arunachalpradesh", "himachal pradesh": "himachalpradesh",
    "madhya pradesh": "madhyapradesh", "uttar pradesh": "uttarpradesh", "tamil nadu": "tamilnadu", "west bengal": "westbengal",
    "jammu and kashmir": "jammukashmir", "uttaranchal": "uttarakhand", "mh": "maharashtra", "ka": "karnataka", "tn": "tamilnadu",
    "ap": "andhrapradesh", "ts": "telangana", "tg": "telangana", "gj": "gujarat", "rj": "rajasthan", "hr": "haryana",
    "pb": "punjab", "kl": "kerala", "wb": "westbengal", "dl": "delhi", "mp": "madhyapradesh", "jk": "jammukashmir",
    "hp": "himachalpradesh", "up": "uttarpradesh", "uk": "uttarakhand", "maharashtr": "maharashtra", "dilli": "delhi",
    "karnatak": "karnataka", "pashchim bangal": "westbengal", "telangan": "telangana", "keral": "kerala", "hariyana": "haryana",
    "panjab": "punjab", "tamil natu": "tamilnadu", "tamilnatu": "tamilnadu", "rajasthan": "rajasthan", "gujarat": "gujarat",
    "bihar": "bihar",
}

# Further Indian regions that an address may name.
IN_REGIONS = ["goa", "assam", "odisha", "jharkhand", "chhattisgarh", "tripura", "sikkim", "manipur", "meghalaya", "mizoram", "nagaland", "chandigarh", "puducherry", "andhrapradesh"]

# Address stopwords and patterns.
ADDRESS_STOPWORDS = ["the", "and", "of", "no", "nos", "number", "de", "la", "du", "des", "le", "les", "l", "d", "india", "usa", "france", "cedex", "bis", "ter", "quater", "null", "na", "none"]
LANDMARK = (
    r"\b(?:near|nr|opp|opposite|behind|beside|besides|next to|adjacent to|adj|in front of|close to|pres de|pres du|en face de|en face du"
    r"|a cote de|derriere)\b[^,]*"
)
UNIT = r"\b(?:suite|ste|apt|apartment|unit|floor|fl|flr|shop|office|room|rm|etage|bureau|door|flat)\s*(?:no\s*)?#?\s*(\d+[a-z]?)"
FR_POSTBOX = r"\b(?:bp|cs)\s*\d+|\bcedex(?:\s*\d+)?"
POSTAL = {
    "in": r"(?<!\d)(\d{3})\s?(\d{3})(?!\d)",
    "us": r"(?<!\d)(\d{5})(?:\s?-\s?\d{4})?(?!\d)",
    "fr": r"(?<!\d)(\d{2})\s?(\d{3})(?!\d)",
    "other": r"(?<!\d)(\d{5,6})(?!\d)",
}

# French administrative phrases dropped from address cores.
FR_ADMIN = ["nouvelle aquitaine", "pays loire", "loire atlantique", "passage calais", "hauts", "gironde", "nord"]

# Replacements that make consonant skeletons, in order.
SKELETON = [("x", "ks"), ("ph", "f"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("bh", "b"), ("dh", "d"), ("ck", "k"), ("q", "k"), ("w", "v"), ("z", "s"), ("b", "p"), ("d", "t"), ("g", "k")]

# Indic code points. All blocks of 128 code points share one layout; the tables are by place in a block.
INDIC_FIRST, INDIC_LAST = 0x0900, 0x0DFF

# Consonants without their inherent vowel.
INDIC_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t",
    0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p",
    0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f",
    0x5F: "y",
}

# Independent vowels.
INDIC_VOWELS = {
    0x04: "a", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li",
}

# Vowel signs.
INDIC_SIGNS = {
    0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai",
    0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "li", 0x63: "li",
}

# Nasals and the visarga.
INDIC_NASALS = {
    0x01: "n", 0x02: "n", 0x03: "h",
}

# The sign that silences a vowel, the first of ten digits, marks without a sound, and letter pairs made one, in order.
INDIC_VIRAMA = 0x4D
INDIC_DIGITS = 0x66
INDIC_IGNORED = (0x3C, 0x3D, 0x00, 0x51, 0x52, 0x70, 0x71)
INDIC_COLLAPSE = [("aa", "a"), ("ii", "i"), ("uu", "u"), ("ee", "i"), ("oo", "u")]
