"""Fixed values of name and address normalisation: results depend on them."""

from __future__ import annotations

import unicodedata

# Legal forms of companies and their canonical tokens.
LEGAL_FORMS = {
    "private": "private", "pvt": "private", "pvte": "private", "priv": "private",
    "limited": "limited", "ltd": "limited", "ltda": "limited", "limitee": "limited",
    "inc": "inc", "incorporated": "inc", "incorporation": "inc",
    "corp": "corp", "corporation": "corp", "corpn": "corp",
    "co": "co", "company": "co", "cos": "co",
    "llc": "llc", "llp": "llp", "pllc": "pllc", "pc": "pc", "plc": "plc",
    "lp": "lp", "llllp": "llp", "pa": "pa", "ltee": "limited",
    "public": "public", "opc": "opc",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sci": "sci", "eurl": "eurl",
    "sa": "sa", "snc": "snc", "scop": "scop", "selarl": "selarl", "scm": "scm",
    "gmbh": "gmbh", "ag": "ag", "bv": "bv", "nv": "nv", "srl": "srl", "spa": "spa",
}

# Spelled legal forms, replaced in this order before a name is cut into tokens.
LEGAL_PHRASES = [
    (r"\bl\s*\.?\s*l\s*\.?\s*c\b\.?", " llc "),
    (r"\bl\s*\.?\s*l\s*\.?\s*p\b\.?", " llp "),
    (r"\bp\s*\.\s*l\s*\.\s*l\s*\.\s*c\b\.?", " pllc "),
    (r"\bp\s*\.\s*c\s*\.", " pc "),
    (r"\bs\s*\.\s*a\s*\.\s*r\s*\.\s*l\b\.?", " sarl "),
    (r"\bs\s*\.\s*a\s*\.\s*s\s*\.\s*u\b\.?", " sasu "),
    (r"\bs\s*\.\s*a\s*\.\s*s\b\.?", " sas "),
    (r"\bs\s*\.\s*a\b\.", " sa "),
    (r"\bpvt\.?\s*ltd\b\.?", " private limited "),
]

# Words without identity in names, and the patterns of names.
NAME_STOP = ["the", "and", "of", "et", "de", "du", "des", "la", "le", "les", "a", "an", "for", "en"]
DBA = r"\b(?:dba|d\s*/\s*b\s*/\s*a|t\s*/\s*a|aka|a\s*/\s*k\s*/\s*a|trading as|doing business as|also known as)\b"
WEBSITE = r"(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co\.in|co|fr|biz|info|us|io|org\.in|net\.in|shop|store|online|site|eu)\b"
HONORIFIC = r"^\s*(?:m\s*/\s*s|mrs|mr|ms|dr|smt|shri|sri)\b\.?\s*(?=\S)"
ORDINAL = r"^(\d+)(?:st|nd|rd|th|er|e|eme|ere)$"
DIGIT_TYPOS = ("013456789", "oleasgtbg")

# Address abbreviations; an entry may stand for two words.
ADDRESS_WORDS = {
    # english street types
    "st": "street", "str": "street", "street": "street", "rd": "road", "road": "road",
    "ave": "avenue", "av": "avenue", "avn": "avenue", "avenue": "avenue", "aven": "avenue",
    "dr": "drive", "drv": "drive", "ln": "lane", "ct": "court", "crt": "court",
    "cir": "circle", "circ": "circle", "blvd": "boulevard", "bd": "boulevard", "boul": "boulevard",
    "bvd": "boulevard", "hwy": "highway", "hiway": "highway", "pkwy": "parkway", "pky": "parkway",
    "pl": "place", "ter": "terrace", "terr": "terrace", "trl": "trail", "tr": "trail",
    "sq": "square", "pt": "point", "mt": "mount", "ft": "fort", "cres": "crescent",
    "xing": "crossing", "expy": "expressway", "fwy": "freeway", "tpke": "turnpike",
    "cty": "county", "hts": "heights", "jct": "junction", "mdws": "meadows", "rdg": "ridge",
    "vly": "valley", "vw": "view", "vlg": "village", "sta": "station", "spg": "spring",
    "spgs": "springs", "cv": "cove", "pnt": "point", "rte": "route", "rt": "route",
    "cswy": "causeway", "aly": "alley", "br": "branch", "brg": "bridge", "bnd": "bend",
    "clf": "cliff", "crk": "creek", "cyn": "canyon", "est": "estate", "ests": "estates",
    "grv": "grove", "hbr": "harbor", "hl": "hill", "hls": "hills", "holw": "hollow",
    "is": "island", "lk": "lake", "lks": "lakes", "ldg": "lodge", "mnr": "manor",
    "orch": "orchard", "pass": "pass", "psge": "passage", "pne": "pine", "pnes": "pines",
    "plz": "plaza", "prt": "port", "rnch": "ranch", "run": "run", "shr": "shore",
    "smt": "summit", "trce": "trace", "trak": "track", "tunl": "tunnel", "un": "union",
    "vis": "vista", "wl": "well", "wls": "wells", "wy": "way",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest",
    "se": "southeast", "sw": "southwest",
    # indian
    "nr": "near", "opp": "opposite", "bldg": "building", "apts": "apartment",
    "apartments": "apartment", "apt": "apartment", "appt": "apartment", "soc": "society",
    "ngr": "nagar", "mkt": "market", "chwk": "chowk", "clny": "colony", "col": "colony",
    "extn": "extension", "ext": "extension", "sec": "sector", "sect": "sector",
    "flr": "floor", "fl": "floor", "gf": "ground floor", "ff": "first floor",
    "mg": "mahatma gandhi", "ph": "phase", "stn": "station", "hosp": "hospital",
    "indl": "industrial", "ind": "industrial", "estt": "estate", "comp": "complex",
    "cplx": "complex", "twr": "tower", "po": "post office",
    # french
    "r": "rue", "imp": "impasse", "all": "allee", "che": "chemin", "chem": "chemin",
    "fbg": "faubourg", "rpt": "rond point", "qu": "quai", "crs": "cours",
    "pas": "passage", "res": "residence", "lot": "lotissement", "za": "zone",
    "zi": "zone", "zac": "zone", "bis": "bis",
}

# Address tokens without identity.
ADDRESS_STOP = [
    "null", "none", "nan", "na", "n", "a", "unit", "suite", "ste", "apt", "no", "nos",
    "number", "num", "h", "hno", "hn", "house", "door", "dno", "plot", "flat", "shop",
    "office", "room", "box", "pobox", "c", "o", "s", "w", "d", "the", "of", "and",
    "township", "twp", "cdp", "city", "town", "village", "region", "district", "dist",
    "taluk", "tehsil", "tal", "teh", "dt", "via", "post", "de", "du", "des", "la", "le",
    "les", "en", "sur", "et", "l", "cedex", "apartment", "floor", "fl", "bldg",
]

# States of the United States and of India with their codes.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca",
    "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
    "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi",
    "wyoming": "wy", "district of columbia": "dc", "puerto rico": "pr",
}
INDIAN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "arp", "assam": "as", "bihar": "br",
    "chhattisgarh": "cg", "chattisgarh": "cg", "goa": "goa", "gujarat": "gj", "haryana": "hr",
    "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mnp", "meghalaya": "ml",
    "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb",
    "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn",
    "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk",
    "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl", "nct of delhi": "dl",
    "jammu and kashmir": "jk", "jammu kashmir": "jk", "ladakh": "lad", "chandigarh": "ch",
    "puducherry": "py", "pondicherry": "py", "andaman and nicobar islands": "an",
    "dadra and nagar haveli": "dn", "daman and diu": "dd", "lakshadweep": "ld",
}
FURTHER_STATE_CODES = ["or", "od", "tg", "ct", "ua"]
STATES = US_STATES | INDIAN_STATES
STATE_CODES = sorted({*STATES.values(), *FURTHER_STATE_CODES})

# Digraphs that spell one sound, replaced in this order.
DIGRAPHS = [("ksh", "x"), ("ks", "x"), ("sh", "s"), ("ph", "f"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"),
            ("gh", "g"), ("ch", "c"), ("jh", "j"), ("w", "v"), ("z", "j"), ("q", "k")]


def latin_folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Latin letters with marks and their plain letters, for translate(), and those that fold to several letters.

    Made from Unicode decompositions of the Latin blocks; a few letters without decomposition are named."""
    named = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Þ": "Th", "þ": "th", "Ð": "D", "ð": "d", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
    source, target, several = [], [], []
    for c in map(chr, [*range(0x00AA, 0x0250), *range(0x1E00, 0x1F00)]):
        if c not in named:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain != c and plain.isascii() and plain.isalnum():
                named[c] = plain
    for c, plain in named.items():
        if len(plain) == 1:
            source.append(c)
            target.append(plain)
        else:
            several.append((c, plain))
    return "".join(source), "".join(target), several
