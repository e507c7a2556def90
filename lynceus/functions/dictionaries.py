"""Small dictionaries of our own: company types, titles, address forms, ordinals, symbols, countries."""

from __future__ import annotations

ORG_TYPES = {
    "limited liability company": "llc", "l.l.c.": "llc", "limited": "ltd", "ltd.": "ltd", "public limited company": "plc",
    "incorporated": "inc", "inc.": "inc", "corporation": "corp", "corp.": "corp", "company": "co",
    "gesellschaft mit beschrankter haftung": "gmbh", "aktiengesellschaft": "ag", "kommanditgesellschaft": "kg",
    "societe anonyme": "sa", "sociedad anonima": "sa", "societa per azioni": "spa", "societe a responsabilite limitee": "sarl",
    "sociedad limitada": "sl", "naamloze vennootschap": "nv", "besloten vennootschap": "bv", "aktiebolag": "ab",
    "joint stock company": "jsc", "public joint stock company": "pjsc", "obshchestvo s ogranichennoy otvetstvennostyu": "ooo",
}
STOPWORDS = ["mr", "mrs", "ms", "miss", "dr", "doctor", "prof", "professor", "sir", "lord", "lady", "dame", "hon", "rev", "sheikh", "herr", "frau", "madame", "monsieur", "senor", "senora", "the"]
ADDRESS_FORMS = ["street", "st", "road", "rd", "avenue", "ave", "boulevard", "blvd", "lane", "ln", "drive", "dr", "square", "sq", "court", "ct", "building", "bldg", "suite", "apartment", "apt", "floor", "po box", "strasse", "str", "rue", "platz", "calle", "ulitsa", "ul"]

_UNITS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]


def _ordinals(n: int) -> dict[str, int]:
    """English ordinals by rule: 1st to nth, and the first dozen in words."""
    end = lambda i: "th" if i % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(i % 10, "th")
    return {f"{i}{end(i)}": i for i in range(1, n + 1)} | {w: i for i, w in enumerate(_UNITS, 1)}


ORDINALS = _ordinals(300)
ORG_SYMBOLS = {"holding": ["holding", "holdings"], "group": ["group", "groupe", "gruppe"], "bank": ["bank", "banque", "banco"], "trade": ["trading", "trade"], "invest": ["investment", "investments", "invest"], "insurance": ["insurance", "assurance"], "logistics": ["logistics", "shipping", "transport"]}
ORG_CLASSES = {"LLC": ["llc", "gmbh", "sarl", "ooo", "bv", "sl"], "JSC": ["jsc", "ag", "sa", "plc", "nv", "spa", "ab", "pjsc"], "CO": ["co", "inc", "corp", "ltd"]}
PERSON_SYMBOLS = {"junior": ["junior", "jr"], "senior": ["senior", "sr"]}
PERSON_NAMES = {"N-JOHN": ["john", "jon", "johan", "juan", "ivan", "ioann"], "N-VLADIMIR": ["vladimir", "wladimir", "volodymyr"], "N-MARIA": ["maria", "marie", "mary", "mariya"], "N-MOHAMMED": ["mohammed", "muhammad", "mohamed", "mohammad"], "N-ALEXANDER": ["alexander", "aleksandr", "alexandre", "alejandro"]}
PERSON_NICKS = {"bill": "william", "bob": "robert", "sasha": "alexander", "misha": "mikhail", "dick": "richard"}
COUNTRIES = {
    "ad": "andorra", "ae": "united arab emirates", "af": "afghanistan", "ar": "argentina", "at": "austria", "au": "australia", "be": "belgium", "bg": "bulgaria", "br": "brazil", "by": "belarus",
    "ca": "canada", "ch": "switzerland", "cl": "chile", "cn": "china", "co": "colombia", "cu": "cuba", "cy": "cyprus", "cz": "czechia", "de": "germany", "dk": "denmark",
    "dz": "algeria", "eg": "egypt", "es": "spain", "fi": "finland", "fr": "france", "gb": "united kingdom", "gr": "greece", "hr": "croatia", "hu": "hungary", "id": "indonesia",
    "ie": "ireland", "il": "israel", "in": "india", "iq": "iraq", "ir": "iran", "it": "italy", "jp": "japan", "kp": "north korea", "kr": "south korea", "kz": "kazakhstan",
    "lb": "lebanon", "ly": "libya", "ma": "morocco", "mx": "mexico", "my": "malaysia", "ng": "nigeria", "nl": "netherlands", "no": "norway", "nz": "new zealand", "pa": "panama",
    "pe": "peru", "ph": "philippines", "pk": "pakistan", "pl": "poland", "pt": "portugal", "ro": "romania", "rs": "serbia", "ru": "russia", "sa": "saudi arabia", "se": "sweden",
    "sg": "singapore", "sy": "syria", "th": "thailand", "tr": "turkey", "ua": "ukraine", "us": "united states", "ve": "venezuela", "vn": "vietnam", "ye": "yemen", "za": "south africa",
}
