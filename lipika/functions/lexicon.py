"""Word lists, script blocks and patterns that results depend on."""

from __future__ import annotations

#: Spelled digits zero to nine by language.
SPELLED_DIGITS: dict[str, list[str]] = {
    "te": ["సున్నా", "ఒకటి", "రెండు", "మూడు", "నాలుగు", "ఐదు", "ఆరు", "ఏడు", "ఎనిమిది", "తొమ్మిది"],
    "ta": ["பூஜ்யம்", "ஒன்று", "இரண்டு", "மூன்று", "நான்கு", "ஐந்து", "ஆறு", "ஏழு", "எட்டு", "ஒன்பது"],
    "hi": ["शून्य", "एक", "दो", "तीन", "चार", "पाँच", "छह", "सात", "आठ", "नौ"],
}

#: Multiplier words, in the order in which they are looked for.
MULTIPLIERS: list[tuple[str, int]] = [
    ("lakh", 100_000),
    ("lakhs", 100_000),
    ("crore", 10_000_000),
    ("crores", 10_000_000),
    ("thousand", 1_000),
    ("hundred", 100),
    ("లక్ష", 100_000),
    ("లక్షల", 100_000),
    ("లక్షలు", 100_000),
    ("కోటి", 10_000_000),
    ("కోట్ల", 10_000_000),
    ("కోట్లు", 10_000_000),
    ("வேயிரம்", 1_000),
    ("லட்சம்", 100_000),
    ("லட்சங்கள்", 100_000),
    ("கோடி", 10_000_000),
    ("हज़ार", 1_000),
    ("हजार", 1_000),
    ("लाख", 100_000),
    ("करोड़", 10_000_000),
]

#: Brand names in any script and their canonical form.
BRAND_ALIASES: dict[str, str] = {
    "swiggy": "swiggy",
    "zomato": "zomato",
    "flipkart": "flipkart",
    "amazon": "amazon",
    "myntra": "myntra",
    "paytm": "paytm",
    "phonepe": "phonepe",
    "google pay": "google pay",
    "googlepay": "google pay",
    "gpay": "google pay",
    "bhim": "bhim",
    "bhim upi": "bhim",
    "hdfc": "hdfc",
    "icici": "icici",
    "sbi": "sbi",
    "axis": "axis",
    "kotak": "kotak",
    "tata": "tata",
    "maruti": "maruti",
    "mahindra": "mahindra",
    "ola": "ola",
    "uber": "uber",
    "rapido": "rapido",
    "whatsapp": "whatsapp",
    "instagram": "instagram",
    "facebook": "facebook",
    "youtube": "youtube",
    "netflix": "netflix",
    "hotstar": "hotstar",
    "amazon prime": "amazon prime",
    "prime video": "amazon prime",
    "jio": "jio",
    "airtel": "airtel",
    "bsnl": "bsnl",
    "स्विगी": "swiggy",
    "ज़ोमैटो": "zomato",
    "जोमैटो": "zomato",
    "फ्लिपकार्ट": "flipkart",
    "अमेज़न": "amazon",
    "अमेज़ॉन": "amazon",
    "पेटीएम": "paytm",
    "फोनपे": "phonepe",
    "गूगल पे": "google pay",
    "व्हाट्सऐप": "whatsapp",
    "व्हाट्सएप": "whatsapp",
    "उबर": "uber",
    "ओला": "ola",
    "जिओ": "jio",
    "స్విగ్గి": "swiggy",
    "జొమాటో": "zomato",
    "ఫ్లిప్‌కార్ట్": "flipkart",
    "అమెజాన్": "amazon",
    "పేటిఎం": "paytm",
    "ఫోన్‌పే": "phonepe",
    "వాట్సాప్": "whatsapp",
    "ఉబర్": "uber",
    "ఓలా": "ola",
    "ஸ்விக்கி": "swiggy",
    "ஜொமேட்டோ": "zomato",
    "ஃபிளிப்கார்ட்": "flipkart",
    "அமேசான்": "amazon",
    "பேடிஎம்": "paytm",
    "ஃபோன்பே": "phonepe",
    "வாட்ஸ்அப்": "whatsapp",
    "உபர்": "uber",
    "ஓலா": "ola",
}

#: Code-point blocks of the scripts that count as a language's own.
SCRIPT_RANGES: dict[str, list[tuple[int, int]]] = {
    "te": [(0x0C00, 0x0C7F)],
    "ta": [(0x0B80, 0x0BFF)],
    "hi": [(0x0900, 0x097F)],
    "en": [(0x41, 0x5A), (0x61, 0x7A)],
}

#: Blocks of other Indic scripts that a language's rows must not hold, in order of report.
FOREIGN_BLOCKS: dict[str, list[tuple[str, int, int]]] = {
    "te": [("devanagari", 0x0900, 0x097F), ("tamil", 0x0B80, 0x0BFF), ("kannada", 0x0C80, 0x0CFF)],
    "ta": [("devanagari", 0x0900, 0x097F), ("telugu", 0x0C00, 0x0C7F), ("malayalam", 0x0D00, 0x0D7F)],
    "hi": [("telugu", 0x0C00, 0x0C7F), ("tamil", 0x0B80, 0x0BFF)],
}

LANGS = ["te", "ta", "hi"]
ENTITY_CLASSES = ["digits", "currency", "addresses", "brands", "codemix", "proper_nouns"]

#: Text that shows a currency amount even without a digit.
CURRENCY_MARKERS = ["रुपये", "రూపాయ", "ரூபாய", "lakh", "crore", "rupees", "₹"]

#: Patterns of refusals and of list or JSON formatting in generated text.
APOLOGY_WORDS = ["I'm sorry", "I cannot", "I can't", "here are", "here is", "sure, here", "of course", "certainly"]
LEAK_STARTS = [r"\s*[\[{\"`]", r"output[: ]", r"[0-9]+[.)] ", r"- "]
LEAK_PHRASE = "sample utterance"

#: First digit of each script's decimal digits that spellers know.
DIGIT_ZERO = {"te": 0x0C66, "ta": 0x0BE6, "hi": 0x0966}
