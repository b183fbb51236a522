"""Fixed values and small lexicons.

Everything here is a plain constant.  Values that must equal the studied
review-mining workflow for equal results are grouped under the
"FIXED VALUES" banners and written out in their natural order.  Larger tables
(accent folding, English stop words) are not typed in: they are built from a
rule (Unicode NFKD) or taken from Spark's own English stop word list.
"""

from __future__ import annotations

import unicodedata

# ---------------------------------------------------------------------------
# FIXED VALUES: these must equal the original study's for equal results.
# ---------------------------------------------------------------------------

# The seven emotion labels, in the order the scorer reports them.  The arg-max
# over them breaks ties to the leftmost label, so all-zero rows get "anger".
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]

# Emotion split of sentences: negative and positive sides.
NEGATIVE_EMOTIONS = ["disgust", "sadness"]
POSITIVE_EMOTIONS = ["neutral", "joy"]

# Rating bands used by the polarity scorer and the sentence split.
NEGATIVE_SCORES = [0, 1, 2]
POSITIVE_SCORES = [4, 5]

# Attribute categories for the criticism classifier.
CATEGORIES = ["appearance", "aroma", "palate", "taste"]

# The per-review aspect columns averaged per beer.
ASPECTS = ["appearance", "aroma", "palate", "taste", "overall", "rating"]

# Extra stop words: forms of "pour".
POUR_WORDS = ["pours", "pour", "poured"]

# Extra stop words: place names (multi-word items never equal a single token).
PLACE_WORDS = [
    "argentina", "thailand", "turkey", "united states", "us", "trinidad", "tobago", "sri lanka",
    "australia", "aussie", "australian", "spain", "austria", "belgium", "brazil", "brazilian",
    "canada", "china", "czech", "denmark", "england", "finland", "france", "germany", "greece",
    "india", "ireland", "italy", "jamaica", "japan", "kenya", "mexico", "netherlands", "norway",
    "poland", "russia", "scotland", "singapore", "chinese", "french", "irish", "italian",
    "jamaican", "japanese", "africa", "african", "mexican", "alaska", "alaskan", "german",
]

# The home-country label and its map label.
HOME_COUNTRY = "United States"
HOME_COUNTRY_MAP_NAME = "United States of America"
OTHER_COUNTRIES = "Other Countries"

# US state name -> two-letter postal code.
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR",
    "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS",
    "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY",
    "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT",
    "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV",
    "Wisconsin": "WI", "Wyoming": "WY",
}

# Cast table of the key-value review files (keys not listed stay strings).
REVIEW_CASTS = {
    "date": "bigint", "abv": "double", "appearance": "double", "aroma": "double",
    "palate": "double", "taste": "double", "overall": "double", "rating": "double",
    "review": "boolean",
}

# Token patterns: three or more ASCII letters (main), or two or more word chars.
THREE_LETTERS = r"\b[a-zA-Z]{3,}\b"
TWO_LETTERS_NUMBERS = r"\b\w\w+\b"
# The same tokens with Python's Unicode word characters spelled out (maximal
# runs of two or more), read identically by Java and RE2.
TWO_LETTERS_NUMBERS_UNI = r"[\p{L}\p{N}_]{2,}"

# Broken UTF-8 apostrophe and its two replacements.
MOJIBAKE_APOSTROPHE = "â\u0080\u0099"
RIGHT_QUOTE = "’"

# "ipa" spelling rule: any word containing "ipa", any case, becomes "ipa".
# Python's Unicode \w is written out as letters, digits and underscore so that
# Java and RE2 read it the same way.
WORD_CHAR = r"[\p{L}\p{N}_]"
IPA_PATTERN = r"(?i)" + WORD_CHAR + r"*ipa" + WORD_CHAR + r"*"
# Same matches, but a match may only start at a word start (no quadratic rescans).
IPA_PATTERN_ANCHORED = r"(?i)(?<!" + WORD_CHAR + r")" + WORD_CHAR + r"*ipa" + WORD_CHAR + r"*"

# Sentence delimiters.
SENTENCE_SPLIT = r"[;.?!]"
SENTENCE_WITH_DELIMS = r"[^.!?;]+(?:\s*-\s*)?[^.!?;]+[.!?;]*"

# Negations kept in the word-cloud stop list.
KEPT_NEGATIONS = ["not", "no", "never"]

# ---------------------------------------------------------------------------
# Defaults of our own (not from the study).
# ---------------------------------------------------------------------------

# Irregular English forms, by word class.
IRREGULAR_LEMMAS = {
    "NN": {"children": "child", "feet": "foot", "geese": "goose", "halves": "half", "knives": "knife", "leaves": "leaf", "lives": "life",
           "loaves": "loaf", "men": "man", "mice": "mouse", "oxen": "ox", "people": "person", "teeth": "tooth", "wives": "wife", "women": "woman"},
    "VB": {"ate": "eat", "became": "become", "been": "be", "began": "begin", "bought": "buy", "brought": "bring", "came": "come", "did": "do",
           "done": "do", "drank": "drink", "drunk": "drink", "eaten": "eat", "fell": "fall", "felt": "feel", "found": "find", "gave": "give",
           "given": "give", "gone": "go", "got": "get", "had": "have", "has": "have", "kept": "keep", "knew": "know", "left": "leave",
           "lost": "lose", "made": "make", "said": "say", "sat": "sit", "saw": "see", "seen": "see", "smelt": "smell", "sold": "sell",
           "taken": "take", "thought": "think", "took": "take", "was": "be", "went": "go", "were": "be"},
    "JJ": {"best": "good", "better": "good", "further": "far", "least": "little", "less": "little", "more": "much", "most": "much",
           "worse": "bad", "worst": "bad"},
}

# A small English emotion lexicon: default for the lexicon scorer.  Callers
# with a real model plug it in through ``scorer=`` instead.
EMOTION_LEXICON = {
    "anger": ["angry", "annoyed", "furious", "hate", "mad", "outraged", "rage"],
    "disgust": ["awful", "disgusting", "gross", "nasty", "rotten", "sour", "vile"],
    "fear": ["afraid", "anxious", "fear", "nervous", "scared", "terrible", "worried"],
    "joy": ["amazing", "delicious", "excellent", "great", "love", "lovely", "wonderful"],
    "neutral": ["average", "fine", "normal", "okay", "regular", "standard", "typical"],
    "sadness": ["bland", "disappointing", "dull", "flat", "sad", "thin", "watery"],
    "surprise": ["unexpected", "surprising", "surprised", "wow", "shocking", "sudden", "odd"],
}

# Category cue words for the lexicon variant of the attribute classifier.
CATEGORY_LEXICON = {
    "appearance": ["color", "colour", "head", "lacing", "clear", "cloudy", "hazy", "foam"],
    "aroma": ["aroma", "nose", "smell", "scent", "floral", "fragrant"],
    "palate": ["body", "carbonation", "mouthfeel", "creamy", "smooth", "thin", "watery"],
    "taste": ["taste", "flavor", "flavour", "bitter", "sweet", "sour", "malty", "hoppy"],
}


# ---------------------------------------------------------------------------
# Rule-built tables.
# ---------------------------------------------------------------------------

def _nfkd_ascii(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")


def accent_fold_tables() -> tuple[str, str, dict[str, str]]:
    """Accent folding derived from Unicode NFKD (the rule, not a typed table).

    Returns ``(from_chars, to_chars, multi)``: code points whose NFKD form keeps
    exactly one ASCII character (for ``translate``), and the rarer ones that
    keep several (ligatures, ellipsis, fractions) for a map lookup.  Every other
    non-ASCII code point keeps nothing and is dropped.
    """
    src, dst, multi = [], [], {}
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = _nfkd_ascii(ch)
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        elif len(folded) > 1 and cp <= 0xFFFF:
            multi[ch] = folded
    return "".join(src), "".join(dst), multi
