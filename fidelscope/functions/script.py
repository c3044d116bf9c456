"""Fixed values of the cleaning rules: script ranges, character map, stopwords, labels.

Everything here is data.  The values are part of the observable behaviour (another letter in
a range or another stopword changes results), so they are stated as they are.
"""

from __future__ import annotations

# --- Fixed values: letters that are written in several ways -----------------------------
# (first code point of the variant series, first code point of the standard series); each
# series has seven members, in the same vowel order.
LETTER_SERIES = [
    (0x1240, 0x1200),
    (0x1280, 0x1200),
    (0x1230, 0x1220),
    (0x12D0, 0x12A0),
    (0x1350, 0x12D8),
]
SERIES_LENGTH = 7

# --- Fixed values: Ethiopic punctuation U+1361..U+1368 ----------------------------------
PUNCTUATION_FIRST = 0x1361
PUNCTUATION_TARGETS = ",.;:?|! "

# --- Fixed values: zero of every digit row that becomes ASCII (Arabic-Indic, N'Ko, Tibetan)
DIGIT_ZEROS = [0x0660, 0x07C0, 0x0F20]

# --- Fixed values: stopwords, matched as whole tokens -----------------------------------
STOPWORDS = tuple(
    """
    እና ነው ላይ የ ለ በ ከ ወደ ይህ ያ እነዚህ እነዚያ እኔ አንተ
    እሱ እሷ እኛ እናንተ እነሱ ነበር ሆነ ብቻ አሁን በጣም አለ የለም
    እንዲሁም ስለ ለዚህ ምንም ያለ ምን እንዴት የት መቼ ለምን ማን የትኛው
    እንኳን ብዙ ሌላ አንድ ሁለት ሶስት አራት አምስት ስድስት ሰባት ስምንት ዘጠኝ አስር
    ሃያ ሰላሳ አርባ ሃምሳ ስልሳ ሰባ ሰማኒያ ዘጠና መቶ ሺህ ሚሊዮን ቢሊዮን
    ትናንት ዛሬ ነገ አንዴ ሁልጊዜ አንዳንድ የሆነ ሁሉም ውስጥ ውጪ
    በኋላ በፊት በላይ በታች እስከ እስከዚህ ቀን ሳምንት ወር ዓመት ጊዜ ደቂቃ ሰዓት
    እጅግ አጥብቆ ፈጽሞ በደንብ ብቻም ተመሳሳይ ልዩ አዲስ አሮጌ ትልቅ ትንሽ
    ጥሩ መጥፎ አፍ ዓይን እግር እጅ ሰው ሴት ወንድ ህፃን ልጅ እናቴ አባቴ ወንድሜ እህቴ
    ሀገር ከተማ ቤት መንገድ ዛፍ ውሃ ምግብ መጽሐፍ ጠረጴዛ ወንበር በር መስኮት ስም ቃል
    መቼም የትም እንዴትም መጥፎም ጥሩም እየ ማለት ም የሚ አም
    አሉት አለች ነበሩ ነበርን ነበራችሁ ነበረ
    """.split()
)

# --- Fixed values: label codes and the order of the report ------------------------------
LABEL_NAMES = {0: "normal", 1: "hate", 2: "offensive"}
UNKNOWN_LABEL = "unknown"
REPORT_LABELS = ("hate", "offensive", "normal")
SAMPLES_PER_LABEL = 3
SAMPLE_WIDTH = 200

# --- Fixed values: training and request defaults ----------------------------------------
MAX_FEATURES = 10_000
MIN_DF = 5
MAX_DF = 0.8
TEST_SHARE = 0.2
SEED = 42
MAX_ITER = 2000
DEFAULT_MESSAGE_LIMIT = 1000

# White space as the Unicode property plus the four ASCII separators U+001C..U+001F.
WHITE_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WHITE_SPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
WORD = r"\p{L}\p{N}_"

# --- Fixed values: patterns --------------------------------------------------------------
URL = rf"(?:http|www)[^{WHITE_SPACE}]+"
MENTION = rf"[@#][{WORD}]+"
SENTENCE_END = "።?!.,;:"
SYMBOLS = (
    r"\x{1F600}-\x{1F64F}"  # emoticons
    r"\x{1F300}-\x{1F5FF}"  # symbols and pictographs
    r"\x{1F680}-\x{1F6FF}"  # transport and maps
    r"\x{1F1E0}-\x{1F1FF}"  # flags
    r"\x{2702}-\x{27B0}"  # dingbats
    r"\x{24C2}-\x{1F251}"  # enclosed characters and all up to the squared ideographs
    r"\x{1F900}-\x{1F9FF}"  # supplemental symbols
    r"\x{1FA00}-\x{1FA6F}"  # chess and extended symbols
    r"\x{2B00}-\x{2BFF}"  # arrows
    r"\x{2000}-\x{206F}"  # general punctuation
    r"\x{FE00}-\x{FE0F}"  # variation selectors
    r"\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"  # ASCII punctuation and the space
)
# Characters that stay, per script profile (as the inside of a character class).
SCRIPT_PROFILES = {
    "ethiopic": r"\x{1200}-\x{137F}0-9",
    "latin": r"\p{IsLatin}0-9",
}


def character_map() -> dict[str, str]:
    """Every character that normalisation changes, with its replacement."""
    mapping = {
        chr(variant + i): chr(standard + i)
        for variant, standard in LETTER_SERIES
        for i in range(SERIES_LENGTH)
    }
    mapping |= {chr(PUNCTUATION_FIRST + i): c for i, c in enumerate(PUNCTUATION_TARGETS)}
    mapping |= {chr(zero + i): str(i) for zero in DIGIT_ZEROS for i in range(10)}
    return mapping
