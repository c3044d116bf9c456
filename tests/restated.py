"""Plain-Python statement of the text rules, used only to check the Spark expressions."""

import re
import unicodedata

from fidelscope.functions import script

_TABLE = str.maketrans(script.character_map())
_LINK = re.compile(r"(?:https?|www)\S+")
_TAG = re.compile(r"[@#]\w+")


def clean(text):
    if text is None:
        return ""
    folded = unicodedata.normalize("NFKC", text).translate(_TABLE)
    folded = _TAG.sub("", _LINK.sub("", folded))
    kept = [c if "ሀ" <= c <= "፿" or c in "0123456789" else " " for c in folded]
    return " ".join(w for w in "".join(kept).split() if w not in script.STOPWORDS)


def sentences(text):
    out, current = [], ""
    for here, following in zip(text or "", (text or "")[1:] + " ", strict=False):
        current += here
        if here in script.SENTENCE_END and following.isspace():
            out.append(current.strip())
            current = ""
    return [s for s in [*out, current.strip()] if s]


def feature_tokens(cleaned):
    return re.findall(r"\w{2,}", cleaned.lower())
