"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: A word with the space before it, or white space that no word takes: the tokenizer's own cut
#: into pieces never crosses these borders, so ids of the parts are ids of the whole.
PART = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space in Python that the tokenizer's patterns may see otherwise: such texts go whole.
ODD = re.compile("[\x1c-\x1f\x85]")
#: A text without other white space than single spaces and line breaks is cut by split().
OTHER = re.compile("[^\\S \\n]")
#: Characters whose classes no Unicode version of the last ten years has changed.
SETTLED = re.compile("[\x00-\u04ff]*")
CACHE_PARTS = 1_000_000
#: The pieces into which a byte-level tokenizer cuts a text before it merges bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def keys_of(text: str) -> list[str] | None:
    """Parts of a text: ``word`` after a space, ``\\nword`` after a line break, `` word`` after
    neither, and other white space behind a zero.  None for a text that must go whole."""
    if not text:
        return []
    other = OTHER.search(text)
    if other and ODD.search(text):
        return None
    # Line breaks before other white space are one piece, but the last of them before a word is not.
    if not other and "\n\n\n" not in text and "\n\n " not in text and not text[-2:].isspace():
        keys = text.replace("\n", " \n").split(" ")
        if "" not in keys:
            keys[0] = f" {keys[0]}"
            return keys
    parts = PART.findall(text)
    return [f"\0{p}" if p.isspace() else p[1:] if p[0] == " " else f" {p}" for p in parts]


def byte_table() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the
    others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_merger(path: str):
    """The tokenizer's vocabulary in a faster library, where that gives the same ids; else None.

    So it is for a plain byte-level vocabulary whose ids count the single bytes and then the merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, table = spec["model"].get("vocab"), byte_table()
    cut = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel":
        return None
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    in_order = all(vocabulary.get(m) == 256 + i for i, m in enumerate(merges))
    if cut.get("add_prefix_space") or not cut.get("use_regex") or not in_order:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(map(table.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
    if len(ranks) != 256 + len(merges) or sorted(ranks[bytes([b])] for b in range(256)) != list(range(256)):
        return None
    return tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids; a special token's name is plain text."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merger = byte_merger(path)
        self.newline = self.whole(["\n"])[0]
        # Parts used lately, and those used before them; what is used again stays.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def lines(self, words: list[str]) -> list[bytes]:
        """Ids of words without line breaks, encoded as the lines of one text."""
        joined = "\n".join(words)
        if self.merger and not SETTLED.fullmatch(joined):
            settled = [bool(SETTLED.fullmatch(w)) for w in words]
            if any(settled):
                found = [iter(self.lines([w for w, s in zip(words, settled, strict=True) if s == kind])) for kind in (False, True)]
                return [next(found[s]) for s in settled]
            ids = np.frombuffer(self.whole([joined])[0], "<u4")
        elif self.merger:
            ids = np.array(self.merger.encode_ordinary(joined), "<u4")
        else:
            ids = np.frombuffer(self.whole([joined])[0], "<u4")
        end = np.frombuffer(self.newline, "<u4")
        ends = np.append(np.flatnonzero(ids == end[0]), len(ids))
        if len(end) != 1 or len(ends) != len(words):
            return self.whole(words)
        starts = np.append(0, ends[:-1] + 1)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def learn(self, keys: set[str]) -> None:
        """Put the ids of all these parts into the cache."""
        if len(self.cache) + len(keys) > CACHE_PARTS // 2:
            self.older, self.cache = self.cache, {}
        again = keys & self.older.keys()
        self.cache.update((k, self.older[k]) for k in again)
        keys = keys - again
        blank = [k for k in keys if k[0] == "\0" or k == "\n"]
        self.cache.update(zip(blank, self.whole([k.removeprefix("\0") for k in blank]), strict=True))
        words = list(keys.difference(blank))
        for a in range(0, len(words), 2_000):
            some = words[a : a + 2_000]
            found = self.lines([k[1:] if k[0] in " \n" else f" {k}" for k in some])
            self.cache.update(
                (k, self.newline + ids if k[0] == "\n" else ids) for k, ids in zip(some, found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        keys = [keys_of(t) for t in texts]
        get = self.cache.get
        found = [None if k is None else list(map(get, k)) for k in keys]
        open_ = [i for i, f in enumerate(found) if f and None in f]
        if open_:
            self.learn({k for i in open_ for k, ids in zip(keys[i], found[i]) if ids is None})
            get = self.cache.get
            for i in open_:
                found[i] = [f or get(k) for k, f in zip(keys[i], found[i])]
        return [
            self.whole([text])[0] if f is None else b"".join(f) for text, f in zip(texts, found, strict=True)
        ]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """The worker process's own encoder: words met by earlier tasks of the worker are still known."""
    return Encoder(path)
