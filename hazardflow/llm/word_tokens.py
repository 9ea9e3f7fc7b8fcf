"""Token ids of whole texts by the tokenizers library, with a cache of words inside a task.

The vocabularies used here split a text at white space, then into letter
runs, digits and signs; a word's ids depend on the word alone.  Each task
keeps the ids of words it has met, so the library sees a word once.  That
holds for the characters listed in ``_PLAIN``; a stretch of text with any
other character, or with the start of a special token, goes to the library as
it is, and so does every text of a tokenizer of another make.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Most words in a task's cache; further ones are encoded anew each time.
CACHE_WORDS = 600_000

# The split pattern of the vocabulary, and characters on which
# normalisation, lower-casing and the pattern's classes are the same everywhere.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWER = "a-zªµºß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňōŏőœŕŗřśŝšţťŧũūŭůűųŵŷźżž"
_UPPER = "A-ZÀ-ÖØ-Þ"
_NUMBER = "0-9²³¹¼-¾"
_SIGNS = r"!-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷"
_PLAIN = re.compile(f"[{_LOWER}{_UPPER}{_NUMBER}{_SIGNS} \n\t\r]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[{_NUMBER}]|[{_SIGNS}]+")


class WordTokens:
    """Encodes texts with the tokenizer file at ``path``, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = [p.get("pattern", {}).get("Regex") for p in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (split == [_PATTERN, None] and kinds == ["NFC", "Replace", "Lowercase"]
                        and not made.get("post_processor"))
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._spell = lambda w: bytes_of.pre_tokenize_str(w)[0][0]
        self._model = self.whole.model
        self._cache: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        import numpy as np

        spelt = word if word.isascii() else self._spell(word)
        ids = np.array([t.id for t in self._model.tokenize(spelt)], "<u4").tobytes()
        if len(self._cache) < CACHE_WORDS:
            self._cache[word] = ids
        return ids

    def _library(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        words, cache = _WORDS.findall(text.lower()), self._cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            return b"".join([cache.get(w) or self._word(w) for w in words])

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, as little-endian unsigned 32-bit integers; none for a null."""
        if not text:
            return b""
        if not self.by_word or "<|" in text:
            return self._library(text)
        if _PLAIN.fullmatch(text):
            return self._plain(text)
        # white space of this kind ends a word for every part of the tokenizer
        return b"".join(self._plain(p) if _PLAIN.fullmatch(p) else self._library(p)
                        for p in re.split("([ \n\t\r]+)", text) if p)


@lru_cache(maxsize=4)
def loaded(path: str) -> WordTokens:
    """One encoder per Python worker and file."""
    return WordTokens(path)
