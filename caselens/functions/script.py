"""Consonants of words, the same for Latin and Urdu spellings."""

from __future__ import annotations

import re
from functools import lru_cache

# Consonants of Urdu letters in Latin; letters left out are vowels or silent.
_CONSONANTS = dict(zip("بپتٹثجچحخدڈذرڑزژسشصضطظغفقکگلمنں", "bpttsjchkddzrrzzssszttgfkkglmnn"))
_CONSONANTS |= {"ط": "t", "ظ": "z", "ض": "z", "ح": "", "چ": "c", "ش": "s"}


@lru_cache(maxsize=100_000)
def skeleton(word: str) -> str:
    """Consonants of a word in Latin, the same for Latin and Urdu spellings."""
    if re.search("[؀-ۿ]", word):
        s = "".join(_CONSONANTS.get(c, "") for c in word)
    else:
        s = word.replace("q", "k").replace("x", "ks").replace("z", "z")
        s = re.sub(r"[aeiouywvh]", "", s)
    return re.sub(r"(.)\1+", r"\1", s.replace("z", "s"))
