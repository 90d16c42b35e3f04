"""Word tokens as a full-text index sees them: letters and digits, case and diacritics folded, stemmed."""

from __future__ import annotations

import functools
import re
import unicodedata


def _fold_char(c: str) -> str:
    low = c.lower()
    if ord(c) < 128:
        return low
    parts = unicodedata.normalize("NFD", low)
    return parts[0] if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]) else low


@functools.lru_cache(maxsize=50_000)
def _folded_wide(word: str) -> str:
    return "".join(_fold_char(c) for c in word if not unicodedata.combining(c))


def _folded(word: str) -> str:
    return word.lower() if word.isascii() else _folded_wide(word)


_WORD = re.compile(r"(?:[^\W_]|[̀-ͯ])+")


def raw_tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of every run of letters, digits and their diacritics."""
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]


def count_words(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text))


def tokens(text: str) -> list[str]:
    return [stem(_folded(w)) for w in _WORD.findall(text)]


_VOWEL = "aeiou"


def _is_vowel(w: str, k: int) -> bool:
    return w[k] in _VOWEL or (w[k] == "y" and k > 0 and not _is_vowel(w, k - 1))


def _measure(w: str) -> int:
    shape = "".join("v" if _is_vowel(w, k) else "c" for k in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(_is_vowel(w, k) for k in range(len(w)))


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant that is not w, x or y."""
    n = len(w)
    return n >= 3 and not _is_vowel(w, n - 3) and _is_vowel(w, n - 2) and not _is_vowel(w, n - 1) and w[-1] not in "wxy"


# The suffix rules of Porter (1980), steps 2 to 4.
STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
    "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
# End of fixed values.
_STEP2 = sorted((tuple(r.split(":")) for r in STEP2.split()), key=lambda r: -len(r[0]))
_STEP3 = sorted((tuple(r.split(":")) for r in STEP3.split()), key=lambda r: -len(r[0]))
_STEP4 = sorted(STEP4.split(), key=lambda s: -len(s))


def _swap(w: str, rules, least: int) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + new if _measure(base) > least else w
    return w


@functools.lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """The Porter stem of a folded word; words of under three or over 64 bytes stay. The rules see bytes."""
    if not 3 <= len(w.encode()) <= 64:
        return w
    return _stem(w) if w.isascii() else _stem(w.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


def _stem(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and not _is_vowel(cut, len(cut) - 1) and cut[-1] not in "lsz":
            w = cut[:-1]
        elif _measure(cut) == 1 and _short_end(cut):
            w = cut + "e"
        else:
            w = cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 0)
    w = _swap(w, _STEP3, 0)
    for suffix in _STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
