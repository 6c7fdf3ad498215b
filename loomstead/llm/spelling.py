"""Names in Hebrew and Latin letters: plain forms and one alphabet of sounds for both scripts."""

from __future__ import annotations

import re
import unicodedata

# Letters and letter groups with their sound. Longer groups come first; vowels keep four classes.
HEBREW_SOUNDS = [("טש", "C"), ("תש", "C"), ("דז", "z"), ("וו", "v"), ("יי", "i"), ("וי", "u"), ("א", "a"), ("ב", "b"), ("ג", "g"), ("ד", "d"), ("ה", ""), ("ו", "u"), ("ז", "z"), ("ח", "X"), ("ט", "t"), ("י", "i"), ("כ", "X"), ("ל", "l"), ("מ", "m"), ("נ", "n"), ("ס", "s"), ("ע", "e"), ("פ", "p"), ("צ", "T"), ("ק", "k"), ("ר", "r"), ("ש", "S"), ("ת", "t")]
LATIN_SOUNDS = [("tsch", "C"), ("tsh", "C"), ("tch", "C"), ("sch", "S"), ("cz", "C"), ("sz", "S"), ("sh", "S"), ("ts", "T"), ("tz", "T"), ("kh", "X"), ("ch", "X"), ("ck", "k"), ("ph", "p"), ("th", "t"), ("oo", "u"), ("ou", "u"), ("ie", "e"), ("ye", "e"), ("ei", "i"), ("ey", "i"), ("ai", "i"), ("ay", "i"), ("oy", "u"), ("oi", "u"), ("ii", "i"), ("a", "a"), ("b", "b"), ("c", "T"), ("d", "d"), ("e", "e"), ("f", "p"), ("g", "g"), ("h", ""), ("i", "i"), ("j", "i"), ("k", "k"), ("l", "l"), ("m", "m"), ("n", "n"), ("o", "a"), ("p", "p"), ("q", "k"), ("r", "r"), ("s", "s"), ("t", "t"), ("u", "u"), ("v", "v"), ("w", "v"), ("x", "ks"), ("y", "i"), ("z", "z")]
FINALS = str.maketrans("ךםןףץ", "כמנפצ")
MARKS = re.compile("[֑-ֽֿ-ׇ‎‏‪-‮⁦-⁩​﻿\xad]")
QUOTES = re.compile("[\"'׳״`´‘’“”„]")

_SOUND = {k: v for k, v in HEBREW_SOUNDS + LATIN_SOUNDS}
_GROUPS = re.compile("|".join(re.escape(k) for k, _ in HEBREW_SOUNDS + LATIN_SOUNDS) + "|.")
_DOUBLE = re.compile(r"(.)\1+")


def plain(text: str) -> str:
    """Lower case, no points or direction marks, final letters as others, blanks single."""
    text = MARKS.sub("", unicodedata.normalize("NFC", text)).lower().translate(FINALS)
    return " ".join(text.replace("־", "-").split())


def sound(word: str) -> str:
    """A word's sounds, the same for its Hebrew and its Latin spelling as far as these agree; doubled sounds are single."""
    return _DOUBLE.sub(r"\1", "".join(_SOUND.get(g, "") for g in _GROUPS.findall(word)))


def bones(sounds: str) -> str:
    """Sounds without vowels."""
    return _DOUBLE.sub(r"\1", re.sub("[aeiu]", "", sounds))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance where a swap of neighbours is one edit; ``most + 1`` if it is above ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], now[j - 1])
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)
