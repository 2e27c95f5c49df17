"""Labels for the sentence tagger's training places, from rules on their contexts.

Used for training and for held-out accuracy only; the operator itself reads the trained chain.
"""

from __future__ import annotations

import re

from ..sentences import _opens, _shape, script

# Abbreviations that a sentence does not end with (what they abbreviate follows), lower case without the last point.
LEADING = set(
    "dr prof mr mrs ms m mme mlle sr sra srta st fig figs sec vol no nr núm num pág págs pag p pp cf vs approx ca bzw e.g i.e z d u h b ex ej c.-à-d "
    "abb bsp tab kap art nº рис с т е стр см им г-н π.χ δηλ βλ डॉ د".split()
)
# Abbreviations that may end one, if a sentence begins behind them.
TRAILING = set("etc inc ltd co corp jr p.m a.m u.s u.k usw г д др al".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
# States, and bodies and things of theirs that are named behind them.
STATES = set("u.s u.k u.n e.u".split())
BODIES = set("army navy air congress senate government department president dollar dollars supreme court treasury constitution house parliament commission council embassy census bureau postal open".split())
UNCASED_ENDS = set("。！？｡।॥۔።؟։။៕។") | set("\u0f0d\u0f0e\u1362\u1367")  # the last ones Tibetan, Ethiopic


def label(context: tuple[str, str, str, str, str, str]) -> bool:
    before, marks, closers, gap, after, inside = context
    inside = inside.lstrip("l")  # the mark of a unit without capitals
    if inside:
        return False
    if not marks:
        return _bare(before, after)
    opens, shape, mark = _opens(after), _shape(before), marks[-1]
    low = before.lower().lstrip("([“«\"")
    begins = opens in ("U", "`", "(", "（", "“", "„", "«", "「", "\"", "¿", "¡", "id", "0", "[") or len(opens) > 2
    if opens and opens in ",;:—–-/%・、，":
        return False
    if mark in UNCASED_ENDS:
        return not (closers and opens in ("HIRAGANA", "HANGUL"))
    if mark in ";;":
        return bool(re.search(r"[Ͱ-Ͽἀ-῿]", before)) and (begins or not opens)
    if marks.startswith(("…", "...")) and len(opens) > 2 and not gap:
        return False
    if closers and not gap and len(opens) > 2:
        return False  # the sentence goes on behind the quotation
    if not begins:
        return False
    if mark == "." and marks == "." and not closers:
        if low in LEADING:
            return False
        if low in STATES and after.lower().strip(".,;:") in BODIES:
            return False
        if shape == "A" and script(before[-1]) == "U" and opens in ("U", "`"):
            return False  # an initial
        if shape == "0" and after.lower().strip(".,") in MONTHS:
            return False
        if not gap:
            return low not in TRAILING and len(before) > 1 and (opens == "U" and shape not in ("A", "AA") or opens in ("`", "“", "«", "„", "¿", "¡", "(") or len(opens) > 2 and shape != "0")
        return True
    if not gap and opens in ("0", "id"):
        return False
    return True


def _bare(before: str, after: str) -> bool:
    """White space beside Thai or Lao: a sentence ends where both sides are of the script."""
    return script(before[-1]) in ("THAI", "LAO") and script(after[0]) in ("THAI", "LAO")
